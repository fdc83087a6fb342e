"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of rows from its weight; within it, a document's expected copies are
proportional to a size measure, the bit length of its character count, so long documents are favoured gently.
The whole part of the expected copies is certain. The remainders p sum to a whole number n, and Pareto order
sampling draws exactly n of them: documents are ranked by U / (1 - U) divided by p / (1 - p), U hashed
from seed and id, and the n smallest are taken.

No source is ranked by one task: the rank of the n-th smallest is found by counting 65536 monotone buckets of
the ranking value per source, and only the bucket that holds the cut is ordered.

Texts are read twice: for their sizes, and to give them out.

Defined cases: very long texts have the size of their whole length; a null source is a stratum of its own; null or empty text has size 0 and is never drawn; repeated
rows of one id share one U and so fall on the same side of the cut, as do any ties (rank semantics: a sample can
then exceed n by the rows tied with the last one); null ids share one U; a source whose documents all have size 0
gives nothing; a source named in `weights` but absent takes no part in the total; a weight of 0 drops its source;
an empty table gives an empty result; other columns pass through and clashing names are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.llm.common import fresh, if_small, settled

SEED = "mix-1"
#: Rows drawn in all, as a share of the rows read.
TOTAL_SHARE = 1.0
BUCKETS = 65536


def _size(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.bin(n.cast("bigint")))).otherwise(0).cast("bigint")


def _order(u: Column, p: Column) -> Column:
    return (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))


def draw(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total_share: float = TOTAL_SHARE,
    seed: str = SEED,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    copies: str = "copies",
) -> DataFrame:
    """Rows of docs that are drawn, with a column saying how many copies.

    weights: by source; others get 0. None: the square root of each source's number of documents, which lifts
    small sources and holds back hot ones. Besides the per-source tables nothing is shuffled: documents are
    judged where they lie.
    """
    src, x, e, n, q, b, u = fresh(docs, "m_source", "m_size", "m_expected", "m_n", "m_order", "m_bucket", "m_u")
    cut_b, before, cut_q, rate, peer = fresh(docs, "m_cut_b", "m_before", "m_cut_q", "m_rate", "m_join")
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "#"), F.coalesce(F.col(key).cast("string"), F.lit("")) ).cast("binary")), 1, 13), 16, 10)
    drawn = (digits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))

    sized = docs.select("*", F.col(source).alias(src), _size(F.col(text)).alias(x), drawn.alias(u))
    # all counts are taken from these three small columns; the texts are read once more at the end
    small = settled(sized.select(src, x, u))
    stats = settled(small.groupBy(src).agg(F.count("*").alias("n_docs"), F.sum(x).alias("sum_x"))).where("sum_x > 0")
    if weights is None:
        w = F.sqrt(F.col("n_docs").cast("double"))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col(src) == F.lit(name), F.lit(float(value))).otherwise(w)
    stats = stats.withColumn("w", w)
    whole = stats.agg(F.sum("n_docs").cast("double").alias("all_docs"), F.sum("w").alias("all_w"))
    goal = F.floor(F.col("all_docs") * F.lit(float(total_share)) * F.col("w") / F.col("all_w") + 0.5).cast("bigint")
    plan = settled(stats.crossJoin(F.broadcast(whole)).select(F.col(src), (goal.cast("double") / F.col("sum_x").cast("double")).alias(rate), goal.alias(n)).where(F.col(n) > 0))

    def judged(rows: DataFrame, plan: DataFrame) -> DataFrame:
        """Documents with expected copies e, the value q that orders their remainder, and its bucket."""
        named = if_small(plan.withColumnRenamed(src, peer))
        at = rows.join(named, rows[src].eqNullSafe(named[peer])).drop(peer).where(F.col(x) > 0)
        at = at.withColumn(e, F.col(rate) * F.col(x).cast("double"))
        p = F.col(e) - F.floor(e).cast("double")
        at = at.withColumn(q, F.when(p > 0, _order(F.col(u), p)))
        return at.withColumn(b, F.floor(F.col(q) / (F.lit(1.0) + F.col(q)) * F.lit(float(BUCKETS))).cast("int"))

    narrow = judged(small, plan).select(src, n, e, q, b)
    counts = settled(narrow.groupBy(src, n, b).agg(F.count("*").alias("c"), F.sum(F.floor(e)).alias("sure")))
    left = counts.withColumn("rest", F.col(n) - F.sum("sure").over(Window.partitionBy(src))).where(F.col(b).isNotNull() & (F.col("rest") > 0))
    upto = F.sum("c").over(Window.partitionBy(src).orderBy(b))
    # the bucket of the rest-th value; where all remainders are drawn, the last bucket
    left = left.withColumn("upto", upto).withColumn("most", F.max(b).over(Window.partitionBy(src)))
    at_cut = left.where((F.col("upto") - F.col("c") < F.col("rest")) & ((F.col("upto") >= F.col("rest")) | (F.col(b) == F.col("most"))))
    cuts = settled(at_cut.select(F.col(src).alias("c_source"), F.col(b).alias(cut_b), (F.col("rest") - F.col("upto") + F.col("c")).alias(before)))

    close = narrow.join(if_small(cuts), F.col(src).eqNullSafe(F.col("c_source")) & (F.col(b) == F.col(cut_b)))
    ranked = close.withColumn("place", F.row_number().over(Window.partitionBy(src).orderBy(q)))
    last = ranked.where(F.col("place") <= F.col(before)).groupBy("c_source").agg(F.max(q).alias(cut_q))
    with_cut = plan.join(last, F.col(src).eqNullSafe(F.col("c_source")), "left").drop("c_source")
    final = judged(sized, settled(with_cut))
    taken = F.floor(e).cast("int") + F.when(F.col(q) <= F.col(cut_q), 1).otherwise(0)
    return final.select(*[F.col(c) for c in docs.columns], taken.alias(copies)).where(F.col(copies) > 0)


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The columns of docs, each drawn document as many times as drawn."""
    (c,) = fresh(docs, "m_copies")
    got = draw(docs, copies=c, **options)
    return got.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(c))).alias(c)).drop(c)


def oracle(total_share: float = TOTAL_SHARE, seed: str = SEED) -> str:
    return f"""
    WITH s AS (SELECT doc_id, source, CASE WHEN length(text) > 0 THEN length(bin(length(text))) ELSE 0 END AS x FROM documents),
    st AS (SELECT source, count(*) AS n_docs, CAST(sum(x) AS BIGINT) AS sum_x, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM s GROUP BY source HAVING sum(x) > 0),
    a AS (SELECT CAST(sum(n_docs) AS DOUBLE) AS all_docs, sum(w) AS all_w FROM st),
    p AS (SELECT source, CAST(floor(all_docs * CAST({total_share} AS DOUBLE) * w / all_w + 0.5) AS BIGINT) AS n, sum_x FROM st, a),
    e AS (SELECT doc_id, s.source, n, (CAST(n AS DOUBLE) / CAST(sum_x AS DOUBLE)) * CAST(x AS DOUBLE) AS e,
          (CAST(('0x' || substr(md5('{seed}#' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS UBIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
          FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source WHERE x > 0 AND n > 0),
    r AS (SELECT *, n - sum(floor(e)) OVER (PARTITION BY source) AS rest, e - floor(e) AS f FROM e),
    q AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS q FROM r),
    k AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY q NULLS LAST) AS place FROM q)
    SELECT doc_id, source, CAST(floor(e) + CASE WHEN q IS NOT NULL AND place <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
    FROM k WHERE floor(e) + CASE WHEN q IS NOT NULL AND place <= rest THEN 1 ELSE 0 END > 0"""
