"""Stability and quality metrics as aggregations, and the coercion of labels."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.functions.text import strip

LABEL_NAMES = ("label", "labels", "target", "y", "class", "attack", "is_attack", "anomaly", "is_anomaly")
#: Ids below it are characters after the shift by 256, before the surrogates.
FEWEST_IDS = 0xD800 - 256
_NO, _YES = ("0", "false", "benign", "normal", "ham"), ("1", "true", "malicious", "attack", "anomaly", "phish", "spam")


def label_column(df: DataFrame) -> str:
    """The column that holds labels, by its usual names in any case."""
    by_name = {c.lower(): c for c in df.columns}
    for name in LABEL_NAMES:
        if name in by_name:
            return by_name[name]
    raise KeyError(f"none of {sorted(df.columns)} is named like a label")


def label_value(c: Column) -> Column:
    """0 or 1 for the usual words, the whole part of a number, 0 for null, 1 for any other word."""
    s = F.lower(strip(c.cast("string")))
    return F.when(c.isNull(), 0).when(s.isin(*_NO), 0).when(s.isin(*_YES), 1).otherwise(F.coalesce(s.try_cast("double").try_cast("int"), F.lit(1)))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two id arrays: ids are mapped to characters and compared in the JVM.

    Ids that are no characters by themselves are numbered by their place among the pair's distinct ids. A pair with more
    than FEWEST_IDS distinct ids, some of them that large, is an error. A null array gives null.
    """

    def chars(ids: Column) -> Column:
        hexed = F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i.cast("bigint") + 256), 4, "0")), "")
        return F.decode(F.unhex(hexed), "UTF-16BE")

    distinct = F.array_distinct(F.concat(a, b))
    numbered = lambda ids: F.transform(ids, lambda i: F.array_position(distinct, i))
    plain = F.coalesce(F.array_min(distinct) >= 0, F.lit(True)) & (F.coalesce(F.array_max(distinct), F.lit(0)) < FEWEST_IDS)
    apart = F.when(F.size(distinct) < FEWEST_IDS, F.levenshtein(chars(numbered(a)), chars(numbered(b)))).otherwise(
        F.raise_error(F.lit("too many distinct ids in one pair")).cast("int")
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(plain, F.levenshtein(chars(a), chars(b))).otherwise(apart)


def drift_report(df: DataFrame, base: str, changed: dict[str, str]) -> DataFrame:
    """One row per drift: n, mean lengths, mean absolute change of length, mean edit distance.

    base and the values of changed name id-array columns of df; all sit in one row, so nothing is joined.
    """
    per_row = F.array(
        *(
            F.struct(F.lit(name).alias("drift"), F.size(base).alias("a"), F.size(c).alias("b"), edit_distance(F.col(base), F.col(c)).alias("d"))
            for name, c in changed.items()
        )
    )
    flat = df.select(F.explode(per_row).alias("r")).select("r.*")
    return flat.groupBy("drift").agg(
        F.count("*").alias("n"),
        F.avg("a").alias("avg_len"),
        F.avg("b").alias("avg_len_pert"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("avg_abs_len_jitter"),
        F.avg("d").alias("avg_edit_distance"),
    )


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row of counts and the ratios made of them; a ratio over nothing is 0."""
    counts = df.agg(
        *(F.count_if((truth == t) & (guess == g)).alias(name) for name, t, g in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    with_rates = counts.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return with_rates.withColumn("f1", ratio(2 * p * r, p + r))


def within_budget(df: DataFrame, length: str, budget: int, order: str, range_rows: int = 200_000) -> DataFrame:
    """The first rows by `order` whose running sum of `length` stays within the budget.

    The order is cut into ranges of some `range_rows` rows. Their sums come first, ranges that begin beyond the budget are
    dropped, and the running sums of the others run in parallel.
    """
    parts = min(10_000, -(-df.count() // range_rows)) if range_rows else 1
    edges = df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    at = F.lit(sorted(set(edges))).cast("array<double>")
    part = F.size(F.filter(at, lambda e: e < F.col(order))) if edges else F.lit(0)
    ranged = df.withColumn("_part", part)
    sums = ranged.groupBy("_part").agg(F.sum(length).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")).where(F.col("_before") <= budget)
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most 10 000 rows
    out = ranged.join(F.broadcast(starts), "_part").withColumn("running", F.col("_before") + F.sum(length).over(inside))
    return out.where(F.col("running") <= budget).drop("_part", "_before")


def probe_loss(df: DataFrame, ids: str, label: str, size: int = 8192) -> float:
    """Log loss of a linear probe on token shares, the stand-in for a mean-pooled embedding probe."""
    tokens = df.select(F.transform(ids, lambda i: i.cast("string")).alias("t"), F.col(label).cast("double").alias("label"))
    counted = CountVectorizer(inputCol="t", outputCol="features", vocabSize=size).fit(tokens).transform(tokens)
    model = LogisticRegression(maxIter=20).fit(counted)
    scored = model.transform(counted).select("label", vector_to_array("probability")[1].alias("p"))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = scored.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("x")).first().x
    return 1e9 if loss is None or loss != loss else float(loss)

