r"""Line dedup by distinct-site spread.

A line is a piece of the text between line feeds, trimmed of blanks and lower-cased for comparison; blank lines
are never removed. Each line's sites are gathered in a HyperLogLog sketch per line hash, which partial aggregation
merges before and after the shuffle. The estimate decides far from the threshold; a line whose estimate lies within
`band` of it gets an exact count of distinct sites. A line on at least `min_sites` sites is boilerplate.

A document loses its boilerplate lines in every copy, whatever share of it they are; one that has no other line is left
with empty text. With `spare_mirrors` a proven mirror stays whole, for near-dedup to judge: a text that stands unchanged
on at least `min_sites` sites, so that the copies alone make boilerplate of all its lines.

Texts are read twice: once for the hashes of their lines, which are stored and serve all counts, and once to be stripped.

Defined cases: null text stays null; empty text stays empty; a null site counts for nothing; a line on just
min_sites sites goes; very long texts and lines are read whole; a line repeated within a document or a repeated row counts its site once, and all its occurrences go; a null id is
allowed (rows are told apart by their text); an empty table gives an empty result; other columns,
whatever their names, pass through unchanged. n_chars, if present, is set to the new length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import fresh, if_small, settled

MIN_SITES = 8
LG_K = 10
#: Three times the relative standard error 1.04 / sqrt(2 ** LG_K), rounded up.
BAND = 0.1

BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def line_hash(line: Column) -> Column:
    """64 bits; at 10^9 distinct lines two collide with odds of 3 %, at worst hiding one line."""
    return F.xxhash64(line_key(line))


def hashed_lines(docs: DataFrame, site: str = "source", text: str = "text") -> DataFrame:
    """Rows (site, k, lines), one for each text: hash of the text, and hashes of its lines that are not blank, each once."""
    solid = F.filter(F.split(F.col(text), "\n"), lambda x: line_key(x) != "")
    lines = F.array_distinct(F.transform(solid, line_hash))
    return docs.where(F.col(text).isNotNull()).select(F.col(site).cast("string").alias("site"), F.xxhash64(text).alias("k"), lines.alias("lines"))


def spread_lines(hashed: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """Hashes (line) of the lines on at least min_sites sites, of rows from hashed_lines()."""
    pairs = hashed.where("site IS NOT NULL").select("site", F.explode("lines").alias("line"))
    spread = pairs.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    spread = settled(spread.where(F.col("sites") >= low))
    sure = spread.where(F.col("sites") > high).select("line")
    near = spread.where(F.col("sites") <= high).select("line")
    exact = pairs.join(if_small(near, 16), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("line"))


def mirrored_texts(hashed: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (k) of the texts that stand whole on at least min_sites sites."""
    at = hashed.where("site IS NOT NULL").groupBy("k").agg(F.count_distinct("site").alias("sites"))
    return at.where(F.col("sites") >= min_sites).select("k")


def strip_lines(
    docs: DataFrame,
    site: str = "source",
    text: str = "text",
    min_sites: int = MIN_SITES,
    spare_mirrors: bool = False,
    band: float = BAND,
    lg_k: int = LG_K,
    removed: str | None = None,
) -> DataFrame:
    """docs without their boilerplate lines; `removed`, if given, names a column for how many went.

    Decisions travel as hashes: only (line hash, site) pairs, (text hash, line hash) pairs and then the documents
    themselves are shuffled. Equal texts share one key, so a hot text costs one row of decisions.
    """
    hashed = settled(hashed_lines(docs, site, text))
    bad = settled(spread_lines(hashed, min_sites, band, lg_k))
    k, hits = fresh(docs, "k_text", "k_hits")
    found = hashed.select("k", F.explode("lines").alias("line")).join(if_small(bad, 16), "line", "left_semi")
    found = found.groupBy("k").agg(F.collect_set("line").alias(hits))
    if spare_mirrors:
        found = found.join(mirrored_texts(hashed, min_sites), "k", "left_anti")
    joined = docs.withColumn(k, F.xxhash64(text)).join(found.withColumnRenamed("k", k), k, "left")

    lines = F.split(F.col(text), "\n")
    is_bad = lambda x: F.array_contains(F.col(hits), line_hash(x))
    gone, out_lines = fresh(joined, "k_gone", "k_lines")
    joined = joined.withColumn(out_lines, F.when(F.col(hits).isNotNull(), lines)).withColumn(gone, F.filter(F.col(out_lines), is_bad))
    flag, shorter = fresh(joined, "k_flag", "k_short")
    joined = joined.withColumn(flag, F.col(hits).isNotNull())
    joined = joined.withColumn(shorter, F.when(F.col(flag), F.array_join(F.filter(F.col(out_lines), lambda x: ~is_bad(x)), "\n")))
    out = []
    for c in docs.columns:
        if c.lower() == text.lower():
            out.append(F.coalesce(F.col(shorter), F.col(c)).alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col(flag), F.length(shorter)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    if removed:
        out.append(F.when(F.col(flag), F.size(gone)).otherwise(0).alias(removed))
    return joined.select(*out)


def oracle(min_sites: int = MIN_SITES, spare_mirrors: bool = False) -> str:
    key = r"lower(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))"
    mirror = f"(SELECT text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY text HAVING count(DISTINCT source) >= {min_sites})"
    spared = f" AND k.text NOT IN {mirror}" if spare_mirrors else ""
    return f"""
    WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, {key} AS key FROM l),
    bad AS (SELECT key FROM k WHERE key <> '' AND source IS NOT NULL GROUP BY key HAVING count(DISTINCT source) >= {min_sites}),
    f AS (SELECT k.*, bad.key IS NOT NULL{spared} AS is_bad FROM k LEFT JOIN bad ON k.key = bad.key),
    d AS (SELECT doc_id, count(*) FILTER (is_bad) AS n_bad, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_bad) AS rest FROM f GROUP BY doc_id)
    SELECT documents.doc_id, CASE WHEN n_bad > 0 THEN coalesce(rest, '') ELSE text END AS text, coalesce(n_bad, 0)::INTEGER AS removed_lines
    FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id"""
