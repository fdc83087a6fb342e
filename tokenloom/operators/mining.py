"""Span mining: candidate tokens and their corpus frequencies.

Texts are cut at boundary characters into segments; equal segments are counted first, so that spans are
enumerated once per distinct segment and weighted by its count. Both aggregations combine on the map side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
TAG = "<[A-Z][A-Z0-9_]{1,31}>"
MOST_TAGS = 64

_PLAIN = " \t\n" + ",:;" + "=&?" + "/#%" + "()[]{}<>" + "\"'|"
BOUNDARIES = {"default": _PLAIN, "base": _PLAIN}
BOUNDARIES["http"] = BOUNDARIES["waf"] = _PLAIN + "._-" + "\\+*!$"


def boundaries(preset: str) -> str:
    try:
        return BOUNDARIES[preset.strip().lower()]
    except KeyError:
        raise ValueError(f"no boundary preset {preset!r}; there are {', '.join(BOUNDARIES)}") from None


def _class(chars: str) -> str:
    return "".join("\\" + ch if re.match(r"[^\w\s]", ch) else ch for ch in chars)


def segments(text: Column, bounds: str) -> Column:
    """Array of the maximal runs without boundary characters, interiors of <TAGS> left out."""
    inner = "[A-Z][A-Z0-9]{1,31}" if "_" in bounds else "[A-Z][A-Z0-9_]{1,31}"
    blanked = F.regexp_replace(text, f"(?<=<){inner}(?=>)", "") if {"<", ">"} <= set(bounds) else text
    return F.regexp_extract_all(blanked, F.lit(f"[^{_class(bounds)}]+"), F.lit(0))


def symbol_runs(text: Column, bounds: str) -> Column:
    """Array of the maximal runs of boundary characters that are neither blank nor < or >."""
    symbols = "".join(ch for ch in bounds if not ch.isspace() and ch not in "<>")
    return F.regexp_extract_all(text, F.lit(f"[{_class(symbols)}]+"), F.lit(0)) if symbols else F.array().cast("array<string>")


def counted(df: DataFrame, pieces: Column) -> DataFrame:
    """Rows (piece, n) over all texts."""
    return df.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def spans(pieces: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Rows (token, n): every substring of the pieces with a length in the range, once per place where it starts."""
    size = F.length("piece")
    at = pieces.where(size >= shortest).select("piece", "n", F.explode(F.sequence(F.lit(1), size - shortest + 1)).alias("start"))
    most = F.least(F.lit(longest), size - F.col("start") + 1)
    cut = at.select("piece", "n", "start", F.explode(F.sequence(F.lit(shortest), most)).alias("len"))
    return cut.select(F.substring("piece", F.col("start"), F.col("len")).alias("token"), "n")


def candidates(df: DataFrame, text: str = "text", bounds: str = _PLAIN, shortest: int = 2, longest: int = 24, sym_shortest: int = 2, sym_longest: int = 0, min_freq: int = 10) -> DataFrame:
    """Rows (token, freq) of all spans and symbol n-grams that occur at least min_freq times."""
    found = spans(counted(df, segments(F.col(text), bounds)), shortest, longest)
    if sym_longest >= max(1, sym_shortest):
        found = found.unionByName(spans(counted(df, symbol_runs(F.col(text), bounds)), sym_shortest, sym_longest))
    freq = found.groupBy("token").agg(F.sum("n").alias("freq"))
    return freq.where((F.col("freq") >= min_freq) & ~F.col("token").isin(*SPECIALS))


def tags(df: DataFrame, text: str = "text", min_freq: int = 1, most: int = MOST_TAGS) -> DataFrame:
    """The most frequent <TAGS>, at most `most` of them (the cap is the feature), ties by name."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(0))).alias("tag")).groupBy("tag").agg(F.count("*").alias("freq"))
    return found.where(F.col("freq") >= min_freq).orderBy(F.desc("freq"), "tag").limit(most)


def characters(df: DataFrame, text: str = "text", also: str = "") -> DataFrame:
    """Distinct characters of all texts and of `also`, sorted."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a set takes in a text at once; as rows in the JVM every character of it would be a string of its own
        chars: set[str] = set()
        for batch in batches:
            for given in batch.column(0):
                chars.update(given.as_py() or "")
        yield pa.RecordBatch.from_arrays([pa.array(sorted(chars), pa.string())], names=["ch"])

    found = df.select(F.col(text).cast("string").alias("text")).mapInArrow(seen, "ch string")
    if also:
        extra = F.explode(F.array(*(F.lit(c) for c in sorted(set(also)))))
        found = found.unionByName(df.sparkSession.range(1).select(extra.alias("ch")))
    return found.distinct().orderBy("ch")


ASCII = "".join(map(chr, range(32, 127))) + "\t\n\r"
