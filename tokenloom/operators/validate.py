"""Vocabulary guardrails: tokens that would break typed symbols apart, and budget lost to random blobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITS = {"max_long_hex_fraction": 0.005, "max_long_hex_count": 32, "max_b64_fraction": 0.002, "max_b64_count": 16}
ISSUE = "code string, message string"


def broken_symbols(vocab: DataFrame, typed: Sequence[str]) -> DataFrame:
    """Issues (code, message), one for each typed symbol of which a bracketed piece is a token; the least such token is named."""
    symbols = vocab.sparkSession.createDataFrame([(s,) for s in typed], "symbol string")
    risky = vocab.where((F.length("token") >= 2) & (F.col("token").contains("<") | F.col("token").contains(">")))
    inside = risky.join(F.broadcast(symbols), (F.col("token") != F.col("symbol")) & F.contains(F.col("symbol"), F.col("token")))
    return inside.groupBy("symbol").agg(F.min("token").alias("token")).select(
        F.lit("typed_symbol_substring").alias("code"),
        F.format_string("token '%s' is a piece of the typed symbol '%s'", "token", "symbol").alias("message"),
    )


def entropy_counts(vocab: DataFrame, typed: Sequence[str]) -> DataFrame:
    """One row (tokens, long_hex, b64) over the non-empty tokens; typed, <...> and [...] tokens count in the first only."""
    t = F.col("token")
    exempt = t.isin(*typed) | (t.startswith("<") & t.endswith(">")) | (t.startswith("[") & t.endswith("]"))
    return vocab.where(t != "").agg(
        F.count("*").alias("tokens"),
        F.count_if(~exempt & t.rlike(r"^[0-9A-Fa-f]{16,}\z")).alias("long_hex"),
        F.count_if(~exempt & t.rlike(r"^[A-Za-z0-9+/]{24,}={0,2}\z")).alias("b64"),
    )


def entropy_issues(vocab: DataFrame, typed: Sequence[str], **limits: float) -> DataFrame:
    """Issues (code, message) of too many blob-like tokens, by count or by share."""
    most = {**LIMITS, **limits}
    if unknown := set(most) - set(LIMITS):
        raise TypeError(f"no such limits: {sorted(unknown)}")
    c = entropy_counts(vocab, typed)
    n = F.greatest(F.lit(1), F.col("tokens"))
    checks = []
    for column, short in (("long_hex", "hex"), ("b64", "b64")):
        over = (F.col(column) > most[f"max_{'long_hex' if short == 'hex' else short}_count"]) | (F.col(column) / n > most[f"max_{'long_hex' if short == 'hex' else short}_fraction"])
        checks.append((over, f"entropy_{short}_overflow", column, "of them look like random blobs"))
    if {"<HEX>", "<HASH>"} & set(typed):
        checks.append((F.col("long_hex") > 5, "typed_hygiene_leak_hex", "long_hex", "raw hex tokens remain beside the typed symbol"))
    if "<B64>" in typed:
        checks.append((F.col("b64") > 3, "typed_hygiene_leak_b64", "b64", "raw base-64 tokens remain beside the typed symbol"))
    found = F.array(*(F.struct(F.when(over, code).alias("code"), F.format_string(f"%s of %s tokens: {said}", column, "tokens").alias("message")) for over, code, column, said in checks))
    return c.select(F.explode(found).alias("i")).select("i.code", "i.message").where("code IS NOT NULL")


def issues(vocab: DataFrame, typed: Sequence[str], **limits: float) -> DataFrame:
    return broken_symbols(vocab, typed).unionByName(entropy_issues(vocab, typed, **limits))
