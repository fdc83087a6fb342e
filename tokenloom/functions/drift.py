"""Harmless changes of format, for measuring how stable a vocabulary's output is."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import BLANK, strip


def blanks_folded(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{BLANK}]+", " "))


def delimiters_spaced(c: Column) -> Column:
    return blanks_folded(F.regexp_replace(c, r"([(){}<>,:;=\[\]])", " $1 "))


@F.pandas_udf(T.StringType())
def keys_sorted(texts: pd.Series) -> pd.Series:
    """JSON texts with their keys sorted, compact and in ASCII; other texts as they are.

    A vectorised Python function, as the JVM's JSON writer spells numbers differently.
    """

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
        except (ValueError, TypeError, RecursionError):
            return text

    return texts.map(one, na_action="ignore")


def attributes_shuffled(c: Column, seed: int = 42) -> Column:
    """HTML tags with their blank-separated attributes in a random order, drawn from the tag's own text and the seed."""
    tag = rf"<[A-Za-z0-9:_\-]+[{BLANK}]+[^>]+>"
    pieces = F.regexp_extract_all(c, F.lit(rf"{tag}|(?:(?!{tag})[\s\S])+"), F.lit(0))

    def mixed(piece: Column) -> Column:
        name = F.regexp_extract(piece, rf"^<([A-Za-z0-9:_\-]+)[{BLANK}]", 1)
        inner = F.regexp_extract(piece, rf"^<[A-Za-z0-9:_\-]+[{BLANK}]+([^>]+)>\z", 1)
        parts = F.filter(F.split(inner, rf"[{BLANK}]+"), lambda p: p != "")
        keyed = F.transform(parts, lambda p, i: F.struct(F.xxhash64(F.lit(seed), piece, i).alias("k"), p.alias("p")))
        order = F.transform(F.array_sort(keyed), lambda s: s["p"])
        return F.when((name != "") & (F.size(parts) > 1), F.concat(F.lit("<"), name, F.lit(" "), F.array_join(order, " "), F.lit(">"))).otherwise(piece)

    return F.when(c.contains("<"), F.array_join(F.transform(pieces, mixed), "")).otherwise(c)


def drifts(dataset: str | None = None) -> dict:
    """The changes that suit a dataset, by name."""
    found = {"ws": blanks_folded, "delim_spaces": delimiters_spaced}
    if dataset == "waf":
        found["json_sort_keys"] = keys_sorted
    if dataset == "phish_html":
        found["html_attr_shuffle"] = attributes_shuffled
    return found
