"""Noise classification: records that are mostly hashes, hex or base-64 blobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.text import BLANK, strip

LEAST_CHARS, LEAST_SHARE = 32, 0.85


def is_hash(c: Column) -> Column:
    return c.rlike(r"^[0-9A-Fa-f]{32,64}\z")


def is_hex(c: Column) -> Column:
    return c.rlike(r"^[0-9A-Fa-f]{16,}\z")


def is_base64(c: Column) -> Column:
    """24 characters or more, padding included; with - and _ too, but not capitals alone."""
    shape = c.rlike(r"^(?=[\s\S]{24})[0-9A-Za-z+/_\-]+={0,2}\z")
    return shape & c.rlike("[a-z0-9+/=]") & ~c.rlike(r"^[+/=_\-]*[A-Z](?:[A-Z+/=_\-])*\z")


def _kind(c: Column) -> Column:
    return F.when(is_hash(c), "<HASH>").when(is_hex(c), "<HEX>").when(is_base64(c), "<B64>")


def classify(c: Column) -> Column:
    """<HASH>, <HEX> or <B64> if the whole text is one, or at least 85 % of the characters of its pieces are; else null.

    Among mixed pieces the kind with most characters names the record, ties in the order given.
    """
    return _stripped_kind(strip(c))


#: A whole piece that any kind can be of; pieces of other shapes count by their length only.
_BLOB = rf"(?=[0-9A-Za-z+/_\-]{{16}})(?<![^{BLANK}])[0-9A-Za-z+/_\-]{{16,}}+={{0,2}}+(?![^{BLANK}])"


def _stripped_kind(s: Column) -> Column:
    zero = F.struct(F.length(F.regexp_replace(s, f"[{BLANK}]+", "")).alias("all"), *(F.lit(0).alias(n) for n in ("hash", "hex", "b64")))

    def add(acc: Column, piece: Column) -> Column:
        n, kind = F.length(piece), _kind(piece)
        part = lambda name, symbol: (acc[name] + F.when(kind == symbol, n).otherwise(0)).alias(name)
        return F.struct(acc["all"].alias("all"), part("hash", "<HASH>"), part("hex", "<HEX>"), part("b64", "<B64>"))

    def name(acc: Column) -> Column:
        noise = acc["hash"] + acc["hex"] + acc["b64"]
        enough = (acc["all"] >= LEAST_CHARS) & (noise > 0) & (noise / acc["all"] >= LEAST_SHARE)
        largest = F.greatest(acc["hash"], acc["hex"], acc["b64"])
        return F.when(enough, F.when(acc["hash"] == largest, "<HASH>").when(acc["hex"] == largest, "<HEX>").otherwise("<B64>"))

    mixed = F.when(s.rlike(_BLOB), F.aggregate(F.regexp_extract_all(s, F.lit(_BLOB), F.lit(0)), zero, add, name))
    return F.when(s != "", F.coalesce(_kind(s), mixed))


def cleaned(c: Column) -> Column:
    """The record, or its noise symbol in place of all of it."""
    return F.coalesce(classify(c), c)


def unprintable(c: Column) -> Column:
    """Holds a control character other than tab and line breaks, or anything from code point 127 up."""
    return c.rlike(r"[^\t\n\r -~]")
