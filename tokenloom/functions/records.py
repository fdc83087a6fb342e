"""Role-marked record serialization and the row formatters of the known datasets."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.httpstruct import Marks
from tokenloom.functions.text import first_filled, float_repr, strip


def value_text(c: Column, kind: T.DataType) -> Column:
    """A value as it stands in a serialized record: null, true/false, shortest numbers, text as is, compact JSON for the rest."""
    if isinstance(kind, T.StringType):
        shown = c
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = float_repr(c.cast("double"))
    elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        shown = F.to_json(c, {"ignoreNullFields": "false"})
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("null"))


def serialized(df: DataFrame, columns: Sequence[str] | None = None, order: Sequence[str] | None = None, emit_missing: bool = True, marks: Marks = Marks()) -> Column:
    """One text per row: key, separator, value and end mark for each field, keys sorted or in the given order.

    A key of `order` that is no column gets the empty mark, or is left out without emit_missing.
    """
    have = list(columns if columns is not None else df.columns)
    parts = []
    for key in sorted(have) if order is None else order:
        if key in have:
            value = value_text(F.col(key), df.schema[key].dataType)
            value = F.when(value == "", marks.empty).otherwise(value)
        elif emit_missing:
            value = F.lit(marks.empty)
        else:
            continue
        parts.append(F.concat(F.lit(f"{marks.key_prefix}{key}{marks.key_suffix} {marks.sep} "), value, F.lit(f" {marks.eol}")))
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def serialized_map(c: Column, order: Sequence[str] | None = None, emit_missing: bool = True, marks: Marks = Marks()) -> Column:
    """serialized() for a column of type map<string,string>."""
    keys = F.array_sort(F.map_keys(c)) if order is None else F.array(*map(F.lit, order))
    if order is not None and not emit_missing:
        keys = F.filter(keys, lambda k: F.map_contains_key(c, k))

    def one(key: Column) -> Column:
        value = F.when(F.map_contains_key(c, key), F.coalesce(F.element_at(c, key), F.lit("null"))).otherwise("")
        return F.concat(
            F.lit(marks.key_prefix), key, F.lit(f"{marks.key_suffix} {marks.sep} "), F.when(value == "", marks.empty).otherwise(value), F.lit(f" {marks.eol}")
        )

    return F.array_join(F.transform(keys, one), " ")


def _holds_objects(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.MapType, T.VariantType)) or (isinstance(kind, T.ArrayType) and _holds_objects(kind.elementType))


@F.pandas_udf(T.StringType())
def _spaced(texts: pd.Series) -> pd.Series:
    """JSON as plain text: lists joined by blanks, objects printed anew in ASCII with a blank after each mark."""

    def plain(value: object) -> str:
        if value is None:
            return ""
        if isinstance(value, list):
            return " ".join(plain(v) for v in value if v is not None).strip()
        return json.dumps(value) if isinstance(value, dict) else str(value)

    return texts.map(lambda t: plain(json.loads(t)), na_action="ignore")


def plain_text(c: Column, kind: T.DataType) -> Column:
    """A value as plain text: null is empty, lists are joined by blanks at every depth, structs and maps become JSON.

    Lists of plain values stay in the JVM; values with objects inside are printed by a vectorised Python function.
    """
    if _holds_objects(kind):
        shown = _spaced(F.to_json(c, {"ignoreNullFields": "false"}))
    elif isinstance(kind, T.ArrayType):
        shown = strip(F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: plain_text(x, kind.elementType)), " "))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = float_repr(c.cast("double"))
    elif isinstance(kind, T.BooleanType):
        shown = F.when(c, "True").when(~c, "False")
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit(""))


def as_text(df: DataFrame, name: str) -> Column:
    """A column as plain text."""
    return plain_text(F.col(name), df.schema[name].dataType)


def _field(df: DataFrame, *names: str) -> Column:
    """First of the named columns that exists and is not blank, stripped."""
    have = [as_text(df, n) for n in names if n in df.columns]
    return first_filled(*have) if have else F.lit("")


def any_text(df: DataFrame) -> Column:
    """First column that is not blank, label-like columns aside."""
    return _field(df, *(c for c in df.columns if c.lower() not in ("label", "anomaly", "target", "class")))


def _tagged(df: DataFrame, *parts: Column) -> Column:
    text = strip(F.concat_ws("\n", *parts))
    return F.when(text == "", any_text(df)).otherwise(text)


def _part(df: DataFrame, tag: str, name: str, gap: str = " ") -> Column:
    value = _field(df, name)
    return F.when(value != "", F.concat(F.lit(f"<{tag}>{gap}"), value))


def waf(df: DataFrame) -> Column:
    """A request's five sections, all tags always there."""
    get = lambda n: _field(df, n)
    head = [F.concat(F.lit(f"<{tag}> "), get(n), F.lit("\n")) for tag, n in (("METHOD", "method"), ("URL", "url"), ("PROT", "protocol"))]
    tail = [F.concat(F.lit(f"<{tag}>\n"), get(n), F.lit("\n")) for tag, n in (("HDR", "headers"), ("BODY", "body"))]
    return strip(F.concat(*head, *tail))


def hdfs(df: DataFrame) -> Column:
    date, time = _field(df, "date"), _field(df, "time")
    stamp = F.when((date != "") | (time != ""), strip(F.concat(F.lit("<TS> "), date, F.lit(" "), time)))
    return _tagged(df, stamp, *(_part(df, tag, n) for tag, n in (("LEVEL", "level"), ("COMP", "component"), ("BLK", "block_id"), ("MSG", "content"))))


def phish_html(df: DataFrame) -> Column:
    return _tagged(df, _part(df, "PATH", "path"), _part(df, "YEAR", "year"), _part(df, "HTML", "text", "\n"))


def phishing_email(df: DataFrame) -> Column:
    tags = (("SUBJ", "subject"), ("FROM", "sender"), ("TO", "receiver"), ("DATE", "date"), ("DATASET", "dataset_name"), ("URLS", "urls"))
    return _tagged(df, *(_part(df, tag, n) for tag, n in tags), _part(df, "BODY", "text", "\n"))


FORMATTERS = {"hdfs": hdfs, "phish_html": phish_html, "phishing_email": phishing_email, "waf": waf}
TEXT_KEYS = {"hdfs": ("content", "text"), "phish_html": ("text", "html"), "phishing_email": ("text", "body", "subject"), "waf": ("body", "url", "method")}


def row_text(df: DataFrame) -> Column:
    """Text of a row for experiments: the first filled one of the usual columns, else the row as JSON."""
    got = _field(df, "formatted", "text", "body", "url", "content")
    return F.when(got == "", F.to_json(F.struct(*df.columns))).otherwise(got)
