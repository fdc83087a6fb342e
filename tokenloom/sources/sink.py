"""Sinks: cleaned corpora, exported texts and metric files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.httpstruct import structured
from tokenloom.functions.noise import cleaned
from tokenloom.functions.text import strip
from tokenloom.plans.config import Contract
from tokenloom.sources.scan import FORMATS, dataset_path, dataset_texts, first_rows, json_field, scan


def _prepared(c: Column, structure: str | None, max_len: int) -> Column:
    out = cleaned(c)
    return structured(out, max_len=max_len) if (structure or "none").lower() in ("http", "waf") else out


def _one_line(c: Column) -> Column:
    return F.translate(c, "\r\n", "  ")


def _put_field(key: str):
    @F.pandas_udf("string")
    def put(lines: pd.Series, texts: pd.Series) -> pd.Series:
        def one(line: str, text: str) -> str:
            obj = json.loads(line)
            obj = {**obj, key: text} if isinstance(obj, dict) and key in obj else {key: text}
            return json.dumps(obj, ensure_ascii=False)

        return pd.Series([one(a, b) for a, b in zip(lines, texts)], dtype=object)

    return put


def clean_corpus(
    spark: SparkSession, source: str, target: str, fmt: str = "txt", key: str = "text", most: int | None = None, out_fmt: str | None = None, structure: str | None = None, max_len: int = 4096
) -> None:
    """Rewrites a corpus with noise records replaced, and HTTP records structured if asked.

    Text and JSON lines come out as text or JSON lines (other fields and their order kept); Parquet as any of the three, nulls as
    empty texts. Parquet output of line formats is refused, as is a missing column.
    """
    fmt, out_fmt = fmt.lower(), (out_fmt or fmt).lower()
    for name in (fmt, out_fmt):
        if name not in FORMATS:
            raise ValueError(f"format {name!r} is none of {', '.join(FORMATS)}")
    if out_fmt == "parquet" and fmt != "parquet":
        raise ValueError("only Parquet input can be written as Parquet")
    if most is not None and most <= 0:
        raise ValueError("a row limit must be positive")
    limited = lambda df: df if most is None else first_rows(df.withColumn("_at", F.monotonically_increasing_id()), most, "_at").drop("_at")
    if fmt == "parquet":
        df = limited(spark.read.parquet(source))
        if key not in df.columns:
            raise KeyError(f"{source} has no column {key!r}")
        df = df.withColumn(key, _prepared(F.coalesce(F.col(key).cast("string"), F.lit("")), structure, max_len))
        if out_fmt == "parquet":
            df.write.mode("overwrite").parquet(target)
            return
        text, line = F.col(key), None
    else:
        df = spark.read.text(source)
        if fmt == "jsonl":
            df = limited(df.select(strip(F.col("value")).alias("value")).where("value <> ''"))
            df = df.select("value", json_field(F.col("value"), key).alias("t"))
            line = F.col("value")
        else:
            df = limited(df.where("value <> ''")).select("value", F.col("value").alias("t"))
            line = None
        df = df.withColumn("t", _prepared(F.col("t"), structure, max_len))
        text = F.col("t")
    if out_fmt == "txt":
        df.select(_one_line(text).alias("value")).write.mode("overwrite").text(target)
    elif line is not None:
        df.select(_put_field(key)(line, text).alias("value")).write.mode("overwrite").text(target)
    else:
        df.select(text.alias(key)).write.mode("overwrite").option("ignoreNullFields", "false").json(target)


def export_dataset(df: DataFrame, name: str, folder: str, split: str = "train", key: str = "text", most: int | None = None, formatted: bool = True) -> str:
    """Writes a data set's texts as JSON lines to <org>__<name>_<split>.jsonl in the folder, and returns the path."""
    path = f"{folder.rstrip('/')}/{dataset_path(name).replace('/', '__')}_{split}.jsonl"
    dataset_texts(df, name, formatted=formatted, most=most).select(F.col("text").alias(key)).write.mode("overwrite").json(path)
    return path


def write_texts(texts: DataFrame, path: str, text: str = "text") -> None:
    texts.select(_one_line(F.col(text)).alias("value")).write.mode("overwrite").text(path)


def write_contracted(spark: SparkSession, source: str, contract: Contract, target: str | None = None, fmt: str = "txt", key: str = "text", most: int | None = None) -> DataFrame:
    """Rows (id, text) of a corpus under a contract; written as lines of text to target, if one is given."""
    texts = scan(spark, source, fmt, key, most).withColumn("text", contract.applied(F.col("text")))
    if target is not None:
        write_texts(texts, target)
    return texts


def save_json(payload: Mapping, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def save_csv(rows: Iterable[Sequence], path: str | Path, header: Sequence[str]) -> None:
    """Comma-separated values without quoting."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("".join(",".join(map(str, r)) + "\n" for r in [header, *rows]), encoding="utf-8")
