"""Corpus scans: every source becomes rows (id, text), and the table registry."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import records
from tokenloom.functions.noise import cleaned
from tokenloom.functions.text import first_filled, strip

FORMATS = ("txt", "jsonl", "parquet")


def _field_udf(key: str):
    """JSON text -> its text field as Python prints it, or the whole object printed anew where the field is absent."""

    @F.pandas_udf("string")
    def get(lines: pd.Series) -> pd.Series:
        def one(line: str) -> str:
            obj = json.loads(line)
            return str(obj[key]) if isinstance(obj, dict) and key in obj else json.dumps(obj, ensure_ascii=False)

        return lines.map(one, na_action="ignore")

    return get


def json_field(line: Column, key: str) -> Column:
    """Text of a JSON line: the field as it prints, `None` for null, or the whole object printed anew without it.

    A plain string field is taken in the JVM; other values need the vectorised Python printer. A malformed line raises.
    """
    value = F.variant_get(F.try_parse_json(line), "$." + key, "variant") if key.isidentifier() else F.lit(None)
    plain = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(line), "$." + key, "string")) if key.isidentifier() else F.lit(None).cast("string")
    rest = _field_udf(key)(F.when(plain.isNull(), line))
    return F.coalesce(plain, rest)


def first_rows(df: DataFrame, most: int | None, order: str = "id") -> DataFrame:
    """The first rows by order; None keeps all, 0 and less are refused."""
    if most is None:
        return df
    if most <= 0:
        raise ValueError("a row limit must be positive")
    return df.orderBy(order).limit(most)


def with_id(df: DataFrame) -> DataFrame:
    """Adds a bigint id that grows with the position in the files; no shuffle."""
    return df.withColumn("id", F.monotonically_increasing_id())


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    return with_id(spark.read.text(path).where("value <> ''").select(F.col("value").alias("text")))


def scan_jsonl(spark: SparkSession, path: str, key: str = "text") -> DataFrame:
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")
    return with_id(lines.select(json_field(F.col("line"), key).alias("text")))


def scan_parquet(spark: SparkSession, path: str, key: str = "text") -> DataFrame:
    return with_id(spark.read.parquet(path).select(F.col(key).cast("string").alias("text")).where("text IS NOT NULL"))


def scan(spark: SparkSession, path: str, fmt: str = "txt", key: str = "text", most: int | None = None, clean: bool = False) -> DataFrame:
    """Rows (id, text) of a corpus; with clean, records that are noise become their symbol."""
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(FORMATS)}")
    df = scan_text(spark, path) if fmt == "txt" else scan_jsonl(spark, path, key) if fmt == "jsonl" else scan_parquet(spark, path, key)
    df = first_rows(df, most)
    return df.withColumn("text", cleaned(F.col("text"))) if clean else df


# --- registry ---

#: Path of each known data set; register() says where one lies.
DATASETS = {"hdfs": "hdfs", "phish_html": "phish_html", "phishing_email": "phishing_email", "waf": "waf"}
_ALIASES = {"hdfs_v1": "hdfs", "waf_v2": "waf"}


def register(key: str, path: str) -> None:
    """Says where a known data set lies, such as a folder or <org>/<name>."""
    if key not in DATASETS:
        raise ValueError(f"no dataset {key!r}; there are {', '.join(datasets())}")
    DATASETS[key] = path


def datasets() -> list[str]:
    return sorted(DATASETS)


def dataset_key(name: str) -> str:
    """Canonical key of a data set given by key, alias or hub path."""
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a dataset name can't be blank")
    wanted = name.strip().lower().replace(" ", "_").replace("-", "_")
    wanted = _ALIASES.get(wanted, wanted)
    if wanted in DATASETS:
        return wanted
    for key, path in DATASETS.items():
        if name == path:
            return key
    raise ValueError(f"no dataset {name!r}; there are {', '.join(datasets())}")


def dataset_path(name: str) -> str:
    return DATASETS[dataset_key(name)]


_HELD_OUT = ("val", "valid", "validation", "dev")


def split_name(wanted: str, have: list[str]) -> str:
    """The wanted split, or for a held-out one that is absent, validation or else test."""
    if wanted in have:
        return wanted
    if wanted.strip().lower() in _HELD_OUT:
        for other in ("validation", "test"):
            if other in have:
                return other
    raise ValueError(f"no split {wanted!r}; there are {', '.join(sorted(have))}")


def load_dataset(spark: SparkSession, splits: dict[str, str], split: str | None = None, fmt: str = "parquet", streaming: bool = False, **options: str) -> DataFrame:
    """A data set whose splits lie at the given paths; None reads all of them."""
    paths = list(splits.values()) if split is None else [splits[split_name(split, list(splits))]]
    if not streaming:
        return spark.read.format(fmt).options(**options).load(paths)
    schema = spark.read.format(fmt).options(**options).load(paths).schema
    streams = [spark.readStream.format(fmt).options(**options).schema(schema).load(path) for path in paths]
    return reduce(DataFrame.unionByName, streams)


def dataset_texts(df: DataFrame, name: str, key: str | None = None, formatted: bool = True, most: int | None = None) -> DataFrame:
    """Rows (id, text) of a data set: its formatter's text or the first filled text column, stripped, none empty."""
    which = dataset_key(name)
    if formatted:
        text = records.FORMATTERS[which](df)
    else:
        keys = (key,) if key else records.TEXT_KEYS[which]
        text = first_filled(*(records.as_text(df, k) for k in keys if k in df.columns), records.any_text(df))
    out = df.select(strip(text).alias("text")).where("text <> ''")
    if df.isStreaming:
        if most is not None:
            raise ValueError("a stream has no first rows")
        return out
    return first_rows(with_id(out), most)


def pulled(df: DataFrame, path: str, most: int | None = None, shuffle: bool = False, seed: int = 0) -> None:
    """Writes a data set as Parquet, the first `most` rows, or as many seeded random ones."""
    if shuffle and most is not None:
        df = df.orderBy(F.rand(seed)).limit(most)
    elif shuffle:
        df = df.orderBy(F.rand(seed))
    elif most is not None:
        at = "_at"
        df = first_rows(df.withColumn(at, F.monotonically_increasing_id()), most, at).drop(at)
    df.write.mode("overwrite").parquet(path)


def sampled(df: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, int]:
    """n rows drawn evenly, and how many there were; a top-k by random number, which never holds more than n rows a task."""
    return df.orderBy(F.rand(seed)).limit(n), df.count()
