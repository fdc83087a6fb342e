"""The stateless operators over streams, and a running count of tags.

Contract, noise cleaning and encoding are Column expressions, so they run over a stream as they do over a table. Counts
are stateful: their state grows with the distinct keys. Event time with a watermark is an addition of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions.noise import cleaned
from tokenloom.operators.mining import TAG
from tokenloom.plans.artifact import Artifact, Runtime
from tokenloom.plans.config import Contract


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None, **options: str) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def normalized(df: DataFrame, contract: Contract, text: str = "text", clean: bool = True) -> DataFrame:
    return df.withColumn(text, contract.applied(cleaned(F.col(text)) if clean else F.col(text)))


def encoded(df: DataFrame, artifact: Artifact, text: str = "text") -> DataFrame:
    return df.withColumn("ids", Runtime(artifact).encoded(F.col(text)))


def tag_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Running counts of <TAGS>; for complete or update mode."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(0))).alias("tag")).groupBy("tag").agg(F.count("*").alias("freq"))


def windowed_counts(df: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and key; rows later than `late` are dropped and their state is freed."""
    return df.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def write(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Starts a file sink that handles everything there is and stops; exactly once by its checkpoint."""
    return df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
