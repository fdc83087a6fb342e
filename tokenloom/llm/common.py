"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows and bytes handed at once to the vectorised functions; they bound a worker's memory, not the result.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the folder the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a local session gets a folder in its warehouse;
    a cluster session is refused, for a machine's own disk would not outlive it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(named)


#: Paths of the tables stored so far, by enclosing scratch().
_STORED: list[list[str]] = [[]]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared checkpoint folder and read again, and the table's path."""
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}-{name}"
    _STORED[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a stored table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a stored table: their lineage is cut, and a lost executor loses none of them."""
    return stored(df, "settled")[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, on leaving and after a failure too, the tables stored inside and those added to the list given."""
    _STORED.append([])
    try:
        yield _STORED[-1]
    finally:
        for path in _STORED.pop():
            dropped(spark, path)


def outliving(path: str) -> str:
    """path, handed on from the innermost scratch() to what encloses it."""
    _STORED[-1].remove(path)
    _STORED[-2].append(path)
    return path


def released(spark: SparkSession) -> None:
    """Delete the tables stored outside any scratch(); call it when no result is needed any more."""
    while _STORED[0]:
        dropped(spark, _STORED[0].pop())


def if_small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df, marked for broadcast if its counted rows fit the session's broadcast threshold; call it on settled rows."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return F.broadcast(df) if row_bytes * df.count() <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that no column of df bears, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def field_type(df: DataFrame, column: str) -> T.DataType:
    return df.select(F.col(column)).schema[0].dataType


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """mapInArrow over slices of at most SLICE_ROWS rows."""
    return map_arrow_with(df, lambda: fn, schema)


#: What a worker remembers of the stage it runs: the stage's name, and the function made for it.
_LATEST: list = [None, None]


def _kept(stage: str, make: Callable[[], Callable]) -> Callable:
    """The function of a stage: made once in a worker, and let go when the worker turns to another stage."""
    if _LATEST[0] != stage:
        _LATEST[1] = None
        _LATEST[:] = [stage, make()]
    return _LATEST[1]


def map_arrow_with(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """The same, with a function that remembers things, made in the worker; they are let go with the stage."""
    stage = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = _kept(stage, make)
        for batch in batches:
            # rows of a batch are of like size in the mean; a single longer one is a slice of its own at worst
            step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                yield fn(batch.slice(start, step))

    return df.mapInArrow(run, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 50_000, most: int | None = None, cut_keys: set[int] | None = None) -> Iterator[pa.Table]:
    """The rows of batches sorted by an integer key, in tables of some `least` rows that cut no run of equal keys.

    With `most`, a run is cut when so many of its rows are held; its key is added to cut_keys before its first piece comes.
    """
    held: list[pa.Table] = []
    rows, wanted = 0, least
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows >= wanted:
            whole = pa.concat_tables(held).combine_chunks()
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield whole.slice(0, cut)
            held, rows = [whole.slice(cut)], rows - cut
            if most is not None and rows >= most:
                cut_keys.add(int(keys[-1]))
                yield held[0]
                held, rows = [], 0
            wanted = max(least, 2 * rows)
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def tasked(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Rows (id, group, ...) with a number `task`: every two rows of a group are in some task together, and no task has over 2 * most rows or so.

    A group of up to `most` rows is a task. A larger one is cut into random parts, every two parts are a task, and a row is
    in all tasks of its part. Groups that large are few: rows / most of them.
    """
    full, number, parts, own, other = fresh(rows, "g_full", "g_number", "g_parts", "g_own", "g_other")
    sizes = settled(rows.groupBy(F.col(group).alias(full)).agg(F.count("*").alias(number)).where(F.col(number) > most))
    if sizes.isEmpty():
        return rows.withColumn("task", F.col(group).cast("bigint"))
    named = rows.join(if_small(sizes), F.col(group) == F.col(full), "left")
    named = named.withColumn(parts, F.ceil(F.coalesce(F.col(number), F.lit(1)) / most).cast("int"))
    named = named.withColumn(own, F.pmod(F.xxhash64("id"), F.col(parts)).cast("int"))
    named = named.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    task = F.xxhash64(group, F.least(other, own), F.greatest(other, own))
    return named.select(*rows.columns, task.alias("task"))


def collapsed(items: DataFrame, *value: str) -> tuple[DataFrame, DataFrame]:
    """Of settled items (id, *value), the least id of each value with it, and edges (a, b) from each other id to that one.

    Counts are combined before the shuffle, and only values that repeat are joined back, so a value that a third of
    all items bear is one row of it.
    """
    heads = settled(items.groupBy(*value).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    again = heads.where("n > 1").select(F.col("id").alias("b"), *(F.col(v).alias("r_" + v) for v in value))
    same = [F.col(v) == F.col("r_" + v) for v in value]
    edges = items.join(if_small(again), same).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    return heads.select("id", *value), edges


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return body, offsets - offsets[0]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node of the component.

    Alternating large-star and small-star steps; rounds grow with the logarithm of a component's diameter. Each
    step is stored, so a lost executor costs one step at most. A node's least neighbour is found by an
    aggregation and joined back, so that the edges of a hub need not meet in one task.
    Self-loops and repeated edges are allowed; an edge with a null end is ignored.
    """
    spark = edges.sparkSession

    def with_least(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), F.col("u") == F.col("w")).drop("w")

    cur, path = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each node's greater neighbours go to its least one
        large = with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large, between = stored(large.distinct(), "edges")
        # small star: each node and its lesser neighbours go to the least of them
        pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        last = path
        cur, path = stored(with_least(large).select(pair.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "edges")
        dropped(spark, last)
        dropped(spark, between)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def bounded_sample(df: DataFrame, key: str, stratum: str, most: int, seed: int = 17) -> DataFrame:
    """At most `most` rows of each stratum, those whose key hashes lowest; the same ones at any partitioning.

    A first count per stratum sets a bar on the hash, so that only about 2 * most rows of each are ranked.
    Rows with a null key or stratum take no part.
    """
    draw, total, bar, place = fresh(df, "b_draw", "b_total", "b_bar", "b_place")
    df = df.where(F.col(key).isNotNull() & F.col(stratum).isNotNull())
    sizes = settled(df.groupBy(F.col(stratum).alias(total + "_s")).agg(F.count("*").alias(total)))
    sizes = sizes.select(F.col(total + "_s"), ((2.0 * most + 100) / F.col(total)).alias(bar))
    drawn = df.withColumn(draw, F.xxhash64(F.lit(seed), key) / F.lit(float(2**63)) * 0.5 + 0.5)
    drawn = drawn.join(if_small(sizes), F.col(stratum) == F.col(total + "_s")).where(F.col(draw) <= F.col(bar))
    # rows that share a key are ordered by all they hold
    drawn = drawn.withColumn(place, F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key, *(c for c in df.columns if c not in (key, stratum)))))
    return drawn.where(F.col(place) <= most).select(*df.columns)
