"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length 1. Each table projects them on some Gaussian directions, the draws, shifts, and
cuts the line into cells of width WIDTH; vectors with equal cells in all draws of a table share a bucket. Cosines
in a bucket are computed exactly, and pairs of at least THRESHOLD are near copies. For cosine 0.95 (distance 0.316) a draw
agrees with odds 0.80, and for unrelated vectors with odds 0.33. Draws are as many as leave a vector at most a fiftieth
of a chance mate a table, whatever the number of vectors, and tables as many as find a pair at cosine 0.95 with odds
RECALL; at cosine 0.98 that is 0.999. So work grows as n ^ 1.2 and recall does not change.

Equal vectors are one item in the search, however many ids bear them. Buckets are formed of ids alone; single ids and
repeated sets drop out before any vector moves. In a bucket the exact components are found by breadth-first search over
what is not reached yet, so a crowded bucket yields a spanning tree and no partner is cut; a bucket of more than BUCKET_ROWS
vectors is cut into random parts, and every two parts meet in a task of their own. Groups are connected
components; the least id of each stays.

Defined cases: a vector that is null, empty, all zero, or holds a null, NaN or infinity is in no group; vectors of
different lengths are never near; ids may be of any type that can be ordered, and keep it; a null id is in no group; rows
that share an id are one item, grouped by every vector they bear; equal vectors are near, and so are all at a cosine
of just the threshold; an empty table gives an empty result. Only id and vector are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import collapsed, components, field_type, if_small, map_arrow_with, settled, tasked, whole_runs

THRESHOLD = 0.95
WIDTH = 1.26
RECALL = 0.92
#: Odds that one draw puts two vectors in one cell: at cosine 0.95, and at cosine 0.
AGREE, CHANCE = 0.80, 0.3336
SEED = 20240607


#: Ids of a bucket that are held to tell whether another table has the same set, and vectors of a bucket that one task takes.
SET_ROWS, BUCKET_ROWS = 1_000_000, 100_000


def shape(n: int) -> tuple[int, int]:
    """Draws and tables for n vectors."""
    draws = max(8, math.ceil(math.log(50 * max(n, 2)) / -math.log(CHANCE)))
    return draws, math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**draws))


def planes(size: int, draws: int, tables: int, width: float = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and the odd multipliers that mix a table's cells into one key; the same on every machine."""
    rng = np.random.Generator(np.random.PCG64([seed, size]))
    return (
        rng.standard_normal((size, tables * draws)),
        rng.uniform(0, width, tables * draws),
        rng.integers(0, 2**63, (tables, draws + 1), dtype=np.int64) * 2 + 1,
    )


def keys(unit: np.ndarray, drawn: tuple[np.ndarray, np.ndarray, np.ndarray], width: float = WIDTH) -> np.ndarray:
    """Bucket of each vector in each table, as one 64-bit number."""
    directions, shifts, odd = drawn
    tables, draws = odd.shape[0], odd.shape[1] - 1
    cells = np.floor((unit @ directions + shifts) / width).astype(np.int64).reshape(len(unit), tables, draws)
    with np.errstate(over="ignore"):
        mixed = (cells * odd[None, :, :draws]).sum(axis=2) + odd[None, :, draws]
        mixed ^= mixed >> 29
        return mixed * np.int64(-7046029254386353131)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length that usable vectors of the list column have."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        x = flat[starts[rows][:, None] + np.arange(size)]
        usable = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if usable.any():
            yield rows[usable], x[usable]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def digests(vectors: DataFrame) -> DataFrame:
    """Rows (id, d1, d2) of the usable vectors: a 128-bit hash of each, null for others."""
    schema = T.StructType([T.StructField("id", field_type(vectors, "id")), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, 2), np.int64)
        seen = np.zeros(batch.num_rows, bool)
        for rows, x in by_length(batch.column(1)):
            x = x + 0.0  # one zero
            out[rows] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v) for v in x), np.int64).reshape(-1, 2)
            seen[rows] = True
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k], mask=~seen) for k in (0, 1))], names=schema.fieldNames())

    return map_arrow_with(vectors, lambda: run, schema)


def bucketed(vectors: DataFrame, draws: int, tables: int) -> DataFrame:
    """Rows (id, key), one for each usable vector and table."""
    schema = T.StructType([T.StructField("id", field_type(vectors, "id")), T.StructField("key", T.LongType())])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        drawn: dict[int, tuple] = {}

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for rows, x in by_length(batch.column(1)):
                size = x.shape[1]
                if size not in drawn:
                    drawn.clear()
                    drawn[size] = planes(size, draws, tables)
                at.append(np.repeat(rows, tables))
                out.append(keys(unit(x), drawn[size]).ravel())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(out))], names=["id", "key"])

        return run

    return map_arrow_with(vectors, make, schema)


def shared(rows: DataFrame, set_rows: int = SET_ROWS) -> DataFrame:
    """Rows (bucket, id) of the buckets that hold two ids or more; equal sets of ids are one bucket, but for buckets of over set_rows ids."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("id", rows.schema["id"].dataType)])
    rows = rows.select("key", "id", F.xxhash64("id").alias("mark")).repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_keys: set[int] = set()
        for table in whole_runs(batches, "key", most=set_rows, cut_keys=cut_keys):
            key, mark, ids = table.column("key").to_numpy(), table.column("mark").to_numpy(), table.column("id").combine_chunks()
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
            at = np.flatnonzero(fresh)
            bounds = np.flatnonzero(np.diff(key[at], prepend=~key[:1]))
            sizes = np.diff(bounds, append=len(at))
            with np.errstate(over="ignore"):
                sets = np.add.reduceat(mark[at] * np.int64(-7046029254386353131), bounds) ^ np.add.reduceat(mark[at] >> 7, bounds)
            # the pieces of a bucket that is too large to be held go by its key
            cut = np.isin(key[at[bounds]], np.fromiter(cut_keys, np.int64, len(cut_keys)))
            sets = np.where(cut, key[at[bounds]], sets)
            own = np.repeat((sizes > 1) | cut, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sets, sizes)[own]), ids.take(pa.array(at[own]))], names=["bucket", "id"])

    return rows.mapInArrow(run, schema).distinct()


def groups(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, set_rows: int = SET_ROWS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Rows (id, group_id) of all ids that have a near copy; group_id is the least id of the group, which stays."""
    kind = field_type(vectors, vector)
    wide = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    flat = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<float>" if wide else "array<double>").alias("v")).where("id IS NOT NULL")
    items = settled(digests(flat).where("d1 IS NOT NULL").distinct())
    heads, copies = collapsed(items, "d1", "d2")
    draws, tables = shape(heads.count())
    # ids that only repeat another's vector are left out of the buckets
    gone = settled(items.select("id").distinct().join(heads.select("id"), "id", "left_anti"))
    lone = flat.join(if_small(gone), "id", "left_anti")
    members = settled(shared(bucketed(lone, draws, tables), set_rows))
    filled = tasked(members, "bucket", bucket_rows).join(flat, "id").select("task", "id", "v").repartition("task").sortWithinPartitions("task")
    schema = T.StructType([T.StructField("a", members.schema["id"].dataType), T.StructField("b", members.schema["id"].dataType)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "task", 10_000):
            bucket, ids = table.column("task").to_numpy(), table.column("id").combine_chunks()
            for rows, x in by_length(table.column("v")):
                a, b = edges(bucket[rows], unit(x), threshold)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[a])), ids.take(pa.array(rows[b]))], names=["a", "b"])

    return components(filled.mapInArrow(search, schema).unionByName(copies)).select(F.col("node").alias("id"), F.col("root").alias("group_id"))


def edges(bucket: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs with at least this cosine within each run of equal buckets."""
    bounds = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
    sizes = np.diff(bounds, append=len(bucket))
    two = bounds[sizes == 2]
    two = two[(x[two] * x[two + 1]).sum(axis=1) >= threshold]
    a_out, b_out = [two], [two + 1]
    for start, size in zip(bounds[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        left = np.arange(start, start + size)
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                at = todo.pop()
                close = x[left] @ x[at] >= threshold
                found = left[close]
                a_out.append(np.full(len(found), at))
                b_out.append(found)
                todo.extend(found.tolist())
                left = left[~close]
    return np.concatenate(a_out), np.concatenate(b_out)


#: For test tables without near copies: of every twentieth vector one copy at a cosine of some 0.997, and one at some 0.75.
NEAR_IDS, FAR_IDS = 10**12, 2 * 10**12


def with_copies(vectors: DataFrame) -> DataFrame:
    """All vectors (vec_id, embedding), and the two copies of every twentieth."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    some = rows.where("vec_id % 20 = 0")
    near = F.transform("embedding", lambda x, i: x * (F.lit(1.0) + F.lit(0.1) * ((i * 7 + F.col("vec_id")) % 3 - 1)))
    far = F.transform("embedding", lambda x, i: F.when(i % 8 == 0, -x).otherwise(x))
    rows = rows.unionByName(some.select((F.col("vec_id") + NEAR_IDS).alias("vec_id"), near.alias("embedding")))
    return rows.unionByName(some.select((F.col("vec_id") + FAR_IDS).alias("vec_id"), far.alias("embedding")))


def oracle(threshold: float = THRESHOLD, copies: bool = False) -> str:
    rows = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
    if copies:
        rows += f""" UNION ALL SELECT vec_id + {NEAR_IDS}, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (1 + 0.1::DOUBLE * (((i - 1) * 7 + vec_id) % 3 - 1))) FROM embeddings WHERE vec_id % 20 = 0
        UNION ALL SELECT vec_id + {FAR_IDS}, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN (i - 1) % 8 = 0 THEN -x ELSE x END) FROM embeddings WHERE vec_id % 20 = 0"""
    return f"""
    WITH RECURSIVE v AS ({rows}),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
    r(id, root) AS (SELECT a, a FROM p UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a)
    SELECT id AS vec_id, min(root) AS group_id FROM r GROUP BY id"""
