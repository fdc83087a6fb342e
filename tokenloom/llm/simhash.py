r"""SimHash near-dedup with pigeonhole blocks.

A document's fingerprint has 128 bits: every distinct word (a run of \w in the lower-cased text) votes on each bit
with weight round(8 (1 + log2 of its count)), by the bits of a 128-bit hash of the word. Two documents are near
copies if their fingerprints differ in at most RADIUS = 14 bits. The fingerprint is split into 5 blocks of 25 or 26 bits;
14 wrong bits leave at least one block with at most two of them, and two wrong bits leave one of a block's three parts
clean. So every near pair meets in a cell, which is one part's value: a fingerprint is in 15 cells, and nothing else
is shuffled. Within a cell each row is listed under its block's value and those one-bit neighbours that keep the part;
blocks that differ in up to two bits share an entry there, and rows that share one are verified by Hamming distance.
No pair within the radius is missed. Groups are connected components, and the least id of each stays.

Why 14: a copy with a share f of its words replaced differs in about 128 sqrt(2 f) / pi bits, 11.5 of them at 4 %, while
texts that share nothing but frequent words differ in 47 +- 5.5.

Equal fingerprints are one row in the search, however many documents bear them. In a crowded entry the exact
components are found by breadth-first search over what is not reached yet, which needs one row of distances per
fingerprint reached and emits a spanning tree in place of all pairs; the groups are the same. A cell of more than
CELL_ROWS rows is cut into random parts, and every two parts meet in a task of their own.

Defined cases: null or empty text, or text without a word, has a null fingerprint and is in no group; ids are whole
numbers, rows with a null id are in no group and stay; rows that share an id are one document: they are grouped by
every text they bear, and the row with the least text stays; very long texts are read whole; ties between
fingerprint votes give 0; an empty table gives an empty result; extra columns pass through, clashing names allowed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tokenloom.llm.common import collapsed, components, fresh, map_arrow_with, settled, tasked, whole_runs

RADIUS = 14
#: Widths of the parts of each block, highest bits first.
WIDTHS = ((9, 9, 8), (9, 9, 8), (9, 9, 8), (9, 8, 8), (9, 8, 8))
BLOCK_BITS, PART_BITS = 26, 9
#: Runs of equal entries longer than this are searched breadth first; the groups are the same either way.
CROWD = 64
#: Rows of a cell that one task takes; the groups are the same with any number.
CELL_ROWS = 1_000_000
#: Rows whose entries are listed at once.
LISTED = 50_000
#: Letters of the words that a worker remembers; bounds its memory, not the result.
LETTERS_KEPT = 4_000_000

_WORD = re.compile(r"\w+")
_CHUNK = 8192


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Digests(dict):
    """128-bit hashes of words, worked out at first use."""

    letters = 0

    def __missing__(self, word: str) -> bytes:
        if self.letters > LETTERS_KEPT:
            self.clear()
            self.letters = 0
        self.letters += len(word)
        got = self[word] = xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))
        return got


def fingerprint(text: str | None, digests: Digests | None = None) -> tuple[int, int] | None:
    """(hi, lo), each as a signed 64-bit number; None without words."""
    counts = Counter(words(text)) if text else None
    digests = Digests() if digests is None else digests
    if not counts:
        return None
    n = np.fromiter(counts.values(), np.float64, len(counts))
    # whole numbers whose sums stay below 2 ** 24 in every chunk: float32 products are exact, in any order
    weights = np.rint(8 * (1 + np.log2(n))).astype(np.float32)
    packed = np.frombuffer(b"".join(map(digests.__getitem__, counts)), np.uint8).reshape(len(counts), 16)
    votes = np.zeros(128, np.int64)
    for at in range(0, len(counts), _CHUNK):
        bits = np.unpackbits(packed[at : at + _CHUNK], axis=1).astype(np.float32)
        votes += (weights[at : at + _CHUNK] @ bits).astype(np.int64)
    half = np.packbits(2 * votes > int(weights.sum(dtype=np.float64))).view(">i8")
    return int(half[0]), int(half[1])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, hi, lo), one for each row of docs; hi and lo null without words. No shuffle."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "hi", "lo")])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        digests = Digests()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [fingerprint(t, digests) for t in batch.column(1).to_pylist()]
            hi, lo = ([None if b is None else b[k] for b in both] for k in (0, 1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["id", "hi", "lo"])

        return run

    return map_arrow_with(docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")), make, schema)


_BLOCKS = [sum(w) for w in WIDTHS]


def _bits(at: int, n: int) -> Column:
    """n bits of the fingerprint from bit `at`, counted from the highest."""
    high = lambda c, at, n: F.shiftrightunsigned(F.col(c), 64 - at - n).bitwiseAND(F.lit(2**n - 1))
    if at + n <= 64:
        return high("hi", at, n)
    if at >= 64:
        return high("lo", at - 64, n)
    return F.shiftleft(high("hi", at, 64 - at), at + n - 64).bitwiseOR(high("lo", 0, at + n - 64))


def _cells() -> list[Column]:
    """The cells of a row (hi, lo): number of the block's part, and the part's value."""
    out, at = [], 0
    for k, n in enumerate(n for parts in WIDTHS for n in parts):
        out.append(_bits(at, n).bitwiseOR(F.lit(k << PART_BITS)).cast("int"))
        at += n
    return out


def _flips() -> list[np.ndarray]:
    """For each part, what its block's value is flipped with to list it: nothing, or one bit outside of the part."""
    out = []
    for parts in WIDTHS:
        left = sum(parts)
        for n in parts:
            left -= n
            inside = ((1 << n) - 1) << left
            out.append(np.array([0] + [1 << j for j in range(sum(parts)) if not (inside >> j) & 1], np.int64))
    return out


FLIPS = _flips()
#: Bits of each part within its block's value.
_INSIDE = np.array([(1 << _BLOCKS[k // 3]) - 1 - int(f[1:].sum()) for k, f in enumerate(FLIPS)], np.int64).reshape(len(WIDTHS), 3)


def _block_values(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One column for each block."""
    hi, lo, out, at = hi.view(np.uint64), lo.view(np.uint64), [], 0
    cut = lambda x, at, n: (x >> np.uint64(64 - at - n)) & np.uint64(2**n - 1)
    for n in _BLOCKS:
        if at + n <= 64:
            out.append(cut(hi, at, n))
        elif at >= 64:
            out.append(cut(lo, at - 64, n))
        else:
            out.append((cut(hi, at, 64 - at) << np.uint64(at + n - 64)) | cut(lo, 0, at + n - 64))
        at += n
    return np.stack(out, axis=1).astype(np.int64)


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one entry, of all that two rows with these block values share, under which their pair is reported."""
    apart = a ^ b
    k = (np.bitwise_count(apart) <= 2).argmax(axis=1)
    rows = np.arange(len(a))
    x, y, d = a[rows, k], b[rows, k], apart[rows, k]
    part = ((_INSIDE[k] & d[:, None]) == 0).argmax(axis=1)
    low = d & -d
    # equal: the value; one bit apart: the lesser value; two: the lesser of the two values in between
    at = np.where(d == low, np.minimum(x, y), np.minimum(x ^ low, y ^ low))
    return ((3 * k + part) << BLOCK_BITS) | at


def _listed(cell: np.ndarray, hi: np.ndarray, lo: np.ndarray, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the rows in order, with each one's row; of all entries, those of one share."""
    part = cell >> PART_BITS
    values = _block_values(hi, lo)
    keys, rows = [], []
    for k in np.unique(part).tolist():
        own = np.flatnonzero(part == k)
        key = ((values[own, k // 3][:, None] ^ FLIPS[k]) | (k << BLOCK_BITS)).ravel()
        row = np.repeat(own, len(FLIPS[k]))
        if shares > 1:
            mine = (key * 2654435761 >> 7) % shares == share
            key, row = key[mine], row[mine]
        keys.append(key)
        rows.append(row)
    key, row = np.concatenate(keys), np.concatenate(rows)
    packed = np.sort((key << 32) | row)
    return packed >> 32, packed & 0xFFFFFFFF


def near_pairs(cell: np.ndarray, ids: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows of equal cell within the radius: every such pair whose first meeting is there, or, in a run longer than crowd, a spanning forest."""
    a_out, b_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    shares = -(-len(cell) // LISTED)
    for share in range(shares):
        key, row = _listed(cell, hi, lo, share, shares)
        for a, b in _entry_pairs(key, row, hi, lo, radius, crowd):
            a_out.append(ids[a])
            b_out.append(ids[b])
    return np.concatenate(a_out), np.concatenate(b_out)


def _entry_pairs(key: np.ndarray, row: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    bounds = np.flatnonzero(np.diff(key, prepend=-1))
    sizes = np.diff(bounds, append=len(key))
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= crowd), sizes))
    for lag in range(1, crowd):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        x, y = row[at], row[at + lag]
        close = np.bitwise_count((hi[x] ^ hi[y]).view(np.uint64)) + np.bitwise_count((lo[x] ^ lo[y]).view(np.uint64)) <= radius
        x, y, met = x[close], y[close], key[at[close]]
        first = _first_meeting(_block_values(hi[x], lo[x]), _block_values(hi[y], lo[y])) == met
        yield x[first], y[first]
    for k in np.flatnonzero(sizes > crowd):
        own = row[bounds[k] : bounds[k] + sizes[k]]
        h, m = hi[own].view(np.uint64), lo[own].view(np.uint64)
        left = np.arange(len(own))
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                close = np.bitwise_count(h[left] ^ h[x]) + np.bitwise_count(m[left] ^ m[x]) <= radius
                found = left[close]
                yield np.full(len(found), own[x]), own[found]
                todo.extend(found.tolist())
                left = left[~close]


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (id, group_id) of all ids that have a near copy; group_id is the least id of the group, which stays."""
    if radius > RADIUS:
        raise ValueError(f"the blocks find pairs within {RADIUS} bits only")
    return _grouped(settled(fingerprints(docs, key, text)), radius)


def _grouped(prints: DataFrame, radius: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    rows, copies = collapsed(prints.where("id IS NOT NULL AND hi IS NOT NULL"), "hi", "lo")
    spread = rows.select(F.explode(F.array(*_cells())).alias("cell"), "id", "hi", "lo")
    spread = tasked(spread, "cell", cell_rows).repartition("task").sortWithinPartitions("task")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "task", LISTED):
            cell, ids, hi, lo = (table.column(c).to_numpy() for c in ("cell", "id", "hi", "lo"))
            a, b = near_pairs(cell.astype(np.int64), ids, hi, lo, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    edges = spread.mapInArrow(search, schema).unionByName(copies)
    return components(edges).select(F.col("node").alias("id"), F.col("root").alias("group_id"))


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group, the one of the least id."""
    prints = settled(fingerprints(docs, key, text))
    gone = _grouped(prints, radius).where("id <> group_id").select("id")
    kept = docs.join(gone, F.col(key) == gone["id"], "left_anti")
    if not prints.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        lone, place = fresh(docs, "s_lone", "s_place")
        kept = kept.withColumn(lone, F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
        kept = kept.withColumn(place, F.row_number().over(Window.partitionBy(key, lone).orderBy(text))).where(F.col(place) == 1)
    return kept.select(*docs.columns)
