"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each non-blank paragraph (a line, trimmed) is expanded by counter-mode SHA-256 into LANES numbers of 32 bits; a
document's fingerprint is their sum by lane modulo 2^32. Addition is commutative, so the order of paragraphs
does not matter, repeated paragraphs count with multiplicity, and paragraphs are inserted or deleted by
adding or subtracting their vectors. LANES x 32 = 1024 bits put a forged or chance collision out of reach
of generalised-birthday attacks at these sizes.

Defined cases: null text has a null fingerprint and no paragraphs, and equals nothing; empty or blank text has the
all-zero fingerprint; very long texts are hashed whole; repeated rows get equal fingerprints; an empty table gives
an empty result. Only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import field_type, fresh, if_small, map_arrow, settled

LANES = 32
#: Trimmed from both ends of a paragraph.
BLANKS = " \t\r\x0b\x0c"
_COUNTERS = [b"\x1f%d" % i for i in range(LANES // 8)]


def paragraphs(text: str) -> list[bytes]:
    return [p.encode() for line in text.split("\n") if (p := line.strip(BLANKS))]


def vectors(parts: list[bytes]) -> np.ndarray:
    """One row of LANES 32-bit numbers for each paragraph."""
    out = bytearray()
    for part in parts:
        h = hashlib.sha256(part)
        for counter in _COUNTERS:
            c = h.copy()
            c.update(counter)
            out += c.digest()
    return np.frombuffer(bytes(out), dtype=">u4").reshape(len(parts), LANES).astype(np.uint32)


def text_vector(text: str) -> np.ndarray:
    return vectors(paragraphs(text)).sum(axis=0, dtype=np.uint32)


def as_hex(vector: np.ndarray) -> str:
    return vector.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint, paragraphs), one for each row of docs; no shuffle."""
    schema = T.StructType([T.StructField(key, field_type(docs, key)), T.StructField("fingerprint", T.StringType()), T.StructField("paragraphs", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        split = [[] if t is None else paragraphs(t) for t in texts]
        flat = vectors([p for parts in split for p in parts])
        ends = np.cumsum([len(p) for p in split])
        prints = []
        for t, parts, end in zip(texts, split, ends):
            prints.append(None if t is None else as_hex(flat[end - len(parts) : end].sum(axis=0, dtype=np.uint32)))
        counts = pa.array([len(p) for p in split], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string()), counts], names=[key, "fingerprint", "paragraphs"])

    return map_arrow(docs.select(F.col(key).alias(key), F.col(text).alias("t")), run, schema)


def equal_sets(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds same_as: the least key whose paragraphs are the same multiset; null without a fingerprint, or if all such keys are null.

    Keys are combined before the shuffle, and only fingerprints that repeat are joined back.
    """
    rows = settled(prints)
    (peer,) = fresh(rows, "same_print")
    there = rows.where("fingerprint IS NOT NULL")
    least = there.groupBy(F.col("fingerprint").alias(peer)).agg(F.min(key).alias("same_as"), F.count("*").alias("n"))
    again = settled(least.where("n > 1").drop("n"))
    joined = rows.join(if_small(again, 512), F.col("fingerprint") == F.col(peer), "left")
    alone = F.when(F.col("fingerprint").isNotNull() & F.col(peer).isNull(), F.col(key))
    return joined.select(*rows.columns, F.coalesce("same_as", alone).alias("same_as"))


def lanes(fingerprint: Column) -> Column:
    at = F.sequence(F.lit(0), F.lit(LANES - 1))
    return F.transform(at, lambda i: F.conv(F.substr(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def _hexed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def inserted(fingerprint: Column, more: Column) -> Column:
    """Fingerprint of the union of two multisets; null if either is null."""
    return _hexed(F.zip_with(lanes(fingerprint), lanes(more), lambda a, b: (a + b).bitwiseAND(F.lit(2**32 - 1))))


def deleted(fingerprint: Column, fewer: Column) -> Column:
    """Fingerprint with the paragraphs of `fewer` taken out; null if either is null."""
    return _hexed(F.zip_with(lanes(fingerprint), lanes(fewer), lambda a, b: (a - b + F.lit(2**32)).bitwiseAND(F.lit(2**32 - 1))))


def oracle() -> str:
    lane = lambda i: f"CAST(('0x' || substr(h{i // 8}, {8 * (i % 8) + 1}, 8)) AS UBIGINT)"
    sums = " || ".join(f"printf('%08x', CAST(coalesce(sum({lane(i)}), 0) % 4294967296 AS BIGINT))" for i in range(LANES))
    hashes = ", ".join(f"sha256(p || chr(31) || '{i}') AS h{i}" for i in range(LANES // 8))
    return f"""
    WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS p FROM documents),
    h AS (SELECT doc_id, {hashes} FROM l WHERE p <> ''),
    f AS (SELECT d.doc_id, CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE {sums} END AS fingerprint, CAST(count(h0) AS INTEGER) AS paragraphs
          FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id)
    SELECT doc_id, fingerprint, paragraphs, CASE WHEN fingerprint IS NOT NULL THEN min(doc_id) OVER (PARTITION BY fingerprint) END AS same_as FROM f"""
