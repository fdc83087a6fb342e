"""Language ID by error-correcting output codes.

Every language has a codeword of +-1 bits. For each bit a binary classifier over character trigrams (as UTF-8
bytes of the lower-cased text, everything but letters blanked, hashed to DIM buckets) tells the languages of either
sign apart: its weights are log ratios of smoothed trigram shares, each language counting alike, and its output
is the mean weight over the text, scaled so that held-out texts have a typical margin of 1. Decoding is loss-weighted:
a language's distance is the sum over bits of exp(-3 sign output), weighted by the bit's held-out accuracy. The
nearest codeword wins. The margin is (second - best) / (second + best); a document is ambiguous if it lies below the
bar. The bar is set by planted mixtures: held-out texts of two languages are cut and joined at 60 to 40, and MIXTURES_BELOW
of their margins lie below it; but it never rejects more than PURE_BELOW of the held-out texts themselves, should the
classifiers not tell the languages apart well enough.

The classifiers are fitted on at most PER_LANGUAGE labelled documents of each language; every document is then read
whole and decoded in one pass without a shuffle.

Defined cases: null, empty or letterless text has a null language, margin 0 and is rejected; ambiguous documents are
rejected; a tie goes to the language that sorts first, and with margin 0 is ambiguous; null labels are not
learned from; with one language in the labels that language is given to every text with letters; an empty table or one without
labels gives null languages; repeated rows decode alike; extra columns pass through, clashing names allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import bounded_sample, field_type, map_arrow

#: Labelled documents of each language used for fitting; a third of them is held out.
PER_LANGUAGE = 600
DIM = 8192
MIXTURES_BELOW, PURE_BELOW = 0.95, 0.02
#: Share of the larger part of a planted mixture, and how many are planted.
LARGER, PLANTED = 0.6, 1500
#: At up to this many languages all two-way splits are used as bits, beyond it random ones.
EXHAUSTIVE = 5

_KEEP = bytes(c if chr(c).isalpha() or c >= 0x80 else 0x20 for c in range(256))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts end to end, and how many each has; 0 for letterless texts."""
    bodies = []
    for t in texts:
        inner = b" ".join(t.lower().encode("utf-8", "replace").translate(_KEEP).split())
        bodies.append(b" " + inner + b" " if inner else b"")
    sizes = np.array([max(0, len(b) - 2) for b in bodies], np.int64)
    raw = np.frombuffer(b"".join(b + b"  " if b else b"" for b in bodies) + b"  ", np.uint8).astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    # each body is followed by two blanks: drop the four trigrams that reach into them
    widths = np.array([len(b) + 2 if b else 0 for b in bodies], np.int64)
    starts = np.cumsum(widths) - widths
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    code = code[at]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)).astype(np.int64), sizes


def codewords(n: int) -> np.ndarray:
    """Row k is the codeword of language k: rows differ in many bits, and no two columns split alike."""
    if n <= EXHAUSTIVE:
        bits = [[1 if (c >> (n - 1 - k)) & 1 else -1 for k in range(n)] for c in range(2 ** (n - 1), 2**n - 1)]
        return np.array(bits, np.int64).T.reshape(n, -1)
    rng, best, gap = np.random.Generator(np.random.PCG64(5)), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        tried = rng.choice([-1, 1], (n, width))
        apart = min(int((tried[i] != tried[j]).sum()) for i in range(n) for j in range(i))
        if apart > gap and (np.abs(tried.sum(axis=0)) < n).all():
            best, gap = tried, apart
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    bar: float

    def outputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Output of each bit's classifier for each text, and which texts have letters."""
        idx, sizes = trigrams(texts)
        sums = np.zeros((len(texts), self.weights.shape[1]))
        solid = np.flatnonzero(sizes)
        if len(solid):
            ends = np.cumsum(sizes[solid])
            for k in range(self.weights.shape[1]):
                sums[solid, k] = np.add.reduceat(self.weights[idx, k], ends - sizes[solid])
        return sums / np.maximum(sizes, 1)[:, None], sizes > 0

    def decode(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword of each row, and its margin."""
        if len(self.languages) == 1:
            return np.zeros(len(out), np.int64), np.ones(len(out))
        loss = np.exp(np.clip(-3.0 * self.code[None, :, :] * out[:, None, :], -30, 30))
        far = (loss * self.trust).sum(axis=2)
        rank = np.sort(far, axis=1)
        return far.argmin(axis=1), (rank[:, 1] - rank[:, 0]) / (rank[:, 1] + rank[:, 0])


def fit(texts: list[str], labels: list[str], held: list[bool]) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages)) if len(languages) > 1 else np.empty((1, 0), np.int64)
    held_out = np.array(held)
    y = np.array([languages.index(x) for x in labels])
    shares = np.zeros((len(languages), DIM))
    for k in range(len(languages)):
        own = np.flatnonzero((y == k) & ~held_out)
        idx, _ = trigrams([texts[i] for i in own])
        counts = np.bincount(idx, minlength=DIM) + 0.5
        shares[k] = counts / counts.sum()
    weights = np.empty((DIM, code.shape[1]))
    for b in range(code.shape[1]):
        weights[:, b] = np.log(shares[code[:, b] > 0].mean(axis=0)) - np.log(shares[code[:, b] < 0].mean(axis=0))
    model = Model(languages, code, weights, np.ones(code.shape[1]), 0.0)
    tests = np.flatnonzero(held_out)
    if not len(tests) or not code.shape[1]:
        return model
    out, solid = model.outputs([texts[i] for i in tests])
    out, truth = out[solid], y[tests][solid]
    if not len(out):
        return model
    scale = np.maximum(np.median(np.abs(out), axis=0), 1e-9)
    right = (np.sign(out) == code[truth]).mean(axis=0)
    model = Model(languages, code, weights / scale, right / right.sum(), 0.0)
    _, margin = model.decode(out / scale)
    mixed = mixtures([texts[i] for i in tests], y[tests])
    if not mixed:
        return model
    blend, solid = model.outputs(mixed)
    _, between = model.decode(blend[solid])
    bar = min(np.quantile(between, MIXTURES_BELOW) if len(between) else 0.0, np.quantile(margin, PURE_BELOW))
    return Model(languages, code, model.weights, model.trust, float(bar))


def mixtures(texts: list[str], y: np.ndarray, seed: int = 7) -> list[str]:
    """PLANTED texts that begin in one language and go on in another, LARGER of their characters in the first."""
    by = [np.flatnonzero(y == k) for k in range(int(y.max()) + 1)] if len(y) else []
    by = [rows for rows in by if len(rows)]
    if len(by) < 2:
        return []
    rng, out = np.random.Generator(np.random.PCG64(seed)), []
    for _ in range(PLANTED):
        i, j = rng.choice(len(by), 2, replace=False)
        a, b = texts[rng.choice(by[i])], texts[rng.choice(by[j])]
        n = min(len(a) / LARGER, len(b) / (1 - LARGER))
        out.append(a[: int(n * LARGER)] + " " + b[: int(n * (1 - LARGER))])
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model fitted on the driver; what comes there is bounded by per_language texts of each language."""
    small = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(lang).alias("y")).where("t IS NOT NULL")
    got = bounded_sample(small, "id", "y", per_language).withColumn("held", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(3)) == 0).orderBy("y", "id", "t").collect()
    return fit([r.t for r in got], [r.y for r in got], [r.held for r in got])


def _judge(model: Model | None, column: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    texts = [t or "" for t in column.to_pylist()]
    if model is None:
        return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    out, solid = model.outputs(texts)
    best, margin = model.decode(out)
    margin = np.where(solid, margin, 0.0)
    return [model.languages[k] if s else None for k, s in zip(best, solid)], margin, solid & (margin >= model.bar) & (margin > 0)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, language, margin, keep), one for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [T.StructField(key, field_type(docs, key)), T.StructField("language", T.StringType()), T.StructField("margin", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, margin, keep = _judge(sent.value, batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(margin), pa.array(keep)], names=schema.fieldNames())

    return map_arrow(docs.select(F.col(key).alias(key), F.col(text).alias("t")), run, schema)


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Rows of docs whose language is told without ambiguity; one pass, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, keep = _judge(sent.value, batch.column(at))
        return batch.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)
