"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled quality 1; everything else in the corpus is unlabelled, labels 0 are not
used. Each document becomes FEATURES dense numbers, computed once and kept in the checkpoint folder. A first
classifier, fitted without a hashed half of the positives, tells positives from unlabelled documents; from its scores
over the whole corpus the class prior is estimated as the least ratio of the unlabelled tail to that of the positives left
out (those it was fitted on score too high and would make the prior too low). A network with one hidden layer then minimises
the non-negative unbiased risk

    prior * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - prior * E_P[loss(g, -)])

with the sigmoid loss; where the second term is negative its gradient is reversed. E_U is taken over all documents with
words: each step is one pass over the stored features in which every task sums its rows' losses and gradients, so only a
few hundred numbers come to the driver. E_P is taken over at most POSITIVES trusted documents, drawn by hash.
FIRST_STEPS and STEPS say how many passes the two fits make.

Defined cases: null text is read as empty; a document without words scores 0 and is not kept; without trusted
positives every document with words is kept with score 0.5; a document with labels both 1 and 0 is trusted; a null id is
scored like any other but not trusted; of rows that share a trusted id the one of least features is learned from; repeated
rows score alike, and ties in the score are kept or not together; very long texts are read whole; an empty table gives an
empty result; extra columns cannot clash, for only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import bounded_sample, field_type, if_small, map_arrow, settled, text_bytes

POSITIVES = 4000
HIDDEN = 24
FIRST_STEPS, STEPS = 20, 30
#: A tail must hold this share of the positives for its ratio to count in the prior.
LEAST_TAIL = 0.2

_KINDS = np.full(256, 6, np.int64)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[[9, 13, 32]], _KINDS[10], _KINDS[128:] = 0, 1, 2, 3, 4, 7
_KINDS[[ord(c) for c in ".,;:'\"?()-"]] = 5
#: Frequent function words of some large languages.
_COMMON = frozenset(
    "the of and to a in is that it for was on with be by as this are at from or an not have he we they you i "
    "de la le et les des en un une du que est pour qui dans par sur au pas ce il ne se "
    "der die und das den von zu mit sich auf ist im dem ein eine nicht als auch es "
    "el los y del las por con no su para al lo como más pero sus".split()
)
FEATURES = 18


def features(texts: list[str], body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text; its UTF-8 bytes are body[at[i]:at[i + 1]]."""
    n = len(texts)
    owner = np.repeat(np.arange(n) * 8, np.diff(at))
    kinds = np.bincount(owner + _KINDS[body], minlength=8 * n).reshape(n, 8).astype(np.float64)
    size = np.maximum(kinds.sum(axis=1), 1)
    out = np.zeros((n, FEATURES))
    out[:, :8] = kinds / size[:, None]
    for i, text in enumerate(texts):
        ws = text.split()
        k = len(ws)
        if not k:
            continue
        lines = text.split("\n")
        out[i, 8:] = (
            np.log1p(k),
            (len(text) - k + 1) / k,
            len(set(ws)) / k**0.9,
            sum(map(eq, ws, ws[1:])) / k,
            sum(map(_COMMON.__contains__, ws)) / k,
            text.count("|") / k,
            text.count("!") / k,
            (text.count(". ") + text.count(".\n")) / k,
            1 - len(set(lines)) / len(lines),
            np.log1p(k / len(lines)),
        )
    return out


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, x), one for each row of docs; x is null without words. No shuffle."""
    schema = T.StructType([T.StructField(key, field_type(docs, key)), T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        x = features(texts, *text_bytes(batch.column(1))).astype(np.float32)
        blank = np.array([not t or t.isspace() for t in texts], bool)
        offsets = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), mask=np.append(blank, False))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=schema.fieldNames())

    return map_arrow(docs.select(F.col(key).alias(key), F.col(text).alias("t")), run, schema)


@dataclass
class Net:
    """tanh network with one hidden layer on standardised features; output g > 0 means positive. theta holds w1, b1, w2, b2."""

    mean: np.ndarray
    spread: np.ndarray
    theta: np.ndarray

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        n = len(self.mean) * HIDDEN
        return self.theta[:n].reshape(-1, HIDDEN), self.theta[n : n + HIDDEN], self.theta[n + HIDDEN : -1], self.theta[-1]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts()
        return np.tanh(self.scaled(x) @ w1 + b1) @ w2 + b2

    def sums(self, x: np.ndarray, loss: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Sum of the loss over the rows, and of its gradient by theta."""
        w1, b1, w2, b2 = self.parts()
        z = self.scaled(x)
        h = np.tanh(z @ w1 + b1)
        value, slope = loss(h @ w2 + b2)
        dh = np.outer(slope, w2) * (1 - h * h)
        return np.concatenate([[value.sum()], (z.T @ dh).ravel(), dh.sum(axis=0), h.T @ slope, [slope.sum()]])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sigmoid_loss(sign: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Loss s(-g) of calling a positive (sign 1), or s(g) of a negative (-1), and its slope by g."""
    return lambda g: (sigmoid(-sign * g), -sign * sigmoid(g) * sigmoid(-g))


def log_loss(sign: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    return lambda g: (np.logaddexp(0, -sign * g), -sign * sigmoid(-sign * g))


Total = Callable[[Net, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]], np.ndarray]


def risk(net: Net, positive: np.ndarray, unlabelled: Total, prior: float | None) -> tuple[float, np.ndarray, bool]:
    """Risk, its descent gradient, and whether the second term was negative. prior None: plain log loss, either side counting alike."""
    mean = lambda loss: net.sums(positive, loss) / len(positive)
    if prior is None:
        both = mean(log_loss(1)) + unlabelled(net, log_loss(-1))
        return both[0], both[1:], False
    as_positive, as_negative = prior * mean(sigmoid_loss(1)), prior * mean(sigmoid_loss(-1))
    rest = unlabelled(net, sigmoid_loss(-1)) - as_negative
    if rest[0] >= 0:
        return as_positive[0] + rest[0], as_positive[1:] + rest[1:], False
    return as_positive[0], -rest[1:], True


def fit(start: Net, positive: np.ndarray, unlabelled: Total, prior: float | None, steps: int) -> Net:
    """Full-batch descent by resilient steps: each weight has a step of its own, longer while the gradient keeps its sign."""
    net, size, before = start, np.full(len(start.theta), 0.05), np.zeros(len(start.theta))
    for _ in range(steps):
        _, grad, _ = risk(net, positive, unlabelled, prior)
        grad = grad + 1e-4 * net.theta
        same = grad * before
        size = np.clip(np.where(same > 0, 1.2 * size, np.where(same < 0, 0.5 * size, size)), 1e-6, 0.5)
        grad = np.where(same < 0, 0, grad)
        net = Net(net.mean, net.spread, net.theta - np.sign(grad) * size)
        before = grad
    return net


def fresh_net(mean: np.ndarray, spread: np.ndarray, seed: int = 11) -> Net:
    rng, n = np.random.Generator(np.random.PCG64(seed)), len(mean)
    theta = [rng.normal(0, n**-0.5, n * HIDDEN), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), [0.0]]
    return Net(mean, spread, np.concatenate(theta))


def matrix(column: pa.Array) -> np.ndarray:
    """The feature rows of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)


def summed(feats: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """sums() of all rows' x; every task adds up its own, and the tasks' sums are added in Spark."""
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = matrix(batch.column(0))
            for start in range(0, len(x), 8192):
                total = total + sums(x[start : start + 8192])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    rows = feats.select("x").mapInArrow(run, schema).groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r.value for r in sorted(rows)])


def over_all(feats: DataFrame, rows: float) -> Total:
    return lambda net, loss: summed(feats, lambda x: net.sums(x, loss)) / rows


def _score(feats: DataFrame, net: Net, key: str, column: str) -> DataFrame:
    sent = feats.sparkSession.sparkContext.broadcast(net)
    kept = [f for f in feats.schema if f.name != "x"]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("x")
        there = column.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(batch.num_rows)
        if there.any():
            out[there] = sigmoid(sent.value(matrix(column.drop_null())))
        return pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(out, mask=~there)], names=schema.fieldNames())

    return map_arrow(feats, run, schema)


def prior_of(all_bins: np.ndarray, trusted_bins: np.ndarray) -> float:
    """Estimated share of positives, from counts by score of the whole corpus and of trusted positives: least ratio of the tails above any score."""
    u, p = (np.cumsum(bins[::-1]).astype(float) for bins in (all_bins, trusted_bins))
    if not u[-1] or not p[-1]:
        return 1.0
    tail = (p / p[-1] >= LEAST_TAIL) & (p > 0)
    # the upper end of each ratio's error keeps a chance dip from deciding
    ratio = (u / u[-1]) / np.maximum(p / p[-1], 1e-9) * (1 + 1 / np.sqrt(np.maximum(p, 1)))
    return float(min(ratio[tail].min(), 1.0))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", positives: int = POSITIVES) -> DataFrame:
    """Rows (key, score, keep), one for each row of docs; keep: score >= 0.5."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("t_id")).distinct()
    feats = settled(featured(docs, key, text))
    usable = feats.where(F.col("x").isNotNull())
    # the ids of few documents are labelled; their feature rows are the only ones that are joined
    known = settled(usable.join(if_small(settled(trusted), 16), F.col(key) == F.col("t_id"), "left_semi").groupBy(key).agg(F.min("x").alias("x")))
    chosen = bounded_sample(known.withColumn("s", F.lit(1)), key, "s", positives)
    left_out = F.pmod(F.xxhash64(F.lit(9), F.col(key)), F.lit(2)) == 0
    got = chosen.select("x", left_out.alias("left_out")).orderBy(key).collect()
    pos = np.array([r.x for r in got], np.float64)
    if not len(pos):
        return feats.select(F.col(key), F.when(F.col("x").isNotNull(), 0.5).otherwise(0.0).alias("score"), F.col("x").isNotNull().alias("keep"))
    aside = np.array([r.left_out for r in got])
    if aside.all() or not aside.any():
        aside = np.zeros(len(pos), bool)
    moments = summed(usable, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n, mean, square = moments[0], moments[1 : FEATURES + 1] / moments[0], moments[FEATURES + 1 :] / moments[0]
    everything = over_all(usable, n)
    first = fit(fresh_net(mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1e-3), pos[~aside], everything, None, FIRST_STEPS)
    # the tail ratio needs the positives' scores and the whole corpus's, in 200 bins each
    bins = summed(usable, lambda x: np.bincount((sigmoid(first(x)) * 200).astype(np.int64), minlength=201).astype(float))
    held = pos[aside] if aside.any() else pos
    prior = prior_of(bins, np.bincount((sigmoid(first(held)) * 200).astype(np.int64), minlength=201).astype(float))
    net = fit(first, pos, everything, prior, STEPS)
    scored = _score(feats, net, key, "score")
    return scored.select(F.col(key), F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("score", F.lit(0.0)) >= 0.5).alias("keep"))
