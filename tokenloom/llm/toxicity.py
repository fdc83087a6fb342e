"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are lexicon densities (a fixed list of insults, plain and disguised, and a list learned from the labels),
second-person proximity of the hits, capitals, punctuation and obfuscation rates. The learned list holds the words and
word beginnings that occur in at least LEAST_DOCS toxic fitting documents and there LEAST_ODDS times as often as in the
clean ones, at most LEARNED_MOST; it covers languages and slurs that the fixed list lacks. Trees of depth 3 are boosted on log loss over binned features; a held-out third
of the labelled documents calibrates the scores by pool-adjacent-violators, and a document is toxic if its
calibrated probability is at least THRESHOLD. Fitting uses at most PER_CLASS labelled documents of either class;
every document is then read whole and scored in one pass without a shuffle.

Defined cases: null and empty text score like a text without words: its features are all 0; very long texts are read
whole; repeated rows score alike, and a score of just the threshold is toxic; a label row without a document, or with a null id or label, is not learned from;
of contradictory labels of one document the toxic one counts; without labels of both classes the score is null and
toxic false; an empty table gives an empty result; only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import bounded_sample, field_type, map_arrow_with, settled, text_bytes

PER_CLASS = 4000
THRESHOLD = 0.5
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 48

#: Insults of some large languages; a parameter of features().
LEXICON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool foolish loser losers scum scumbag trash garbage "
    "worthless pathetic disgusting clown clowns jerk creep freak pig pigs swine vermin coward liar imbecile cretin dimwit "
    "halfwit nitwit retard retarded bastard bastards bitch asshole shit shitty crap crappy fuck fucking fucker "
    "douchebag prick cunt whore slut hateful sucker useless repulsive filthy filth ignorant "
    "abruti abrutie crétin débile imbécile connard connasse salaud salope merde ordure minable pourri dégoûtant "
    "dummkopf blödmann arschloch scheiße scheisse trottel depp vollidiot abschaum wertlos erbärmlich widerlich dreck hure "
    "idiota imbécil estúpido estúpida tonto tonta basura escoria inútil asqueroso asquerosa mierda cabrón gilipollas payaso perdedor".split()
)
SECOND = frozenset("you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes tú ti tus vosotros".split())

_LEET = str.maketrans("013457@$!|€", "oieastasiie"[:11])
_EDGES = "\"'.,;:!?()[]{}<>-_*#%&$@~`/\\|…«»“”‘’¡¿"
_SQUEEZE = re.compile(r"(.)\1{2,}")
_JOINERS = re.compile(r"[\W_]+")
HIT, HIDDEN, YOU, CAPS, SHOUT, MIXED, STRETCHED, SINGLE, ASKS, LEARNED = (1 << k for k in range(10))
FEATURES = 23
LEAST_DOCS, LEAST_ODDS = 5, 20.0
#: Lengths of the word beginnings that are tried for the learned list.
STEMS = (5, 6, 7, 8)
#: Words and word beginnings that the learned list holds at most, the most telling ones.
LEARNED_MOST = 5000
#: Letters of the tokens that a worker remembers; bounds its memory, not the result.
LETTERS_KEPT = 6_000_000


class Masks(dict):
    """Mask of each token, worked out at first use."""

    letters = 0

    def __init__(self, learned: frozenset[str]) -> None:
        self.learned = learned
        #: Bits of the words that are known as they stand.
        self.known = {w: (w in learned and LEARNED) | (w in SECOND and YOU) | (w in LEXICON and HIT) for w in {*learned, *SECOND, *LEXICON} if not w.endswith("*")}
        #: Beginnings of the learned word beginnings, which are all at least so long.
        self.heads = {w[: STEMS[0]] for w in learned if w.endswith("*")}
        self.head_set, self.known_set = pa.array(sorted(self.heads), pa.string()), pa.array(list(self.known), pa.string())
        self.known_bits = np.array([*self.known.values(), 0], np.int16)

    def __missing__(self, token: str) -> int:
        if self.letters > LETTERS_KEPT:
            self.clear()
            self.letters = 0
        self.letters += len(token)
        got = self[token] = self.mask(token)
        return got

    def mask(self, token: str) -> int:
        core = token.strip(_EDGES)
        low = core.lower()
        mask = self.known.get(low, 0)
        if low[: STEMS[0]] in self.heads and any(low[:k] + "*" in self.learned for k in STEMS if k < len(low)):
            mask |= LEARNED
        if core is not token and core != token:
            mask |= ("!" in token and SHOUT) | ("?" in token and ASKS)
        if low != core and len(core) > 1 and core.isupper():
            mask |= CAPS
        if mask & HIT:
            return mask
        if len(low) == 1:
            return mask | (low.isalpha() and SINGLE)
        if not low.isalpha() and any(map(str.isalpha, low)):
            mask |= MIXED
            if _JOINERS.sub("", low.translate(_LEET)) in LEXICON or _JOINERS.sub("", low) in LEXICON or _JOINERS.sub("", token.lower().translate(_LEET)) in LEXICON:
                mask |= HIDDEN
        if _SQUEEZE.search(low):
            mask |= STRETCHED
            if _SQUEEZE.sub(r"\1", low) in LEXICON or _SQUEEZE.sub(r"\1\1", low) in LEXICON:
                mask |= HIDDEN
        return mask


def _spelled(tokens: pa.Array, masks: np.ndarray) -> int:
    """Insults spelled out in single letters."""
    at = np.flatnonzero(masks & SINGLE)
    if len(at) < 3:
        return 0
    bounds = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    sizes = np.diff(bounds, append=len(at))
    runs = [at[b : b + n] for b, n in zip(bounds.tolist(), sizes.tolist()) if n >= 3]
    return sum("".join(w.strip(_EDGES) for w in tokens.take(pa.array(run)).to_pylist()).lower() in LEXICON for run in runs)


def token_masks(words: pa.Array, masks: Masks) -> np.ndarray:
    """Masks of distinct tokens: column by column for plain ASCII words, and by Masks for the others."""
    core = pc.utf8_trim(words, characters=_EDGES)
    low = pc.ascii_lower(core)
    true = lambda x: x.to_numpy(zero_copy_only=False)
    size = true(pc.utf8_length(low))
    plain = true(pc.string_is_ascii(words)) & true(pc.ascii_is_alpha(low)) & (size > 1) & ~_tripled(low)
    plain &= ~true(pc.is_in(pc.utf8_slice_codeunits(low, 0, STEMS[0]), value_set=masks.head_set))
    found = true(pc.fill_null(pc.index_in(low, value_set=masks.known_set), len(masks.known_bits) - 1))
    out = masks.known_bits[found]
    out |= true(pc.ascii_is_upper(core)).astype(np.int16) * CAPS
    out |= true(pc.match_substring(words, "!")).astype(np.int16) * SHOUT
    out |= true(pc.match_substring(words, "?")).astype(np.int16) * ASKS
    rest = np.flatnonzero(~plain)
    out[rest] = np.fromiter(map(masks.__getitem__, words.take(pa.array(rest)).to_pylist()), np.int16, len(rest))
    return out


def _tripled(words: pa.Array) -> np.ndarray:
    """Which words hold a byte three times in a row."""
    body, at = text_bytes(words)
    out = np.zeros(len(words), bool)
    if len(body) > 2:
        runs = np.flatnonzero((body[2:] == body[1:-1]) & (body[1:-1] == body[:-2]))
        owner = np.searchsorted(at, runs, side="right") - 1
        out[owner[at[owner + 1] >= runs + 3]] = True
    return out


#: Bits that are counted over all tokens of a text, and the column of each count's share.
_TALLIED = ((YOU, 11), (CAPS, 12), (SHOUT, 13), (ASKS, 14), (MIXED, 15), (STRETCHED, 16), (SINGLE, 17))
_PERCENT = [11, 16]
#: Characters that are counted: 1 for exclamation marks, 2 for those that stand for letters.
_MARKS = np.zeros(256, np.uint8)
_MARKS[ord("!")], _MARKS[[ord(c) for c in "#$%&*@"]] = 1, 2


def features(texts: pa.Array | list[str | None], masks: Masks) -> np.ndarray:
    """One row of FEATURES numbers for each text. All texts are cut and counted at once; only those with a hit are looked at one by one."""
    column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    out = np.zeros((len(column), FEATURES))
    if not len(column):
        return out
    split = pc.utf8_split_whitespace(column)
    tokens = split.flatten()
    solid = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), split.value_lengths().to_numpy())[solid]
    tokens = tokens.filter(pa.array(solid))
    if not len(tokens):
        return out
    coded = tokens.dictionary_encode()
    flat = token_masks(coded.dictionary, masks)[coded.indices.to_numpy()]
    rows, starts = np.unique(owner, return_index=True)
    ends = np.append(starts[1:], len(owner))
    n = (ends - starts).astype(float)
    for bit, at in _TALLIED:
        out[rows, at] = np.add.reduceat((flat & bit) != 0, starts, dtype=np.int64) / n
    out[:, _PERCENT] *= 100
    body, at = text_bytes(column)
    marks = _MARKS[body]
    marked = np.flatnonzero(marks)
    of = np.searchsorted(at, marked, side="right") - 1
    each = np.bincount(of * 3 + marks[marked], minlength=3 * len(column)).reshape(-1, 3)[rows]
    count = lambda what: pc.count_substring(column, what).to_numpy()[rows].astype(float)
    chars = pc.utf8_length(column).to_numpy()[rows].astype(float)
    out[rows, 18] = each[:, 1] / chars
    out[rows, 19] = count("!!") + count("??")
    out[rows, 20] = each[:, 2] / chars
    out[rows, 21] = np.log1p(n)
    out[rows, 22] = chars / n
    found = np.bitwise_or.reduceat(flat, starts)
    singles = np.add.reduceat((flat & SINGLE) != 0, starts, dtype=np.int64) >= 3
    for k in np.flatnonzero((found & (HIT | HIDDEN | LEARNED) != 0) | singles).tolist():
        out[rows[k], :11] = _hit_features(tokens.slice(starts[k], ends[k] - starts[k]), flat[starts[k] : ends[k]])
    return out


def _hit_features(tokens: pa.Array, m: np.ndarray) -> tuple[float, ...]:
    """The features that depend on hits: 0 where there is none."""
    n = len(tokens)
    spelled = _spelled(tokens, m)
    plain, hidden = np.flatnonzero(m & HIT), np.flatnonzero(m & HIDDEN)
    you = np.flatnonzero(m & YOU)
    taught = np.flatnonzero(m & LEARNED)
    hits = np.flatnonzero(m & (HIT | HIDDEN | LEARNED))
    count = len(hits) + spelled
    words = lambda at: {w.strip(_EDGES).lower() for w in tokens.take(pa.array(at)).to_pylist()} if len(at) else ()
    near = 0.0
    if len(hits) and len(you):
        right = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(right, len(you) - 1)]), np.abs(hits - you[np.maximum(right - 1, 0)]))
        near = float((1 / (1 + gap)).sum())
    dense = 0
    if len(hits):
        dense = int((np.searchsorted(hits, hits + 50) - np.arange(len(hits))).max())
    return (
        100 * len(plain) / n,
        100 * (len(hidden) + spelled) / n,
        100 * count / n,
        np.log1p(count),
        np.log1p(len(words(hits))),
        100 * len(taught) / n,
        np.log1p(len(taught)),
        np.log1p(len(words(taught))),
        dense,
        near,
        100 * near / n,
    )


@dataclass
class Model:
    """Each tree: split features and bars by level order (2 ** DEPTH - 1 of them), and 2 ** DEPTH leaf values."""

    base: float
    splits: np.ndarray
    bars: np.ndarray
    leaves: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    learned: frozenset[str] = frozenset()

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.splits, self.bars, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.interp(raw, self.knots, self.levels) if len(self.knots) else 1 / (1 + np.exp(-raw))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the increasing step function of least squares, ties in the score pooled first."""
    values, where = np.unique(score, return_inverse=True)
    size = np.bincount(where).astype(float)
    blocks: list[list[float]] = []
    for v, total, weight in zip(values, np.bincount(where, weights=y), size):
        blocks.append([total, weight, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2], high]
    knots = [k for b in blocks for k in (b[2], b[3])]
    levels = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(knots), np.array(levels)


def _tree(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy tree on binned features: split features, last left bins, and leaf values."""
    inner = 2**DEPTH - 1
    split, bar, node = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(binned), np.int64)
    width = binned.shape[1]
    for level in range(DEPTH):
        for k in range(2**level - 1, 2 ** (level + 1) - 1):
            rows = np.flatnonzero(node == k)
            cells = (binned[rows] + np.arange(width) * (BINS + 1)).ravel()
            g, h = (np.bincount(cells, weights=np.repeat(s[rows], width), minlength=width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for s in (grad, hess))
            gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
            gain[(h < 2) | (h[:, -1:] - h < 2)] = 0
            best = np.unravel_index(gain.argmax(), gain.shape)
            if gain[best] > 1e-6:
                split[k], bar[k] = best
        node = 2 * node + 1 + (binned[np.arange(len(binned)), split[node]] > bar[node])
    leaf = node - inner
    g, h = (np.bincount(leaf, weights=s, minlength=inner + 1) for s in (grad, hess))
    return split, bar, RATE * -g / (h + 1)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model | None:
    own = ~held
    if len(set(y[own].tolist())) < 2:
        return None
    edges = [np.unique(np.quantile(x[own, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[own, f], side="left") for f, e in enumerate(edges)], axis=1)
    goal = y[own].astype(float)
    base = float(np.log(goal.mean() / (1 - goal.mean())))
    raw, splits, bars, leaves = np.full(len(goal), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        split, bar, leaf = _tree(binned, p - goal, p * (1 - p) + 1e-6)
        bars.append([edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(split, bar)])
        splits.append(split)
        leaves.append(leaf)
        one = Model(0.0, np.array([split]), np.array(bars[-1:]), np.array([leaf]), np.empty(0), np.empty(0))
        raw += one.raw(x[own])
    model = Model(base, np.array(splits), np.array(bars), np.array(leaves), np.empty(0), np.empty(0))
    if len(set(y[held].tolist())) == 2:
        model.knots, model.levels = isotonic(model.raw(x[held]), y[held].astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model | None:
    """A model fitted on the driver; what comes there is bounded: FEATURES numbers for 2 * per_class documents."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("y"))
    chosen = settled(bounded_sample(marked, "l_id", "y", per_class))
    # at most 2 * per_class rows by construction
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("l_id"))
    rows = settled(rows.select("id", "y", "t", (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(3)) == 0).alias("held")))
    learned = lexicon(rows.where("NOT held"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "t"), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        masks = Masks(learned)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(batch.column("t"), masks)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "y", "held")), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "held", "x"])

        return run

    got = map_arrow_with(rows, make, schema).orderBy("id", "x").collect()
    if not got:
        return None
    model = fit(np.array([r.x for r in got]), np.array([r.y for r in got]), np.array([r.held for r in got]))
    if model is not None:
        model.learned = learned
    return model


def lexicon(rows: DataFrame, most: int = LEARNED_MOST) -> frozenset[str]:
    """Telling words, and word beginnings marked by a star, of rows (id, y, t)."""
    words = F.array_distinct(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"))
    stems = [F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.left(w, F.lit(k)), F.lit("*"))) for k in STEMS]
    terms = rows.select("y", F.explode(F.array_distinct(F.flatten(F.array(words, *stems)))).alias("term")).where("length(term) > 2")
    sizes = rows.agg(F.sum("y").alias("toxic"), F.count("*").alias("all")).first()
    if not sizes["toxic"]:
        return frozenset()
    toxic, clean = sizes["toxic"], sizes["all"] - sizes["toxic"]
    seen = terms.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = ((F.col("a") + 0.5) / (toxic + 1)) / ((F.col("b") + 0.5) / (clean + 1))
    best = seen.where((F.col("a") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).orderBy(odds.desc(), "term").limit(most)
    return frozenset(r.term for r in best.collect())


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, score, toxic), one for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, field_type(docs, key)), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        got = sent.value
        masks = Masks(got.learned if got else frozenset())

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            if got is None:
                p, flag = pa.nulls(n, pa.float64()), np.zeros(n, bool)
            else:
                p = got.probability(features(batch.column(1), masks))
                flag = p >= threshold
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(flag)], names=schema.fieldNames())

        return run

    return map_arrow_with(docs.select(F.col(key).alias(key), F.col(text).alias("t")), make, schema)
