r"""BPE encoding and decoding by speculation and verification.

A text is split by the vocabulary's pattern into words. For each new distinct word, greedy longest match proposes
tokens. A sequence of tokens is the BPE encoding of its bytes if and only if every adjacent pair of tokens is
compatible, that is, the pair's bytes encode to just that pair; all adjacent pairs of all proposed words are looked
up at once in a sorted table of pairs judged so far. Only words with an incompatible pair are merged exactly,
and only pairs never seen before are judged by exact merging.

Defined cases: null text gives null ids, a null count and a null `exact`; empty text gives no ids; texts are
encoded whole, however long; strings of special tokens are ordinary text; repeated rows get equal ids; decoding an
id outside the vocabulary is an error, a vocabulary that lacks a byte is refused, pairs of equal rank merge from the left, a null list gives null, and bytes that are not UTF-8 become U+FFFD; an empty
table gives an empty result. Only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import field_type, map_arrow_with, text_bytes

#: Vocabulary file in rank format; every line holds a token in base 64 and its rank.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SHAPE = r"'(?:[stmd]|re|ve|ll)| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+"
#: Below U+0240 the classes are short enough to spell out for the faster engine.
_LOW = 0x240
#: First UTF-8 byte of U+0240.
_LOW_BYTE = 0xC9


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LOW) if unicodedata.category(chr(c))[0] == kind)


_LATIN = re.compile(_SHAPE.format(L=_class("L"), N=_class("N"), W=_WS))
_ANY = regex.compile(_SHAPE.format(L=r"\p{L}", N=r"\p{N}", W=_WS))

#: Distinct words, their letters, and pairs that a worker remembers before it starts anew; bounds its memory, not the result.
WORDS_KEPT = 600_000
LETTERS_KEPT = 8_000_000
PAIRS_KEPT = 500_000


class Encoder:
    def __init__(self, ranks_file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ranks.items()}
        lacking = [b for b in range(256) if bytes([b]) not in self.ranks]
        if lacking:
            raise ValueError(f"the vocabulary has no token for {len(lacking)} of the 256 bytes, such as {lacking[0]}")
        size = max(self.tokens) + 1
        self.width = np.fromiter((len(self.tokens.get(i, b"")) for i in range(size)), np.int64, size)
        self.offset = np.cumsum(self.width) - self.width
        self.body = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.longest: dict[bytes, int] = {}
        for token in self.ranks:
            head = token[:3]
            self.longest[head] = max(self.longest.get(head, 1), len(token))
        self.words: dict[str, int] = {}
        self.letters = 0
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.pairs = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.merged_exactly = 0

    def split(self, text: str, latin: bool) -> list[str]:
        return (_LATIN if latin else _ANY).findall(text)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the adjacent pair of least rank merges first, the leftmost on a tie."""
        get, none = self.ranks.get, 1 << 40
        cuts = list(range(len(word) + 1))
        # rank[i] is that of the piece from cuts[i] to cuts[i + 2]
        rank = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while rank and (best := min(rank)) < none:
            i = rank.index(best)
            del cuts[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(word[cuts[i] : cuts[i + 2]], none)
            if i:
                rank[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
        return [get(word[a:b]) for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, word: bytes) -> list[int]:
        """The same for long words, with a heap: n log n where merge() is quadratic."""
        ranks, n = self.ranks, len(word)
        piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if piece[i] is not None else n
            if j >= n or piece[i] is None or len(piece[i]) + len(piece[j]) != size:
                continue
            piece[i], piece[j] = piece[i] + piece[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                    heapq.heappush(heap, (r, a, len(piece[a]) + len(piece[b])))
        return [ranks[p] for p in piece if p is not None]

    def exact(self, word: bytes) -> list[int]:
        return self.merge(word) if len(word) <= 64 else self.merge_long(word)

    def greedy(self, word: bytes) -> list[int]:
        ranks, longest, out, at, n = self.ranks, self.longest, [], 0, len(word)
        while at < n:
            end = min(n, at + longest.get(word[at : at + 3], 2))
            while (token := ranks.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair left << 32 | right, whether its bytes encode to just that pair."""
        wanted = np.unique(pairs)
        at = np.searchsorted(self.pairs, wanted)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == wanted[known]
        new = wanted[~known]
        if len(new):
            verdicts = [
                self.exact(self.tokens[left] + self.tokens[right]) == [left, right]
                for left, right in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist())
            ]
            pairs_all = np.concatenate([self.pairs, new])
            order = np.argsort(pairs_all, kind="stable")
            self.pairs, self.fits = pairs_all[order], np.concatenate([self.fits, np.array(verdicts, bool)])[order]
        return self.fits[np.searchsorted(self.pairs, pairs)]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not remembered yet."""
        if len(self.words) > WORDS_KEPT or self.letters > LETTERS_KEPT:
            self.letters = 0
            self.words, self.flat, self.starts, self.sizes = {}, np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if not new:
            return
        raw = [w.encode() for w in new]
        guesses = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(new)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs = ((flat[:-1] << 32) | flat[1:])[inside]
        if len(pairs):
            wrong = np.unique(owner[1:][inside][~self.compatible(pairs)])
            if len(wrong):
                for k in wrong.tolist():
                    guesses[k] = self.exact(raw[k])
                self.merged_exactly += len(wrong)
                sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
                flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        first = len(self.words)
        self.words.update(zip(new, range(first, first + len(new))))
        self.letters += sum(map(len, new))
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str], latin: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        split = [self.split(t, low) for t, low in zip(texts, latin)]
        words = [w for ws in split for w in ws]
        self.learn(words)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.cumsum([len(ws) for ws in split])] if split else np.empty(0, np.int64)
        return ids, np.diff(upto, prepend=0)

    def decodes_to(self, ids: np.ndarray, counts: np.ndarray, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the ids of each text, counts of them, are the bytes body[at[i]:at[i + 1]]."""
        width = self.width[ids]
        ends = np.cumsum(width)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if not len(ids) or ends[-1] != len(body) or not np.array_equal(upto, at):
            # some text decodes to another length: text by text
            each = np.concatenate([[0], np.cumsum(counts)])
            return np.array([self.decode(ids[a:b].tolist()) == body[c:d].tobytes() for a, b, c, d in zip(each, each[1:], at, at[1:])], bool)
        made = self.body[np.repeat(self.offset[ids] - (ends - width), width) + np.arange(int(ends[-1]))]
        wrong = np.concatenate([[0], np.cumsum(made != body)])
        return wrong[at[1:]] == wrong[at[:-1]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _shared(df: DataFrame, ranks: str):
    with open(ranks, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """Rows (key, ids, n_tokens, exact), one for each row of docs; exact: the ids decode to the text. No shuffle.

    The vocabulary file (its size is the vocabulary's, whatever the data) is read on the driver and sent to each executor once.
    """
    sent = _shared(docs, ranks)
    schema = T.StructType(
        [
            T.StructField(key, field_type(docs, key)),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("exact", T.BooleanType()),
        ]
    )

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        enc = Encoder(sent.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(1)
            body, at = text_bytes(column)
            texts = ["" if t is None else t for t in column.to_pylist()]
            high = np.concatenate([[0], np.cumsum(body >= _LOW_BYTE)])
            ids, counts = enc.encode(texts, (high[at[1:]] == high[at[:-1]]).tolist())
            exact = enc.decodes_to(ids, counts, body, at)
            absent = column.is_null().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32(), mask=np.append(absent, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(counts.astype(np.int32), mask=absent), pa.array(exact, pa.bool_(), mask=absent)],
                names=schema.fieldNames(),
            )

        return run

    return map_arrow_with(docs.select(F.col(key).alias(key), F.col(text).alias("t")), make, schema)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """Rows (key, text) from rows with ids; no shuffle."""
    sent = _shared(encoded, ranks)
    schema = T.StructType([T.StructField(key, field_type(encoded, key)), T.StructField("text", T.StringType())])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        enc = Encoder(sent.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else enc.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.fieldNames())

        return run

    return map_arrow_with(encoded.select(F.col(key).alias(key), F.col(ids).alias("x")), make, schema)
