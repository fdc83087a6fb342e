"""Greedy longest-match encoding by a dictionary, and decoding.

The dictionary becomes one regular expression, a trie of optional tails; leftmost matches of it are the longest ones.
Ids are looked up in an Arrow function: by distinct word, or for dictionaries of few longer tokens over whole batches at once.
The dictionary is bounded by the vocabulary size and does not grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Matcher:
    """Trie in arrays: children[state] maps a character to a state, accepts[state] is a token id or -1."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    accepts: list[int] = field(default_factory=lambda: [-1])
    longest: int = 1

    @classmethod
    def of(cls, tokens: Iterable[tuple[str, int]]) -> Matcher:
        """Empty tokens are skipped; of equal tokens the lower id counts."""
        m = cls()
        for token, number in tokens:
            at = 0
            for ch in token:
                if ch not in m.children[at]:
                    m.children[at][ch] = len(m.children)
                    m.children.append({})
                    m.accepts.append(-1)
                at = m.children[at][ch]
            if at:
                m.accepts[at] = number if m.accepts[at] < 0 else min(number, m.accepts[at])
                m.longest = max(m.longest, len(token))
        return m

    def to_dict(self) -> dict:
        return {"trie_next": self.children, "accept": self.accepts, "max_token_len": self.longest, "tie_break": "longer_then_lower_id"}

    @classmethod
    def from_dict(cls, d: Mapping) -> Matcher:
        return cls([{k: int(v) for k, v in c.items()} for c in d["trie_next"]], [int(x) for x in d["accept"]], int(d["max_token_len"]))

    def pattern(self) -> str:
        """Regular expression that matches the longest token at a place."""

        def quoted(ch: str) -> str:
            return re.sub(r"([^\w])", r"\\\1", ch) if ord(ch) < 128 and not ch.isspace() else (f"\\x{{{ord(ch):x}}}" if not ch.isalnum() else ch)

        def below(state: int) -> str:
            tails = [quoted(ch) + below(nxt) for ch, nxt in sorted(self.children[state].items())]
            if not tails:
                return ""
            body = tails[0] if len(tails) == 1 and self.accepts[state] < 0 else "(?:" + "|".join(tails) + ")"
            return body + "?" if self.accepts[state] >= 0 else body

        return below(0)


def trie_tokens(text: Column, vocab: Mapping[str, int]) -> Column:
    """Array of the pieces: tokens, or single characters where none begins."""
    pattern = Matcher.of(vocab.items()).pattern()
    return F.regexp_extract_all(text, F.lit(f"{pattern}|[\\s\\S]" if pattern else r"[\s\S]"), F.lit(0))


#: Up to so many tokens of two characters or more are looked for one by one, all over a batch; the ids are the same either way.
FEW = 64


def encoded(text: Column, vocab: Mapping[str, int], unk: str = "[UNK]") -> Column:
    """Ids of a text. An unknown character becomes the id of `unk`, 1 if the vocabulary lacks it; null gives null."""
    return encoded_arrow(vocab, unk)(text)


def _lowest(vocab: Mapping[str, int]) -> dict[str, int]:
    return {token: int(number) for token, number in vocab.items() if token}


class WordEncoder:
    """Greedy encoding word by word, each distinct word once.

    A text is cut behind the characters that no longer token holds, where greedy matches can't run across. Words and their
    ids are remembered up to `kept` characters. Where there are few longer tokens, each is looked for in all texts at once.
    """

    def __init__(self, vocab: Mapping[str, int], unk: str = "[UNK]", kept: int = 2_000_000) -> None:
        self.ids, self.unknown, self.kept = _lowest(vocab), int(vocab.get(unk, 1)), kept
        inside = {ch for token in self.ids if len(token) > 1 for ch in token}
        cuts = [ch for ch in " \t\n\r,;.:!?()<>[]{}\"'=&/#%|-_" if ch not in inside]
        at = re.escape("".join(cuts))
        self.pieces = re.compile(f"[^{at}]+[{at}]?|[{at}]").findall if cuts else lambda text: [text] if text else []
        self.longer = sorted((token for token in self.ids if len(token) > 1), key=len)
        self.single = np.full(0x110001 if len(self.longer) <= FEW else 0, self.unknown, np.int32)
        for token, number in self.ids.items():
            if len(token) == 1 and len(self.single):
                self.single[ord(token)] = number
        sizes: dict[str, set[int]] = {}
        for token in self.ids:
            sizes.setdefault(token[:2] if len(token) > 1 else token, set()).add(len(token))
        self.sizes = {head: tuple(sorted(found, reverse=True)) for head, found in sizes.items()}
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.letters, self.used = 0, 0
        self.flat = np.empty(1 << 16, np.int32)
        self.starts: list[int] = []
        self.counts: list[int] = []

    def greedy(self, word: str) -> list[int]:
        ids, sizes, out, at, n = self.ids, self.sizes, [], 0, len(word)
        while at < n:
            head = word[at : at + 2]
            found = None
            for size in sizes.get(head, ()) if len(head) > 1 else ():
                found = ids.get(word[at : at + size])
                if found is not None:
                    at += size
                    break
            if found is None:
                found = ids.get(word[at], self.unknown)
                at += 1
            out.append(found)
        return out

    def learn(self, words: list[str]) -> None:
        if self.letters > self.kept:
            self.clear()
        for word in dict.fromkeys(words):
            if word in self.words:
                continue
            ids = self.greedy(word)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.words[word] = len(self.starts)
            self.starts.append(self.used)
            self.counts.append(len(ids))
            self.used += len(ids)
            self.letters += len(word)

    def few(self, texts: pa.Array) -> pa.Array:
        absent = texts.is_null().to_numpy(zero_copy_only=False)
        given = [t or "" for t in texts.to_pylist()]
        most = len(self.longer[-1]) if self.longer else 1
        chars = np.frombuffer(("\0".join(given) + "\0" * most).encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in given), np.int64, len(given)))
        # behind each text stands what is no character, so that no token runs across
        chars[ends - 1] = 0x110000
        chars[len(chars) - most :] = 0x110000
        ids, size = self.single[chars], np.zeros(len(chars), np.int32)
        heads = {ch: np.flatnonzero(chars == ord(ch)) for ch in {token[0] for token in self.longer}}
        named = ids.copy() if self.longer else ids
        for token in self.longer:
            at = heads[token[0]]
            for k in range(1, len(token)):
                at = at[chars[at + k] == ord(token[k])]
            size[at], named[at] = len(token), self.ids[token]
        chosen = _from_the_left(np.flatnonzero(size), size)
        ids[chosen] = named[chosen]
        kept = chars != 0x110000
        for k in range(1, most):
            kept[chosen[size[chosen] > k] + k] = False
        counts = np.add.reduceat(kept, np.append(0, ends[:-1]), dtype=np.int64) if len(given) else np.zeros(0, np.int64)
        upto = np.append(0, np.cumsum(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32(), mask=np.append(absent, False)), pa.array(ids[kept], pa.int32()))

    def __call__(self, texts: pa.Array) -> pa.Array:
        if len(self.single):
            return self.few(texts)
        absent = texts.is_null().to_numpy(zero_copy_only=False)
        split = [[] if t is None else self.pieces(t) for t in texts.to_pylist()]
        flat = [w for ws in split for w in ws]
        self.learn(flat)
        at = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        counts, starts = np.array(self.counts, np.int64)[at], np.array(self.starts, np.int64)[at]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32), pa.int32(), mask=np.append(absent, False)), pa.array(ids, pa.int32()))


def _from_the_left(starts: np.ndarray, size: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Of matches that may overlap, those that are left when each takes its place from the left."""
    chosen = [starts[:0]]
    for _ in range(rounds):
        if not len(starts):
            break
        ends = starts + size[starts]
        free = np.append(True, starts[1:] >= np.maximum.accumulate(ends)[:-1])
        chosen.append(starts[free])
        left = ~free & (starts >= ends[free][np.cumsum(free) - 1])
        starts = starts[left]
    upto, rest = 0, []
    for start, end in zip(starts.tolist(), (starts + size[starts]).tolist()):  # long chains, as of aa in aaaa
        if start >= upto:
            rest.append(start)
            upto = end
    return np.concatenate([*chosen, np.array(rest, np.int64)])


def slices(texts: pa.Array, rows: int = 512, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Start and length of slices of some `size` bytes and at most `rows` texts; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = int(np.searchsorted(ends, before + size, side="right"))
        stop = min(max(stop, start + 1), start + rows, len(texts))
        yield start, stop - start
        start = stop


def encoded_arrow(vocab: Mapping[str, int], unk: str = "[UNK]"):
    """The same as a vectorised function; its price a word does not depend on the size of the vocabulary."""
    known = dict(vocab)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = WordEncoder(known, unk)
        for texts in batches:
            # given out slice by slice: a batch's ids together take several times its texts
            for start, size in slices(texts):
                yield encoder(texts.slice(start, size))
            if not len(texts):
                yield pa.array([], pa.list_(pa.int32()))

    return encode


def decoded(ids: Column, vocab: Mapping[str, int]) -> Column:
    """Tokens of the ids end to end; an unknown id gives nothing. Dense ids are looked up by their place."""
    names = {int(number): token for token, number in vocab.items()}
    top = max(names, default=-1)
    if top < 4 * len(names) and min(names, default=0) >= 0:
        # one literal, which is folded into an array when the query is planned; its separator is in no token
        used = {ch for token in names.values() for ch in token}
        mark = next(ch for ch in map(chr, range(0xE000, 0xF8FF)) if ch not in used)
        places = F.split(F.lit(mark.join(names.get(i, "") for i in range(top + 1))), mark)
        token = lambda i: F.when(i >= 0, F.get(places, i))
    else:
        lookup = F.map_from_arrays(F.lit(list(names)), F.lit(list(names.values())))
        token = lambda i: F.try_element_at(lookup, i)
    return F.array_join(F.transform(ids, lambda i: F.coalesce(token(i), F.lit(""))), "")


def framed(a: Column, b: Column | None = None, cls_id: int = 2, sep_id: int = 3) -> Column:
    """CLS a SEP, or CLS a SEP b SEP."""
    head = F.concat(F.array(F.lit(cls_id)), a, F.array(F.lit(sep_id)))
    return head if b is None else F.concat(head, b, F.array(F.lit(sep_id)))


def segment_ids(a: Column, b: Column | None = None) -> Column:
    """0 over the first sequence and its two marks, 1 over the second and its one."""
    zeros = F.array_repeat(F.lit(0), F.size(a) + 2)
    return zeros if b is None else F.concat(zeros, F.array_repeat(F.lit(1), F.size(b) + 1))


def padded(ids: Column, length: int = 512, pad_id: int = 0) -> Column:
    cut = F.slice(ids, F.lit(1), F.lit(length))
    return F.concat(cut, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(cut)))


def attention(ids: Column, length: int = 512) -> Column:
    used = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))


def unknown_rate(ids: Column, unk_id: int = 1) -> Column:
    return F.size(F.filter(ids, lambda i: i == unk_id)) / F.greatest(F.lit(1), F.size(ids))


def batch(ids: Column, length: int = 512) -> Column:
    """Struct of the three arrays that a model takes, right-padded and right-cut."""
    f = framed(F.slice(ids, F.lit(1), F.lit(length - 2)))
    return F.struct(padded(f, length).alias("input_ids"), attention(f, length).alias("attention_mask"), padded(F.array_repeat(F.lit(0), F.size(f)), length).alias("token_type_ids"))
