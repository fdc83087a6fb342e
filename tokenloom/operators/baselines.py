"""Subword baselines: BPE, WordPiece and Unigram vocabularies over word counts.

Counting words is the part that grows with the data, and it is a distributed aggregation. Up to MOST_WORDS distinct words
merge on the driver. More of them stay distributed: each round counts pairs in Spark, brings the parts of words that the
most frequent pairs hold together to the driver, makes hundreds of merges over them, and stores the merged words; the result
is the same. The Unigram E-step is distributed over the words.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.mining import SPECIALS, spans
from tokenloom.sources.shared import dropped, settled

MOST_WORDS = 400_000
#: Distributed merging: parts of words that come to the driver in a round, words of a first task (of Unigram too), pairs that a task holds before it gives them out.
MOST_PARTS, TASK_WORDS, HELD_PAIRS = 200_000, 50_000, 1_000_000
#: Unigram: letters whose lattices are laid out together.
LATTICE_LETTERS = 100_000


def words(c: Column) -> Column:
    """Runs of word characters and runs of punctuation."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """Rows (left, right, n) of adjacent characters, weighted by word."""
    at = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    cut = at.select(F.substring("word", F.col("i"), F.lit(1)).alias("left"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("right"), "n")
    return cut.groupBy("left", "right").agg(F.sum("n").alias("n"))


def _merged(counts: DataFrame, size: int, min_freq: int, prefix: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    counts, path = settled(counts.select("word", "n"))
    try:
        if counts.count() > MOST_WORDS:
            return _merge_rounds(counts, size, min_freq, prefix)
        return _merge_loop(sorted((r.word, r.n) for r in counts.collect()), size, min_freq, prefix)
    finally:
        dropped(counts.sparkSession, path)


def _merge_loop(counted: list[tuple[str, int]], size: int, min_freq: int, prefix: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    vocab = {t: i for i, t in enumerate(SPECIALS)}
    for ch in sorted({ch for w, _ in counted for ch in w}):
        vocab.setdefault(ch, len(vocab))
    seqs: list[list[int]] = []
    for w, _ in counted:
        seq = []
        for k, ch in enumerate(w):
            piece = prefix + ch if k else ch
            seq.append(vocab.setdefault(piece, len(vocab)))
        seqs.append(seq)
    names = {i: t for t, i in vocab.items()}
    done = _merge_seqs(seqs, [n for _, n in counted], names, vocab, size, max(1, min_freq), prefix)
    return vocab, [(names[left], names[right]) for left, right, _ in done]


def _merge_seqs(seqs: list[list[int]], weights: list[int], names: dict[int, str], vocab: dict[str, int], size: int, least: int, prefix: str, sure: bool = False) -> list[tuple[int, int, int]]:
    """Merges (left, right, new) of the most frequent pairs of at least `least`; sequences, names and vocab grow along.

    With sure, a merge into a token that was there before is the last.
    """
    total: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, (seq, n) in enumerate(zip(seqs, weights)):
        for pair in zip(seq, seq[1:]):
            total[pair] += n
            where[pair].add(k)
    heap = [(-n, pair) for pair, n in total.items()]
    heapq.heapify(heap)
    merges = []
    while len(vocab) < size and heap:
        n, pair = heapq.heappop(heap)
        if -n != total[pair]:
            if total[pair] > 0:
                heapq.heappush(heap, (-total[pair], pair))
            continue
        if -n < least:
            break
        left, right = names[pair[0]], names[pair[1]]
        token = left + right[len(prefix) :] if prefix and right.startswith(prefix) else left + right
        known = token in vocab
        new = vocab.setdefault(token, len(vocab))
        names[new] = token
        merges.append((*pair, new))
        if sure and known:
            break
        grown: set[tuple[int, int]] = set()
        for k in where.pop(pair, ()):
            seq, weight = seqs[k], weights[k]
            i = 0
            while i < len(seq) - 1:
                if (seq[i], seq[i + 1]) != pair:
                    i += 1
                    continue
                for other, step in (((seq[i - 1], seq[i]) if i else None, -1), ((seq[i + 1], seq[i + 2]) if i + 2 < len(seq) else None, -1)):
                    if other:
                        total[other] += step * weight
                seq[i : i + 2] = [new]
                for other in ((seq[i - 1], new) if i else None, (new, seq[i + 1]) if i + 1 < len(seq) else None):
                    if other:
                        total[other] += weight
                        where[other].add(k)
                        grown.add(other)
                i += 1
        total[pair] = 0
        for other in grown:
            heapq.heappush(heap, (-total[other], other))
    return merges


def _merge_rounds(counts: DataFrame, size: int, min_freq: int, prefix: str, ahead: int = 1000) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """_merge_loop over words that stay distributed.

    A round takes the `ahead` most frequent pairs, or fewer, and all as frequent as the last of them, the bar. Words are cut
    wherever another pair stands, and their parts of two symbols or more are counted. These parts come to the driver, at
    most MOST_PARTS of them, and all merges of at least the bar are made there. They are those that whole words would give:
    a token that a round makes is made of the same symbols everywhere, so a pair of tokens stands over one pair of the
    round's first symbols, and its count is whole if that one is not cut, and under the bar if it is. Only a token that was
    there already may be made of others elsewhere, so it ends the round.
    """
    spark = counts.sparkSession
    vocab = {t: i for i, t in enumerate(SPECIALS)}
    counts, spread_path = settled(counts.repartition(min(10_000, -(-counts.count() // TASK_WORDS)), "word"))
    at = counts.select("word", F.posexplode(F.regexp_extract_all("word", F.lit(r"(?s)."), F.lit(0))).alias("k", "ch"))
    first = at.groupBy("ch", (F.col("k") > 0).alias("inner")).agg(F.min(F.struct("word", "k")).alias("at")).collect()  # two rows a character
    for ch in sorted({r.ch for r in first}):
        vocab.setdefault(ch, len(vocab))
    for r in sorted((r for r in first if r.inner), key=lambda r: (r["at"].word, r["at"].k)):
        vocab.setdefault(prefix + r.ch, len(vocab))
    start = dict(vocab)

    def split(words: pa.Array) -> pa.Array:
        return pa.array([[start[prefix + ch if k else ch] for k, ch in enumerate(w)] for w in words.to_pylist()], pa.list_(pa.int32()))

    names, merges, least = {i: t for t, i in vocab.items()}, [], max(1, min_freq)
    seqs, path = settled(counts.where(F.length("word") > 1).select(F.arrow_udf(split, "array<int>")("word").alias("seq"), "n"))
    dropped(spark, spread_path)
    try:
        while len(vocab) < size:
            pairs = seqs.mapInArrow(_pair_sums, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            ranked = [(r.a, r.b, r.n) for r in pairs.orderBy(F.desc("n"), "a", "b").limit(ahead).collect()]
            if not ranked:
                break
            done = _round_merges(seqs, ranked, least if len(ranked) < ahead else ranked[-1][2] + 1, names, vocab, size, prefix)
            merges += [(names[a], names[b]) for a, b, _ in done]
            if len(vocab) < size:
                last = path
                seqs, path = settled(seqs.mapInArrow(_merger(done), "seq array<int>, n bigint"))
                dropped(spark, last)
    finally:
        dropped(spark, path)
    return vocab, merges


def _round_merges(seqs: DataFrame, ranked: list[tuple[int, int, int]], bar: int, names: dict[int, str], vocab: dict[str, int], size: int, prefix: str) -> list[tuple[int, int, int]]:
    """The merges of a round: ranked holds all pairs of at least the bar, which is raised until the parts are few enough."""
    take = len(ranked)
    while True:
        if take < len(ranked):
            bar = max(bar, ranked[take][2] + 1)
        whole = [(a, b) for a, b, n in ranked[:take] if n >= bar]
        # where ties leave no pair over the bar, the first of them merges alone
        parts = seqs.mapInArrow(_cutter(whole or [ranked[0][:2]]), "part array<int>, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
        found = parts.limit(MOST_PARTS + 1).toArrow()
        if len(found) <= MOST_PARTS or not whole:
            break
        take = len(whole) // 2
    cut, weights = found["part"].to_pylist(), found["n"].to_pylist()
    if not whole:
        bar, size = ranked[0][2], min(size, len(vocab) + 1)
    return _merge_seqs(cut, weights, names, vocab, size, bar, prefix, sure=True)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of sequences, none empty: all symbols, the row of each, its pair with the next one as a number, -1 at a row's end, and the rows' n."""
    seqs = batch.column(0)
    flat = seqs.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(seqs)), seqs.value_lengths().to_numpy())
    code = np.full(len(flat), -1, np.int64)
    code[:-1] = np.where(rows[:-1] == rows[1:], flat[:-1] << 32 | flat[1:], -1)
    return flat, rows, code, batch.column(1).to_numpy()


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n by pair, over many batches at a time."""

    def out(codes: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
        c, n = _summed(np.concatenate(codes), np.concatenate(sums))
        return pa.RecordBatch.from_arrays([pa.array((c >> 32).astype(np.int32)), pa.array((c & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    codes, sums, held = [], [], 0
    for batch in batches:
        _, rows, code, n = _codes(batch)
        inside = code >= 0
        c, s = _summed(code[inside], n[rows[inside]])
        codes.append(c)
        sums.append(s)
        held += len(c)
        if held > HELD_PAIRS:
            yield out(codes, sums)
            codes, sums, held = [], [], 0
    if codes:
        yield out(codes, sums)


def _among(code: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each code in the sorted ones, -1 if absent."""
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return np.where(known[at] == code, at, -1)


def _cutter(pairs: list[tuple[int, int]]):
    """Rows (part, n): the runs of a sequence whose neighbours are all among the pairs."""
    known = np.sort(np.array([a << 32 | b for a, b in pairs], np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, rows, code, n = _codes(batch)
            joined = _among(code, known) >= 0
            behind = np.append(False, joined[:-1])
            kept = joined | behind
            first = np.flatnonzero(kept & ~behind)
            ends = np.append(0, np.cumsum(kept))
            offsets = np.append(ends[first], ends[-1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[kept].astype(np.int32))), pa.array(n[rows[first]])], names=["part", "n"])

    return cut


def _merger(merges: list[tuple[int, int, int]]):
    """Rows (seq, n) after the merges, one after another; sequences of one symbol are left out.

    Each pass makes the first merge that a sequence has, everywhere in it, from left to right.
    """
    codes = np.array([a << 32 | b for a, b, _ in merges], np.int64)
    order = np.argsort(codes)
    known, rank, news = codes[order], order, np.array([new for *_, new in merges], np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            while len(batch):
                flat, rows, code, n = _codes(batch)
                at = _among(code, known)
                ranks = np.where(at >= 0, rank[at], len(merges))
                first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                least = np.minimum.reduceat(ranks, first)
                hit = (ranks < len(merges)) & (ranks == least[rows])
                if not hit.any():
                    break
                # of overlapping ones, as in aaa, every other one from the left
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit)))) - 1
                hit &= run % 2 == 0
                flat[hit] = news[ranks[hit]]
                kept = ~np.append(False, hit[:-1])
                flat, rows = flat[kept], rows[kept]
                sizes = np.bincount(rows, minlength=len(n))
                long = sizes > 1
                offsets = np.append(0, np.cumsum(sizes[long])).astype(np.int32)
                batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[long[rows]].astype(np.int32))), pa.array(n[long])], names=["seq", "n"])
            if len(batch):
                yield batch

    return merge


def bpe(counts: DataFrame, size: int, min_freq: int = 10) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and ordered merges: the most frequent adjacent pair merges first, ties by lower ids."""
    return _merged(counts, size, min_freq, "")


def wordpiece(counts: DataFrame, size: int, min_freq: int = 10, prefix: str = "##") -> dict[str, int]:
    """Vocabulary of word beginnings and of pieces that continue a word, which bear the prefix."""
    return _merged(counts, size, min_freq, prefix)[0]


def bpe_encoder(vocab: dict[str, int], merges: list[tuple[str, str]], unk: str = "[UNK]"):
    """Vectorised function from text to ids; words are remembered per worker process."""
    rank = {pair: k for k, pair in enumerate(merges)}
    unknown = vocab.get(unk)

    def word_ids(word: str) -> list[int]:
        parts = list(word)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), math.inf))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        ids = [vocab.get(p, unknown) for p in parts]
        return [i for i in ids if i is not None]

    return _word_encoder(word_ids)


def wordpiece_encoder(vocab: dict[str, int], prefix: str = "##", unk: str = "[UNK]", longest_word: int = 100):
    unknown = vocab.get(unk, 1)

    def word_ids(word: str) -> list[int]:
        out, at = [], 0
        if len(word) > longest_word:
            return [unknown]
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = word[at:end] if not at else prefix + word[at:end]
                if piece in vocab:
                    out.append(vocab[piece])
                    at = end
                    break
            else:
                return [unknown]
        return out

    return _word_encoder(word_ids)


def _word_encoder(word_ids):
    @F.arrow_udf("array<int>")
    def encode(lists: pa.Array) -> pa.Array:
        seen: dict[str, list[int]] = {}
        out = []
        for ws in lists.to_pylist():
            ids = None if ws is None else []
            for w in ws or ():
                if w not in seen:
                    seen[w] = word_ids(w)
                ids.extend(seen[w])
            out.append(ids)
        return pa.array(out, pa.list_(pa.int32()))

    return lambda text: encode(words(text))


def unigram(counts: DataFrame, size: int, longest: int = 16, seeds: int = 100_000, rounds: int = 2, shrink: float = 0.75) -> dict[str, float]:
    """Log probabilities of `size` pieces, specials included: EM over segmentations, the least used pieces pruned.

    Seeds are the `seeds` substrings of most frequency times length, and all characters. The lattices of many words are laid
    out together once and stored; words stay distributed, and what comes to the driver is one number per piece and round.
    """
    spark = counts.sparkSession
    counted, counted_path = settled(counts.select("word", "n"))
    counts, words_path = settled(counted.repartition(min(10_000, -(-counted.count() // TASK_WORDS) or 1), "word"))
    dropped(spark, counted_path)
    subs = spans(counts.withColumnRenamed("word", "piece"), 1, longest).groupBy("token").agg(F.sum("n").alias("n"))
    subs, subs_path = settled(subs.where((F.length("token") == 1) | (F.col("n") > 1)))
    chars = {r.token: r.n for r in subs.where(F.length("token") == 1).collect()}
    multi = subs.where(F.length("token") > 1).orderBy(F.desc(F.col("n") * F.length("token")), "token").limit(seeds)
    weight = {**{r.token: float(r.n) for r in multi.collect()}, **{c: float(n) for c, n in chars.items()}}
    pieces = list(weight)
    lattices, lattices_path = settled(_lattices(counts, pieces))
    try:
        goal = size - len(SPECIALS)
        while True:
            for _ in range(rounds):
                weight = _m_step(_e_step(lattices, pieces, weight), chars)
            kept = [t for t in weight if t not in chars]
            room = goal - len(chars)
            if len(kept) <= room:
                break
            keep = max(room, int(len(kept) * shrink))
            best = sorted(kept, key=lambda t: (-weight[t] * (len(t) - 1 or 1), t))[: max(keep, 0)]
            weight = {**{t: weight[t] for t in best}, **{c: weight.get(c, 1e-3) for c in chars}}
    finally:
        for path in (words_path, subs_path, lattices_path):
            dropped(spark, path)
    total = sum(weight.values())
    ranked = sorted(weight, key=lambda t: (-weight[t], t))[: max(goal, len(chars))]
    return {**{s: 0.0 for s in SPECIALS}, **{t: math.log(weight[t] / total) for t in ranked}}


def _trie(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A trie in arrays: its steps as numbers of node and character in order, of which the one at place i leads to node i + 1, and the piece of each node, -1 for none."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
    first, at = np.cumsum(lengths) - lengths, np.zeros(len(pieces), np.int64)
    keys, nodes = [np.zeros(0, np.int64)], 1
    for k in range(int(lengths.max(initial=0))):
        own = np.flatnonzero(lengths > k)
        found, which = np.unique(at[own] << 21 | chars[first[own] + k], return_inverse=True)
        at[own] = nodes + which
        keys.append(found)
        nodes += len(found)
    # nodes are numbered length by length and in order of their keys, so that all keys are in order
    names = np.full(nodes, -1, np.int32)
    names[at] = np.arange(len(pieces))
    return np.concatenate(keys), names


def _lattices(counts: DataFrame, pieces: list[str]) -> DataFrame:
    """Rows of many words, the longest first: sizes and n of the words and their lattices, in bytes.

    A node is a place in a word; nodes are numbered place by place, and word by word within a place. Pieces are grouped by
    the place where they end and their length: `groups` has both, and how many words have such a piece, `piece` their
    numbers, and `words` which words; -1 stands for all words that reach the place, of which those without a piece have the
    number after the last piece.
    """
    sent = counts.sparkSession.sparkContext.broadcast(_trie(pieces))  # bounded by the number of seeds

    def laid_out(ws: list[tuple[str, int]]) -> pa.RecordBatch:
        (keys, names), none = sent.value, len(pieces)
        ws.sort(key=lambda w: -len(w[0]))
        sizes = np.fromiter((len(w) for w, _ in ws), np.int32, len(ws))
        chars = np.frombuffer("".join(w for w, _ in ws).encode("utf-32-le"), np.uint32).astype(np.int64)
        base = _places(sizes)
        word = np.repeat(np.arange(len(ws)), sizes)
        ends = np.cumsum(sizes.astype(np.int64))[word]
        start, at, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        k = 0
        while len(start):
            code = at << 21 | chars[start + k]
            place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            known = keys[place] == code
            start, at, k = start[known], place[known] + 1, k + 1
            named = names[at] >= 0
            own = start[named]
            before = sizes[word[own]] - (ends[own] - own)
            found.append(((before + k) << 20 | k, word[own], names[at[named]]))
            more = start + k < ends[start]
            start, at = start[more], at[more]
        ends_at, which, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((which, ends_at))
        ends_at, which, piece = ends_at[order], which[order], piece[order]
        first = np.flatnonzero(np.append(True, ends_at[1:] != ends_at[:-1]))
        groups, some, all_pieces = [], [np.zeros(0, np.int64)], []
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(piece)]):
            place, k = divmod(int(ends_at[a]), 1 << 20)
            reach = int(base[place + 1] - base[place])
            if 3 * (z - a) < reach:
                groups.append((place, k, z - a))
                some.append(which[a:z])
                all_pieces.append(piece[a:z])
            else:
                groups.append((place, k, -1))
                dense = np.full(reach, none, np.int32)
                dense[which[a:z]] = piece[a:z]
                all_pieces.append(dense)
        parts = (sizes, np.array([n for _, n in ws]), np.array(groups), np.concatenate(some), np.concatenate(all_pieces))
        return pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(parts, _LATTICE.values())], names=list(_LATTICE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # long words are laid out among themselves, for each place takes a step
        held: dict[bool, list[tuple[str, int]]] = {False: [], True: []}
        letters = {False: 0, True: 0}
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                long = len(w) > 32
                held[long].append((w, n))
                letters[long] += len(w)
                if letters[long] >= LATTICE_LETTERS:
                    yield laid_out(held[long])
                    held[long], letters[long] = [], 0
        for ws in held.values():
            if ws:
                yield laid_out(ws)

    return counts.where("word <> ''").mapInArrow(run, ", ".join(f"{c} binary" for c in _LATTICE))


_LATTICE = {"sizes": np.int32, "n": np.int64, "groups": np.int32, "words": np.int32, "piece": np.int32}


def _places(sizes: np.ndarray) -> np.ndarray:
    """The first node of each place from 0 to the longest word's end, and the number of nodes; sizes fall."""
    longest = int(sizes[0])
    return np.append(0, np.cumsum(np.searchsorted(-sizes, -np.arange(longest + 1), side="right")))


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials along the last axis; -inf where all are."""
    top = x.max(axis=-1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=-1)) + top[..., 0]


def expected_counts(arcs: np.ndarray, n: np.ndarray, logp: np.ndarray, into: np.ndarray) -> None:
    """Adds to `into` the expected uses of each piece over words of one length, n times each. arcs: words by ends by piece lengths."""
    words, size, wide = arcs.shape
    p = logp[arcs]  # the last entry of logp, which -1 takes, is -inf
    forward = np.full((words, size + 1), -np.inf)
    backward = np.full((words, size + 1), -np.inf)
    forward[:, 0] = backward[:, size] = 0.0
    for e in range(1, size + 1):
        k = min(wide, e)
        forward[:, e] = _log_sum(forward[:, e - k : e][:, ::-1] + p[:, e - 1, :k])
    for s in range(size - 1, -1, -1):
        k = min(wide, size - s)
        ends = np.arange(s, s + k)
        backward[:, s] = _log_sum(backward[:, s + 1 : s + k + 1] + p[:, ends, np.arange(k)])
    for k in range(1, wide + 1):
        ends = np.arange(k, size + 1)
        at = forward[:, ends - k] + p[:, ends - 1, k - 1] + backward[:, ends] - forward[:, size][:, None]
        use = np.where(np.isfinite(forward[:, size])[:, None], np.exp(at, where=np.isfinite(at), out=np.zeros_like(at)), 0.0) * n[:, None]
        np.add.at(into, arcs[:, ends - 1, k - 1].ravel(), use.ravel())


#: A word with a piece of less odds than this is counted by logarithms, lest any product fall under what a float holds.
LEAST_ODDS = 1e-280


def _read(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    for row in zip(*batch.columns):
        yield [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, _LATTICE.values())]


def lattice_uses(sizes: np.ndarray, n: np.ndarray, groups: np.ndarray, words: np.ndarray, piece: np.ndarray, prob: np.ndarray, into: np.ndarray) -> None:
    """Adds to `into` the expected uses of each piece over the words of a lattice, n times each."""
    base, p = _places(sizes).tolist(), np.append(prob, 0.0)[piece]
    last = np.array(base)[sizes] + np.arange(len(sizes))
    forward, backward = np.zeros(base[-1]), np.zeros(base[-1])
    forward[: len(sizes)] = 1.0
    through, uses = np.empty(len(p)), np.empty(len(p))
    steps, a, b = [], 0, 0
    for place, k, count in groups.reshape(-1, 3).tolist():
        start, end = base[place - k], base[place]
        if count < 0:
            z = a + base[place + 1] - end
            start, end = slice(start, start + z - a), slice(end, end + z - a)
        else:
            z = a + count
            start, end, b = start + words[b : b + count], end + words[b : b + count], b + count
        through[a:z] = forward[start] * p[a:z]
        forward[end] += through[a:z]
        steps.append((start, end, a, z))
        a = z
    backward[last] = n / np.maximum(forward[last], LEAST_ODDS)
    for start, end, a, z in reversed(steps):
        behind = backward[end]
        np.multiply(through[a:z], behind, out=uses[a:z])
        backward[start] += p[a:z] * behind
    low = np.flatnonzero(((through < LEAST_ODDS) | (uses < LEAST_ODDS)) & (p > 0))
    if len(low):
        node = np.concatenate([np.arange(base[-1])[end] for _, end, _, _ in steps])
        back = np.repeat(groups[1::3], [z - a for _, _, a, z in steps])
        place = np.searchsorted(base, node, side="right") - 1
        word = node - np.array(base)[place]
        chosen = np.unique(word[low])
        own = np.flatnonzero(np.isin(word, chosen))
        uses[own] = 0.0
        own = own[piece[own] < len(prob)]
        _add_by_logs(chosen, sizes, n, word[own], place[own], back[own], piece[own], prob, into)
    into += np.bincount(piece, uses, minlength=len(into) + 1)[:-1]


def _add_by_logs(chosen: np.ndarray, sizes: np.ndarray, n: np.ndarray, word: np.ndarray, place: np.ndarray, back: np.ndarray, piece: np.ndarray, prob: np.ndarray, into: np.ndarray) -> None:
    """The same for chosen words, by logarithms. word, place and back: of each piece in them, its word, the place of its end and its length."""
    with np.errstate(divide="ignore"):
        logp = np.append(np.log(prob), -np.inf)
    sums = np.zeros(len(prob) + 1)
    row = np.full(len(sizes), -1)
    row[chosen] = np.arange(len(chosen))
    own = np.argsort(row[word], kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(row[word[own]], minlength=len(chosen))))
    a = 0
    while a < len(chosen):  # sizes fall, so words of one size stand together
        size, wide = int(sizes[chosen[a]]), int(back[own].max())
        z = min(int(np.searchsorted(-sizes[chosen], -size, side="right")), a + max(1, 500_000 // (size * wide)))
        at = own[ends[a] : ends[z]]
        dense = np.full((z - a, size, min(size, wide)), -1)
        dense[row[word[at]] - a, place[at] - 1, back[at] - 1] = piece[at]
        expected_counts(dense, n[chosen[a:z]].astype(float), logp, sums)
        a = z
    into += sums[:-1]


def _e_step(lattices: DataFrame, pieces: list[str], weight: dict[str, float]) -> dict[str, float]:
    total = sum(weight.values())
    prob = np.array([weight.get(t, 0.0) / total for t in pieces])
    sent = lattices.sparkSession.sparkContext.broadcast(prob)  # bounded by the number of seeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros(len(sent.value))
        for batch in batches:
            for lattice in _read(batch):
                lattice_uses(*lattice, sent.value, into)
        used = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(into[used])], names=["piece", "w"])

    sums = lattices.mapInArrow(run, "piece int, w double").groupBy("piece").agg(F.sum("w").alias("w")).toArrow()
    return {pieces[i]: w for i, w in zip(sums["piece"].to_pylist(), sums["w"].to_pylist())}


def _m_step(expected: dict[str, float], chars: dict[str, int]) -> dict[str, float]:
    out = {t: w for t, w in expected.items() if w >= 0.5 or t in chars}
    for c in chars:
        out.setdefault(c, 1e-3)
    return out


def unigram_encoder(logp: dict[str, float], unk: str = "[UNK]"):
    """Vectorised function from text to ids: the likeliest segmentation; a character outside the pieces becomes `unk`."""
    ids = {t: i for i, t in enumerate(logp)}
    usable = {t: p for t, p in logp.items() if t not in SPECIALS}
    longest = max(map(len, usable), default=1)
    floor = min(usable.values(), default=0.0) - 10
    unknown = ids[unk]

    def word_ids(word: str) -> list[int]:
        n = len(word)
        best = [(0.0, 0, unknown)] + [(-math.inf, 0, unknown)] * n
        for e in range(1, n + 1):
            for s in range(max(0, e - longest), e):
                piece = word[s:e]
                p = usable.get(piece, floor if e - s == 1 else None)
                if p is not None and best[s][0] + p > best[e][0]:
                    best[e] = (best[s][0] + p, s, ids.get(piece, unknown))
        out, at = [], n
        while at:
            out.append(best[at][2])
            at = best[at][1]
        return out[::-1]

    return _word_encoder(word_ids)
