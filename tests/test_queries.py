"""Every query of the engine against its SQL, over whole tables; those without SQL against brute force."""

import math
import random
from collections import Counter

import pytest

import __spark_entry__ as contract
from tokenloom.operators import baselines
from tokenloom.operators.mining import SPECIALS
from tokenloom.queries import ORACLES, QUERIES
from tokenloom.sources import scan


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(contract.queries()[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_entry_has_rows_and_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["token", "freq", "score"]
    assert df.count() == 1000


def test_sql_is_given_for_known_queries_only():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) - set(ORACLES) == {"encode_greedy", "bpe_merges", "wordpiece_vocab", "unigram_vocab", "vocabulary_topk"}


def test_encode_greedy_equals_a_loop(spark, sf_dir, duck):
    from tokenloom.queries import _doc_vocab

    vocab = _doc_vocab(spark, sf_dir)
    longest = max(map(len, vocab))
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for row in contract.queries()["encode_greedy"](spark, sf_dir).collect():
        text, at, want = texts[row.doc_id], 0, []
        while at < len(text):
            piece = next((text[at:e] for e in range(min(len(text), at + longest), at, -1) if text[at:e] in vocab), text[at])
            want.append(vocab.get(piece, vocab["[UNK]"]))
            at += len(piece)
        assert row.ids == want


def test_bpe_merges_are_the_most_frequent_pairs(spark):
    counts = spark.createDataFrame([("abab", 3), ("abc", 2), ("c", 9)], "word string, n bigint")
    _, merges = baselines.bpe(counts, 100, 2)
    # ab: 3 * 2 + 2 = 8, then abab: 3; abc: 2
    assert [tuple(m) for m in merges] == [("a", "b"), ("ab", "ab"), ("ab", "c")]


def test_unigram_query_trains_on_all_documents_without_own_bounds(spark, sf_dir, duck, monkeypatch):
    given = {}
    monkeypatch.setattr(baselines, "unigram", lambda counts, size, **bounds: given.update(bounds, counts=counts) or {"[UNK]": 0.0})
    contract.queries()["unigram_vocab"](spark, sf_dir)
    want = duck.sql(ORACLES["ws_pretokenize_counts"]).fetchall()
    assert sorted(map(tuple, given.pop("counts").collect())) == sorted(want) and not given


def segmentations(word):
    return [[word]] + [[word[:k], *rest] for k in range(1, len(word)) for rest in segmentations(word[k:])] if word else [[]]


def plain_unigram(counted, size, shrink=0.75):
    """EM over written-out segmentations; the pruning as the operator describes it."""
    subs = Counter()
    for w, n in counted:
        for s in range(len(w)):
            for e in range(s + 1, len(w) + 1):
                subs[w[s:e]] += n
    weight = {t: float(n) for t, n in subs.items() if len(t) == 1 or n > 1}
    chars = [t for t in weight if len(t) == 1]
    room = size - len(SPECIALS) - len(chars)
    while True:
        for _ in range(2):
            total, sums = sum(weight.values()), Counter()
            for w, n in counted:
                odds = [(math.prod(weight[p] / total for p in pieces), pieces) for pieces in segmentations(w) if all(p in weight for p in pieces)]
                whole = sum(p for p, _ in odds)
                for p, pieces in odds:
                    for piece in pieces:
                        sums[piece] += n * p / whole
            weight = {t: x for t, x in sums.items() if x >= 0.5 or t in chars} | {c: sums.get(c, 1e-3) for c in chars}
        kept = sorted((t for t in weight if t not in chars), key=lambda t: (-weight[t] * (len(t) - 1 or 1), t))
        if len(kept) <= room:
            return {t: math.log(x / sum(weight.values())) for t, x in weight.items()}
        weight = {t: weight[t] for t in [*kept[: max(room, int(len(kept) * shrink))], *chars]}


def test_unigram_equals_a_plain_em(spark):
    counted = [("walking", 9), ("walked", 7), ("talking", 5), ("talked", 3), ("king", 4), ("talkative", 2), ("a", 6), ("été", 3)]
    got = baselines.unigram(spark.createDataFrame(counted, "word string, n bigint"), 45)
    want = plain_unigram(counted, 45)
    assert [got.pop(s) for s in SPECIALS] == [0.0] * len(SPECIALS)
    assert set(got) == set(want) and any(len(t) > 6 for t in got)
    assert all(abs(got[t] - want[t]) < 1e-6 for t in want)


def test_noise_is_looked_for_in_every_text(spark, tmp_path):
    texts = ["0123456789abcdef" * 3, "plain words", "deadbeef" * 2, None, " ", "Zm9vYmFyYmF6cXV4Zm9vYmFy"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = {r.doc_id: r.kind for r in contract.queries()["noise_classify"](spark, str(tmp_path)).where("part = 'text'").collect()}
    assert [kinds[k] for k in range(6)] == ["<HASH>", None, "<HEX>", None, None, "<B64>"]
    outs = {r.doc_id: r.out for r in contract.queries()["noise_clean"](spark, str(tmp_path)).where("part = 'text'").collect()}
    assert [outs[k] for k in range(6)] == [kinds[k] or t for k, t in enumerate(texts)]


def test_merging_many_words_in_rounds_equals_the_loop(spark, monkeypatch):
    rng = random.Random(4)
    words = {"".join(rng.choice("aabcé#") for _ in range(rng.randint(1, 7))) for _ in range(60)} | {"aaaaaaaa", "\U0001f600b"}
    counts = spark.createDataFrame([(w, rng.randint(1, 9)) for w in sorted(words)], "word string, n bigint").coalesce(1).cache()
    want = baselines.bpe(counts, 50, 2), baselines.wordpiece(counts, 40, 2)
    monkeypatch.setattr(baselines, "MOST_WORDS", 5)
    assert (baselines.bpe(counts, 50, 2), baselines.wordpiece(counts, 40, 2)) == want


def test_a_stream_without_a_split_reads_all_of_them(spark, tmp_path):
    for k, name in enumerate(("train", "test")):
        spark.range(k * 10, k * 10 + 2).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    splits = {n: f"{tmp_path}/{n}" for n in ("train", "test")}
    got = scan.load_dataset(spark, splits, streaming=True)
    got.writeStream.format("memory").queryName("all_splits").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.id for r in spark.table("all_splits").collect()) == [0, 1, 10, 11]


def test_vocabularies_have_the_default_size(spark, sf_dir, monkeypatch):
    sizes = []
    monkeypatch.setattr(baselines, "bpe", lambda counts, size: sizes.append(size) or ({}, [("a", "b")]))
    monkeypatch.setattr(baselines, "wordpiece", lambda counts, size: sizes.append(size) or {"a": 0})
    monkeypatch.setattr(baselines, "unigram", lambda counts, size: sizes.append(size) or {"a": 0.0})
    for name in ("bpe_merges", "wordpiece_vocab", "unigram_vocab"):
        contract.queries()[name](spark, sf_dir)
    assert sizes == [8192] * 3


def test_issues_of_a_large_vocabulary_bring_nothing_to_the_driver(spark, sf_dir, duck, same_rows, monkeypatch):
    with monkeypatch.context() as patched:
        for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
            patched.setattr(type(spark.range(1)), name, lambda *_: pytest.fail("rows came to the driver"))
        found = contract.queries()["artifact_issues"](spark, sf_dir)
    same_rows(found, duck.sql(ORACLES["artifact_issues"]))


@pytest.mark.parametrize("most_parts, size", [(200_000, 260), (40, 40)])
def test_a_round_makes_many_merges(spark, monkeypatch, most_parts, size):
    rng = random.Random(5)
    syllables = ["".join(rng.choice("aeioklmnrst#") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    words = {"".join(rng.choices(syllables, range(60, 0, -1), k=rng.randint(1, 5))) for _ in range(1500)}
    counts = spark.createDataFrame([(w, rng.randint(1, 30)) for w in sorted(words)], "word string, n bigint").cache()
    want = baselines.bpe(counts, size, 2), baselines.wordpiece(counts, size, 2)
    rounds, stored = [], baselines.settled
    monkeypatch.setattr(baselines, "MOST_WORDS", 5)
    monkeypatch.setattr(baselines, "MOST_PARTS", most_parts, raising=False)
    monkeypatch.setattr(baselines, "settled", lambda df: rounds.append(df) or stored(df))
    assert baselines.bpe(counts, size, 2) == want[0]
    assert len(rounds) < len(want[0][1]) // (10 if most_parts > 40 else 1)
    if most_parts > 40:
        assert baselines.wordpiece(counts, size, 2) == want[1]


@pytest.mark.parametrize("least", [1e-280, 1e-3, 2.0])
def test_uses_in_lattices_equal_written_out_segmentations(spark, monkeypatch, least):
    rng = random.Random(7)
    words = {"".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(80)}
    counted = [(w, rng.randint(1, 9)) for w in sorted(words)]
    pieces = [*"abé\U0001f600", "ab", "ba", "aba", "béa", "bb", "aaé\U0001f600", "gone"]
    weight = {t: rng.random() + 0.01 for t in pieces} | {"bb": 0.0}
    monkeypatch.setattr(baselines, "LATTICE_LETTERS", 90)
    monkeypatch.setattr(baselines, "LEAST_ODDS", least)
    total, want = sum(weight.values()), Counter()
    for w, n in counted:
        odds = [(math.prod(weight[p] / total for p in cut), cut) for cut in segmentations(w) if all(weight.get(p) for p in cut)]
        for p, cut in odds:
            for piece in cut:
                want[piece] += n * p / sum(p for p, _ in odds)
    lattices = baselines._lattices(spark.createDataFrame(counted, "word string, n bigint"), pieces)
    rows = lattices.collect()
    assert len(rows) > 3
    into = baselines.np.zeros(len(pieces))
    for row in rows:
        baselines.lattice_uses(*(baselines.np.frombuffer(x, kind) for x, kind in zip(row, baselines._LATTICE.values())), baselines.np.array([weight[t] / total for t in pieces]), into)
    got = dict(zip(pieces, into))
    assert all(abs(got[t] - want[t]) < 1e-9 * (1 + want[t]) for t in pieces)
