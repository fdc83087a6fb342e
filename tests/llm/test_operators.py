"""The ten operators against brute force, and on null, empty, long, tied, repeated and clashing rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import bpe, common, langid, linededup, lsh, multiset, pareto, quality_pu, shardtree, simhash, toxicity

#: Extra columns bear names that operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, copies string, m_rate string, m_join int, k_text int, k_hits string, s_place int, language string, hi int, t string, x double, key string, held boolean"
DOCS = "doc_id", "text", "lang", "source", "n_chars"


def table_of(spark, rows):
    """Documents from (doc_id, text, lang, source), with the clashing columns filled."""
    full = [(i, t, lang, s, None if t is None else len(t), 7, "c", "r", 1, 2, "h", 3, "l", 4, "t", 0.5, "k", True) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, words="the of and river stone walks under bright morning light over hills where birds sing and people talk about bread wine"):
    rng = random.Random(seed)
    return " ".join(rng.choice(words.split()) + rng.choice(["", "", "ly", "ed", str(seed)]) for _ in range(n))


@pytest.fixture(scope="module")
def messy(spark):
    long_text = "\n".join(prose(k, 60) for k in range(400))
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, None),
        (4, "!!! ... ???", "en", None),
        (5, long_text, "en", "b"),
        (6, long_text, "en", "b"),
        (7, prose(7, 50), "en", "a"),
        (7, prose(7, 50), "en", "a"),
        (None, prose(9, 40), "en", "a"),
        (None, None, None, None),
        (8, "naïve \U0001f600 漢字 é \x00 end", "fr", "c"),
        (9, "x", "en", "c"),
    ]
    return table_of(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(messy):
    return messy.where("false")


LABELS = "doc_id bigint, quality int, toxic int"

APPLIED = {
    "quality": lambda d, lab: quality_pu.classify(d, lab),
    "fingerprints": lambda d, lab: multiset.equal_sets(multiset.fingerprint(d)),
    "toxicity": lambda d, lab: toxicity.score(d, toxicity.train(d, lab)),
    "sharding": lambda d, lab: shardtree.assign(d),
    "simhash": lambda d, lab: simhash.groups(d),
    "simhash_deduped": lambda d, lab: simhash.deduped(d),
    "language": lambda d, lab: langid.identify(d, langid.train(d)),
    "accepted": lambda d, lab: langid.accepted(d, langid.train(d)),
    "line_dedup": lambda d, lab: linededup.strip_lines(d),
    "bpe": lambda d, lab: bpe.encode(d),
    "mixing": lambda d, lab: pareto.mixed(d),
}
#: Those that return one row for each row.
ROW_BY_ROW = {"quality", "fingerprints", "toxicity", "sharding", "language", "line_dedup", "bpe"}


@pytest.mark.parametrize("name", APPLIED)
def test_messy_and_empty_tables(name, spark, messy, empty):
    labels = spark.createDataFrame([(7, 1, 0), (5, 0, 1), (None, 1, None), (99, None, 1)], LABELS)
    got = APPLIED[name](messy, labels)
    n = len(got.collect())
    if name in ROW_BY_ROW:
        assert n == messy.count()
    none = APPLIED[name](empty, labels.where("false"))
    assert none.count() == 0 and none.columns == got.columns
    if name in ("simhash_deduped", "accepted", "line_dedup", "mixing"):
        assert got.columns == messy.columns


def test_messy_rows_have_the_stated_values(spark, messy):
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in (5, 6, 7, 8, 9)], LABELS)
    scores = [(r.doc_id, r.score, r.toxic) for r in toxicity.score(messy, toxicity.train(messy, labels)).collect()]
    blank = {s for k, s, _ in scores if k in (1, 2, 3)}
    assert len(blank) == 1 and len({s for k, s, _ in scores if k in (5, 6)}) == 1 and len({s for k, s, _ in scores if k == 7}) == 1
    assert {(r.score, r.toxic) for r in toxicity.score(messy, None).collect()} == {(None, False)}
    places = [(r.doc_id, (r.region, r.rack, r.shard)) for r in shardtree.assign(messy).collect()]
    assert [p for k, p in places if k is None] == [(None, None, None)] * 2 and len({p for k, p in places if k == 7}) == 1
    assert all(None not in p for k, p in places if k is not None)
    lines = linededup.strip_lines(messy, min_sites=2, removed="gone").select("doc_id", "text", "gone").collect()
    assert [(r.text, r.gone) for r in lines if r.doc_id in (1, 2, 3)].count((None, 0)) == 1 and ("", 0) in [(r.text, r.gone) for r in lines if r.doc_id == 2]
    assert [r.text for r in lines if r.doc_id == 3] == [" \n\t "] and {r.gone for r in lines} == {0}
    prints = {(r.doc_id, r.same_as) for r in multiset.equal_sets(multiset.fingerprint(messy)).collect()}
    assert {(1, None), (2, 2), (3, 2), (5, 5), (6, 5), (7, 7), (None, None)} <= prints
    told = {(r.doc_id, r.language, r.keep) for r in langid.identify(messy, langid.train(messy)).collect() if r.doc_id in (1, 2, 3, 4)}
    assert told == {(k, None, False) for k in (1, 2, 3, 4)}
    drawn = pareto.draw(messy, copies="taken").select("doc_id", "source", "taken").collect()
    # the source that only blank texts bear, null, has documents without size, one of signs and none else
    assert not {1, 2} & {r.doc_id for r in drawn} and all(r.taken > 0 for r in drawn)


def test_a_source_without_size_gives_nothing(spark):
    rows = [(1, "", "en", "void"), (2, None, "en", "void"), (3, "abc", "en", None), (4, "abcd", "en", None), (5, "abc", "en", "full")]
    got = pareto.draw(table_of(spark, rows), copies="taken").groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert {r.source: r.n for r in got} == {None: 2, "full": 1}


# 1


def test_quality_learns_from_positives_alone(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{n}.parquet") for n in ("documents", "labels"))
    teach = F.xxhash64("doc_id") % 2 == 0
    got = quality_pu.classify(docs, labels.where(teach))
    held = got.join(labels.where(~teach), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in held}
    assert kept[1] >= 0.95 and kept[0] <= 0.2


def test_quality_prior_is_the_least_tail_ratio():
    rng = np.random.default_rng(2)
    bins = lambda *parts: np.bincount((np.concatenate(parts) * 200).astype(int), minlength=201)
    trusted = rng.uniform(0.6, 1, 400)
    got = quality_pu.prior_of(bins(trusted, rng.uniform(0.6, 1, 800), rng.uniform(0, 0.5, 2800)), bins(trusted))
    assert abs(got - 0.3) < 0.05
    rare = quality_pu.prior_of(bins(rng.uniform(0.6, 1, 400), rng.uniform(0, 0.5, 99600)), bins(trusted))
    assert abs(rare - 0.004) < 0.001


@pytest.mark.parametrize("prior", [None, 0.1, 0.95])
def test_quality_gradient_is_that_of_the_risk(prior):
    """Against finite differences, with the second term of either sign; where it is negative the gradient is its own reversed."""
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(1, 1, (40, quality_pu.FEATURES)), rng.normal(0, 1, (200, quality_pu.FEATURES))
    total = lambda net, loss: net.sums(unlabelled, loss) / len(unlabelled)
    net = quality_pu.fit(quality_pu.fresh_net(unlabelled.mean(axis=0), unlabelled.std(axis=0)), positive, total, None, 6)
    value, grad, negative = quality_pu.risk(net, positive, total, prior)
    s = lambda z: 1 / (1 + np.exp(-z))

    def plain(theta):
        """The risk, written out; and the second term alone."""
        n = quality_pu.Net(net.mean, net.spread, theta)
        gp, gu = n(positive), n(unlabelled)
        if prior is None:
            return np.log1p(np.exp(-gp)).mean() + np.log1p(np.exp(gu)).mean(), 0.0
        rest = s(gu).mean() - prior * s(gp).mean()
        return prior * s(-gp).mean() + max(0.0, rest), rest

    assert abs(value - plain(net.theta)[0]) < 1e-9 and negative == (plain(net.theta)[1] < 0)
    for k in rng.choice(len(net.theta), 25, replace=False):
        step = np.zeros(len(net.theta))
        step[k] = 1e-5
        up, down = plain(net.theta + step), plain(net.theta - step)
        want = -(up[1] - down[1]) / 2e-5 if negative else (up[0] - down[0]) / 2e-5
        assert abs(grad[k] - want) < 1e-6


def test_quality_gradient_covers_both_signs():
    """The two priors above lie on either side of the sign."""
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(1, 1, (40, quality_pu.FEATURES)), rng.normal(0, 1, (200, quality_pu.FEATURES))
    total = lambda net, loss: net.sums(unlabelled, loss) / len(unlabelled)
    net = quality_pu.fit(quality_pu.fresh_net(unlabelled.mean(axis=0), unlabelled.std(axis=0)), positive, total, None, 6)
    assert [quality_pu.risk(net, positive, total, p)[2] for p in (0.1, 0.95)] == [False, True]


def test_quality_sums_over_tasks_equal_sums_over_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (500, quality_pu.FEATURES)).astype(np.float32)
    feats = spark.createDataFrame([(r.tolist(),) for r in x], "x array<float>").repartition(5)
    net = quality_pu.fresh_net(np.zeros(quality_pu.FEATURES), np.ones(quality_pu.FEATURES))
    got = quality_pu.over_all(feats, 500.0)(net, quality_pu.sigmoid_loss(-1))
    assert np.allclose(got, net.sums(x.astype(float), quality_pu.sigmoid_loss(-1)) / 500)


def test_quality_without_positives_keeps_what_has_words(spark, messy):
    got = {r.doc_id: (r.score, r.keep) for r in quality_pu.classify(messy.where("doc_id IS NOT NULL"), spark.createDataFrame([], LABELS)).collect()}
    assert got[2] == (0.0, False) and got[1] == (0.0, False) and got[5] == (0.5, True)


# 2


def test_fingerprints_equal_just_when_paragraph_multisets_do(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", "b", " a ", "", "c"]) for _ in range(rng.randint(0, 5))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in multiset.equal_sets(multiset.fingerprint(docs)).collect()}
    first = {}
    for i, t in enumerate(texts):
        bag = frozenset(Counter(p.strip() for p in t.split("\n") if p.strip()).items())
        assert got[i].same_as == first.setdefault(bag, i)
        assert got[i].paragraphs == sum(n for _, n in bag)


def test_fingerprints_add_and_subtract(spark):
    rows = [(1, "a\nb\nb"), (2, "c\na"), (3, "b\nc\na\nb\na"), (4, None)]
    p = {r.doc_id: r.fingerprint for r in multiset.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    df = spark.createDataFrame([(p[1], p[2], p[3])], "a string, b string, c string")
    r = df.select(multiset.inserted(F.col("a"), F.col("b")).alias("sum"), multiset.deleted(F.col("c"), F.col("b")).alias("rest")).first()
    assert r["sum"] == p[3] and r["rest"] == p[1] and p[4] is None


# 3


def test_toxicity_on_held_out_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{n}.parquet") for n in ("documents", "labels"))
    teach = F.xxhash64("doc_id") % 2 == 0
    got = toxicity.score(docs, toxicity.train(docs, labels.where(teach)))
    rows = got.select("doc_id", F.col("toxic").alias("said")).join(labels.where(~teach), "doc_id").collect()
    found = [r.said for r in rows if r.toxic == 1]
    false = [r.said for r in rows if r.toxic == 0]
    assert sum(found) >= 0.75 * len(found) and sum(false) <= 0.02 * len(false)


def test_isotonic_levels_are_the_best_increasing_fit():
    rng = np.random.default_rng(4)
    score, y = rng.integers(0, 12, 200).astype(float), rng.integers(0, 2, 200).astype(float)
    knots, levels = toxicity.isotonic(score, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()
    got = np.interp(np.arange(12), knots, levels)
    # max-min formula over values
    sums, sizes = (np.bincount(score.astype(int), weights=w, minlength=12) for w in (y, np.ones(200)))
    mean = lambda a, b: sums[a : b + 1].sum() / sizes[a : b + 1].sum()
    assert np.allclose(got, [max(min(mean(a, b) for b in range(k, 12)) for a in range(k + 1)) for k in range(12)])


def test_toxicity_tree_takes_the_best_split():
    """Every split of the first node, tried one by one."""
    rng = np.random.default_rng(14)
    x = rng.integers(0, 6, (80, 4))
    grad, hess = rng.normal(0, 1, 80), rng.uniform(0.1, 0.25, 80)
    split, bar, leaf = toxicity._tree(x, grad, hess)
    part = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + 1)
    gains = {}
    for f in range(4):
        for b in range(5):
            left = x[:, f] <= b
            if hess[left].sum() >= 2 and hess[~left].sum() >= 2:
                gains[f, b] = part(left) + part(~left) - part(np.ones(80, bool))
    assert (split[0], bar[0]) == max(gains, key=gains.get)
    node = np.zeros(80, int)
    for _ in range(toxicity.DEPTH):
        node = 2 * node + 1 + (x[np.arange(80), split[node]] > bar[node])
    for k in range(2**toxicity.DEPTH):
        rows = node - (2**toxicity.DEPTH - 1) == k
        assert abs(leaf[k] + toxicity.RATE * grad[rows].sum() / (hess[rows].sum() + 1)) < 1e-9


def test_toxicity_boosting_lowers_the_loss():
    rng = np.random.default_rng(15)
    x = rng.normal(0, 1, (600, toxicity.FEATURES))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(600) < 0.05)).astype(int)
    model = toxicity.fit(x, y, np.zeros(600, bool))
    def loss(trees):
        part = toxicity.Model(model.base, model.splits[:trees], model.bars[:trees], model.leaves[:trees], np.empty(0), np.empty(0))
        return np.logaddexp(0, np.where(y == 1, -1, 1) * part.raw(x)).mean()

    losses = [loss(k) for k in (0, 1, 5, 20, 60)]
    assert all(a > b for a, b in zip(losses, losses[1:])) and losses[-1] < 0.5 * losses[0]


def test_toxicity_features_of_a_batch_equal_those_of_each_text():
    texts = [None, "", "you are an idiot", prose(4, 80), "WHY you stupid i d i o t!! ??", "a b c d " * 9, prose(5, 30) + " @#$ sc4m"]
    whole = toxicity.features(texts, toxicity.Masks(frozenset(["river"])))
    for t, row in zip(texts, whole):
        assert np.array_equal(toxicity.features([t], toxicity.Masks(frozenset(["river"])))[0], row)
    assert whole[2, 11] == 25.0 and whole[4, 19] == 2 and whole[3, 5] > 0 and whole[5, 17] == 1.0


def test_toxicity_features_see_disguises():
    one = lambda text: toxicity.features([text], toxicity.Masks(frozenset()))[0]
    plain, clean = one("you are an idiot"), one("you are a friend")
    for text in ("you are an 1d10t", "you are an i.d.i.o.t", "you are an idiooooot", "you are an i d i o t"):
        assert one(text)[1] > 0, text
    assert plain[0] > 0 and clean[2] == 0 and not one(None).any() and not one("").any()


# 4


def descend(key, tree):
    import hashlib
    import math

    path, node = "", tree
    while isinstance(node, dict):
        best = None
        for name in sorted(node):
            w = shardtree.weight(node[name])
            if w > 0:
                u = (int(hashlib.md5(f"{path}{name}#{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                draw = math.log(u) / w
                if best is None or draw > best[0]:
                    best = draw, name
        path, node = path + best[1] + "/", node[best[1]]
    return tuple(path.rstrip("/").split("/"))


def test_sharding_equals_a_descent_and_moves_little(spark):
    keys = spark.range(3000).withColumnRenamed("id", "doc_id")
    places = lambda tree: {r.doc_id: (r.region, r.rack, r.shard) for r in shardtree.assign(keys, tree=tree).collect()}
    before = places(shardtree.TREE)
    assert all(before[k] == descend(k, shardtree.TREE) for k in range(0, 3000, 7))
    share = Counter(p[0] for p in before.values())
    for name, node in shardtree.TREE.items():
        assert abs(share[name] / 3000 - shardtree.weight(node) / shardtree.weight(shardtree.TREE)) < 0.04
    after = places({**shardtree.TREE, "west": {**shardtree.TREE["west"], "w4": {"s0": 8}}})
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    # w4 grew, and west with it: nothing leaves west, what comes from elsewhere goes to west, and what moves inside west goes to w4
    assert {a[0] == "west" for a, _ in moved} == {True, False} and all(b[0] == "west" for _, b in moved)
    assert all(b[1] == "w4" for a, b in moved if a[0] == "west")
    uneven = {"a": 3, "b": {"r": 2, "q": {"s": 1, "t": 1}}}
    for k, got in places(uneven).items():
        assert got == (*descend(k, uneven), None, None)[:3]
    with pytest.raises(ValueError, match="levels"):
        shardtree.assign(keys, tree={"a": {"b": {"c": {"d": 1}}}})
    with pytest.raises(ValueError, match="positive"):
        shardtree.assign(keys, tree={"a": {"b": {"c": 0}}})


# 5


def near(hi, lo, radius):
    h, m = hi.view(np.uint64), lo.view(np.uint64)
    d = np.bitwise_count(h[:, None] ^ h).astype(int) + np.bitwise_count(m[:, None] ^ m)
    return {(i, j) for i, j in zip(*np.nonzero(d <= radius)) if i < j}


def planted_prints(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, (120, 2), dtype=np.int64)
    rows = [base]
    for k in range(1, 18):
        copy = base[:40].copy()
        for r in copy:
            for b in rng.choice(128, k, replace=False):
                r[b // 64] ^= np.uint64(1 << int(b % 64)).view(np.int64)
        rows.append(copy)
    x = np.concatenate(rows)
    return x[:, 0].copy(), x[:, 1].copy()


def cells_of(hi, lo):
    """The cells of every row, worked out on the bits written down one by one."""
    out = []
    for h, m in zip(hi.view(np.uint64).tolist(), lo.view(np.uint64).tolist()):
        bits, at = f"{h:064b}{m:064b}", 0
        for k, n in enumerate(n for parts in simhash.WIDTHS for n in parts):
            out.append((k << simhash.PART_BITS) | int(bits[at : at + n], 2))
            at += n
        assert at == 128
    return np.array(out)


def test_simhash_search_finds_every_pair_once():
    hi, lo = planted_prints(5)
    n = len(hi)
    cells, own = cells_of(hi, lo), np.repeat(np.arange(n), 15)
    a, b = simhash.near_pairs(cells, own, hi[own], lo[own], simhash.RADIUS, crowd=10**6)
    pairs = [(min(p), max(p)) for p in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(pairs)) and set(pairs) == near(hi, lo, simhash.RADIUS)


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 7])
def test_simhash_groups_equal_brute_force(spark, cell_rows):
    """With a small bound on a cell's rows, cells are cut and their parts meet two by two."""
    hi, lo = planted_prints(6)
    prints = spark.createDataFrame([(int(i), int(h), int(m)) for i, (h, m) in enumerate(zip(hi, lo))], "id bigint, hi bigint, lo bigint")
    got = {r.id: r.group_id for r in simhash._grouped(prints, simhash.RADIUS, cell_rows).collect()}
    assert got == roots(near(hi, lo, simhash.RADIUS))


def test_simhash_crowds_give_the_same_groups():
    rng = np.random.default_rng(8)
    hi, lo = np.zeros(300, np.int64), rng.integers(0, 2**40, 300)
    ids = np.arange(300)
    own = np.repeat(ids, 15)
    a, b = simhash.near_pairs(cells_of(hi, lo), own, hi[own], lo[own], simhash.RADIUS)
    assert roots(zip(a.tolist(), b.tolist())) == roots(near(hi, lo, simhash.RADIUS))


def test_simhash_fingerprint_is_the_sign_of_the_votes():
    import math

    import xxhash

    for text in ("one two two three", "x", prose(3, 700), "naïve 漢字 été été"):
        votes = [0] * 128
        for word, count in Counter(simhash.words(text)).items():
            digest, weight = int.from_bytes(xxhash.xxh3_128_digest(word.encode()), "big"), round(8 * (1 + math.log2(count)))
            for k in range(128):
                votes[k] += weight if (digest >> (127 - k)) & 1 else -weight
        want = int("".join("1" if v > 0 else "0" for v in votes), 2)
        hi, lo = simhash.fingerprint(text)
        assert ((hi % 2**64) << 64) | (lo % 2**64) == want
    assert simhash.fingerprint(None) is simhash.fingerprint("") is simhash.fingerprint("!?") is None


def test_simhash_keeps_one_of_each_group(spark):
    text = prose(1, 300)
    edited = text.split()
    edited[10], edited[200] = "changed", "words"
    rows = [(5, text, "en", "a"), (3, " ".join(edited), "en", "b"), (9, prose(2, 300), "en", "a"), (4, text, "en", "c"), (None, text, "en", "a"), (9, prose(2, 300), "en", "a"), (6, "", "en", "a"), (7, None, "en", "a")]
    got = [r.doc_id for r in simhash.deduped(table_of(spark, rows)).collect()]
    assert sorted(got, key=str) == [3, 6, 7, 9, None]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 51: 50}


# 6


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").dropDuplicates(["text"])
    teach = F.xxhash64("doc_id") % 2 == 0
    model = langid.train(docs.where(teach))
    rows = langid.identify(docs.where(~teach), model).join(docs, "doc_id").select("language", "lang", "keep").collect()
    assert np.mean([r.language == r.lang for r in rows]) >= 0.98 and np.mean([r.keep for r in rows]) >= 0.98


def test_language_flags_planted_mixtures_and_keeps_pure_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet").dropDuplicates(["text"])
    teach = F.xxhash64("doc_id") % 2 == 0
    model = langid.train(docs.where(teach))
    by = defaultdict(list)
    for r in docs.where(~teach & (F.length("text") > 300)).select("text", "lang").collect():
        by[r.lang].append(r.text)
    rng, mixed = random.Random(12), {0.5: [], 0.6: []}
    for share, out in mixed.items():
        for _ in range(1000):
            a, b = (rng.choice(by[k]) for k in rng.sample(sorted(by), 2))
            n = min(len(a) / share, len(b) / (1 - share))
            out.append(a[: int(n * share)] + " " + b[: int(n * (1 - share))])
    kept = lambda texts: langid._judge(model, pa.array(texts))[2].mean()
    assert kept([t for ts in by.values() for t in ts]) >= 0.99
    assert kept(mixed[0.5]) <= 0.1 and kept(mixed[0.6]) <= 0.1


def test_language_decoding_equals_loops():
    rng = np.random.default_rng(5)
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((langid.DIM, code.shape[1])), rng.uniform(0.5, 1, code.shape[1]), 0.1)
    out = rng.normal(0, 1, (60, code.shape[1]))
    out[0] = 0  # all languages are equally far
    best, margin = model.decode(out)
    for row, k, m in zip(out, best, margin):
        far = [sum(t * np.exp(-3 * c * o) for t, c, o in zip(model.trust, word, row)) for word in code]
        first, second = sorted(far)[:2]
        assert k == far.index(min(far)) and abs(m - (second - first) / (second + first)) < 1e-9
    assert best[0] == 0 and margin[0] == 0


def test_language_codewords_differ():
    for n in (2, 3, 5, 9):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_language_rejects_scraps_and_ties(spark):
    rows = [(k, t, lang, "s") for k, (t, lang) in enumerate([("the cat sat on the mat " * 9, "en"), ("der hund und die katze " * 9, "de")] * 30)]
    model = langid.train(table_of(spark, rows))
    got = {r.doc_id: r for r in langid.identify(table_of(spark, [(1, None, "", ""), (2, "123 !", "", ""), (3, "the cat and the mat", "", "")]), model).collect()}
    assert (got[1].language, got[1].keep) == (None, False) == (got[2].language, got[2].keep) and got[3].language == "en" and got[3].keep


# 7


def test_embeddings_recall_and_precision_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((300, 32))
    noisy = base[:150] + rng.standard_normal((150, 32)) * rng.uniform(0.05, 0.3, (150, 1))
    x = np.concatenate([base, noisy])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r.id: r.group_id for r in lsh.groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i, j in zip(*np.nonzero(u @ u.T >= lsh.THRESHOLD)) if i < j]
    assert len(pairs) > 100
    assert np.mean([got.get(i, -1) == got.get(j, -2) for i, j in pairs]) >= 0.9
    want = roots(pairs)
    assert all(i in want and want[i] == want[g] for i, g in got.items())


def test_embeddings_shape_keeps_the_recall_at_any_size():
    for n in (10, 50_000, 10**9):
        draws, tables = lsh.shape(n)
        assert 1 - (1 - lsh.AGREE**draws) ** tables >= lsh.RECALL
        assert n * lsh.CHANCE**draws <= 1 / 50 or draws == 8


@pytest.mark.parametrize(("set_rows", "bucket_rows"), [(2, 100_000), (100, 3), (2, 3)])
def test_embeddings_of_crowded_buckets(spark, set_rows, bucket_rows):
    """Buckets that are cut, as ids and as vectors, give the same groups."""
    rng = np.random.default_rng(16)
    base = rng.standard_normal((4, 16))
    x = np.concatenate([base[k % 4] + rng.standard_normal((1, 16)) * 0.02 for k in range(60)])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.id: r.group_id for r in lsh.groups(df, set_rows=set_rows, bucket_rows=bucket_rows).collect()}
    assert got == {k: k % 4 for k in range(60)}


def test_runs_are_kept_whole_or_cut_and_named():
    keys = [1] * 3 + [2] * 40 + [3] * 2 + [4] * 30
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 4], pa.int64())], names=["key"]) for k in range(0, len(keys), 4)]
    whole = [t.column("key").to_pylist() for t in common.whole_runs(iter(batches), "key", 5)]
    assert [k for t in whole for k in t] == keys and all(len({k for k in keys if k in t} & set(u)) == 0 for i, t in enumerate(whole) for u in whole[i + 1 :])
    cut = set()
    pieces = [t.column("key").to_pylist() for t in common.whole_runs(iter(batches), "key", 5, 10, cut)]
    assert [k for t in pieces for k in t] == keys and cut == {2, 4} and max(map(len, pieces)) <= 25
    assert list(common.whole_runs(iter([]), "key")) == []


def test_embeddings_with_names_for_ids(spark):
    rows = [("b", [1.0, 2.0]), ("a", [1.0, 2.01]), ("c", [1.0, 2.0]), ("z", [-1.0, 2.0]), (None, [1.0, 2.0])]
    assert {r.id: r.group_id for r in lsh.groups(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()} == {"a": "a", "b": "a", "c": "a"}


def test_embeddings_that_cannot_be_scaled_are_in_no_group(spark):
    one, nan = [1.0, 2.0], float("nan")
    rows = [(1, one), (2, one), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 0.0]), (None, one), (9, [10.0, 20.0]), (1, one)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("key", F.lit(1)).withColumn("bucket", F.lit(1))
    assert {r.id: r.group_id for r in lsh.groups(df).collect()} == {1: 1, 2: 1, 9: 1}
    assert lsh.groups(df.where("false")).count() == 0


# 8


def stripped(rows, min_sites):
    key = lambda line: line.strip(linededup.BLANKS).lower()
    sites = defaultdict(set)
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            if key(line) and site is not None:
                sites[key(line)].add(site)
    out = []
    for i, text, _, _ in rows:
        lines = (text or "").split("\n")
        bad = [x for x in lines if len(sites[key(x)]) >= min_sites]
        if text is not None and bad:
            text = "\n".join(x for x in lines if len(sites[key(x)]) < min_sites)
        out.append((i, text))
    return out


@pytest.mark.parametrize("lg_k", [4, linededup.LG_K])
def test_line_dedup_equals_brute_force(spark, lg_k):
    """With the coarse sketch the wide band sends every line to the exact counts."""
    rng = random.Random(10)
    rows = [(k, None if k % 31 == 0 else "\n".join(rng.choice([f"Line {rng.randint(0, 60)}", "  SHARED footer", "", f"own words of page number {k} and nothing else in here"]) for _ in range(rng.randint(0, 7))), "en", rng.choice([None, *"abcdefghij"])) for k in range(300)]
    got = linededup.strip_lines(table_of(spark, rows), min_sites=6, lg_k=lg_k, band=0.1 if lg_k > 4 else 0.9)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(stripped(rows, 6))
    assert got.where("n_chars <> length(text)").count() == 0


def test_line_dedup_spares_proven_mirrors_only(spark):
    """Short pages made of boilerplate lose it; a page that stands whole on enough sites keeps its lines."""
    rows = [(k, f"Shared footer\nown {k}", "en", f"s{k}") for k in range(6)] + [(10 + k, "A mirrored page\nof two lines", "en", f"s{k}") for k in range(6)]
    rows += [(20, "SHARED footer", "en", "s1"), (21, "Shared footer \nx", "en", "s2"), (22, "A mirrored page\nof two lines\nand more", "en", None), (23, None, "en", "s1")]
    got = {r.doc_id: (r.text, r.n_chars, r.gone) for r in linededup.strip_lines(table_of(spark, rows), min_sites=6, spare_mirrors=True, removed="gone").collect()}
    for k in range(6):
        assert got[k] == (f"own {k}", 5, 1) and got[10 + k] == ("A mirrored page\nof two lines", 28, 0)
    assert [got[k] for k in range(20, 24)] == [("", 0, 1), ("x", 1, 1), ("and more", 8, 2), (None, None, 0)]


def test_pipeline_strips_pages_made_of_boilerplate(spark):
    import corpus_pipeline

    rows = [(k, f"The shared footer of all sites\npage {k}", "en", f"s{k}") for k in range(9)]
    got = dict(corpus_pipeline.STAGES)["line_dedup"](spark, table_of(spark, rows), "")
    assert sorted(r.text for r in got.collect()) == [f"page {k}" for k in range(9)]


# 9


@pytest.fixture(scope="module")
def exact_encoder():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.RANKS, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    shape = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return raw, tiktoken.Encoding("reference", pat_str=shape, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_an_exact_encoder(spark, exact_encoder, sf_dir):
    _, want = exact_encoder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in bpe.encode(docs).collect():
        assert r.exact and r.n_tokens == len(r.ids)
        assert r.ids == want.encode_ordinary(texts[r.doc_id])


def test_bpe_on_odd_words(exact_encoder):
    raw, want = exact_encoder
    enc, rng = bpe.Encoder(raw), random.Random(11)
    texts = ["", " ", "a" * 5000, "ab" * 900, "<|endoftext|>", "don't we'LL", "\x1c \x85　x", "漢字かな交じり文", "é̂", "\U0001f468‍\U0001f469"]
    texts += ["".join(rng.choice("aeiothnsr '\n0129.-éßñ漢") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    for t in texts:
        ids, _ = enc.encode([t], [max(map(ord, t), default=0) < bpe._LOW])
        assert ids.tolist() == want.encode_ordinary(t), t
        assert enc.decode(ids.tolist()).decode() == t
    assert enc.merged_exactly > 0


def test_bpe_refuses_a_vocabulary_that_lacks_a_byte():
    import base64

    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(255)]
    with pytest.raises(ValueError, match="no token for 1 of the 256 bytes"):
        bpe.Encoder(b"\n".join(lines))


def test_bpe_decodes_what_it_encodes(spark, messy):
    ids = bpe.encode(messy)
    back = bpe.decode(ids)
    key = lambda rows: sorted(rows, key=repr)
    assert key((r.doc_id, r.text) for r in back.collect()) == key((r.doc_id, r.text) for r in messy.select("doc_id", "text").collect())
    assert ids.where("n_tokens IS NULL AND ids IS NULL AND exact IS NULL").count() == 2
    assert bpe.decode(ids.where("false")).count() == 0


# 10


def test_mixing_draws_fixed_sizes_and_whole_copies(spark):
    rows = [(k, "w" * (1 + k % 900), "en", "big" if k % 10 else "small") for k in range(2000)]
    weights = {"big": 1.0, "small": 3.0, "absent": 5.0}
    got = pareto.draw(table_of(spark, rows), weights, copies="taken").select("doc_id", "source", "taken").collect()
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    assert by == {"big": 500, "small": 1500}
    size = {k: (1 + k % 900).bit_length() for k in range(2000)}
    total = sum(size[k] for k in range(0, 2000, 10))
    for r in got:
        if r.source == "small":
            e = 1500 * size[r.doc_id] / total
            assert int(e) <= r.taken <= int(e) + 1
    whole = pareto.mixed(table_of(spark, rows), weights=weights)
    assert whole.count() == 2000


def test_mixing_ties_fall_on_one_side(spark):
    rows = [(1, "abc", "en", "a")] * 5 + [(2, "abc", "en", "a")] * 5
    got = Counter(r.doc_id for r in pareto.mixed(table_of(spark, rows), total_share=0.5).collect())
    assert set(got.values()) == {5} and len(got) == 1
