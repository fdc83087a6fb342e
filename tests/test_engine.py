"""Encoders, artifacts, metrics, corpora, streams, runs and the command line against plain Python."""

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom import __main__ as cli
from tokenloom.functions import drift, httpstruct, records
from tokenloom.operators import baselines, induce, matcher, metrics, mining, validate
from tokenloom.operators.matcher import Matcher, WordEncoder
from tokenloom.operators.mining import SPECIALS
from tokenloom.plans import runs
from tokenloom.plans.artifact import Artifact, HygieneArtifact, Runtime, check_versions, export_folder, tokenizer_config
from tokenloom.plans.build import build_baseline, build_vocabulary
from tokenloom.plans.config import Build, Contract, Trainer
from tokenloom.queries import QUERIES, flagship
from tokenloom.sources import scan, sink
from tokenloom.streaming import jobs

# encoding


def greedy(text, vocab):
    out, at, longest = [], 0, max(map(len, vocab))
    while at < len(text):
        piece = next((text[at:e] for e in range(min(len(text), at + longest), at, -1) if text[at:e] in vocab), text[at])
        out.append(vocab.get(piece, vocab.get("[UNK]", 1)))
        at += len(piece)
    return out


def test_both_encoders_equal_a_loop_whatever_the_vocabulary(spark):
    rng = random.Random(1)
    letters = "ab c-é<>\U0001f600\n"
    for size in (0, 3, 30, 200):
        made = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(size)}
        vocab = {t: k for k, t in enumerate(["[PAD]", "[UNK]", *sorted(made)])}
        texts = ["", *("".join(rng.choice(letters + "xyz") for _ in range(rng.randint(1, 60))) for _ in range(80))]
        want = [greedy(t, vocab) for t in texts]
        assert WordEncoder(vocab)(pa.array([*texts, None])).to_pylist() == [*want, None]
        assert WordEncoder(vocab, kept=5)(pa.array(texts)).to_pylist() == want
        df = spark.createDataFrame(list(enumerate([*texts, None])), "k int, t string").coalesce(1)
        got = df.select("k", matcher.encoded(F.col("t"), vocab).alias("ids")).orderBy("k").collect()
        assert [r.ids for r in got] == [*want, None]


def test_ids_are_given_out_slice_by_slice():
    texts = pa.array(["ab" * 300_000, None, "", *["a b é"] * 1200, "b" * 3_000_000, "é"])
    given = list(matcher.encoded_arrow({"[UNK]": 1, "a": 2, "ab": 3, "é": 4}).func(iter([texts, texts.slice(0, 0)])))
    assert [x for part in given for x in part.to_pylist()] == WordEncoder({"[UNK]": 1, "a": 2, "ab": 3, "é": 4})(texts).to_pylist()
    assert max(map(len, given)) <= 512 and all(len(part) == 1 or len(part.flatten()) <= 1 << 20 for part in given)


def test_single_characters_and_few_longer_tokens():
    vocab = {"[PAD]": 0, "[UNK]": 1, "a": 2, "\U0001f600": 3}
    for texts in (["a\U0001f600b", "", None, "é"], ["a[PAD]b", "[PA", "D]"], ["[PA", "D]", "a"], []):
        assert WordEncoder(vocab)(pa.array(texts, pa.string())).to_pylist() == [None if t is None else greedy(t, vocab) for t in texts]


def test_decoding_by_place_and_by_map(spark):
    df = spark.createDataFrame([([2, 3, 99, -1],), ([],), (None,)], "ids array<int>")
    for vocab in ({"a": 0, "b": 2, "c": 3}, {"b": 2, "c": 3, "far": 10**6}):
        assert [r.x for r in df.select(matcher.decoded(F.col("ids"), vocab).alias("x")).collect()] == ["bc", "", None]


# artifacts: the addresses' case, and a whole round trip


def test_addresses_become_symbols_that_are_encoded_whole(spark):
    contract = Contract(enable_json_serialization=False)
    vocab = {t: k for k, t in enumerate([*SPECIALS, "SRC", "DST", "=", "<IPV4>", "<PORT>", " "])}
    art = Artifact({"schema_version": "vocabulary.v1", "builder": "test"}, vocab, contract, list(SPECIALS), Matcher.of((t, i) for t, i in vocab.items() if not t.startswith("[")))
    df = spark.createDataFrame([("SRC=192.168.1.10 DST=10.0.0.5 PORT:443",)], "x string")
    row = df.select(contract.applied(F.col("x")).alias("text"), Runtime(art).encoded(F.col("x")).alias("ids")).first()
    assert row.text == "SRC=<IPV4> DST=<IPV4> PORT:<PORT>"
    tokens = [art.tokens[i] for i in row.ids]
    assert tokens[:7] == ["SRC", "=", "<IPV4>", " ", "DST", "=", "<IPV4>"] and "<PORT>" in tokens
    assert validate.issues(art.frame(spark), ["<IPV4>", "<PORT>"]).count() == 0


def test_artifact_round_trip_and_encoding(spark, tmp_path):
    vocab = {**{t: k for k, t in enumerate(SPECIALS)}, "GET": 5, "/": 6, "index": 7}
    art = Artifact({"builder": "test"}, vocab, Contract(enable_typed_hygiene=False), list(SPECIALS))
    again = Artifact.loads(art.dumps())
    assert again.vocab == vocab and again.matcher == art.matcher and again.contract == art.contract
    runtime = Runtime(again)
    df = spark.createDataFrame([("GET/index",)], "x string")
    row = df.select(runtime.encoded(F.col("x")).alias("i"), runtime.tokenized(F.col("x")).alias("t"), runtime.decoded(runtime.encoded(F.col("x"))).alias("d")).first()
    assert (row.i, row.t, row.d) == ([5, 6, 7], ["GET", "/", "index"], "GET/index")
    assert (runtime.vocab_size, runtime.token_id("GET"), runtime.token_id("none"), runtime.token(7), runtime.token(99)) == (8, 5, 1, "index", "[UNK]")
    runtime.register(spark, "encode_it")
    assert spark.sql("SELECT encode_it('GET/index') AS i").first().i == [5, 6, 7]
    art.save(tmp_path / "a")
    assert (art.save_vocabulary(tmp_path, "mine")).name.startswith("mine-")
    export_folder(tmp_path / "a", tmp_path / "out", 128, extra={"note": 1})
    assert tokenizer_config(tmp_path / "out") | {"note": 1, "model_max_length": 128} == tokenizer_config(tmp_path / "out")
    assert Artifact.load(tmp_path / "out").vocab == json.loads((tmp_path / "out" / "vocab.json").read_text()) == vocab
    with pytest.raises(FileExistsError):
        export_folder(tmp_path / "a", tmp_path / "out")
    export_folder(tmp_path / "a", tmp_path / "out", overwrite=True)
    (tmp_path / "a" / "vocabulary_artifact.json").rename(tmp_path / "a" / "old_name.json")
    assert Artifact.load(tmp_path / "a", "old_name.json").vocab == vocab
    with pytest.raises(FileNotFoundError):
        Artifact.load(tmp_path / "a")


def test_versions_must_match(tmp_path):
    made = HygieneArtifact(Contract(lowercase_mode="ascii"), "h2", "t1")
    made.save(tmp_path)
    again = HygieneArtifact.load(tmp_path)
    assert again == made
    check_versions(again, {"tokenizer_version": "t1", "hygiene_version": "h2"})
    with pytest.raises(ValueError, match="don't match"):
        check_versions(again, {"tokenizer_version": "t1", "hygiene_version": "h1"})
    with pytest.raises(FileExistsError):
        made.save(tmp_path)


def test_a_build_reads_all_texts_unless_told_otherwise(spark):
    texts = spark.createDataFrame([(k, "seen " if k < 3 else "later ") for k in range(40)], "id bigint, text string")
    everything = build_vocabulary(texts, Build(trainer=Trainer(vocab_size=64, min_freq=3)))
    assert "later" in everything.vocab and Trainer().sample_texts is None
    assert "later" not in build_vocabulary(texts, Build(trainer=Trainer(vocab_size=64, min_freq=3, sample_texts=3))).vocab


def test_the_price_of_a_token_can_be_replaced(spark):
    cands = spark.createDataFrame([("abcd", 10), ("wxyz", 10)], "token string, freq bigint")
    got = induce.scored(cands, " ", 1.0, price=lambda t: F.when(t.startswith("w"), 7).otherwise(0))
    assert {r.token: r.score for r in got.collect()} == {"abcd": 30.0, "wxyz": 23.0}


# mining and the flagship, in plain Python


def test_flagship_equals_plain_counting(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["river", "stone", "10.0.0.1", "walks,", "walking", "a=b"]) for _ in range(30)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for text in texts:
        text = text.replace("10.0.0.1", "<IPV4>")
        inside = text.replace("<IPV4>", "<>")
        cut = set(mining.boundaries("default"))
        word = ""
        for ch in inside + " ":
            if ch in cut:
                for i in range(len(word)):
                    for j in range(i + 2, min(len(word), i + 24) + 1):
                        counts[word[i:j]] += 1
                word = ""
            else:
                word += ch
    want = sorted(((n * (len(t) - 1), len(t), t, n) for t, n in counts.items() if n >= 10), reverse=True)[:1000]
    got = [(r.score, len(r.token), r.token, r.freq) for r in flagship(spark, str(tmp_path)).collect()]
    assert got == [(float(s), k, t, n) for s, k, t, n in want]


# baselines


def plain_merges(counted, size, min_freq, prefix):
    """Merging by counting every pair anew."""
    vocab = {t: k for k, t in enumerate(SPECIALS)}
    for ch in sorted({ch for w, _ in counted for ch in w}):
        vocab.setdefault(ch, len(vocab))
    seqs = []
    for w, n in sorted(counted):
        seq = [prefix + ch if k else ch for k, ch in enumerate(w)]
        for piece in seq:
            vocab.setdefault(piece, len(vocab))
        seqs.append((seq, n))
    while len(vocab) < size:
        pairs = Counter()
        for seq, n in seqs:
            for pair in zip(seq, seq[1:]):
                pairs[pair] += n
        if not pairs:
            break
        n, best = min((-n, (vocab[a], vocab[b])) for (a, b), n in pairs.items())
        if -n < min_freq:
            break
        names = {i: t for t, i in vocab.items()}
        left, right = names[best[0]], names[best[1]]
        token = left + (right[len(prefix) :] if prefix and right.startswith(prefix) else right)
        vocab.setdefault(token, len(vocab))
        for seq, _ in seqs:
            i = 0
            while i < len(seq) - 1:
                if (seq[i], seq[i + 1]) == (left, right):
                    seq[i : i + 2] = [token]
                i += 1
    return vocab


@pytest.mark.parametrize("prefix", ["", "##"])
def test_merged_vocabularies_equal_plain_merging(spark, prefix):
    rng = random.Random(5)
    counted = [(w, rng.randint(1, 9)) for w in sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(40)})]
    counts = spark.createDataFrame(counted, "word string, n bigint")
    got = baselines.wordpiece(counts, 60, 2) if prefix else baselines.bpe(counts, 60, 2)[0]
    assert got == plain_merges(counted, 60, 2, prefix)


@pytest.mark.parametrize("kind", ["bpe", "wordpiece", "unigram"])
def test_baselines_are_written_and_encode(spark, tmp_path, kind):
    texts = spark.createDataFrame([(k, "walking talking walked talked 10.0.0.1 king") for k in range(20)], "id bigint, text string")
    build_baseline(kind, texts, tmp_path / "m", 80, Contract(), min_freq=2, hygiene_folder=tmp_path / "h", version="v1", emit_contract=True)
    assert tokenizer_config(tmp_path / "m")["tokenizer_version"] == "v1" and HygieneArtifact.load(tmp_path / "h").hygiene_version == "v1"
    assert Contract.from_json((tmp_path / "m" / "contract.json").read_text()) == Contract()
    ids = texts.select(runs.baseline_encoded(tmp_path / "m")(F.lit("walking king")).alias("i")).first().i
    assert len(ids) >= 2 and 1 not in ids


# metrics


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_any_ids(spark):
    rng = random.Random(6)
    pick = lambda top: [rng.choice([rng.randrange(5), rng.randrange(top)]) for _ in range(rng.randint(0, 9))]
    pairs = [(pick(top), pick(top)) for top in (300, 55_040, 60_000, 2**31 - 1) for _ in range(40)] + [([70000], [70001]), ([], []), ([55296], [55297])]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)] + [(-1, None, [1])], "k int, a array<int>, b array<int>")
    got = {r.k: r.d for r in df.select("k", metrics.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {-1: None, **{k: distance(a, b) for k, (a, b) in enumerate(pairs)}}


@pytest.mark.parametrize("range_rows", [0, 7, 1000])
def test_token_budget_equals_a_running_sum(spark, range_rows):
    rng = random.Random(7)
    rows = [(k, rng.randint(0, 9)) for k in range(200)]
    rng.shuffle(rows)
    got = metrics.within_budget(spark.createDataFrame(rows, "id bigint, n bigint"), "n", 300, "id", range_rows)
    total, want = 0, []
    for k, n in sorted(rows):
        total += n
        if total <= 300:
            want.append((k, n, total))
    assert sorted(map(tuple, got.collect())) == want


def test_probe_tells_labels_by_their_tokens(spark):
    rows = [([1, 2, 3] if k % 2 else [4, 5], k % 2) for k in range(60)]
    noise = [([1, 2], k % 2) for k in range(60)]
    told, blind = (metrics.probe_loss(spark.createDataFrame(r, "ids array<int>, label int"), "ids", "label") for r in (rows, noise))
    assert told < 0.1 < 0.6 < blind < 0.75


def test_attributes_are_shuffled_and_kept(spark):
    page = '<p class="a" id="b" title="c" lang="d">x</p><br><i>y</i>'
    df = spark.createDataFrame([(k,) for k in range(30)], "k int")
    outs = {r.x for r in df.select(F.concat(drift.attributes_shuffled(F.concat(F.lit(page), F.lit("<q a='"), F.col("k").cast("string"), F.lit("' b='2' c='3'>")))).alias("x")).collect()}
    tags = {o[o.index("<q") : o.index("<q") + 3] + " ".join(p.split("=")[0] for p in o[o.index("<q") :].strip("<q>").split()) for o in outs}
    assert len(tags) > 1 and all(sorted(o[: o.index(">")].split()[1:]) == sorted(['class="a"', 'id="b"', 'title="c"', 'lang="d"']) for o in outs)


# corpora


def test_json_lines_keep_their_other_fields(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"b": 1, "text": "' + "ab01" * 8 + '", "a": [2]}\n\n{"text": null}\n{"other": "é"}\n', encoding="utf-8")
    sink.clean_corpus(spark, f"{tmp_path}/in.jsonl", f"{tmp_path}/out", "jsonl")
    got = sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert got == sorted(['{"b": 1, "text": "<HASH>", "a": [2]}', '{"text": "None"}', '{"text": "{\\"other\\": \\"é\\"}"}'])
    with pytest.raises(ValueError, match="Parquet"):
        sink.clean_corpus(spark, f"{tmp_path}/in.jsonl", f"{tmp_path}/out", "jsonl", out_fmt="parquet")
    with pytest.raises(ValueError, match="positive"):
        sink.clean_corpus(spark, f"{tmp_path}/in.jsonl", f"{tmp_path}/out", "jsonl", most=0)


def test_metric_files(tmp_path):
    sink.save_json({"a": 1, "é": None}, tmp_path / "x" / "m.json")
    assert json.loads((tmp_path / "x" / "m.json").read_text(encoding="utf-8")) == {"a": 1, "é": None}
    sink.save_csv([(1, "b")], tmp_path / "x" / "m.csv", ["n", "s"])
    assert (tmp_path / "x" / "m.csv").read_text() == "n,s\n1,b\n"


def test_files_of_queries_are_released(spark, sf_dir):
    import os

    from tokenloom.sources import shared

    kept = QUERIES["scan_text_nonnull"](spark, sf_dir)
    assert kept.count() > 0
    shared.released(spark)
    assert not os.listdir(shared.checkpoint_folder(spark).removeprefix("file:") + "/files")


def test_datasets_are_registered_and_split(spark, tmp_path):
    scan.register("waf", "some/where")
    try:
        assert scan.dataset_path("waf_v2") == "some/where" and scan.dataset_key("some/where") == "waf"
    finally:
        scan.register("waf", "waf")
    assert scan.split_name("dev", ["train", "test"]) == "test"
    for bad in ("", "none"):
        with pytest.raises(ValueError):
            scan.dataset_key(bad)
    spark.range(9).coalesce(1).write.parquet(f"{tmp_path}/train")
    df = scan.load_dataset(spark, {"train": f"{tmp_path}/train"}, "train")
    scan.pulled(df, f"{tmp_path}/first", most=4)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/first").collect()) == [0, 1, 2, 3]
    scan.pulled(df, f"{tmp_path}/drawn", most=4, shuffle=True, seed=3)
    assert spark.read.parquet(f"{tmp_path}/drawn").distinct().count() == 4
    drawn, seen = scan.sampled(df, 5)
    assert (drawn.count(), seen) == (5, 9)
    stream = scan.load_dataset(spark, {"train": f"{tmp_path}/train"}, streaming=True).select(F.col("id").cast("string").alias("text"))
    with pytest.raises(ValueError, match="stream"):
        scan.dataset_texts(stream, "waf", "text", formatted=False, most=2)


def test_nested_values_as_plain_text(spark):
    df = spark.sql("SELECT array(array('a', 'b'), array('c', null), null) AS l, named_struct('k', 'é', 'n', 1.5D) AS s, array(map('x', 1)) AS m, cast(null AS array<string>) AS n, true AS t")
    got = df.select(*(records.as_text(df, c).alias(c) for c in df.columns)).first()
    assert tuple(got) == ("a b c", '{"k": "\\u00e9", "n": 1.5}', '{"x": 1}', "", "True")


def test_a_request_in_columns(spark):
    df = spark.sql("SELECT 'get' AS method, '/a?b=1' AS url, cast(null AS string) AS protocol, 'Host: x.org\\nAccept: y' AS headers, '' AS body")
    want = "<METHOD> get <URL> / a <QK> b <QVAL> <NUM> <PROT> <EMPTY> <EOL> <HDR> host <SEP> x.org <EOL> <HDR> accept <SEP> y <EOL>"
    assert df.select(httpstruct.structured_row(df).alias("x")).first().x == want
    other = spark.sql("SELECT 1 AS a")
    assert other.select(Contract(structured_input_mode="http").applied_to_rows(other).alias("x")).first().x == "<K:a> <SEP> 1 <EOL>"


# streams


def test_running_and_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "<A1> <B1>"), ("2024-01-01 00:50:00", "<A1>"), ("2024-01-01 02:00:00", "x")]
    spark.createDataFrame(rows, "at string, text string").select(F.col("at").cast("timestamp").alias("at"), "text").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    tags = jobs.tag_counts(jobs.read(spark, f"{tmp_path}/in", schema))
    tags.writeStream.format("memory").queryName("running_tags").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination(60)
    assert {r.tag: r.freq for r in spark.table("running_tags").collect()} == {"<A1>": 2, "<B1>": 1}
    hours = jobs.windowed_counts(jobs.read(spark, f"{tmp_path}/in", schema), "at", "text")
    hours.writeStream.format("memory").queryName("hours").outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r.window.start.hour, r.text, r.n) for r in spark.table("hours").collect()) == [(0, "<A1>", 1), (0, "<A1> <B1>", 1), (2, "x", 1)]


# runs and the command line


def test_matrix_measures_every_pair(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"GET /item/{k}  q" if k % 2 else f"POST /cart/{k}  r", k % 2) for k in range(40)], "id bigint, text string, label int")
    build = Build(trainer=Trainer(vocab_size=120, min_freq=2))
    got = runs.matrix({"waf": rows}, tmp_path, ("vocabulary", "bpe"), build, budget=100)
    assert [(g["dataset"], g["algorithm"]) for g in got] == [("waf", "vocabulary"), ("waf", "bpe")]
    for g in got:
        assert g["avg_len"] > 1 and g["probe_loss"] < 0.7 and {d["drift"] for d in g["drifts"]} == {"ws", "delim_spaces", "json_sort_keys"} and 0 < g["rows_within_budget"] <= 40
        assert json.loads((tmp_path / f"waf_{g['algorithm']}" / "metrics.json").read_text())["algorithm"] == g["algorithm"]


def test_command_line(spark, tmp_path, capsys):
    corpus = tmp_path / "corpus.txt"
    corpus.write_text("\n".join(f"GET /item/{k} from 10.0.0.{k}" for k in range(60)) + "\n" + "ab01" * 8 + "\n")
    out = str(tmp_path / "art")
    assert cli.main(["train", "vocabulary", "--corpus", str(corpus), "--out", out, "--vocab-size", "120", "--min-freq", "3"]) == 0
    assert cli.main(["validate", "--artifact", out]) == 0
    assert cli.main(["train", "vocabulary", "--corpus", str(corpus), "--out", f"{out}-http", "--vocab-size", "400", "--min-freq", "3", "--preset", "http"]) == 0
    assert Artifact.load(f"{out}-http").contract.structured_input_mode == "http"
    assert cli.main(["train", "vocabulary", "--corpus", str(corpus), "--out", f"{out}-raw", "--vocab-size", "400", "--min-freq", "3", "--preset", "http", "--structured", "none"]) == 0
    assert Artifact.load(f"{out}-raw").contract.structured_input_mode == "none"
    blobs = Artifact({}, {t: k for k, t in enumerate([*SPECIALS, *(f"{k:032x}" for k in range(50))])}, Contract(), list(SPECIALS))
    blobs.save(tmp_path / "bad")
    assert cli.main(["validate", "--artifact", str(tmp_path / "bad")]) == 2
    assert cli.main(["validate", "--artifact", str(tmp_path / "bad"), "--hex-share", "1.0", "--hex-most", "60"]) == 2  # the leak beside the symbol stays
    assert cli.main(["export", "--artifact", out, "--out", str(tmp_path / "hub")]) == 0
    assert cli.main(["clean", "--corpus", str(corpus), "--out", f"{tmp_path}/clean"]) == 0
    assert spark.read.text(f"{tmp_path}/clean").where("value = '<HASH>'").count() == 1
    assert cli.main(["contract", "--corpus", str(corpus), "--out", f"{tmp_path}/contracted"]) == 0
    assert spark.read.text(f"{tmp_path}/contracted").where("value LIKE '%from <IPV4>'").count() == 60
    capsys.readouterr()
    assert cli.main(["contract", "--corpus", str(corpus), "--most", "2"]) == 0
    assert capsys.readouterr().out == "GET /item/0 from <IPV4>\nGET /item/1 from <IPV4>\n"
    assert cli.main(["verify", "--corpus", str(corpus), "--artifact", out, "--n", "3"]) == 0
    assert capsys.readouterr().out.startswith("61 texts\n")
    spark.range(5).select(F.col("id").cast("string").alias("text"), "id").write.parquet(f"{tmp_path}/train")
    assert cli.main(["pull", f"train={tmp_path}/train", "--split", "train", "--key", "text", "--most", "3", "--out", f"{tmp_path}/pulled"]) == 0
    assert spark.read.parquet(f"{tmp_path}/pulled").columns == ["text"] and spark.read.parquet(f"{tmp_path}/pulled").count() == 3
    assert cli.main(["train", "unigram", "--corpus", str(corpus), "--out", f"{out}-u", "--vocab-size", "90", "--version", "v3", "--hygiene-out", f"{out}-h"]) == 0
    assert HygieneArtifact.load(f"{out}-h").tokenizer_version == "v3"


def test_no_query_lacks_a_check():
    """Queries without SQL are held against plain Python here and in test_queries."""
    from tokenloom.queries import ORACLES

    assert set(QUERIES) - set(ORACLES) == {"encode_greedy", "bpe_merges", "wordpiece_vocab", "unigram_vocab", "vocabulary_topk"}


def test_few_longer_tokens_are_looked_for_in_whole_batches(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(WordEncoder, "greedy", lambda *_: pytest.fail("went word by word"))
    for _ in range(100):
        vocab = {"".join(rng.choices("ab\0é\U0001f600", k=rng.randint(1, 5))): k + 2 for k in range(rng.randint(6, 20))}
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("ab\0é\U0001f600", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        assert WordEncoder(vocab)(pa.array(texts, pa.string())).to_pylist() == [None if t is None else greedy(t, vocab) for t in texts]
    vocab = {"a": 2, "aa": 3, "ab": 4, "ba": 5, "aab": 6, "bb": 7}
    for text in ("a" * 4001, "ab" * 2000, "aabba" * 900):
        assert WordEncoder(vocab)(pa.array([text])).to_pylist() == [greedy(text, vocab)]
