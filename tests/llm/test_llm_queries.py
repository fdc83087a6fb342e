"""Registered queries against their SQL, and the pipeline stage by stage."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tokenloom.llm import common, lsh, simhash
from tokenloom.llm.queries import ORACLES, QUERIES


def test_ten_operators_and_the_pipeline_are_registered():
    found = contract.queries()
    assert sorted({n.split("_")[0] for n in QUERIES}) == sorted(f"op{k}" for k in range(1, 11)) and set(QUERIES) | {"pipeline"} <= set(found)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "encoding"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(contract.queries()[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_embeddings_copies_are_told_from_far_ones(spark, sf_dir):
    got = {r.vec_id: r.group_id for r in contract.queries()["op7_embeddings_copies"](spark, sf_dir).collect()}
    near = [k for k in got if lsh.NEAR_IDS <= k < lsh.FAR_IDS]
    assert len(near) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").count() > 0
    assert all(got[k] <= k - lsh.NEAR_IDS for k in near) and not any(k >= lsh.FAR_IDS for k in got)


def messy(spark, sf_dir, empty=False):
    """Documents with odd rows among them, and columns whose names the operators use inside."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long_text = " ".join(r.text for r in docs.where("lang = 'en'").orderBy("doc_id").select("text").collect()) * 3
    odd = [
        (9001, None, "en", "site0", None),
        (9002, "", "en", "site0", 0),
        (9003, " \n\t", None, None, 3),
        (9004, "!!! 123 ???", "en", "site1", 11),
        (9005, long_text, "en", "site1", len(long_text)),
        (9006, long_text, "en", "site2", len(long_text)),
        (9007, "the cat and the dog went to the house of the man", "en", "site1", 48),
        (9007, "the cat and the dog went to the house of the man", "en", "site1", 48),
        (None, "where the birds sing in the light of the morning", "en", None, 48),
        (None, None, None, None, None),
    ]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("id", "m_source", "k_text", "s_lone", "keep", "copies", "t", "x"):
        rows = rows.withColumn(name, F.lit(name))
    return rows.where("false") if empty else rows


def test_messy_documents_go_through_every_stage(spark, sf_dir):
    rows = messy(spark, sf_dir).cache()
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, rows, sf_dir).cache()
    kept = [r.doc_id for r in told.select("doc_id").collect()]
    assert not {9001, 9002, 9003, 9004} & set(kept) and kept.count(9007) == 2 and {9005, 9006} <= set(kept)
    assert told.where("text IS NULL").count() == 0
    lines = stages["line_dedup"](spark, told, sf_dir).cache()
    assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in lines.select("doc_id").collect())
    assert lines.where("n_chars <> length(text)").count() == 0
    lone = stages["near_dedup"](spark, lines, sf_dir).cache()
    ids = [r.doc_id for r in lone.select("doc_id").collect()]
    assert ids.count(9007) == 1 and len({9005, 9006} & set(ids)) <= 1
    mixed = stages["mixing"](spark, lone, sf_dir).cache()
    assert mixed.where("text IS NULL OR text = ''").count() == 0 and 0 < mixed.count() <= 1.05 * lone.count()
    for df in (told, lines, lone, mixed):
        assert df.columns == rows.columns
    out = stages["encoding"](spark, mixed, sf_dir)
    assert out.count() == mixed.count() and out.where("NOT exact").count() == 0


def test_empty_documents_go_through_every_stage(spark, sf_dir):
    rows = messy(spark, sf_dir, empty=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        assert out.count() == 0
        if name != "encoding":
            assert out.columns == rows.columns


def test_pipeline_equals_its_stages_worked_out_one_by_one(spark, tmp_path):
    """Two languages, a footer on nine sites, near copies, and a blend of languages, with the result worked out in plain Python."""
    en = "the of and to in that is was for with as his on be at by had this are".split()
    de = "der die und das den von zu mit sich auf ist im dem ein eine nicht als auch".split()
    rng = random.Random(4)
    body = lambda words, k: " ".join(f"{rng.choice(words)} {rng.choice(words)}x{k}" for _ in range(60))
    rows = [(k, body(en if k % 2 else de, k), "en" if k % 2 else "de", f"s{k % 9}") for k in range(200)]
    rows = [(k, f"{t}\nThe footer of every one of these sites", lang, s) for k, t, lang, s in rows]
    rows += [(1000 + k, rows[k][1].replace(rows[k][1].split()[7], "other", 1), rows[k][2], "s3") for k in range(0, 20)]
    halves = [(2000 + k, " ".join(body(en, k).split()[:60] + body(de, k).split()[:60]), None, "s4") for k in range(10)]
    df = spark.createDataFrame([(k, t, lang, s, len(t)) for k, t, lang, s in rows + halves], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, df, "").cache()
    ids = {r.doc_id for r in told.collect()}
    assert len(ids & {k for k, *_ in halves}) <= 1 and len(ids & {k for k, *_ in rows}) >= 0.97 * len(rows)
    lines = stages["line_dedup"](spark, told, "").cache()
    want = {k: t.split("\n")[0] for k, t, *_ in rows}
    assert {r.doc_id: r.text for r in lines.collect() if r.doc_id < 2000} == {k: t for k, t in want.items() if k in ids}
    lone = {r.doc_id for r in stages["near_dedup"](spark, lines, "").collect()}
    texts = {r.doc_id: r.text for r in lines.collect()}
    prints = {k: simhash.fingerprint(t) for k, t in texts.items()}
    near = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(prints[a], prints[b])) <= simhash.RADIUS
    group = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and near(a, b) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert lone == set(group.values()) and len(lone) < len(texts)
    out = contract.queries()["pipeline"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= lone and all(r.exact for r in out)


def test_a_failing_stage_leaves_no_tables(spark, sf_dir, monkeypatch):
    def fails(spark, docs, sf_dir):
        raise ArithmeticError("on purpose")

    common.use_checkpoints(spark)
    tables = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/tables"
    common.released(spark)
    common.stored(spark.range(3), "kept")
    assert os.listdir(tables)
    common.released(spark)
    before = set(os.listdir(tables))
    for at in (2, 4):
        made = list(corpus_pipeline.STAGES)
        made[at] = (made[at][0], fails)
        monkeypatch.setattr(corpus_pipeline, "STAGES", made)
        with pytest.raises(ArithmeticError):
            corpus_pipeline.run(spark, sf_dir)
        common.released(spark)
        assert set(os.listdir(tables)) <= before


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, docs, sf_dir).cache()
    assert told.columns == docs.columns and 0.97 * docs.count() <= told.count() <= docs.count()
    lines = stages["line_dedup"](spark, told, sf_dir).cache()
    assert lines.columns == docs.columns and lines.count() == told.count()
    lone = stages["near_dedup"](spark, lines, sf_dir).cache()
    assert lone.columns == docs.columns and lone.select("text").distinct().count() == lone.count() < lines.count()
    mixed = stages["mixing"](spark, lone, sf_dir).cache()
    assert mixed.columns == docs.columns and mixed.join(lone, docs.columns, "left_anti").count() == 0
    ids = stages["encoding"](spark, mixed, sf_dir)
    assert ids.count() == mixed.count() and ids.where("NOT exact").count() == 0
    assert contract.queries()["pipeline"](spark, sf_dir).count() == mixed.count()
