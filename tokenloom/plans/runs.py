"""Reports over encoders: a verified sample, and the matrix of data sets by algorithms."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import drift
from tokenloom.operators import baselines, metrics
from tokenloom.plans.artifact import Artifact, Runtime
from tokenloom.plans.build import build_baseline, build_vocabulary
from tokenloom.plans.config import Build
from tokenloom.sources.scan import first_rows, sampled
from tokenloom.sources.sink import save_json

ALGORITHMS = ("vocabulary", "bpe", "wordpiece", "unigram")


def verified(texts: DataFrame, artifact: Artifact, n: int | None = None, seed: int = 42) -> tuple[DataFrame, int]:
    """Rows (id, text, tokens, unknown, rate) of n texts drawn evenly, of all without n, and how many texts there are."""
    drawn, seen = (texts, texts.count()) if n is None else sampled(texts, n, seed)
    runtime = Runtime(artifact)
    unknown = runtime.token_id("[UNK]")
    ids = drawn.select("id", "text", runtime.encoded(F.col("text")).alias("ids"))
    share = F.size(F.filter("ids", lambda i: i == unknown))
    return ids.select("id", "text", F.size("ids").alias("tokens"), share.alias("unknown"), (share / F.greatest(F.lit(1), F.size("ids"))).alias("rate")), seen


def baseline_encoded(folder: str | Path):
    """A function text -> ids by a stored subword model."""
    model = json.loads((Path(folder) / "tokenizer.json").read_text(encoding="utf-8"))["model"]
    if model["type"] == "BPE":
        return baselines.bpe_encoder(model["vocab"], [tuple(pair) for pair in model["merges"]])
    if model["type"] == "WordPiece":
        return baselines.wordpiece_encoder(model["vocab"])
    return baselines.unigram_encoder(dict(model["vocab"]))


def encoder(algorithm: str, texts: DataFrame, folder: Path, build: Build):
    """A Column function text -> ids of an algorithm trained on texts, or read from the folder if it is there already."""
    if algorithm == "vocabulary":
        if not folder.exists():
            build_vocabulary(texts, build).save(folder)
        return Runtime(Artifact.load(folder)).encoded
    if not folder.exists():
        build_baseline(algorithm, texts, folder, build.trainer.vocab_size, build.contract, build.trainer.min_freq)
    encode, contract = baseline_encoded(folder), build.contract
    return lambda text: encode(contract.applied(text))


def measured(rows: DataFrame, encode, dataset: str, most: int | None, most_drifted: int | None, budget: int | None) -> dict:
    """Length, probe loss, drifts and the rows of a token budget, of rows (id, text, label)."""
    ids = first_rows(rows, most).select("id", F.col("text"), F.col("label"), encode(F.col("text")).alias("ids"))
    out: dict = {"avg_len": ids.agg(F.avg(F.size("ids")).alias("x")).first().x, "probe_loss": metrics.probe_loss(ids, "ids", "label")}
    changed: dict[str, Column] = {name: encode(change(F.col("text"))) for name, change in drift.drifts(dataset).items()}
    wide = first_rows(rows, most_drifted).select(encode(F.col("text")).alias("base"), *(c.alias(f"to_{name}") for name, c in changed.items()))
    out["drifts"] = [r.asDict() for r in metrics.drift_report(wide, "base", {name: f"to_{name}" for name in changed}).collect()]
    if budget is not None:
        lengths = ids.select("id", F.size("ids").alias("n"))
        out["rows_within_budget"] = metrics.within_budget(lengths, "n", budget, "id").count()
    return out


def matrix(
    datasets: Mapping[str, DataFrame],
    folder: str | Path,
    algorithms: Sequence[str] = ALGORITHMS,
    build: Build = Build(),
    most: int | None = 20_000,
    most_drifted: int | None = 2_000,
    budget: int | None = 5_000_000,
) -> list[dict]:
    """Trains every algorithm on every data set (rows id, text, label), measures it, and writes metrics.json beside each model.

    The first rows by id are measured: `most` of them, `most_drifted` under drifts; None measures all.
    """
    out = []
    for name, rows in datasets.items():
        for algorithm in algorithms:
            at = Path(folder) / f"{name}_{algorithm}"
            encode = encoder(algorithm, rows.select("id", "text"), at, build)
            got = {"dataset": name, "algorithm": algorithm, **measured(rows, encode, name, most, most_drifted, budget)}
            save_json(got, at / "metrics.json")
            out.append(got)
    return out
