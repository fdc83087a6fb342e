"""Builds: from texts to a vocabulary artifact or a subword baseline."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.httpstruct import TAGS
from tokenloom.operators import baselines, induce, mining
from tokenloom.operators.mining import SPECIALS
from tokenloom.plans.artifact import CONTRACT_FILE, VOCAB_SCHEMA, Artifact, HygieneArtifact, save_tokenizer, versions
from tokenloom.plans.config import Build, Contract
from tokenloom.sources.scan import first_rows


def reserved(build: Build, texts: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """Tokens reserved after the model specials: typed symbols, marks, for HTTP its tags and the discovered ones, then extra."""
    c = build.contract
    found = [*c.typed_symbols(), c.sep_token, c.eol_token, c.empty_token]
    if build.trainer.for_http:
        found += TAGS + [r.tag for r in mining.tags(texts, min_freq=max(1, build.trainer.min_freq)).collect()]  # 64 at most
    return [t for t in dict.fromkeys([*found, *extra]) if t and t not in SPECIALS]


def build_vocabulary(texts: DataFrame, build: Build, extra: Sequence[str] = (), price: Callable[[Column], Column] | None = None) -> Artifact:
    """Artifact from rows (id, text). The contract's output feeds three aggregations and is cached for them.

    price: distortion of a token as a Column function, in place of the configured mode.
    """
    build = build.settled()
    t = build.trainer
    bounds = "".join(t.boundaries)
    proc = first_rows(texts, t.sample_texts).select(build.contract.applied(F.col("text")).alias("text")).persist()
    try:
        special = reserved(build, proc, extra)
        chars: list[str] = []
        if t.include_char_vocab or t.include_ascii_fallback:
            also = bounds + (mining.ASCII if t.include_ascii_fallback else "")
            # bounded by the alphabet
            chars = [r.ch for r in mining.characters(proc, also=also).collect()] if t.include_char_vocab else sorted(set(also))
        cands = mining.candidates(proc, "text", bounds, t.len_min, t.len_max, t.symbol_ngram_min_len, t.symbol_ngram_max_len, t.min_freq)
        ranked = induce.scored(cands, bounds, t.lambda_rd, t.distortion_mode, t.boundary_penalty, price)
        base = induce.base_tokens(special, build.contract.typed_symbols(), chars)
        rows = induce.vocabulary(ranked, base, t.vocab_size).collect()  # vocab_size rows at most
    finally:
        proc.unpersist()
    vocab = {r.token: r.id for r in sorted(rows, key=lambda r: r.id)}
    return Artifact({"schema_version": VOCAB_SCHEMA, "builder": "tokenloom", "build_config": build.to_dict()}, vocab, build.contract, [*SPECIALS, *special])


def build_baseline(
    kind: str,
    texts: DataFrame,
    folder: str | Path,
    size: int,
    contract: Contract,
    min_freq: int = 10,
    max_length: int = 512,
    hygiene_folder: str | Path | None = None,
    tokenizer_version: str | None = None,
    hygiene_version: str | None = None,
    version: str | None = None,
    emit_contract: bool = False,
) -> dict:
    """Counts words in Spark, trains bpe, wordpiece or unigram, and writes the model, with the contract beside it or as an artifact of its own."""
    both = None
    if hygiene_folder is not None or tokenizer_version or hygiene_version or version:
        both = versions(tokenizer_version, hygiene_version, version)
    counts = baselines.word_counts(texts.select(contract.applied(F.col("text")).alias("text")))
    if kind == "bpe":
        vocab, merges = baselines.bpe(counts, size, min_freq)
        model = {"type": "BPE", "unk_token": "[UNK]", "vocab": vocab, "merges": [list(m) for m in merges]}
    elif kind == "wordpiece":
        model = {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": baselines.wordpiece(counts, size, min_freq)}
    elif kind == "unigram":
        model = {"type": "Unigram", "unk_id": SPECIALS.index("[UNK]"), "vocab": [[t, p] for t, p in baselines.unigram(counts, size).items()]}
    else:
        raise ValueError(f"no baseline {kind!r}; there are bpe, wordpiece, unigram")
    save_tokenizer(model, folder, max_length, *(both or (None, None)))
    if hygiene_folder is not None:
        HygieneArtifact(contract, both[1], both[0]).save(hygiene_folder, overwrite=True)
    if emit_contract or hygiene_folder is None:
        (Path(folder) / CONTRACT_FILE).write_text(contract.to_json(), encoding="utf-8")
    return model
