"""Artifacts: vocabulary, matcher and contract as data files, and the runtime over them."""

from __future__ import annotations

import json
import shutil
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

from tokenloom.operators import matcher, validate
from tokenloom.operators.induce import numbered
from tokenloom.operators.matcher import Matcher
from tokenloom.operators.mining import SPECIALS
from tokenloom.plans.config import Contract

VOCAB_SCHEMA, HYGIENE_SCHEMA = "vocabulary.v1", "hygiene_artifact.v1"
#: Files of an artifact folder. Other names can be given where a folder is read.
VOCAB_FILE, META_FILE, CONTRACT_FILE = "vocabulary_artifact.json", "vocabulary_meta.json", "contract.json"
_ROLES = dict(zip(("pad_token", "unk_token", "cls_token", "sep_token", "mask_token"), SPECIALS))


def _dump(path: Path, data: object) -> None:
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")


def _file(path: str | Path, name: str) -> Path:
    """The file itself, or the one of that name in a folder."""
    p = Path(path)
    p = p / name if p.is_dir() else p
    if not p.exists():
        raise FileNotFoundError(f"no {name} at {p}")
    return p


@dataclass
class Artifact:
    meta: dict
    vocab: dict[str, int]
    contract: Contract
    special_tokens: list[str]
    matcher: Matcher = None

    def __post_init__(self) -> None:
        self.matcher = self.matcher or Matcher.of(self.vocab.items())

    @cached_property
    def tokens(self) -> list[str]:
        """Token of each id, empty in gaps."""
        out = [""] * (max(self.vocab.values(), default=-1) + 1)
        for token, number in self.vocab.items():
            out[number] = token
        return out

    def dumps(self) -> str:
        body = {"meta": self.meta, "vocab": self.vocab, "matcher": self.matcher.to_dict(), "contract": self.contract.to_dict(), "special_tokens": self.special_tokens}
        return json.dumps(body, ensure_ascii=False)

    @classmethod
    def loads(cls, text: str) -> Artifact:
        d = json.loads(text)
        vocab = {str(k): int(v) for k, v in d["vocab"].items()}
        return cls(d.get("meta") or {"schema_version": VOCAB_SCHEMA}, vocab, Contract.from_dict(d["contract"]), [str(t) for t in d.get("special_tokens", [])], Matcher.from_dict(d["matcher"]))

    @classmethod
    def load(cls, path: str | Path, name: str = VOCAB_FILE) -> Artifact:
        """From the file itself, or from the one of that name in a folder."""
        return cls.loads(_file(path, name).read_text(encoding="utf-8"))

    def save(self, folder: str | Path) -> None:
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        (out / VOCAB_FILE).write_text(self.dumps(), encoding="utf-8")
        _dump(out / "tokenizer_config.json", {"model_max_length": 512, "padding_side": "right", "truncation_side": "right"})
        _dump(out / "special_tokens_map.json", {**_ROLES, "additional_special_tokens": [t for t in self.special_tokens if t not in SPECIALS]})

    def save_vocabulary(self, folder: str | Path, prefix: str | None = None) -> Path:
        path = Path(folder) / ((prefix + "-" if prefix else "") + VOCAB_FILE)
        path.write_text(self.dumps(), encoding="utf-8")
        return path

    def frame(self, spark: SparkSession) -> DataFrame:
        return numbered(spark, self.tokens).where("token <> ''")

    def issues(self, spark: SparkSession, **limits: float) -> DataFrame:
        return issues_of(self.frame(spark), self.contract, **limits)


def issues_of(vocab: DataFrame, contract: Contract, **limits: float) -> DataFrame:
    """The issues of a vocabulary under a contract; it is a table with a token column, of any size."""
    return validate.issues(vocab.where("token <> ''"), contract.typed_symbols(), **limits)


class Runtime:
    """Encoding and decoding by an artifact, as Column functions; noise is not cleaned here."""

    def __init__(self, artifact: Artifact) -> None:
        self.artifact = artifact

    @property
    def vocab_size(self) -> int:
        return len(self.artifact.vocab)

    def token_id(self, token: str) -> int:
        return self.artifact.vocab.get(token, self.artifact.vocab.get("[UNK]", 1))

    def token(self, number: int) -> str:
        return self.artifact.tokens[number] if 0 <= number < len(self.artifact.tokens) else "[UNK]"

    def normalized(self, text: Column) -> Column:
        return self.artifact.contract.applied(text)

    def encoded(self, text: Column) -> Column:
        return matcher.encoded(self.normalized(text), self.artifact.vocab)

    def decoded(self, ids: Column) -> Column:
        return matcher.decoded(ids, self.artifact.vocab)

    def tokenized(self, text: Column) -> Column:
        return matcher.trie_tokens(self.normalized(text), self.artifact.vocab)

    def batch(self, text: Column, length: int = 512) -> Column:
        return matcher.batch(self.encoded(text), length)

    def register(self, spark: SparkSession, name: str = "encode_text") -> None:
        """Makes the encoder callable from SQL, for texts that the contract has been applied to."""
        spark.udf.register(name, matcher.encoded_arrow(self.artifact.vocab))


def export_folder(source: str | Path, target: str | Path, max_length: int = 512, overwrite: bool = False, extra: Mapping | None = None) -> None:
    """A tokenizer folder of plain data: artifact, vocabulary, configuration and meta data."""
    src, out = Path(source), Path(target)
    artifact = Artifact.load(src)
    if out.exists():
        if not overwrite:
            raise FileExistsError(f"{out} is there already")
        shutil.rmtree(out)
    out.mkdir(parents=True)
    shutil.copy2(_file(src, VOCAB_FILE), out / VOCAB_FILE)
    roles = src / "special_tokens_map.json"
    _dump(out / roles.name, json.loads(roles.read_text(encoding="utf-8")) if roles.exists() else _ROLES)
    _dump(out / "vocab.json", artifact.vocab)
    _dump(out / "tokenizer_config.json", {"tokenizer_class": "VocabularyTokenizer", "model_max_length": int(max_length), "padding_side": "right", "truncation_side": "right", **(extra or {})})
    _dump(out / META_FILE, artifact.meta)


@dataclass(frozen=True)
class HygieneArtifact:
    contract: Contract = field(default_factory=Contract)
    hygiene_version: str = "unversioned"
    tokenizer_version: str = "unversioned"
    schema_version: str = HYGIENE_SCHEMA

    def dumps(self) -> str:
        d = {"schema_version": self.schema_version, "hygiene_version": self.hygiene_version, "tokenizer_version": self.tokenizer_version, "contract": self.contract.to_dict()}
        return json.dumps(d, ensure_ascii=False, indent=2)

    @classmethod
    def loads(cls, text: str) -> HygieneArtifact:
        d = json.loads(text)
        return cls(Contract.from_dict(d.get("contract", {})), str(d.get("hygiene_version", "unversioned")), str(d.get("tokenizer_version", "unversioned")), d.get("schema_version", HYGIENE_SCHEMA))

    @classmethod
    def load(cls, path: str | Path) -> HygieneArtifact:
        return cls.loads(_file(path, "hygiene_artifact.json").read_text(encoding="utf-8"))

    def save(self, folder: str | Path, overwrite: bool = False) -> Path:
        path = Path(folder) / "hygiene_artifact.json"
        if path.exists() and not overwrite:
            raise FileExistsError(f"{path} is there already")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(self.dumps(), encoding="utf-8")
        return path

    def normalized(self, text: Column) -> Column:
        return self.contract.applied(text)


def versions(tokenizer: str | None, hygiene: str | None, both: str | None = None) -> tuple[str, str]:
    tokenizer, hygiene = tokenizer or both, hygiene or both
    if not tokenizer or not hygiene:
        raise ValueError("a hygiene artifact needs both a tokenizer and a hygiene version")
    return tokenizer, hygiene


def tokenizer_config(path: str | Path) -> dict:
    return json.loads(_file(path, "tokenizer_config.json").read_text(encoding="utf-8"))


def check_versions(artifact: HygieneArtifact, config: Mapping) -> None:
    """Both versions in a tokenizer's configuration must be the artifact's."""
    got, want = (config.get("tokenizer_version"), config.get("hygiene_version")), (artifact.tokenizer_version, artifact.hygiene_version)
    if got != want:
        raise ValueError(f"tokenizer and hygiene versions {got} don't match the artifact's {want}")


def save_tokenizer(model: Mapping, folder: str | Path, max_length: int = 512, tokenizer_version: str | None = None, hygiene_version: str | None = None, specials: Sequence[str] = ()) -> None:
    """A subword model (type, vocab, merges or scores) as JSON files."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    _dump(out / "tokenizer.json", {"version": "1.0", "pre_tokenizer": {"type": "Whitespace"}, "model": dict(model)})
    config = {"tokenizer_class": "PreTrainedTokenizerFast", "model_max_length": int(max_length), "padding_side": "right", "truncation_side": "right"}
    for name, value in (("tokenizer_version", tokenizer_version), ("hygiene_version", hygiene_version)):
        if value is not None:
            config[name] = value
    _dump(out / "tokenizer_config.json", config)
    _dump(out / "special_tokens_map.json", {**_ROLES, **({"additional_special_tokens": list(specials)} if specials else {})})
