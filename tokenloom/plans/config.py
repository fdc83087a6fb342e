"""Frozen configurations with JSON round trips."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import hygiene, httpstruct, records
from tokenloom.functions.text import lower_ascii
from tokenloom.operators import mining


def _is_http(mode: str | None, default: str) -> bool:
    return str(mode or default).strip().lower() in ("http", "waf")


class _Json:
    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=2)

    @classmethod
    def from_dict(cls, data: dict):
        return cls(**data)

    @classmethod
    def from_json(cls, text: str):
        return cls.from_dict(json.loads(text))


@dataclass(frozen=True)
class Contract(_Json):
    """What happens to a text before tokens are looked for, at build time and at encoding time alike."""

    enable_json_serialization: bool = True
    enable_typed_hygiene: bool = True
    json_field_order: list[str] | None = None
    json_emit_missing: bool = True
    enable_numeric_buckets: bool = True
    typed_hygiene_mode: str = "generic"
    enable_version_token: bool = True
    long_num_min_digits: int = 6
    structured_input_mode: str = "none"
    structured_max_len: int = 4096
    lowercase_mode: str = "none"
    key_prefix: str = "<K:"
    key_suffix: str = ">"
    sep_token: str = "<SEP>"
    eol_token: str = "<EOL>"
    empty_token: str = "<EMPTY>"

    @property
    def marks(self) -> httpstruct.Marks:
        return httpstruct.Marks(self.sep_token, self.eol_token, self.empty_token, self.key_prefix, self.key_suffix)

    @property
    def structures(self) -> bool:
        """Whether texts are taken apart as HTTP requests."""
        return _is_http(self.structured_input_mode, "none")

    def applied(self, text: Column) -> Column:
        """The contract over a text column: structure, typed replacement, case."""
        if self.lowercase_mode not in ("none", "", "ascii"):
            raise ValueError(f"no lowercase mode {self.lowercase_mode!r}")
        if self.structures:
            text = httpstruct.structured(text, self.marks, self.long_num_min_digits, int(self.structured_max_len))
        if self.enable_typed_hygiene:
            if _is_http(self.typed_hygiene_mode, "generic"):
                text = hygiene.http(text, self.enable_numeric_buckets, self.long_num_min_digits, self.enable_version_token)
            else:
                text = hygiene.generic(text, self.enable_numeric_buckets, self.long_num_min_digits)
        return lower_ascii(text) if self.lowercase_mode == "ascii" else text

    def applied_to_rows(self, df: DataFrame) -> Column:
        """The contract over whole rows: the parts of a request taken as such if structure is asked for, else role-marked
        serialization, or compact JSON with that switched off."""
        plain = replace(self, structured_input_mode="none")
        if self.structures and httpstruct.is_request(df):
            return plain.applied(httpstruct.structured_row(df, self.marks, self.long_num_min_digits, int(self.structured_max_len)))
        if self.enable_json_serialization:
            return plain.applied(records.serialized(df, order=self.json_field_order, emit_missing=self.json_emit_missing, marks=self.marks))
        return plain.applied(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))

    def typed_symbols(self) -> list[str]:
        if not self.enable_typed_hygiene:
            return []
        symbols = [f"<{s}>" for s in "UUID IPV6 IPV4 TS HASH HEX B64 PORT VER".split()]
        if self.enable_numeric_buckets:
            symbols += [f"<NUM_POW10_{k}>" for k in range(max(0, self.long_num_min_digits - 1), 13)]
        return symbols


@dataclass(frozen=True)
class Trainer(_Json):
    """Budget and candidate range of a vocabulary; None is settled by the preset."""

    vocab_size: int = 8192
    min_freq: int = 10
    len_min: int | None = None
    len_max: int = 24
    boundaries: list[str] | None = None
    preset: str = "default"
    lambda_rd: float = 0.0
    seed: int = 0
    sample_texts: int | None = None
    distortion_mode: str = "none"
    boundary_penalty: float = 1.0
    include_char_vocab: bool | None = None
    include_ascii_fallback: bool | None = None
    symbol_ngram_min_len: int = 2
    symbol_ngram_max_len: int | None = None

    @property
    def for_http(self) -> bool:
        return _is_http(self.preset, "default")

    def settled(self) -> Trainer:
        """Every open choice made as the preset has it."""
        pick = lambda value, default: default if value is None else value
        http = self.for_http
        done = replace(
            self,
            boundaries=list(pick(self.boundaries, mining.boundaries(self.preset or "default"))),
            include_char_vocab=pick(self.include_char_vocab, http),
            include_ascii_fallback=pick(self.include_ascii_fallback, http),
            symbol_ngram_max_len=pick(self.symbol_ngram_max_len, 4 if http else 0),
            len_min=pick(self.len_min, 1 if http else 2),
        )
        if not 1 <= done.len_min <= done.len_max:
            raise ValueError(f"candidates can't have lengths {done.len_min} to {done.len_max}")
        return done


@dataclass(frozen=True)
class Build(_Json):
    """A whole build, as it is kept in the artifact."""

    schema_version: str = "build.v1"
    trainer: Trainer = field(default_factory=Trainer)
    contract: Contract = field(default_factory=Contract)
    corpus_format: str | None = None
    text_key: str | None = None
    max_samples: int | None = None

    @classmethod
    def from_dict(cls, data: dict) -> Build:
        known = {k: data[k] for k in ("schema_version", "corpus_format", "text_key", "max_samples") if k in data}
        return cls(trainer=Trainer.from_dict(data.get("trainer", {})), contract=Contract.from_dict(data.get("contract", {})), **known)

    def settled(self) -> Build:
        """Preset defaults filled in; the HTTP presets force HTTP hygiene over the generic one."""
        contract = self.contract
        if self.trainer.for_http and (contract.typed_hygiene_mode or "generic").lower() == "generic":
            contract = replace(contract, typed_hygiene_mode="http")
        return replace(self, trainer=self.trainer.settled(), contract=contract)
