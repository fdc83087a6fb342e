"""Command line: train vocabularies and baselines, validate and export artifacts, pull, clean and contract corpora.

Paths are read and written by Spark, on whatever file system the session knows; artifacts are small files of the driver.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import fields, replace
from pathlib import Path

from pyspark.sql import SparkSession

from tokenloom.plans import runs
from tokenloom.plans.artifact import Artifact, export_folder
from tokenloom.plans.build import build_baseline, build_vocabulary
from tokenloom.plans.config import Build, Contract, Trainer
from tokenloom.sources import scan, sink

BASELINES = ("bpe", "wordpiece", "unigram")


def _session() -> SparkSession:
    return SparkSession.builder.appName("tokenloom").getOrCreate()


def _contract(args: argparse.Namespace) -> Contract:
    """From a JSON file if one is named, with the options given laid over it."""
    base = Contract.from_json(Path(args.contract).read_text(encoding="utf-8")) if args.contract else Contract()
    given = {name: value for name, value in vars(args).items() if name in {f.name for f in fields(Contract)} and value is not None}
    return replace(base, **given)


def train_vocabulary(args: argparse.Namespace) -> int:
    """With an HTTP preset texts are structured, unless the contract or an option says otherwise."""
    spark = _session()
    if args.config:
        build = Build.from_json(Path(args.config).read_text(encoding="utf-8"))
    else:
        trainer = Trainer(args.vocab_size, args.min_freq, preset=args.preset, seed=args.seed, lambda_rd=args.lambda_rd, sample_texts=args.most, distortion_mode=args.distortion_mode, boundary_penalty=args.boundary_penalty)
        contract = _contract(args)
        if trainer.for_http and args.structured_input_mode is None and not args.contract:
            contract = replace(contract, structured_input_mode="http")
        build = Build(trainer=trainer, contract=contract, corpus_format=args.format, text_key=args.key, max_samples=args.most)
    texts = scan.scan(spark, args.corpus, args.format, args.key, args.most, clean=args.clean)
    artifact = build_vocabulary(texts, build)
    artifact.save(args.out)
    print(f"{len(artifact.vocab)} tokens in {args.out}")
    return 0


def train_baseline(args: argparse.Namespace) -> int:
    texts = scan.scan(_session(), args.corpus, args.format, args.key, args.most, clean=args.clean)
    build_baseline(
        args.kind, texts, args.out, args.vocab_size, _contract(args), args.min_freq, args.max_length,
        args.hygiene_out, args.tokenizer_version, args.hygiene_version, args.version, args.emit_contract,
    )
    print(f"{args.kind} model in {args.out}")
    return 0


def validate(args: argparse.Namespace) -> int:
    """0 if there are no issues, else 2."""
    found = Artifact.load(args.artifact).issues(_session(), max_long_hex_fraction=args.hex_share, max_long_hex_count=args.hex_most, max_b64_fraction=args.b64_share, max_b64_count=args.b64_most).collect()
    for issue in found:
        print(f"{issue.code}: {issue.message}")
    if not found:
        print("no issues")
    return 2 if found else 0


def export(args: argparse.Namespace) -> int:
    export_folder(args.artifact, args.out, args.max_length, args.overwrite)
    print(f"exported to {args.out}")
    return 0


def pull(args: argparse.Namespace) -> int:
    spark = _session()
    splits = dict(pair.split("=", 1) for pair in args.splits)
    df = scan.load_dataset(spark, splits, args.split, args.format)
    wanted = [c for c in (args.key, args.label) if c]
    scan.pulled(df.select(*wanted) if wanted else df, args.out, args.most, args.shuffle, args.seed)
    print(f"wrote {args.out}")
    return 0


def clean(args: argparse.Namespace) -> int:
    sink.clean_corpus(_session(), args.corpus, args.out, args.format, args.key, args.most, args.out_format, args.structure, args.max_len)
    print(f"wrote {args.out}")
    return 0


def contract(args: argparse.Namespace) -> int:
    """To a file by Spark, or line by line to standard output without holding the corpus."""
    texts = sink.write_contracted(_session(), args.corpus, _contract(args), args.out, args.format, args.key, args.most)
    if args.out is None:
        for row in texts.toLocalIterator():
            print(row.text)
    return 0


def verify(args: argparse.Namespace) -> int:
    """How a sample of a corpus is encoded: number of tokens and share of unknown ones."""
    texts = scan.scan(_session(), args.corpus, args.format, args.key)
    report, seen = runs.verified(texts, Artifact.load(args.artifact), args.n, args.seed)
    print(f"{seen} texts")
    for row in report.orderBy("id").collect():  # n rows at most
        print(f"{row.tokens} tokens, {row.unknown} unknown ({row.rate:.3f}): {row.text[:200]!r}")
    return 0


def _corpus_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--corpus", required=True, help="path of the corpus")
    p.add_argument("--format", default="txt", choices=scan.FORMATS)
    p.add_argument("--key", default="text", help="field or column that holds the text")
    p.add_argument("--most", type=int, help="first rows only")


def _contract_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--contract", help="contract as a JSON file")
    p.add_argument("--structured", dest="structured_input_mode", choices=("none", "http", "waf"))
    p.add_argument("--structured-max-len", dest="structured_max_len", type=int)
    p.add_argument("--hygiene", dest="typed_hygiene_mode", choices=("generic", "http", "waf"))
    p.add_argument("--no-hygiene", dest="enable_typed_hygiene", action="store_false", default=None)
    p.add_argument("--no-buckets", dest="enable_numeric_buckets", action="store_false", default=None)
    p.add_argument("--min-digits", dest="long_num_min_digits", type=int)
    p.add_argument("--lowercase", dest="lowercase_mode", choices=("none", "ascii"))


def _train_options(p: argparse.ArgumentParser, size: int | None) -> None:
    _corpus_options(p)
    _contract_options(p)
    p.add_argument("--no-clean", dest="clean", action="store_false", help="leave noise records as they are")
    p.add_argument("--out", required=True)
    p.add_argument("--vocab-size", type=int, default=size, required=size is None)
    p.add_argument("--min-freq", type=int, default=10)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tokenloom", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(required=True)
    train = commands.add_parser("train", help="train a vocabulary or a subword baseline").add_subparsers(required=True)

    v = train.add_parser("vocabulary", help="a vocabulary with its matcher and contract")
    _train_options(v, 8192)
    v.add_argument("--config", help="a whole build as a JSON file")
    v.add_argument("--preset", default="default", choices=("default", "http", "waf"))
    v.add_argument("--seed", type=int, default=0)
    v.add_argument("--lambda-rd", type=float, default=0.0)
    v.add_argument("--distortion-mode", default="none", choices=("none", "boundary_penalty"))
    v.add_argument("--boundary-penalty", type=float, default=1.0)
    v.set_defaults(run=train_vocabulary)

    for kind in BASELINES:
        b = train.add_parser(kind, help=f"a {kind} model over contracted texts")
        _train_options(b, None)
        b.add_argument("--max-length", type=int, default=512)
        b.add_argument("--hygiene-out", help="folder for the contract as an artifact of its own")
        b.add_argument("--tokenizer-version")
        b.add_argument("--hygiene-version")
        b.add_argument("--version", help="both versions")
        b.add_argument("--emit-contract", action="store_true", help="write the contract beside the model too")
        b.set_defaults(run=train_baseline, kind=kind)

    c = commands.add_parser("validate", help="look for broken symbols and random blobs; 2 if there are any")
    c.add_argument("--artifact", required=True)
    for name, default in (("hex-share", 0.005), ("hex-most", 32), ("b64-share", 0.002), ("b64-most", 16)):
        c.add_argument(f"--{name}", type=type(default), default=default)
    c.set_defaults(run=validate)

    e = commands.add_parser("export", help="a tokenizer folder of plain files")
    e.add_argument("--artifact", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--max-length", type=int, default=512)
    e.add_argument("--overwrite", action="store_true")
    e.set_defaults(run=export)

    d = commands.add_parser("pull", help="write a data set as Parquet")
    d.add_argument("splits", nargs="+", help="SPLIT=PATH of each split")
    d.add_argument("--split", help="one of them, or a held-out one by another name")
    d.add_argument("--format", default="parquet")
    d.add_argument("--key", help="text column")
    d.add_argument("--label", help="label column")
    d.add_argument("--most", type=int)
    d.add_argument("--shuffle", action="store_true")
    d.add_argument("--seed", type=int, default=0)
    d.add_argument("--out", required=True)
    d.set_defaults(run=pull)

    n = commands.add_parser("clean", help="put symbols in place of noise records")
    _corpus_options(n)
    n.add_argument("--out", required=True)
    n.add_argument("--out-format", choices=scan.FORMATS)
    n.add_argument("--structure", choices=("none", "http", "waf"))
    n.add_argument("--max-len", type=int, default=4096)
    n.set_defaults(run=clean)

    k = commands.add_parser("contract", help="a corpus under a contract, to a file or standard output")
    _corpus_options(k)
    _contract_options(k)
    k.add_argument("--out")
    k.set_defaults(run=contract)

    y = commands.add_parser("verify", help="encode a sample of a corpus and count unknown tokens")
    _corpus_options(y)
    y.add_argument("--artifact", required=True)
    y.add_argument("--n", type=int, default=5)
    y.add_argument("--seed", type=int, default=42)
    y.set_defaults(run=verify)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
