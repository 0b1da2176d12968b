"""Command line: preprocess, run and score."""

from __future__ import annotations

import argparse
import json
from dataclasses import MISSING, fields

from .config import CHOICES, PreprocessConfig, RunConfig
from .plans.preprocess import build_modules
from .plans.run import run_directory
from .plans.score import build_scores
from .session import build_session


def _options(parser: argparse.ArgumentParser, config: type) -> None:
    kinds = {"int": int, "float": float}
    for f in fields(config):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            parser.add_argument(flag, action="store_true")
        else:
            parser.add_argument(flag, type=kinds.get(f.type, str), choices=sorted(CHOICES[f.name]) if f.name in CHOICES else None,
                                default=None if f.default is MISSING else f.default, required=f.default is MISSING)


def _config(args: argparse.Namespace, config: type):
    return config(**{f.name: getattr(args, f.name) for f in fields(config)}).validate()


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="netloom")
    commands = parser.add_subparsers(dest="command", required=True)
    pre = commands.add_parser("preprocess", help="matrix to gene modules")
    pre.add_argument("--outdir", required=True)
    _options(pre, PreprocessConfig)
    run = commands.add_parser("run", help="modules to networks")
    source = run.add_mutually_exclusive_group(required=True)
    source.add_argument("--module-csv")
    source.add_argument("--module-dir")
    run.add_argument("--result-dir", required=True)
    _options(run, RunConfig)
    score = commands.add_parser("score", help="networks to scores")
    for flag in ("--module-dir", "--result-dir", "--out-csv"):
        score.add_argument(flag, required=True)
    for flag, kind, default in (("--alpha", float, 0.05), ("--beta-mode", str, "expression"), ("--beta-lambda", float, 1.0),
                                ("--edge-weight-mode", str, "binary"), ("--edge-weight-lambda", float, 1.0),
                                ("--tf-top-k", int, 20), ("--propagation-mode", str, "sum")):
        score.add_argument(flag, type=kind, default=default)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    spark = build_session()
    if args.command == "preprocess":
        payload = build_modules(spark, _config(args, PreprocessConfig), args.outdir)
    elif args.command == "run":
        parent, _, name = (args.module_csv or "").rstrip("/").rpartition("/")
        only, folder = (name.removesuffix(".csv"), parent or ".") if args.module_csv else (None, args.module_dir)
        payload = run_directory(spark, folder, args.result_dir, _config(args, RunConfig), only)
    else:
        wide = build_scores(spark, args.module_dir, args.result_dir, args.out_csv, args.alpha, args.beta_mode, args.beta_lambda,
                            args.edge_weight_mode, args.edge_weight_lambda, args.tf_top_k, args.propagation_mode)
        payload = {"out_csv": args.out_csv, "shape": [wide.count(), len(wide.columns) - 1]}
    print(json.dumps(payload, indent=2))
