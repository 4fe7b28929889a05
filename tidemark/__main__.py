"""Job entry points for spark-submit: ``train`` and ``evaluate``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.operators.splits import sample_rows
from tidemark.plans.config import params_from_config, read_config
from tidemark.plans.train import DriftAwareScorer, evaluate, train_and_test
from tidemark.sources.readers import load_data, read_transactions

QUICK_ROWS = {"train": 1_000, "test": 500}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("job", choices=["train", "evaluate"])
    parser.add_argument("--data-path", required=True)
    parser.add_argument("--format", default="csv")
    parser.add_argument("--config")
    parser.add_argument("--model-path", help="trained run to evaluate")
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--quick-test", action="store_true", help="train on a small fixed-size sample")
    parser.add_argument("--drift-analysis", action="store_true", help="evaluate per period as well")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName(f"tidemark-{args.job}").getOrCreate()
    roles, params, eval_params = params_from_config(read_config(spark, args.config) if args.config else {})
    if args.job == "train":
        train_rows, test_rows = load_data(spark, args.data_path, fmt=args.format, roles=roles)
        if args.quick_test:
            train_rows = sample_rows(train_rows, roles.key, QUICK_ROWS["train"], params.seed)
            test_rows = sample_rows(test_rows, roles.key, QUICK_ROWS["test"], params.seed)
        train_and_test(train_rows, test_rows, roles, params, eval_params, args.output_dir)
    else:
        if not args.model_path:
            raise SystemExit("evaluate needs --model-path")
        scorer = DriftAwareScorer.load(spark, args.model_path)
        rows = read_transactions(spark, args.data_path, "test", args.format, scorer.roles)
        periods = params.periods if args.drift_analysis else None
        evaluate(scorer, rows, eval_params, periods, args.output_dir)


if __name__ == "__main__":
    main()
