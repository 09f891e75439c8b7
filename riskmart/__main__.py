"""Run every layer, or one of them, on a folder that holds the raw CSV files."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from riskmart.config import GRAINS, HISTORY_ENDS, MEDIANS, RAW_MODES, RECOMMENDED_CONF, Config
from riskmart.plans import run as R
from riskmart.plans.modelling import SPLITS, Modelling

COUNTS = ("prediction_months", "label_window_months", "max_loan_months", "test_last_n_months")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskmart")
    p.add_argument("root", help="folder with data/*.csv; layers are written below it")
    p.add_argument("--stage", choices=R.STAGES, help="only this layer, from those below it as they are")
    p.add_argument("--split", choices=SPLITS, default="time")
    p.add_argument("--grain", choices=GRAINS, default="customer")
    p.add_argument("--history-end", choices=HISTORY_ENDS, default="inclusive")
    p.add_argument("--raw-mode", choices=RAW_MODES, default="batch", help="whether bronze keeps months that the raw files no longer have")
    p.add_argument("--median", choices=MEDIANS, default="approximate", help="how missing numbers are filled")
    for name in COUNTS:
        p.add_argument(f"--{name.replace('_', '-')}", type=int, metavar="N")
    p.add_argument("--any-unit-form", action="store_true", help="read 1 Year and 1 Month like Years and Months")
    p.add_argument("--exclude", nargs="*", default=[], metavar="COLUMN", help="columns that are no features")
    p.add_argument("--multi-line", nargs="*", default=[], metavar="SOURCE", help="sources with line breaks in fields")
    p.add_argument(
        "--column-type", nargs=3, action="append", default=[], metavar=("SOURCE", "COLUMN", "TYPE"),
        help="type of a column that the schemas do not declare",
    )
    p.add_argument("--refresh", action="store_true", help="rebuild finished layers")
    return p


def config_of(args: argparse.Namespace) -> Config:
    types: dict[str, dict[str, str]] = {}
    for source, column, kind in args.column_type:
        types.setdefault(source, {})[column] = kind
    counts = {name: getattr(args, name) for name in COUNTS if getattr(args, name) is not None}
    return Config.under(
        args.root,
        grain=args.grain,
        history_end=args.history_end,
        plural_only=not args.any_unit_form,
        exclude=tuple(args.exclude),
        multi_line={name: True for name in args.multi_line},
        column_types=types,
        raw_mode=args.raw_mode,
        median=args.median,
        **counts,
    )


def start(spark: SparkSession, args: argparse.Namespace) -> Modelling | None:
    config = config_of(args)
    if args.stage is None:
        return R.run(spark, config, args.split, args.refresh)
    if args.stage == "model":
        return R.run_model(spark, config, args.split, args.refresh)
    getattr(R, f"run_{args.stage}")(spark, config, args.refresh)
    return None


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    builder = SparkSession.builder.appName("riskmart")
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    result = start(builder.getOrCreate(), args)
    if result is not None:
        for name, trained in result.models.items():
            print(f"{name}: area under ROC {trained.auc:.4f}")
        result.importance.show(10, truncate=False)


if __name__ == "__main__":
    main()
