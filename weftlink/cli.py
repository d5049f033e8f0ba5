"""Command line: `python -m weftlink.cli STAGE --mode train --data-dir … --set KEY=VALUE`."""

from __future__ import annotations

import argparse
import json

from .config import resolve

STAGES = ("prepare", "embed", "retrieve", "features", "train", "calibrate", "predict", "evaluate", "validate", "package", "fixture", "explore", "all")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftlink")
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--config")
    parser.add_argument("--mode", choices=("train", "test"))
    parser.add_argument("--data-dir")
    parser.add_argument("--output-dir")
    parser.add_argument("--train-percent", type=float)
    parser.add_argument("--policy-dir")
    parser.add_argument("--destination", default="package.zip")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    args = parser.parse_args(argv)
    try:
        extra = dict(item.split("=", 1) for item in args.set)
        config = resolve(args.config, {"mode": args.mode, "data_dir": args.data_dir, "output_dir": args.output_dir, "train_percent": args.train_percent, **extra})
        if config.mode == "test" and args.stage in ("train", "calibrate", "evaluate"):
            raise ValueError(f"{args.stage} needs --mode train")
        if config.mode == "test" and args.stage in ("predict", "all") and not args.policy_dir:
            raise ValueError("--policy-dir names the calibration of a training run")
    except ValueError as wrong:
        parser.error(str(wrong))
    from pyspark.sql import SparkSession

    from .plans.explorer import export
    from .plans.linkage import Linkage
    from .sources.fixture import write_fixture

    spark = SparkSession.builder.appName("weftlink").getOrCreate()
    if args.stage == "fixture":
        write_fixture(spark, config.data_dir)
        return 0
    if args.stage == "explore":
        export(spark, config.data_dir, args.destination, seed=config.seed)
        return 0
    run = Linkage(spark, config, args.policy_dir)
    done = run.package(args.destination) if args.stage == "package" else getattr(run, args.stage)()
    print(json.dumps(done, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
