"""Command line: ``python -m tidemark --config series.yaml --output out``."""

from __future__ import annotations

import argparse

from . import __version__


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tidemark", description="Generate labelled time series on Spark.")
    p.add_argument("--config", required=True, help="YAML or JSON configuration")
    p.add_argument("--output", help="folder for the series")
    p.add_argument("--no-save", action="store_true", help="generate without writing")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--only", help="name of the one series to generate")
    p.add_argument("--addons", nargs="*", default=[], help="built-in names or dotted paths")
    p.add_argument("--parallelism", type=int, help="shuffle partitions")
    p.add_argument("--dataset", action="store_true", help="the configuration describes a dataset grid")
    p.add_argument("--version", action="version", version=__version__)
    args = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans.addons import resolve
    from .plans.dataset import Dataset
    from .plans.engine import Engine

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if args.parallelism:
        spark.conf.set("spark.sql.shuffle.partitions", str(args.parallelism))
    if args.dataset:
        Dataset(spark, args.config).write(args.output)
        return
    engine = Engine(spark, args.config, seed=args.seed, only=args.only, add_ons=[resolve(a) for a in args.addons])
    out = engine.generate(None if args.no_save else args.output)
    if args.no_save:
        print(out.count(), "samples")


if __name__ == "__main__":
    main()
