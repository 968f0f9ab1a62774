"""Command line: make a dataset of the tables that a disassembler left in a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources import tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("graphkin.export", description=__doc__)
    p.add_argument("source", help=f"folder of the Parquet tables {', '.join(tables.RAW)}")
    p.add_argument("out", help="folder of the dataset")
    args = p.parse_args(argv)
    tables.export_raw(SparkSession.builder.appName("graphkin").getOrCreate(), args.source, args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
