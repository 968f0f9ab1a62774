"""Command line: match two exported datasets and write the result."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .operators import matchers
from .plans.diff import Options, Side, diff
from .sources import tables


#: fixed values: the methods that recover compile units
RECOVERED = ["recover-apsnse", "recover-apspse", "recover-agglnse", "recover-agglpse"]


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("graphkin", description=__doc__)
    p.add_argument("lhs", help="folder of the first dataset")
    p.add_argument("rhs", help="folder of the second dataset")
    p.add_argument("out", help="folder for matched, unmatched1 and unmatched2")
    p.add_argument("-x", "--no-match-inexact", action="store_true")
    p.add_argument("-i", "--no-match-imports", action="store_true")
    p.add_argument("-e", "--match-exports", action="store_true")
    p.add_argument("-n", "--match-names", action="store_true")
    p.add_argument("-l", "--match-hierarchical", choices=["louvain", "modular_decomposition", "groups", *RECOVERED], help="recover-*: the table (pk, grp) of that name in each dataset's folder")
    p.add_argument("-g", "--groups", nargs=2, metavar=("LHS", "RHS"), help="Parquet tables (pk, grp) of groups")
    p.add_argument("-c", "--checkpoints", help="a folder that driver and executors share; spark.checkpoint.dir by default")
    p.add_argument("-m", "--time", action="store_true", help="print the seconds of each matcher")
    p.add_argument("-d", "--debug", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    if args.debug:
        file = logging.FileHandler("debug.log")
        logging.getLogger("graphkin").addHandler(file)
        logging.getLogger("graphkin").setLevel(logging.DEBUG)
    spark = SparkSession.builder.appName("graphkin").getOrCreate()
    if args.checkpoints or not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = args.checkpoints or spark.conf.get("spark.checkpoint.dir", None) or f"{args.out}/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    method = args.match_hierarchical
    groups = [None, None]
    if args.groups:
        groups = [spark.read.parquet(p) for p in args.groups]
    elif method in RECOVERED:
        groups = [tables.load_groups(spark, p, method) for p in (args.lhs, args.rhs)]
    sides = [Side(*tables.load(spark, p), g) for p, g in zip((args.lhs, args.rhs), groups, strict=True)]
    options = Options(imports=not args.no_match_imports, exports=args.match_exports, names=args.match_names, inexact=not args.no_match_inexact, hierarchy="groups" if method in RECOVERED else method)
    result = diff(*sides, options, lambda df: df.checkpoint())
    tables.save(result.matches, result.unmatched_lhs, result.unmatched_rhs, args.out)
    for m in result.metrics if args.time else []:
        print(f"{m['matcher']}: {m['found']} in {m['seconds']:.1f} s")
    print(matchers.report(result.matches).first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
