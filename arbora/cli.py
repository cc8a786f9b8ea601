"""Command line: ``python -m arbora.cli ingest TABLE FILE...`` and ``info TABLE``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from arbora.operators.ground import CLASSIFIERS
from arbora.sources.catalog import PointTable
from arbora.sources.ingest import Stages, ingest_las


def ingest(spark: SparkSession, table: PointTable, files: list[str], classes: list[int], overwrite: bool) -> dict[str, int]:
    """Adds LAS files in one job, each once, keeping these classes (all, if none)."""
    return ingest_las(spark, table, files, Stages(classes=tuple(classes)), overwrite)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="arbora")
    commands = parser.add_subparsers(dest="command", required=True)
    add = commands.add_parser("ingest")
    add.add_argument("table")
    add.add_argument("files", nargs="+", help="files, folders or patterns")
    add.add_argument("-c", "--class", dest="classes", type=int, action="append", default=[])
    add.add_argument("--overwrite", action="store_true", help="removes all points of the table first")
    add.add_argument("--reproject", help="auto, or an EPSG code")
    add.add_argument("--denoise", action="store_true")
    add.add_argument("--ground", choices=sorted(CLASSIFIERS), help="classify ground and vegetation")
    add.add_argument("--tile", type=float, default=Stages.tile)
    add.add_argument("--buffer", type=float, default=Stages.buffer)
    commands.add_parser("info").add_argument("table")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("arbora").getOrCreate()
    table = PointTable(spark, args.table)
    if args.command == "ingest":
        stages = Stages(args.reproject, args.denoise, args.ground, tile=args.tile, buffer=args.buffer, classes=tuple(args.classes))
        for file, n in ingest_las(spark, table, args.files, stages, args.overwrite).items():
            print(f"{file}: {'failed' if n < 0 else n}")
    else:
        print(f"EPSG:{table.epsg}, years {table.available_years()}, {table.points().count()} points in {table.file_count()} files")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
