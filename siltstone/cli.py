"""Command line: groups and compresses the files of a folder by one method, and writes groups, files and reports.

    python -m siltstone.cli -i FOLDER -m METHOD -o OUT [-c CHUNKING] [-n FILES] [-s SUBCHUNK] [-k CHUNK] [-d 0|1] [-r]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.plans.methods import METHODS, Run, run
from siltstone.session import clean
from siltstone.sources import sinks
from siltstone.sources.files import files_from_dir, files_in_ranges

#: Numbers of the methods, fixed values.
NUMBERS = ("lz4", "sf", "hsf", "hsf_rank", "hsf_rank_bib", "sf_bib", "hsf_bib", "greedy")


def parsed(words: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="siltstone", description="Groups similar chunks of files and compresses them.")
    p.add_argument("-i", dest="folder", required=True, help="folder of files, searched with all folders below")
    p.add_argument("-m", dest="method", default="4", help=f"number (0 to {len(NUMBERS) - 1}) or name: {', '.join(METHODS)}")
    p.add_argument("-c", dest="chunking", default="0", choices=("0", "1", "fixed", "cdc"), help="0: chunks of fixed size, 1: content-defined")
    p.add_argument("-n", dest="files", type=int, help="how many files, in natural order (all)")
    p.add_argument("-s", dest="sub_avg", type=int, default=Config.sub_avg, help="average size of the pieces that stand for a chunk")
    p.add_argument("-k", dest="chunk_size", type=int, default=Config.chunk_size, help="size of a chunk")
    p.add_argument("-d", dest="on_disk", type=int, choices=(0, 1), default=0, help="1: write the chunks to containers, too")
    p.add_argument("-r", dest="restore", action="store_true", help="restore the files from the groups, too")
    p.add_argument("-o", dest="out", required=True, help="folder of the results")
    args = p.parse_args(words)
    args.method = NUMBERS[int(args.method)] if args.method.isdigit() and int(args.method) < len(NUMBERS) else args.method
    if args.method not in METHODS:
        p.error(f"no method {args.method}")
    return args


def execute(spark: SparkSession, args: argparse.Namespace) -> Run:
    """Runs a method and writes ``groups/METHOD``, ``summary``, ``histogram``, ``report`` and, if asked for,
    ``containers`` and ``restored`` below the results' folder."""
    fixed = args.chunking in ("0", "fixed")
    config = Config(chunk_size=args.chunk_size, chunking="fixed" if fixed else "cdc", sub_avg=args.sub_avg)
    if fixed:  # in ranges, so that files may have any size
        files, parts = files_in_ranges(spark, args.folder, args.chunk_size, args.files)
    else:
        files, parts = files_from_dir(spark, args.folder, n=args.files), None
    got = run(files, args.method, config, parts)
    sinks.write_groups(got.compressed, f"{args.out}/groups", args.method)
    sinks.write_report(got.summary(), f"{args.out}/summary")
    sinks.write_report(got.report(), f"{args.out}/report")
    sinks.append_histogram(got.histogram(), f"{args.out}/histogram")
    if args.on_disk:
        from siltstone.operators.compress import containers

        placed = containers(got.grouped.chunks)
        sinks.write_containers(placed.join(got.grouped.chunks.select("chunk_id", "content"), "chunk_id"), f"{args.out}/containers")
    if args.restore:
        names = files.select("file_id", F.regexp_replace("path", "^[a-z0-9]+:/*|^/+", "").alias("path"))
        sinks.write_files(got.restored_parts(), names, f"{args.out}/restored")
    return got


def main(words: Sequence[str] | None = None) -> None:
    args = parsed(words)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    got = execute(spark, args)
    got.summary().show(truncate=False)
    got.quality().show(truncate=False)
    clean(spark)


if __name__ == "__main__":
    main()
