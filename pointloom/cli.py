"""Command line: encode, decode, inspect, sample and check."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api
from .constants import DEFAULT_MAX_POINTS


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pointloom", description="Previews of large point clouds, made with Spark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    encode = verbs.add_parser("encode", help="write the preview of a point file")
    encode.add_argument("input")
    encode.add_argument("output")
    encode.add_argument("--max-points", type=int, default=DEFAULT_MAX_POINTS)
    decode = verbs.add_parser("decode", help="write a preview's points as a point file")
    decode.add_argument("input")
    decode.add_argument("output")
    verbs.add_parser("inspect", help="print a preview's header as JSON").add_argument("input")
    sample = verbs.add_parser("sample", help="write evenly spaced points of a point file as another")
    sample.add_argument("input")
    sample.add_argument("output")
    sample.add_argument("--max-points", type=int, default=DEFAULT_MAX_POINTS)
    verbs.add_parser("check", help="say what is wrong with the previews below a folder; exit code 1 if anything is").add_argument("input")
    args = parser.parse_args(argv)
    if args.verb == "inspect":
        print(api.inspect_json(args.input))
        return 0
    spark = SparkSession.builder.appName("pointloom").getOrCreate()
    if args.verb == "encode":
        api.encode_pos(spark, args.input, args.output, args.max_points)
    elif args.verb == "sample":
        api.write_pos(api.sample_pos(spark, args.input, args.max_points), args.output, "sample_index")
    elif args.verb == "check":
        return _check(spark, args.input)
    else:
        api.write_pos(api.decode(spark, args.input, "first"), args.output, "record_index")
    return 0


def _check(spark: SparkSession, folder: str) -> int:
    """A line for each preview with a problem, a part of them at a time."""
    wrong = False
    for row in api.checked_previews(spark, folder).where("problem is not null").select("path", "problem").toLocalIterator():
        print(f"{row['path']}: {row['problem']}")
        wrong = True
    return int(wrong)
