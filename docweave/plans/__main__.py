"""spark-submit entry: run, eval, annotate, config, version."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .. import log
from ..operators import evaluation
from ..sources import content_json
from . import config, pipeline

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="blocks and page objects (Parquet) to trees, files and conflicts")
    run.add_argument("blocks")
    run.add_argument("objects")
    run.add_argument("output")
    score = commands.add_parser("eval", help="nodes (Parquet) and annotation files (folder of JSON) to metrics, a report and badcases")
    score.add_argument("nodes")
    score.add_argument("annotations")
    score.add_argument("output")
    note = commands.add_parser("annotate", help="blocks and edits (Parquet) to annotation files, one JSON line a document")
    note.add_argument("blocks")
    note.add_argument("edits")
    note.add_argument("output")
    for command in (run, score, note):
        command.add_argument("--json-log", action="store_true")
        command.add_argument("--log-file")
    commands.add_parser("config")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(f"docweave {VERSION}")
        return 0
    if args.command == "config":
        print(json.dumps(config.load().masked(), indent=2, ensure_ascii=False))
        return 0
    log.configure(path=args.log_file, as_json=args.json_log)
    say = log.logger(args.command)
    spark = SparkSession.builder.appName("docweave").getOrCreate()
    first, second = {"run": ("blocks", "objects"), "eval": ("nodes", "annotations"), "annotate": ("blocks", "edits")}[args.command]
    tables = []
    for name in (first, second):
        path = getattr(args, name)
        try:
            tables.append(annotation_files(spark, path) if name == "annotations" else spark.read.parquet(path))
        except Exception as e:
            say.error("cannot read %s: %s", path, e)
            return 2
    try:
        if args.command == "run":
            pipeline.write(pipeline.run(*tables), args.output)
        elif args.command == "annotate":
            content_json.annotation_files(*tables).write.mode("overwrite").json(args.output)
        else:
            truth = content_json.annotations(tables[1])
            results = evaluation.evaluate_trees(tables[0], truth, truth.select("doc_id", "dirt_level").distinct())
            results.write.mode("overwrite").parquet(f"{args.output}/results")
            results = spark.read.parquet(f"{args.output}/results")
            evaluation.report(results).write.mode("overwrite").json(f"{args.output}/report")
            evaluation.badcases(results).write.mode("overwrite").json(f"{args.output}/badcases")
    except Exception as e:
        say.error("failed: %s", e)
        return 1
    say.info("wrote %s", args.output)
    return 0


def annotation_files(spark: SparkSession, path: str):
    """(path, content) of the JSON files in a folder."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return files.selectExpr("_metadata.file_path AS path", "value AS content")


if __name__ == "__main__":
    sys.exit(main())
