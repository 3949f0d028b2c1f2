"""The command line: ``python -m gleaner analyze | plagiarism | ai-check | index-sources``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from gleaner.engines import LocalSourceIndexer, StylometricAiEngine, plagiarism_engine
from gleaner.exceptions import GleanerError
from gleaner.logs import setup_logging
from gleaner.plans import reports
from gleaner.plans.pipeline import AnalysisPipeline
from gleaner.settings import Settings
from gleaner.sources.documents import read_document


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gleaner", description="Copied passages and writing style of documents.")
    top.add_argument("--log-level", default="INFO", help="DEBUG, INFO, WARNING or ERROR")
    commands = top.add_subparsers(dest="command", required=True)
    for name, said in (("analyze", "copied passages and style"), ("plagiarism", "copied passages only"), ("ai-check", "style only")):
        one = commands.add_parser(name, help=said)
        one.add_argument("file_path")
        one.add_argument("--format", choices=("json", "text"), default="text", help="json to stdout, or text to stderr")
        one.add_argument("--json-out", help="write the JSON report to this file instead")
        if name == "analyze":
            one.add_argument("--no-plagiarism", action="store_true")
            one.add_argument("--no-ai-check", action="store_true")
    index = commands.add_parser("index-sources", help="index the documents of a directory")
    index.add_argument("directory_path")
    index.add_argument("--recursive", action=argparse.BooleanOptionalAction, default=True)
    return top


def session() -> SparkSession:
    return SparkSession.builder.appName("gleaner").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def emit(made, form: str, json_out: str | None) -> None:
    """JSON to a file if one is named, whatever the format; else JSON to stdout or text to stderr."""
    got = reports.rendered(made)
    if json_out:
        reports.write_json(got["json"], json_out)
        print(f"Report written to {json_out}", file=sys.stderr)
    elif form == "json":
        print(reports.pretty(got["json"]))
    else:
        print(got["text"], file=sys.stderr)


def _analyze(args: argparse.Namespace, settings: Settings) -> None:
    copied = args.command == "plagiarism" or args.command == "analyze" and not args.no_plagiarism
    style = args.command == "ai-check" or args.command == "analyze" and not args.no_ai_check
    spark = session()
    documents = read_document(spark, args.file_path)
    pipeline = AnalysisPipeline(plagiarism_engine(spark, settings), StylometricAiEngine(settings), settings)
    emit(pipeline.run(documents, run_plagiarism=copied, run_ai_check=style), args.format, args.json_out)


def _index(args: argparse.Namespace, settings: Settings) -> int:
    where = os.path.abspath(args.directory_path)
    if not os.path.isdir(where):
        print(f"Error: Not a directory: {where}", file=sys.stderr)
        return 1
    indexer = LocalSourceIndexer(session(), settings)
    indexer.index(where, recursive=args.recursive)
    s = indexer.last_stats
    print(f"Scanned {s.total_files} file(s) ({'recursive' if s.recursive else 'top-level'})", file=sys.stderr)
    print(f"  Indexed: {s.indexed}\n  Skipped: {s.skipped}\n  Up-to-date: {s.up_to_date}\n  Index: {s.index_path}", file=sys.stderr)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    """The exit code: 0, or 1 where the engine says an error."""
    args = parser().parse_args(argv)
    setup_logging(args.log_level)
    try:
        settings = Settings.from_env()
        if args.command == "index-sources":
            return _index(args, settings)
        _analyze(args, settings)
    except GleanerError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


def run() -> None:
    sys.exit(main())
