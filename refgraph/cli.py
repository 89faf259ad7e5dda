"""Command line: scan, report, diff, clean."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from refgraph.plans import clean, compare, project
from refgraph.sources import report
from refgraph.sources.config import REPORT_NAME, absolute, clean_threshold


def _session() -> SparkSession:
    return SparkSession.builder.appName("refgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _confidence(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("a number from 0 to 1 is needed")
    return value


def _scan(args: argparse.Namespace) -> str:
    root = absolute(args.root)
    path = os.path.join(root, args.output or REPORT_NAME)
    found = project.report(project.scan(_session(), root))
    report.write(found, path)
    return report.serialize(found).rstrip("\n") if args.json else report.summary_text(found, path, "Scan complete.")


def _report(args: argparse.Namespace) -> str:
    path = report.input_path(args.input, REPORT_NAME)
    if args.format == "json":
        with open(path, encoding="utf-8") as f:
            return json.dumps(json.load(f), indent=2, ensure_ascii=False)
    found = report.read(path)
    return report.markdown(found, path) if args.format == "md" else report.summary_text(found, path)


def _diff(args: argparse.Namespace) -> str:
    before, after = (report.input_path(p, REPORT_NAME) for p in (args.before, args.after))
    found = compare.diff_reports(_session(), report.read(before), report.read(after), before, after)
    return json.dumps(found, indent=2, ensure_ascii=False) if args.format == "json" else compare.markdown(found) if args.format == "md" else compare.summary_text(found)


def _clean(args: argparse.Namespace) -> str:
    found = report.read(report.input_path(args.input, REPORT_NAME))
    if not found["findings"]["deletionCandidates"]:
        return "No deletion candidates."
    least = args.min_confidence if args.min_confidence is not None else clean_threshold(found["project"]["root"])
    if not args.apply:
        return clean.plan_text(clean.plan(found, least))
    deleted, left = clean.apply(found, least)
    return f"Deleted {len(deleted)} files, left {len(left)} alone."


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("refgraph")
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("scan")
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("--output")
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=_scan)
    p = commands.add_parser("report")
    p.add_argument("input", nargs="?")
    p.add_argument("--format", choices=["summary", "json", "md"], default="summary")
    p.set_defaults(run=_report)
    p = commands.add_parser("diff")
    p.add_argument("before")
    p.add_argument("after")
    p.add_argument("--format", choices=["summary", "json", "md"], default="summary")
    p.set_defaults(run=_diff)
    p = commands.add_parser("clean")
    p.add_argument("input", nargs="?")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--min-confidence", type=_confidence)
    p.set_defaults(run=_clean)
    args = parser.parse_args(argv)
    try:
        print(args.run(args))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
