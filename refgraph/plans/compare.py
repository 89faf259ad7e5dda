"""Comparing two reports, finding by finding, as bags: repeats count, and roots do not."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.operators import reference as ops
from refgraph.sources.report import LABELS, SECTIONS, _lines, relative

CHANGES = ["introduced", "resolved", "persisted"]


def _key(section: str, item: dict, root: str) -> str:
    """The fields that make a finding the same: confidence by its 32 bits."""
    values = [relative(item["file"], root) if k == "file" else int(np.float32(item[k]).view(np.uint32)) if k == "confidence" else item[k] for k in SECTIONS[section]]
    return "|".join(str(v).lower() if isinstance(v, bool) else str(v) for v in values)


def findings(spark: SparkSession, report: dict) -> DataFrame:
    """(section, key, ord, item) of a report's findings, item as JSON."""
    root = report["project"]["root"]
    rows = [(s, _key(s, i, root), n, json.dumps(i)) for s in SECTIONS for n, i in enumerate(report["findings"][s])]
    return spark.createDataFrame(rows, "section string, key string, ord int, item string")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(section, change, key, occurrence, item): the n-th occurrence of a key on both sides persists, with the item of after."""
    keys = ["section", "key"]
    numbered = lambda df: ops.ranked(df, keys, [F.col("ord")]).drop("ord")
    b, a = numbered(before).withColumnRenamed("item", "was"), numbered(after).withColumnRenamed("item", "now")
    change = F.when(F.col("was").isNull(), "introduced").when(F.col("now").isNull(), "resolved").otherwise("persisted")
    return b.join(a, [*keys, "occurrence"], "full").select("section", change.alias("change"), "key", "occurrence", F.coalesce("now", "was").alias("item"))


def summary(changed: DataFrame) -> DataFrame:
    """(section, introduced, resolved, persisted), with a row `totals`."""
    counts = [F.count_if(F.col("change") == c).alias(c) for c in CHANGES]
    return changed.rollup("section").agg(*counts).select(F.coalesce("section", F.lit("totals")).alias("section"), *CHANGES)


def diff_reports(spark: SparkSession, before: dict, after: dict, before_path: str = "", after_path: str = "") -> dict:
    changed = changes(findings(spark, before), findings(spark, after))
    out = {s: {c: [] for c in CHANGES} for s in SECTIONS}
    for r in changed.orderBy("key", "occurrence").collect():
        out[r["section"]][r["change"]].append(json.loads(r["item"]))
    counts = {s: {c: len(v) for c, v in x.items()} for s, x in out.items()}
    counts["totals"] = {c: sum(x[c] for x in counts.values()) for c in CHANGES}
    return {"before": {"path": before_path}, "after": {"path": after_path}, "summary": counts, "findings": out}


def _counts(x: dict) -> str:
    return ", ".join(f"{c} {x[c]}" for c in CHANGES)


# Headings and labels of the two texts below.
def summary_text(diff: dict) -> str:
    out = ["Diff complete.", "", f"Before: {diff['before']['path']}", f"After: {diff['after']['path']}", ""]
    out += [f"{LABELS[s]}: {_counts(diff['summary'][s])}" for s in SECTIONS]
    out += ["", f"Totals: {_counts(diff['summary']['totals'])}"]
    if not any(diff["summary"]["totals"].values()):
        out.append("Nothing changed.")
    return "\n".join(out)


def markdown(diff: dict, root: str = "") -> str:
    out = ["# Diff", "", f"- Before: {diff['before']['path']}", f"- After: {diff['after']['path']}", "", "## Summary", ""]
    out += [f"- {LABELS[s]}: {_counts(diff['summary'][s])}" for s in SECTIONS] + [f"- Totals: {_counts(diff['summary']['totals'])}"]
    for s in SECTIONS:
        out += ["", f"## {LABELS[s]}"]
        for c in CHANGES:
            items = diff["findings"][s][c]
            out += ["", f"### {c.capitalize()}", "", *([f"- {_lines(s, i, root, True)}" for i in items] or ["- none"])]
    return "\n".join(out)
