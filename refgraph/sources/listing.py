"""Listing a source tree. Spark's file sources skip names that start with `_` or `.`, so the driver walks the folders."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from refgraph.functions.globs import Rule, is_ignored, rules

from .config import EXTENSIONS, ProjectConfig


def ignore_rules(config: ProjectConfig) -> list[Rule]:
    return [r for f in config.ignored_folders if (r := Rule.parse(f.rstrip("/") + "/", by_name=True))] + rules(config.ignore_patterns)


def _literal_prefix(rule: Rule) -> str:
    """The folders that a rule names without wildcards."""
    if not rule.deep:
        return ""
    parts = []
    for part in rule.pattern.split("/"):
        if "*" in part or "?" in part:
            break
        parts.append(part)
    return "/".join(parts)


def _enters(folder: str, inside: str, ordered: list[Rule]) -> bool:
    """Whether files below a folder can be wanted. folder is relative to the project, inside to the root that is walked."""
    named = [r for r in ordered if r.by_name]
    negated = [r for r in ordered if r.negated]
    if is_ignored(f"{inside}/x", named):  # ignored by name: only a rule that spells the way below it reopens it
        return any((p := _literal_prefix(r)) and (p == folder or p.startswith(folder + "/") or folder.startswith(p + "/")) for r in negated)
    return bool(negated) or not is_ignored(f"{folder}/x", [r for r in ordered if not r.by_name])


def wanted(path: str, inside: str, ordered: list[Rule]) -> bool:
    """The last rule that matches decides; rules by folder name look at the part of the path inside the walked root."""
    for r in reversed(ordered):
        pattern = r.file_regex()
        if pattern and re.match(pattern, inside if r.by_name else path):
            return r.negated
    return True


def source_files(config: ProjectConfig) -> list[str]:
    """Absolute paths of the project's source files, by path component. Links are not followed."""
    ordered, found = ignore_rules(config), set()

    def walk(folder: str, root: str) -> None:
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{folder}/{entry.name}"
            relative, inside = os.path.relpath(path, config.root), os.path.relpath(path, root)
            if entry.is_symlink():
                continue
            if entry.is_dir():
                if _enters(relative, inside, ordered):
                    walk(path, root)
            elif entry.name.rpartition(".")[0] and entry.name.rpartition(".")[2] in EXTENSIONS and wanted(relative, inside, ordered):
                found.add(path)

    for root in config.roots or [config.root]:
        if os.path.isdir(root):
            walk(root, root)
    return sorted(found, key=lambda p: p.split("/"))


def all_files(root: str) -> list[str]:
    """Every file below root, ignored ones too, but for those behind linked folders; existing() finds these and files outside root."""
    return [f"{at}/{name}" for at, folders, names in os.walk(root) for name in names if os.path.isfile(f"{at}/{name}")]


def existing(paths: DataFrame) -> DataFrame:
    """The rows (path) that are files on a disk that all executors can read, links followed."""

    def find(batches):
        for batch in batches:
            yield batch[[os.path.isfile(p) for p in batch["path"]]]

    return paths.select("path").mapInPandas(find, "path string")


def read_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, content) of files that all executors can read. Text that is not UTF-8 fails the scan."""
    rows = spark.createDataFrame([(p,) for p in paths], "file string")
    parts = max(1, min(len(paths) // 64 + 1, 10_000))

    def read(batches):
        for batch in batches:
            contents = []
            for path in batch["file"]:
                with open(path, encoding="utf-8", newline="") as f:
                    contents.append(f.read())
            yield batch.assign(content=contents)

    return rows.repartition(parts).mapInPandas(read, "file string, content string")
