"""Report documents: reading (strict from version 2, lenient before), writing, and rendering as text or Markdown.

A report is one document about one tree, made to be read by people and by later commands; it is handled on the driver.
"""

from __future__ import annotations

import json
import os
import re

from refgraph.operators.classify import ORPHANS

SECTIONS = {
    "brokenImports": {"file": str, "source": str, "kind": str},
    "orphanFiles": {"file": str, "kind": str, "reason": str, "confidence": float},
    "deadExports": {"file": str, "exportName": str},
    "unusedImports": {"file": str, "source": str, "local": str, "imported": str},
    "routeEntrypoints": {"file": str, "kind": str},
    "deletionCandidates": {"file": str, "reason": str, "confidence": float, "safe": bool},
}
ENUMS = {
    ("brokenImports", "kind"): {"static", "side-effect", "reexport", "reexport-all", "reexport-namespace", "require", "dynamic", "unknown"},
    ("orphanFiles", "kind"): set(ORPHANS),
    ("routeEntrypoints", "kind"): {"user-entry", "package-entry", "next-app-route", "next-pages-route", "app-entry", "tooling-entry", "framework-entry"},
}
COUNTS = ["filesScanned", "entrypoints", *SECTIONS]
VERSION = 2
PREVIEW = 5

# What the counts and sections of a report are called.
LABELS = {
    "filesScanned": "Files scanned", "entrypoints": "Entrypoints", "brokenImports": "Broken imports", "orphanFiles": "Orphan files", "deadExports": "Dead exports",
    "unusedImports": "Unused imports", "routeEntrypoints": "Route entrypoints", "deletionCandidates": "Deletion candidates", "suppressedFindings": "Suppressed findings",
}


class ReportError(ValueError):
    """The document is no valid report."""


def version(document: object) -> int:
    found = document.get("schemaVersion", document.get("version")) if isinstance(document, dict) else None
    if not isinstance(found, int) or isinstance(found, bool):
        raise ReportError("the document has no version")
    return found


def _checked(section: str, item: object, strict: bool) -> dict:
    if not isinstance(item, dict):
        raise ReportError(f"{section} holds a value that is no object")
    out = {}
    for name, kind in SECTIONS[section].items():
        value = item.get(name)
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, kind) or (kind is not bool and isinstance(value, bool)):
            if strict:
                raise ReportError(f"{section} needs {name}")
            value = {str: "", float: 0.0, bool: True}[kind]
        if strict and (section, name) in ENUMS and value not in ENUMS[section, name]:
            raise ReportError(f"{section}.{name} has no such value: {value}")
        out[name] = value
    return out


def parse(text: str) -> dict:
    """The report as version 2; later versions keep their number."""
    document = json.loads(text)
    number = version(document)
    strict = number >= VERSION
    project, summary, findings, graph = (document.get(k) for k in ("project", "summary", "findings", "graph"))
    if strict and not (isinstance(project, dict) and isinstance(project.get("root"), str) and isinstance(summary, dict) and isinstance(findings, dict) and isinstance(graph, dict)):
        raise ReportError("the report lacks a section")
    for value in (document.get("generatedAt"), (project or {}).get("configPath") if isinstance(project, dict) else None):
        if strict and value is not None and not isinstance(value, str):
            raise ReportError("the report has metadata of the wrong kind")
    found = {}
    for section in SECTIONS:
        items = (findings or {}).get(section) if isinstance(findings, dict) else None
        if not isinstance(items, list):
            if strict:
                raise ReportError(f"the report lacks {section}")
            items = []
        found[section] = [_checked(section, item, strict) for item in items]
    modules = graph.get("modules") if isinstance(graph, dict) else document.get("modules")
    if strict and not isinstance(modules, list):
        raise ReportError("the report lacks its modules")
    counts = {}
    for name in COUNTS:
        value = (summary or {}).get(name)
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            if strict:
                raise ReportError(f"the summary needs {name}")
            value = len(found.get(name, []))
        counts[name] = value
    if isinstance((summary or {}).get("suppressedFindings"), int) and summary["suppressedFindings"]:
        counts["suppressedFindings"] = summary["suppressedFindings"]
    root = project["root"] if isinstance(project, dict) and isinstance(project.get("root"), str) else document.get("root") or ""
    return {
        "schemaVersion": max(number, VERSION), "generatedAt": document.get("generatedAt") if isinstance(document.get("generatedAt"), str) else None,
        "project": {"root": root, "configPath": project.get("configPath") if isinstance(project, dict) else None},
        "summary": counts, "findings": found, "graph": {"modules": modules if isinstance(modules, list) else []},
    }


def serialize(report: dict) -> str:
    if report.get("schemaVersion") != VERSION:
        raise ReportError(f"only reports of version {VERSION} are written")
    return json.dumps(report, indent=2, ensure_ascii=False) + "\n"


def read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def write(report: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(serialize(report))


def input_path(given: str | None, default: str) -> str:
    """A `.json` argument is a report; anything else is a project root with its default report."""
    given = given or "."
    return given if given.endswith(".json") else os.path.join(os.path.abspath(given), default)


def shell_quoted(path: str) -> str:
    return path if re.fullmatch(r"[A-Za-z0-9/._-]+", path) else "'" + path.replace("'", "'\\''") + "'"


def relative(file: str, root: str) -> str:
    return file[len(root) + 1 :] if root and file.startswith(root + "/") else file


def _count(n: int, what: str) -> str:
    return f"{n} {what}" + "s" * (n != 1)


def impact(summary: dict) -> tuple[str, str]:
    """The headline, and the move that helps most."""
    # The texts of a report.
    parts = [("brokenImports", "broken import"), ("deletionCandidates", "cleanup candidate"), ("deadExports", "dead export"), ("unusedImports", "unused import")]
    total = sum(summary[k] for k, _ in parts)
    moves = ["Fix broken imports before deleting files.", "Run the cleanup preview and remove unused files of high confidence.", "Remove dead exports or confirm that they are public API.", "Remove unused imports."]
    if not total:
        return f"No actionable findings in {_count(summary['filesScanned'], 'scanned file')}.", "Keep the JSON report as a baseline for later diffs."
    headline = f"{_count(total, 'actionable finding')}: {', '.join(_count(summary[k], what) for k, what in parts if summary[k])}."
    return headline, next(move for (k, _), move in zip(parts, moves, strict=True) if summary[k])


def _lines(section: str, item: dict, root: str, code: bool) -> str:
    file, tick = relative(item["file"], root), "`" if code else ""
    if section == "brokenImports":
        return f"{file} -> {tick}{item['source']}{tick}"
    if section == "orphanFiles":
        return f"{file} ({item['reason']})" if code else file
    if section == "deadExports":
        return f"{file} -> `{item['exportName']}`" if code else f"{file}#{item['exportName']}"
    if section == "unusedImports":
        name = item["local"] if item["local"] == item["imported"] else f"{item['imported']} as {item['local']}"
        return f"{file} -> {tick}{name}{tick} from {tick}{item['source']}{tick}"
    if section == "routeEntrypoints":
        return f"{file} ({item['kind']})"
    sure = f"confidence {item['confidence']:.2f}"
    return f"{file} ({item['reason']}, {sure})" if code else f"{file} ({sure}, {item['reason']})"


# Headings and labels of the two texts below.
def summary_text(report: dict, path: str, title: str = "Report.", tool: str = "refgraph") -> str:
    root, counts = report["project"]["root"], report["summary"]
    headline, move = impact(counts)
    saved = shell_quoted(path)
    out = [title, "", f"Impact: {headline}", f"Best next move: {move}", "", f"Root: {root}"]
    out += [f"{LABELS[k]}: {counts[k]}" for k in [*COUNTS, "suppressedFindings"] if k in counts]
    out += ["", f"Saved report: {path}", "", "Next steps:", f"- Preview cleanup: {tool} clean {saved}", f"- Shareable markdown: {tool} report {saved} --format md"]
    order = [("brokenImports", "Broken imports"), ("deletionCandidates", "Top cleanup candidates"), *((k, LABELS[k]) for k in ("orphanFiles", "deadExports", "unusedImports", "routeEntrypoints"))]
    for section, label in order:
        items = report["findings"][section]
        if items:
            out += ["", f"{label}:", *(f"- {_lines(section, i, root, False)}" for i in items[:PREVIEW])]
            if len(items) > PREVIEW:
                out.append(f"- ... {len(items) - PREVIEW} more")
    return "\n".join(out)


def markdown(report: dict, path: str, tool: str = "refgraph") -> str:
    root, counts = report["project"]["root"], report["summary"]
    headline, move = impact(counts)
    saved = shell_quoted(path)
    out = ["# Report", "", f"> {headline}", "", f"- Generated at: {report['generatedAt'] or 'unknown'}", f"- Root: {root}", f"- Report: {path}", "", "## Summary", ""]
    out += [f"- {LABELS[k]}: {counts[k]}" for k in [*COUNTS, "suppressedFindings"] if k in counts]
    out += ["", "## Impact", "", f"- {headline}", f"- Best next move: {move}", f"- Preview cleanup: `{tool} clean {saved}`", f"- Refresh markdown: `{tool} report {saved} --format md`"]
    for section in SECTIONS:
        items = report["findings"][section]
        out += ["", f"## {LABELS[section]}", "", *([f"- {_lines(section, i, root, True)}" for i in items] or ["- none"])]
    return "\n".join(out)
