"""Clean-up plans from a report. Nothing is deleted without apply=True, and only on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np

from refgraph.functions.paths import normalize
from refgraph.sources.report import VERSION, ReportError, parse, relative, version

MOST_LINES, MOST_BYTES = 20, 16 * 1024
BINARY, MISSING, UNREADABLE = "[binary file]", "[missing file]", "[preview unavailable]"


@dataclass
class Plan:
    targets: list[dict] = field(default_factory=list)
    skipped: list[dict] = field(default_factory=list)


def load(path: str) -> dict:
    """The report at path. Unlike the command line, the library plans from no report before version 2."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if (found := version(json.loads(text))) < VERSION:
        raise ReportError(f"a report of version {VERSION} is needed, this one has version {found}")
    return parse(text)


def plan(report: dict, least: float = 0.0) -> Plan:
    """Candidates whose confidence reaches least, compared as 32-bit floats, and the others."""
    out = Plan()
    for c in report["findings"]["deletionCandidates"]:
        (out.targets if np.float32(c["confidence"]) >= np.float32(least) else out.skipped).append(c)
    return out


def inside(path: str, root: str) -> bool:
    """Whether path lies below root, by its spelling and where its folder really is."""
    path, root = normalize(os.path.join(root, path), keep_up=True), normalize(root, keep_up=True)
    real, top = os.path.realpath(os.path.dirname(path)), os.path.realpath(root)
    return path.startswith(root.rstrip("/") + "/") and (real == top or real.startswith(top.rstrip("/") + "/"))


def apply(report: dict, least: float = 0.0) -> tuple[list[str], list[str]]:
    """Deletes the plan's targets and folders that become empty below the root. Returns (deleted, left alone)."""
    root, deleted, left = report["project"]["root"], [], []
    for c in plan(report, least).targets:
        path = normalize(os.path.join(root, c["file"]), keep_up=True)
        if not inside(path, root) or not (os.path.isfile(path) or os.path.islink(path)):
            left.append(c["file"])
            continue
        os.unlink(path)
        deleted.append(path)
        folder = os.path.dirname(path)
        while inside(folder, root) and os.path.isdir(folder) and not os.listdir(folder):
            os.rmdir(folder)
            folder = os.path.dirname(folder)
    return deleted, left


def excerpt(path: str) -> tuple[bool, str]:
    """(exists, first lines of the file or what stands for them)."""
    if os.path.islink(path):
        return True, UNREADABLE
    try:
        with open(path, "rb") as f:
            data = f.read(MOST_BYTES)
    except FileNotFoundError:
        return False, MISSING
    except OSError:
        return os.path.lexists(path), UNREADABLE
    data = b"".join(data.splitlines(keepends=True)[:MOST_LINES]) if b"\r" not in data else b"\n".join(data.split(b"\n")[:MOST_LINES])
    if b"\0" in data:
        return True, BINARY
    try:
        text = data.decode()
    except UnicodeDecodeError as e:
        if e.reason != "unexpected end of data":
            return True, BINARY
        text = data[: e.start].decode()
    return True, "\n".join(line.removesuffix("\r") for line in text.removesuffix("\n").split("\n")[:MOST_LINES])


def preview(report: dict, least: float = 0.0) -> dict[str, list[dict]]:
    """The plan with excerpts: by confidence downwards, then path."""
    root, p = report["project"]["root"], plan(report, least)
    out: dict[str, list[dict]] = {"targets": [], "skipped": [], "outside": [], "missing": []}
    for name in ("targets", "skipped"):
        for c in getattr(p, name):
            path = normalize(os.path.join(root, c["file"]), keep_up=True)
            item = {"file": path, "relativePath": relative(path, root), "reason": c["reason"], "confidence": c["confidence"]}
            if not inside(path, root):
                out["outside"].append(item | {"exists": False, "excerpt": UNREADABLE})
                continue
            item["exists"], item["excerpt"] = excerpt(path)
            out[name if item["exists"] else "missing"].append(item)
    for items in out.values():
        items.sort(key=lambda i: (-np.float32(i["confidence"]), i["relativePath"]))
    return out


# The lines of a clean-up plan.
def plan_text(p: Plan) -> str:
    line = lambda c: f"- {c['file']} (confidence {c['confidence']:.2f}, {c['reason']})"
    out = ["Clean dry run.", "", f"Deletion targets: {len(p.targets)}", *map(line, p.targets)]
    if p.skipped:
        out += ["", f"Threshold-skipped targets: {len(p.skipped)}", *map(line, p.skipped)]
    return "\n".join([*out, "", "Re-run with --apply to delete these files."])
