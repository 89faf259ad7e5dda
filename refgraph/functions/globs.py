"""Ordered glob rules as native columns: `*` and `?` stay in a segment, `**` crosses them, `!` negates, the last match wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, crossing: bool = True) -> str:
    """The pattern as a regular expression without anchors. crossing=False: `**` stays in a segment as well."""
    wide, out, k = ".*" if crossing else "[^/]*", [], 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out.append("(?:.*/)?" if crossing else "(?:[^/]*/)?")
            k += 3
        elif pattern.startswith("**", k):
            out.append(wide)
            k += 2
        else:
            c = pattern[k]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            k += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    """One line of an ignore list."""

    pattern: str
    negated: bool = False
    folder_only: bool = False
    anchored: bool = False
    #: Names of folders given by the tool's own list: explicit roots lift them.
    by_name: bool = False

    @property
    def deep(self) -> bool:
        return self.anchored or "/" in self.pattern

    @classmethod
    def parse(cls, line: str, by_name: bool = False) -> Rule | None:
        negated = line.startswith("!")
        text = line[negated:].replace("\\", "/")
        folder_only, text = text.endswith("/"), text.rstrip("/")
        anchored, text = text.startswith("/"), text.lstrip("/")
        if text.startswith("./"):
            anchored, text = True, text[2:]
        return cls(text, negated, folder_only, anchored, by_name) if text else None

    def file_regex(self) -> str | None:
        """What a file's path must match in whole; None if no file can."""
        if self.deep:
            g = glob_regex(self.pattern)
            if self.folder_only:
                return None if self.negated else f"(?s)^(?:{g})/.*$"
            return f"(?s)^(?:{g})$" if self.negated else f"(?s)^(?:{g})(?:/.*)?$"
        g = glob_regex(self.pattern, crossing=False)
        if self.folder_only:
            return None if self.negated else f"(?s)^(?:.*/)?(?:{g})/.*$"
        return f"(?s)^(?:.*/)?(?:{g})(?:/.*)?$"


def rules(lines: list[str], by_name: bool = False) -> list[Rule]:
    return [r for line in lines if (r := Rule.parse(line, by_name))]


def ignored(path: Column, ordered: list[Rule]) -> Column:
    """True where the last rule that matches is not negated."""
    found = [F.when(path.rlike(x), F.lit(not r.negated)) for r in reversed(ordered) if (x := r.file_regex())]
    return F.coalesce(*found, F.lit(False)) if found else F.lit(False)


def is_ignored(path: str, ordered: list[Rule]) -> bool:
    """ignored() of one string."""
    for r in reversed(ordered):
        x = r.file_regex()
        if x and re.match(x, path):
            return not r.negated
    return False
