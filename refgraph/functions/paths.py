"""Path functions, as native columns and as the plain functions that driver-side code uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Resolves `.` and `..`. An absolute path never leaves its root, a relative one keeps leading `..`; nothing left is `.`."""
    absolute = F.startswith(path, F.lit("/"))
    segments = F.filter(F.split(path, "/", -1), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")

    def step(stack: Column, s: Column) -> Column:
        can_pop = (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(s != "..", F.concat(stack, F.array(s))).when(can_pop, popped).when(absolute, stack).otherwise(F.concat(stack, F.array(s)))

    joined = F.array_join(F.aggregate(segments, empty, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def normalize(path: str, keep_up: bool = False) -> str:
    """normalize_path of a string. keep_up: `..` that cannot be resolved stays, at a root too (the rule for clean-up targets)."""
    absolute, stack = path.startswith("/"), []
    for s in path.split("/"):
        if s in ("", "."):
            continue
        if s != "..":
            stack.append(s)
        elif stack and stack[-1] != "..":
            stack.pop()
        elif keep_up or not absolute:
            stack.append(s)
    joined = "/".join(stack)
    return "/" + joined if absolute else joined or "."


def path_order(path: Column) -> Column:
    """Sorts by component: `a/b` before `a-b`."""
    return F.split(path, "/", -1)


def package_name(request: Column) -> Column:
    """`@scope/name` or the first segment."""
    return F.when(F.startswith(request, F.lit("@")), F.regexp_extract(request, r"^(@[^/]*(?:/[^/]*)?)", 1)).otherwise(F.substring_index(request, "/", 1))


def route_stem(name: Column) -> Column:
    """The name before a single extension; empty for names with another number of dots."""
    return F.regexp_extract(name, r"^([^./]+)\.([^./]+)$", 1)
