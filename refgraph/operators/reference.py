"""Operators on nodes and the references between them. Every one is a plain plan of joins and aggregates.

Keys that are null are never referenced and refer to nothing. Join sides are left to the optimizer, which broadcasts those
whose size it knows to be small; rule tables and alias tables, which people write by hand, are the only ones with a hint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def unreferenced(nodes: DataFrame, edges: DataFrame, key: str, target: str, exempt: Column | None = None) -> DataFrame:
    """The nodes without an incoming edge, but for exempt ones."""
    left = nodes if exempt is None else nodes.where(~F.coalesce(exempt, F.lit(False)))
    return left.join(edges.select(F.col(target).alias(key)), key, "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame, target: str, key: str) -> DataFrame:
    """The edges whose target is no node, as often as they occur."""
    return edges.join(nodes.select(F.col(key).alias(target)), target, "left_anti")


def resolved(edges: DataFrame, nodes: DataFrame, target: str, key: str) -> DataFrame:
    """The edges whose target is a node; others are dropped silently."""
    return edges.join(nodes.select(F.col(key).alias(target)).distinct(), target, "left_semi")


def in_degree(nodes: DataFrame, edges: DataFrame, key: str, target: str, importer: str) -> DataFrame:
    """(key, imported_by): the distinct importers of each node, 0 for none."""
    counted = edges.groupBy(F.col(target).alias(key)).agg(F.count_distinct(importer).alias("imported_by"))
    return nodes.select(key).join(counted, key, "left").select(key, F.coalesce("imported_by", F.lit(0)).cast("long").alias("imported_by"))


def out_degree(edges: DataFrame, importer: str, target: str) -> DataFrame:
    """(importer, targets, imports): distinct targets, and edges with repeats."""
    return edges.groupBy(importer).agg(F.count_distinct(target).alias("targets"), F.count(F.lit(1)).alias("imports"))


def usage(edges: DataFrame, target: str, member: Column, namespace: Column, unknown: Column) -> DataFrame:
    """(target, used, uses_namespace, uses_unknown): what is used of each target."""
    return edges.groupBy(target).agg(
        F.collect_set(member).alias("used"), F.bool_or(F.coalesce(namespace, F.lit(False))).alias("uses_namespace"), F.bool_or(F.coalesce(unknown, F.lit(False))).alias("uses_unknown")
    )


def dead_members(members: DataFrame, used: DataFrame, keys: list[str], whole: DataFrame | None = None) -> DataFrame:
    """The members (keys) that nothing uses. whole: owners (first key) that are used as a whole, all of whose members live."""
    left = members.join(used.select(*keys), keys, "left_anti")
    return left if whole is None else left.join(whole.select(keys[0]), keys[0], "left_anti")


def cascade(cases: list[tuple[Column, str]]) -> Column:
    """The kind of the first case that holds, else null."""
    return reduce(lambda c, case: c.when(*_when(case)), cases[1:], F.when(*_when(cases[0])))


def _when(case: tuple[Column, str]) -> tuple[Column, Column]:
    return case[0], F.lit(case[1])


def suppressed(findings: DataFrame, rules: DataFrame, exact: list[str], optional: list[str]) -> Column | DataFrame:
    """The findings that no rule covers. A rule covers equal exact fields, and equal optional fields where it names them."""
    r = F.broadcast(rules.select(*(F.col(c).alias(f"__{c}") for c in [*exact, *optional])))  # written by hand
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in exact] + [F.col(f"__{c}").isNull() | (F.col(c) == F.col(f"__{c}")) for c in optional])
    return findings.join(r, on, "left_anti")


def bag_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, n): how often each key was introduced, resolved or persisted, counting repeats. One shuffle: both sides
    are counted together, so the rows of a frequent key are summed before they move."""
    both = before.select(*keys, F.lit(1).alias("was"), F.lit(0).alias("now")).unionByName(after.select(*keys, F.lit(0).alias("was"), F.lit(1).alias("now")))
    counted = both.groupBy(*keys).agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    kinds = [("introduced", F.greatest(F.lit(0), F.col("now") - F.col("was"))), ("resolved", F.greatest(F.lit(0), F.col("was") - F.col("now"))), ("persisted", F.least("was", "now"))]
    changes = F.array(*(F.struct(F.lit(k).alias("change"), n.cast("long").alias("n")) for k, n in kinds))
    return counted.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.change", "c.n").where("n > 0")


def bag_rows(diff: DataFrame, change: str) -> DataFrame:
    """The rows of one change of a bag_diff, as often as they changed."""
    keys = [c for c in diff.columns if c not in ("change", "n")]
    return diff.where(F.col("change") == change).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*keys)


def diff_summary(diff: DataFrame) -> DataFrame:
    """(change, n) and a total."""
    return diff.rollup("change").agg(F.sum("n").alias("n")).select(F.coalesce("change", F.lit("total")).alias("change"), "n")


def threshold_split(rows: DataFrame, confidence: str, least: float) -> DataFrame:
    """Adds eligible: confidence reaches least, compared as 32-bit floats."""
    return rows.withColumn("eligible", F.col(confidence).cast("float") >= F.lit(least).cast("float"))


def first_match(requests: DataFrame, candidates: Column, known: DataFrame, key: str, out: str = "path") -> DataFrame:
    """Adds out: the first of an array of candidates that is a key of known, else null. Each distinct array is looked up once, and is
    shuffled with each of its candidates, so arrays should be short."""
    rows = requests.withColumn("__tried", candidates)
    tried = rows.select("__tried").distinct().select("__tried", F.posexplode("__tried").alias("__at", "__path"))
    hits = tried.join(known.select(F.col(key).alias("__path")).distinct(), "__path", "left_semi")
    best = hits.groupBy("__tried").agg(F.min_by("__path", "__at").alias(out))
    return rows.join(best, "__tried", "left").drop("__tried")


def alias_match(request: Column, aliases: list[tuple[str, str]]) -> Column:
    """The target of the first alias that fits, longest alias first; one `*` stands for what is between its ends. Null if none."""
    cases = []
    for alias, target in sorted(aliases, key=lambda a: -len(a[0])):
        head, star, tail = alias.partition("*")
        if star:
            fits = F.startswith(request, F.lit(head)) & F.endswith(request, F.lit(tail)) & (F.char_length(request) >= len(head) + len(tail))
            captured = F.substring(request, F.lit(len(head) + 1), F.char_length(request) - len(head) - len(tail))
            before, has, after = target.partition("*")
            cases.append(F.when(fits, F.concat(F.lit(before), captured, F.lit(after)) if has else F.lit(target)))
        else:
            cases.append(F.when(request == alias, F.lit(target)))
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def first_occurrence(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, order) of the first row of each value."""
    return rows.groupBy(value).agg(F.min(order).alias(order))


def preview(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of an order; a report's preview is this feature."""
    return rows.orderBy(*order).limit(most)


def excerpt(text: Column, lines: int) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds the number of each row among the rows of its keys."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def placed(rows: DataFrame, order: list[Column], out: str = "place", by: list[str] | None = None) -> DataFrame:
    """Adds the number of each row in an order of all rows, or of those that are equal in by. Ranges of by and order are sorted apart,
    so no group has to fit into a task; only the sizes of groups' parts meet, without by in one task. Ties are numbered in any order;
    equal nulls are one group."""
    by = by or []
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [*(F.col(c) for c in by), *order]
    sorted_apart = rows.repartitionByRange(parts, *at).sortWithinPartitions(*at).withColumn("__id", F.monotonically_increasing_id())
    ranges = written(sorted_apart.select(*rows.columns, F.shiftright("__id", 33).cast("int").alias("__range"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__at")), "ranges")
    sizes = ranges.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("__range").alias("__of"), *(F.col(c).alias(f"__by_{c}") for c in by), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__start"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__by_{c}")), by, F.col("__range") == F.col("__of"))
    found = ranges.join(starts if by else F.broadcast(starts), same)
    return found.select(*rows.columns, (F.col("__start") + F.col("__at") + 1).alias(out))
