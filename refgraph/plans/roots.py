"""The analysis of many roots in one plan: the same findings as of one scan, with a root beside every row.

Everything is a relation: what is on the disk, modules and their imports as a parser leaves them, and each root's own aliases,
entries, keep lists and suppressions. No table is read through the driver and no expression grows with the number of roots or rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.functions.paths import normalize_path, package_name
from refgraph.operators import classify, reports, rules
from refgraph.operators import reference as ops
from refgraph.operators.tables import written
from refgraph.plans.catalogue import query, table
from refgraph.plans.project import BUILTINS, SPECIFIERS, found_paths
from refgraph.sources.config import EXTENSIONS

#: The optional fields of a suppression, by the section that it hides.
OPTIONAL = {"brokenImports": ["source"], "orphanFiles": [], "deadExports": ["exportName"], "unusedImports": ["source", "local"], "deletionCandidates": []}


@dataclass
class Roots:
    #: (root, file, path, kind, importedByCount, importCount, exportCount)
    modules: DataFrame
    #: (root, section, ord, and the fields of operators.reports)
    findings: DataFrame
    #: (root, filesScanned, entrypoints, suppressedFindings)
    reports: DataFrame


def resolve_roots(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, externals: DataFrame | None = None, based: bool = False, closed: bool = False, dotted: bool = False) -> DataFrame:
    """imports (root, file, source, ...) with res_kind (source, asset, external, missing) and res_path.

    files: (root, path) of the disk. aliases: (root, ord, alias, target). externals: (root, name) of declared packages. based: requests
    that are neither relative nor rooted nor aliased are tried from the root; then only declared and built-in packages are external.
    closed: each root is a disk of its own, so `..` ends at the root; else it leads out of it. dotted: names with a dot are tried with
    extensions like those without. Paths are below their roots, file and res_path begin with it."""
    request, root = F.col("source"), F.col("root")
    if aliases is None:
        aliases = imports.sparkSession.createDataFrame([], f"root {imports.schema['root'].dataType.simpleString()}, ord int, alias string, target string")
    special = F.startswith(request, F.lit("node:"))
    relative, rooted = F.startswith(request, F.lit(".")), F.startswith(request, F.lit("/"))
    asked = imports.withColumn("__request", F.when(~special & ~relative & ~rooted, request))
    asked = rules.alias_lookup(asked, aliases, "root", "__request")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    beside = F.concat_ws("/", folder, request)
    if closed:  # the way from the root, as an absolute path
        below = F.substring(folder, F.char_length(root) + 1, F.char_length(folder))
        beside = F.concat(root, normalize_path(F.concat(below, F.lit("/"), request)))
    inner = F.when(relative, beside).when(rooted, F.concat(root, request)).when(F.col("alias").isNotNull(), F.concat_ws("/", root, "alias_target"))
    base = F.coalesce(inner, F.when(~special, F.concat_ws("/", root, request))) if based else inner
    asked = asked.withColumns({"__inner": inner.isNotNull(), "__base": normalize_path(base)}).drop("__request", "alias", "alias_target")
    asked = written(asked, "roots-asked")  # long expressions that several joins refer to
    rows = found_paths(asked, "__base", files.select(F.concat_ws("/", "root", "path").alias("path")), "path", "res_path", dotted)
    outside = F.lit(True)
    if based:
        name = package_name(request)
        outside = name.isin(BUILTINS)
        if externals is not None:
            declared = externals.select("root", F.col("name").alias("__name"), F.lit(True).alias("__declared")).distinct()
            rows = rows.withColumn("__name", name).join(declared, ["root", "__name"], "left").drop("__name")
            outside = outside | F.coalesce("__declared", F.lit(False))
    is_source = F.col("res_path").rlike(rf"[^/]\.(?:{'|'.join(EXTENSIONS)})$")
    kind = F.when(F.col("res_path").isNotNull(), F.when(is_source, "source").otherwise("asset")).when(F.col("__inner"), "missing").when(special | outside, "external").otherwise("missing")
    return rows.withColumn("res_kind", kind).drop("__base", "__inner", "__declared")


def analyze_roots(
    files: DataFrame, modules: DataFrame, imports: DataFrame, aliases: DataFrame | None = None, entries: DataFrame | None = None, keep: DataFrame | None = None, suppressions: DataFrame | None = None, externals: DataFrame | None = None, based: bool = False, closed: bool = False, dotted: bool = False
) -> Roots:
    """files: (root, path) of each disk. modules: (root, path, barrel, exports array<struct<name, kind>>, unused array<struct<source,
    local, imported>>). imports: (root, path, pos, source, kind, specifiers). entries: (root, path, kind), kind `user-entry` or
    `package-entry`. keep: (root, ord, line). suppressions: (root, section, path, source, local, exportName), a null field covering
    everything. aliases, externals, based, closed, dotted: as in resolve_roots. What several plans read (modules, resolved imports,
    findings that suppressions go through) is written; the rest is made when asked for. Roots and paths must not be null."""
    file = F.concat_ws("/", "root", "path")
    named = modules.select("root", "path", file.alias("file"), "barrel", F.array_distinct("exports").alias("exports"), "unused")
    if entries is not None:
        listed = entries.groupBy("root", "path").agg(F.bool_or(F.col("kind") == "user-entry").alias("__user"), F.bool_or(F.col("kind") == "package-entry").alias("__package"))
        named = named.join(listed, ["root", "path"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if entries is not None else F.lit(False)
    named = named.withColumn("kind", classify.entry_kind(F.col("path"), flag("__user"), flag("__package")))
    named = rules.ignored_paths(named, rules.compiled_rules(keep)).withColumnRenamed("ignored", "kept") if keep is not None else named.withColumn("kept", F.lit(False))
    plain = written(named.select("root", "path", "file", "barrel", "exports", "unused", "kind", "kept"), "roots-modules")

    asked = imports.select("root", file.alias("file"), "pos", "source", "kind", F.col("specifiers").cast(SPECIFIERS).alias("specifiers"))
    resolved = written(resolve_roots(asked, files, aliases, externals, based, closed, dotted), "roots-imports")
    edges = ops.resolved(resolved.where("res_kind = 'source'").withColumnRenamed("res_path", "target"), plain, "target", "file")

    taken = edges.select("target", "kind", F.explode_outer("specifiers").alias("s")).select("target", "kind", F.col("s.kind").alias("s_kind"), "s.imported")
    used = taken.where("s_kind in ('Default', 'Named')").select(F.col("target").alias("file"), F.col("imported").alias("exportName")).distinct()
    whole = taken.where("s_kind in ('Namespace', 'Unknown') or (kind = 'dynamic' and s_kind is null)").select(F.col("target").alias("file")).distinct()
    orphans = ops.unreferenced(plain, edges, "file", "target", exempt=F.col("kind").isNotNull() | F.col("barrel") | F.col("kept")).withColumn("kind", classify.orphan_kind(F.col("path")))
    orphans = orphans.select("root", "file", "kind", classify.orphan_reason(F.col("kind")).alias("reason"), classify.orphan_confidence(F.col("kind")).alias("confidence"))
    offered = plain.select("root", "file", "path", "kind", "barrel", F.posexplode("exports").alias("pos", "e")).withColumn("exportName", F.col("e.name"))
    spared = F.coalesce(F.col("kind").isin(classify.KEEPS_EXPORTS), F.lit(False)) | F.col("barrel") | (F.col("exportName") == "*") | classify.framework_consumes(F.col("kind"), F.col("path"), F.col("exportName"))
    found = {
        "brokenImports": resolved.where("res_kind = 'missing'").select("root", "file", "pos", "source", "kind"), "orphanFiles": orphans,
        "deadExports": ops.dead_members(offered.where(~spared), used, ["file", "exportName"], whole).select("root", "file", "pos", "exportName"),
        "unusedImports": plain.select("root", "file", F.posexplode("unused").alias("pos", "u")).select("root", "file", "pos", "u.source", "u.local", "u.imported"),
        "routeEntrypoints": plain.where("kind in ('next-app-route', 'next-pages-route')").select("root", "file", "kind"),
        "deletionCandidates": orphans.select("root", "file", "reason", "confidence", F.lit(True).alias("safe")),
    }

    def shaped(section: str, df: DataFrame) -> DataFrame:
        pos = F.col("pos") if "pos" in df.columns else F.lit(0)
        return df.select("root", F.lit(section).alias("section"), F.struct(F.split("file", "/").alias("parts"), pos.cast("int").alias("pos")).alias("ord"), *((F.col(f) if f in df.columns else F.lit(None)).cast(t).alias(f) for f, t in reports.TYPES.items()))

    def united(rows: dict[str, DataFrame]) -> DataFrame:
        out = None
        for section, df in rows.items():
            out = shaped(section, df) if out is None else out.unionByName(shaped(section, df))
        return out

    before = united(found)
    counts = plain.groupBy("root").agg(F.count(F.lit(1)).alias("filesScanned"), F.count("kind").alias("entrypoints"))
    if suppressions is None:
        after, counts = before, counts.withColumn("suppressedFindings", F.lit(0).cast("long"))
    else:
        named = lambda f: F.when(F.col("section").isin([s for s, fields in OPTIONAL.items() if f in fields]), F.col(f)).alias(f)
        hides = suppressions.where(F.col("section").isin(list(OPTIONAL))).select("section", file.alias("file"), *map(named, ("source", "local", "exportName")))
        before = written(before, "roots-found")  # counted by key, counted whole, joined and counted again
        after = rules.suppressed_by_table(before, hides, ["section", "file"], ["source", "local", "exportName"])
        lost = before.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(after.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "root", "left")
        counts = counts.join(lost.select("root", (F.col("n") - F.coalesce("m", F.lit(0))).alias("suppressedFindings")), "root", "left").withColumn("suppressedFindings", F.coalesce("suppressedFindings", F.lit(0).cast("long")))

    degrees = edges.groupBy("target").agg(F.count_distinct("file").alias("importedByCount")).withColumnRenamed("target", "file")
    outgoing = edges.groupBy("file").agg(F.count(F.lit(1)).alias("importCount"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    degreed = plain.join(degrees, "file", "left").join(outgoing, "file", "left").select("root", "file", "path", "kind", zero("importedByCount"), zero("importCount"), F.size("exports").cast("long").alias("exportCount"))
    return Roots(degreed, after, counts)


def documents(found: Roots) -> DataFrame:
    """(root, report): the report of every root, one document each."""
    modules = found.modules.select("root", F.split("file", "/").alias("ord"), "file", F.col("path").alias("relativePath"), F.col("kind").alias("entrypointKind"), "importedByCount", "importCount", "exportCount")
    none = F.lit(None).cast("string")
    return reports.documents(found.reports.withColumns({"generatedAt": none, "configPath": none}), found.findings, modules)


# Queries: customers as modules of 40 roots, by number in their root


ROOTS = 40


def _roots(spark: SparkSession, sf_dir: str) -> Roots:
    """Module j imports a of module 2j, and every fifth leaves it unused; every seventh imports module 3j as a whole. Every 11th is a
    page, every 13th a tool's configuration, every 17th and 19th an entry, every 23rd a barrel. Every root has aliases, a keep list
    and suppressions, and is a disk of its own, whose configurations are asked for without extension."""
    named = "case when {0} % 13 = 5 then concat('lib', {0}, '/jest.config') when {0} % 11 = 0 then concat('app/x', {0}, '/page') else concat('lib/m', {0}) end"
    asks = "case j % 4 when 0 then concat('@/', {0}) when 1 then concat('/', {0}, '.ts') when 2 then concat('~', {0}, '!x') else concat(if(j % 11 = 0, '../../', './../'), {0}) end"
    keys = table(spark, sf_dir, "customer").selectExpr(f"c_custkey % {ROOTS} as r", f"c_custkey div {ROOTS} as j").selectExpr("*", *(f"{named.format(f'({k} * j)')} as n{k}" for k in (1, 2, 3)))
    base = keys.selectExpr("r", "j", "concat('/r', r) as root", "concat(n1, '.ts') as path", f"{asks.format('n2')} as r2", f"{asks.format('n3')} as r3")

    spec = "array(named_struct('kind', '{0}', 'imported', '{1}', 'local', '{1}'))"
    asked = [("0", "r2", spec.format("Named", "a")), ("1", "if(j % 7 = 0, r3, null)", spec.format("Namespace", "*")), ("2", "'node:fs'", spec.format("Default", "fs")), ("3", "'react'", spec.format("Default", "react"))]
    each = ", ".join(f"named_struct('pos', {pos}, 'source', {source}, 'kind', 'static', 'specifiers', {s})" for pos, source, s in asked)
    imports = base.selectExpr("root", "path", f"explode(array({each})) as i").selectExpr("root", "path", "i.*").where("source is not null")
    modules = base.selectExpr(
        "root", "path", "j % 23 = 7 as barrel", "transform(array('a', 'b', 'a'), x -> named_struct('name', x, 'kind', 'named')) as exports",
        "filter(array(named_struct('source', r2, 'local', 'a', 'imported', 'a')), x -> j % 5 = 0) as unused",
    )

    every = base.select("r", "root").distinct()
    lines = lambda *made: every.select("r", "root", F.posexplode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in m.items())) for m in made))).alias("ord", "x")).select("r", "root", "ord", "x.*")
    aliases = lines({"alias": "@/*", "target": "*"}, {"alias": "~*!x", "target": "./*"}, {"alias": "@/*", "target": "gone/*"})
    keep = lines({"of": 0, "line": "lib/m*3.ts"}, {"of": 1, "line": "lib/**"}, {"of": 1, "line": "!lib/m?.ts"}).where("r % 3 = of")
    entries = base.where("j % 17 = 3").select("root", "path", F.lit("user-entry").alias("kind")).unionByName(base.where("j % 19 = 4").select("root", "path", F.lit("package-entry").alias("kind")))
    none = F.lit(None).cast("string")
    hide = lambda where, section, **fields: base.where(where).select("root", F.lit(section).alias("section"), "path", *(fields.get(f, none).alias(f) for f in ("source", "local", "exportName")))
    hides = hide("r % 4 = 0 and j = 7", "orphanFiles").unionByName(hide("r % 4 = 1", "deadExports", exportName=F.lit("b"))).unionByName(hide("r % 4 = 2 and j % 2 = 0", "unusedImports")).unionByName(hide("r % 4 = 3", "brokenImports", source=F.lit("@/lib/m1000000")))
    return analyze_roots(base.select("root", "path"), modules, imports, aliases, entries, keep, hides, closed=True, dotted=True)


_NAMED = "case when {0} % 13 = 5 then 'lib' || {0} || '/jest.config' when {0} % 11 = 0 then 'app/x' || {0} || '/page' else 'lib/m' || {0} end"
_REQUEST = "case j % 4 when 0 then '@/' || {0} when 1 then '/' || {0} || '.ts' when 2 then '~' || {0} || '!x' else case when j % 11 = 0 then '../../' || {0} else './../' || {0} end end"
_ROOTS = f"""
with c as (
  select *, '/r' || r as root, '/r' || r || '/' || path as file,
    case when j % 17 = 3 then 'user-entry' when j % 19 = 4 then 'package-entry' when j % 13 = 5 then 'tooling-entry' when j % 11 = 0 then 'next-app-route' end as kind, j % 23 = 7 as barrel,
    case r % 3 when 0 then path like 'lib/m%3.ts' when 1 then starts_with(path, 'lib/') and not regexp_matches(path, '^lib/m.\\.ts$') else false end as kept
  from (select c_custkey % {ROOTS} as r, c_custkey // {ROOTS} as j, {_NAMED.format("(c_custkey // %d)" % ROOTS)} || '.ts' as path from customer)),
asked as (
  select r, root, file, j, 2 * j as t, 0 as pos, {_REQUEST.format(f"({_NAMED.format('(2 * j)')})")} as source from c
  union all select r, root, file, j, 3 * j, 1, {_REQUEST.format(f"({_NAMED.format('(3 * j)')})")} from c where j % 7 = 0),
edges as (select a.*, b.file as target from asked a join c b on b.r = a.r and b.j = a.t),
orphans as (select * from c where kind is null and not barrel and not kept and file not in (select target from edges)),
found as (
  select root, 'brokenImports' as section, file, source, 'static' as kind, null as local, null as imported, null as exportName, null as reason, null::float as confidence, null::boolean as safe, r, j from asked a
    where not exists (select 1 from c where c.r = a.r and c.j = a.t)
  union all select root, 'orphanFiles', file, null, 'orphan-module', null, null, null, 'Module has no inbound references and is not treated as an entrypoint.', 0.88, null, r, j from orphans
  union all select root, 'deadExports', file, null, null, null, null, e, null, null, null, r, j from c, (values ('a'), ('b')) v(e)
    where (kind is null or kind = 'next-app-route') and not barrel and file not in (select target from edges where pos = 1) and not (e = 'a' and file in (select target from edges where pos = 0))
  union all select root, 'unusedImports', file, source, null, 'a', 'a', null, null, null, null, r, j from asked where pos = 0 and j % 5 = 0
  union all select root, 'routeEntrypoints', file, null, kind, null, null, null, null, null, null, r, j from c where kind = 'next-app-route'
  union all select root, 'deletionCandidates', file, null, null, null, null, null, 'Module has no inbound references and is not treated as an entrypoint.', 0.88, true, r, j from orphans),
hidden as (
  select *, coalesce((section = 'orphanFiles' and r % 4 = 0 and j = 7) or (section = 'deadExports' and r % 4 = 1 and exportName = 'b') or (section = 'unusedImports' and r % 4 = 2 and j % 2 = 0) or (section = 'brokenImports' and r % 4 = 3 and source = '@/lib/m1000000'), false) as gone
  from found)"""


@query(_ROOTS + " select root, section, file, source, kind, local, imported, exportName, reason, confidence, safe from hidden where not gone")
def roots_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roots(spark, sf_dir).findings.drop("ord")


@query(_ROOTS + """, degrees as (select target as file, count(distinct file) as n from edges group by target), outgoing as (select file, count(*) as n from edges group by file)
select root, file, path, kind, coalesce(d.n, 0)::bigint as importedByCount, coalesce(o.n, 0)::bigint as importCount, 2::bigint as exportCount from c left join degrees d using (file) left join outgoing o using (file)""")
def roots_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roots(spark, sf_dir).modules


@query(_ROOTS + """, n as (
  select root, count(*) filter (where gone) as h, count(*) filter (where not gone and section = 'brokenImports') as b, count(*) filter (where not gone and section = 'orphanFiles') as f, count(*) filter (where not gone and section = 'deadExports') as d,
    count(*) filter (where not gone and section = 'unusedImports') as u, count(*) filter (where not gone and section = 'routeEntrypoints') as t, count(*) filter (where not gone and section = 'deletionCandidates') as x from hidden group by root)
select root, count(*) as filesScanned, count(kind) as entrypoints, any_value(b)::bigint as brokenImports, any_value(f)::bigint as orphanFiles, any_value(d)::bigint as deadExports, any_value(u)::bigint as unusedImports, any_value(t)::bigint as routeEntrypoints,
  any_value(x)::bigint as deletionCandidates, any_value(h)::bigint as suppressedFindings from c join n using (root) group by root""")
def roots_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every root, as the documents of the whole analysis say."""
    made = reports.read_reports(documents(_roots(spark, sf_dir)), "root", "report")
    return made.reports.select("root", "filesScanned", "entrypoints", *reports.SECTIONS, "suppressedFindings")
