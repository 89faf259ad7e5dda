"""Queries over reports of many roots. Roots are groups of customers; what their reports find is made from their orders and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.operators import reports as ops
from refgraph.operators.classify import ORPHANS
from refgraph.operators.reference import placed
from refgraph.plans.catalogue import query, table
from refgraph.plans.rules import _pick

ROOTS = 40
KINDS = ["static", "require", "dynamic"]
PATH = ".refgraph/latest report.json"


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    root = _text("/r", F.col("o_custkey") % ROOTS)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", root.alias("root"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber").join(orders.select("o_orderkey", "root"), "o_orderkey")
    return orders, lines


def _findings(spark: SparkSession, sf_dir: str, sections: tuple = ops.SECTIONS) -> DataFrame:
    orders, lines = _base(spark, sf_dir)
    file = {True: _text(F.col("root"), "/src/o", F.col("o_orderkey"), ".ts"), False: _text(F.col("root"), "/src/o", F.col("o_orderkey"), "/l", F.col("l_linenumber"), ".ts")}
    kind = _pick(list(ORPHANS), F.col("o_custkey") % 3)
    reason, sure = _pick([r for r, _ in ORPHANS.values()], F.col("o_custkey") % 3), _pick([str(c) for _, c in ORPHANS.values()], F.col("o_custkey") % 3).cast("float")

    def rows(df: DataFrame, section: str, where: str, whole: bool, **fields: Column) -> DataFrame:
        made = {"file": file[whole]} | fields
        return df.where(where).select("root", F.lit(section).alias("section"), *(made.get(f, F.lit(None)).cast(t).alias(f) for f, t in ops.TYPES.items()))

    local = _text("x", F.col("l_linenumber"))
    made = {
        "brokenImports": rows(lines, "brokenImports", "l_partkey % 13 = 5", False, source=_text("./p", F.col("l_partkey")), kind=_pick(KINDS, F.col("l_suppkey") % 3)),
        "orphanFiles": rows(orders, "orphanFiles", "o_orderkey % 11 = 3", True, kind=kind, reason=reason, confidence=sure),
        "deadExports": rows(lines, "deadExports", "l_partkey % 17 = 4", False, exportName=_text("p", F.col("l_partkey"))),
        "unusedImports": rows(lines, "unusedImports", "l_suppkey % 19 = 7", False, source=_text("s", F.col("l_suppkey")), local=local, imported=F.when(F.col("l_partkey") % 2 == 0, local).otherwise("default")),
        "routeEntrypoints": rows(orders, "routeEntrypoints", "o_orderstatus = 'P' and o_orderkey % 7 = 1", True, kind=F.lit("next-pages-route")),
        "deletionCandidates": rows(orders, "deletionCandidates", "o_orderkey % 11 = 3 and o_custkey % 3 <> 1", True, reason=reason, confidence=sure, safe=F.lit(True)),
    }
    found = None
    for s in sections:
        found = made[s] if found is None else found.unionByName(made[s])
    return found.withColumn("ord", F.struct(F.split("file", "/").alias("parts"), *(f for f in ops.FIELDS if f != "file")))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, _ = _base(spark, sf_dir)
    counts = orders.groupBy("root").agg(F.count(F.lit(1)).alias("filesScanned"), F.count_if(F.col("o_orderstatus") == "P").alias("entrypoints"))
    hidden = F.substring("root", 3, 9).cast("long")
    return counts.select("root", F.lit("2024-05-01T00:00:00.000Z").alias("generatedAt"), F.when(hidden % 2 == 0, _text(F.col("root"), "/c.json")).alias("configPath"), "filesScanned", "entrypoints", F.when(hidden % 3 == 0, hidden).otherwise(0).alias("suppressedFindings"))


_KINDS, _REASONS, _SURE = (", ".join(f"'{x}'" for x in xs) for xs in (ORPHANS, [r for r, _ in ORPHANS.values()], [str(c) for _, c in ORPHANS.values()]))
_FOUND = f"""
o as (select *, '/r' || (o_custkey % {ROOTS}) as root, o_custkey % 3 + 1 as spot from orders),
l as (select l.*, root from lineitem l join o on l_orderkey = o_orderkey),
lines as (select *, root || '/src/o' || l_orderkey || '/l' || l_linenumber || '.ts' as file from l),
files as (select *, root || '/src/o' || o_orderkey || '.ts' as file, [{_KINDS}][spot::int] as k, [{_REASONS}][spot::int] as r, [{_SURE}][spot::int]::float as c from o),
found as (
  select root, 'brokenImports' as section, file, './p' || l_partkey as source, ['static', 'require', 'dynamic'][(l_suppkey % 3 + 1)::int] as kind, null as local, null as imported, null as exportName, null as reason, null::float as confidence, null::boolean as safe
    from lines where l_partkey % 13 = 5
  union all select root, 'orphanFiles', file, null, k, null, null, null, r, c, null from files where o_orderkey % 11 = 3
  union all select root, 'deadExports', file, null, null, null, null, 'p' || l_partkey, null, null, null from lines where l_partkey % 17 = 4
  union all select root, 'unusedImports', file, 's' || l_suppkey, null, 'x' || l_linenumber, case when l_partkey % 2 = 0 then 'x' || l_linenumber else 'default' end, null, null, null, null from lines where l_suppkey % 19 = 7
  union all select root, 'routeEntrypoints', file, null, 'next-pages-route', null, null, null, null, null, null from files where o_orderstatus = 'P' and o_orderkey % 7 = 1
  union all select root, 'deletionCandidates', file, null, null, null, null, null, r, c, true from files where o_orderkey % 11 = 3 and o_custkey % 3 <> 1),
numbered as (
  select *, substr(file, length(root) + 2) as rel, row_number() over (partition by root, section order by string_split(file, '/'), source, kind, local, imported, exportName, reason, confidence, safe) as n from found)"""
_COUNTED = """
counted as (
  select o.root, count(*) as files, count(*) filter (where o_orderstatus = 'P') as entries, any_value(coalesce(b, 0)) as b, any_value(coalesce(f, 0)) as f, any_value(coalesce(d, 0)) as d, any_value(coalesce(u, 0)) as u,
    any_value(coalesce(t, 0)) as t, any_value(coalesce(x, 0)) as x, case when any_value(substr(o.root, 3)::int) % 3 = 0 then any_value(substr(o.root, 3)::int) else 0 end as hidden,
    case when any_value(substr(o.root, 3)::int) % 2 = 0 then o.root || '/c.json' end as config
  from o left join (
    select root, count(*) filter (where section = 'brokenImports') as b, count(*) filter (where section = 'orphanFiles') as f, count(*) filter (where section = 'deadExports') as d, count(*) filter (where section = 'unusedImports') as u,
      count(*) filter (where section = 'routeEntrypoints') as t, count(*) filter (where section = 'deletionCandidates') as x from found group by root) using (root)
  group by o.root),
said as (
  select *, b + x + d + u as total, concat_ws(', ', case when b > 0 then b || ' broken import' || if(b = 1, '', 's') end, case when x > 0 then x || ' cleanup candidate' || if(x = 1, '', 's') end,
    case when d > 0 then d || ' dead export' || if(d = 1, '', 's') end, case when u > 0 then u || ' unused import' || if(u = 1, '', 's') end) as listed from counted),
impact as (
  select *, case when total > 0 then total || ' actionable finding' || if(total = 1, '', 's') || ': ' || listed || '.' else 'No actionable findings in ' || files || ' scanned file' || if(files = 1, '', 's') || '.' end as headline,
    case when b > 0 then 'Fix broken imports before deleting files.' when x > 0 then 'Run the cleanup preview and remove unused files of high confidence.' when d > 0 then 'Remove dead exports or confirm that they are public API.'
      when u > 0 then 'Remove unused imports.' else 'Keep the JSON report as a baseline for later diffs.' end as move from said)"""
_JSON = {
    "brokenImports": "{'file': file, 'source': source, 'kind': kind}", "orphanFiles": "{'file': file, 'kind': kind, 'reason': reason, 'confidence': round(confidence::double, 2)}", "deadExports": "{'file': file, 'exportName': exportName}",
    "unusedImports": "{'file': file, 'source': source, 'local': local, 'imported': imported}", "routeEntrypoints": "{'file': file, 'kind': kind}", "deletionCandidates": "{'file': file, 'reason': reason, 'confidence': round(confidence::double, 2), 'safe': safe}",
}
_DOCUMENTS = f"""
with {_FOUND}, {_COUNTED},
arrays as (select root, {", ".join(f"to_json(list({item} order by n) filter (where section = '{s}'))::varchar as {s}" for s, item in _JSON.items())} from numbered group by root),
graph as (
  select root, to_json(list({{'file': file, 'relativePath': substr(file, length(root) + 2), 'entrypointKind': case when o_orderstatus = 'P' then 'user-entry' end, 'importedByCount': o_orderkey % 5, 'importCount': 0::bigint, 'exportCount': o_custkey % 3}} order by file, o_orderkey)
    filter (where o_orderkey % 50 = 0))::varchar as modules from files group by root),
documents as (
  select root, '{{"schemaVersion":2,"generatedAt":"2024-05-01T00:00:00.000Z","project":{{"root":"' || root || '","configPath":' || coalesce('"' || config || '"', 'null') || '}},"summary":{{"filesScanned":' || files || ',"entrypoints":' || entries
    || ',"brokenImports":' || b || ',"orphanFiles":' || f || ',"deadExports":' || d || ',"unusedImports":' || u || ',"routeEntrypoints":' || t || ',"deletionCandidates":' || x || case when hidden > 0 then ',"suppressedFindings":' || hidden else '' end
    || '}},"findings":{{' || {" || ',' || ".join(f"""'"{s}":' || coalesce({s}, '[]')""" for s in _JSON)} || '}},"graph":{{"modules":' || coalesce(modules, '[]') || '}}}}' as report
  from counted left join arrays using (root) left join graph using (root))"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, _ = _base(spark, sf_dir)
    file = _text(F.col("root"), "/src/o", F.col("o_orderkey"), ".ts")
    modules = orders.where("o_orderkey % 50 = 0").select(
        "root", F.struct(file.alias("file"), "o_orderkey").alias("ord"), file.alias("file"), _text("src/o", F.col("o_orderkey"), ".ts").alias("relativePath"), F.when(F.col("o_orderstatus") == "P", "user-entry").alias("entrypointKind"),
        (F.col("o_orderkey") % 5).alias("importedByCount"), F.lit(0).cast("long").alias("importCount"), (F.col("o_custkey") % 3).alias("exportCount"),
    )
    return ops.documents(_reports(spark, sf_dir), _findings(spark, sf_dir), modules)


@query(_DOCUMENTS + " select root, report from documents")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of every root, in one plan."""
    return _documents(spark, sf_dir)


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as others might send them: by root whole, cut off, without a summary, with a confidence in quotes, or of version 1
    with unknown kinds and a finding without a file."""
    report, kind = F.col("report"), F.substring("root", 3, 9).cast("int") % 6
    odd = F.replace(F.replace(report, F.lit('"schemaVersion":2'), F.lit('"version":1')), F.lit('"kind":"require"'), F.lit('"kind":"odd"'))
    odd = F.regexp_replace(odd, '"deadExports":\\[\\{"file":', '"deadExports":[{"fil":')
    text = F.when(kind == 1, F.left(report, F.char_length(report) - 1)).when(kind == 2, F.replace(report, F.lit('"summary"'), F.lit('"sum"'))).when(kind == 3, F.regexp_replace(report, '"confidence":(0.84)', '"confidence":"$1"')).when(kind == 4, odd).otherwise(report)
    return _documents(spark, sf_dir).select("root", text.alias("text"))


@query(f"""
with {_FOUND},
sent as (select *, substr(root, 3)::int % 6 as how, n - 1 as ord from numbered),
old as (select *, row_number() over (partition by root, section order by n) - 1 as again from sent where how = 4 and not (section = 'deadExports' and n = 1))
select root, section, ord::int as ord, file, source, kind, local, imported, exportName, reason, confidence, safe from sent where how in (0, 5)
union all select root, section, ord::int, file, source, kind, local, imported, exportName, reason, confidence, safe from sent s where how = 3 and not exists (select 1 from sent t where t.root = s.root and t.confidence = 0.84::float)
union all select root, section, again::int, file, source, case when section = 'brokenImports' and kind = 'require' then 'unknown' else kind end, local, imported, exportName, reason, confidence, safe from old""")
def report_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of documents in bulk, of those that are reports."""
    return ops.read_reports(_sent(spark, sf_dir), "root").findings.select("root", "section", "ord", *ops.FIELDS)


@query(f"""
with {_FOUND},
wrong as (select root, section, min(n) - 1 as first from numbered where confidence = 0.84::float group by root, section)
select distinct root as id, case when substr(root, 3)::int % 6 = 1 then 'no JSON' when substr(root, 3)::int % 6 = 2 then 'summary is missing or no object'
    else (select min_by('findings.' || section || '[' || first || '] is wrong', case section when 'orphanFiles' then 0 else 1 end) from wrong w where w.root = o.root) end as problem
from o where substr(root, 3)::int % 6 in (1, 2) or (substr(root, 3)::int % 6 = 3 and root in (select root from wrong))""")
def report_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no reports, and why."""
    return ops.read_reports(_sent(spark, sf_dir), "root").rejects


_LINE = """case section when 'brokenImports' then rel || ' -> ' || source when 'orphanFiles' then rel when 'deadExports' then rel || '#' || exportName
  when 'unusedImports' then rel || ' -> ' || case when local = imported then local else imported || ' as ' || local end || ' from ' || source
  when 'routeEntrypoints' then rel || ' (' || kind || ')' else rel || ' (confidence ' || printf('%.2f', round(confidence::double, 2)) || ', ' || reason || ')' end"""
_PREVIEWS = f"""
with {_FOUND},
previews as (
  select root, section, n::int as place, '- ' || {_LINE} as line from numbered where n <= 5
  union all select root, section, 6, '- ... ' || (count(*) - 5) || ' more' from numbered group by root, section having count(*) > 5)"""


@query(_PREVIEWS + " select root, section, place, line from previews")
def report_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five findings of every section of every root, and how many more there are."""
    return ops.previews(_findings(spark, sf_dir), ["root", "section"], [F.col("ord")], ops.finding_line())


_ORDER = "{'brokenImports': 1, 'deletionCandidates': 2, 'orphanFiles': 3, 'deadExports': 4, 'unusedImports': 5, 'routeEntrypoints': 6}"
_TITLES = "{'brokenImports': 'Broken imports', 'deletionCandidates': 'Top cleanup candidates', 'orphanFiles': 'Orphan files', 'deadExports': 'Dead exports', 'unusedImports': 'Unused imports', 'routeEntrypoints': 'Route entrypoints'}"
_LABELLED = """'Files scanned: ' || files || chr(10) || '{0}Entrypoints: ' || entries || chr(10) || '{0}Broken imports: ' || b || chr(10) || '{0}Orphan files: ' || f || chr(10) || '{0}Dead exports: ' || d || chr(10) || '{0}Unused imports: ' || u
  || chr(10) || '{0}Route entrypoints: ' || t || chr(10) || '{0}Deletion candidates: ' || x || case when hidden > 0 then chr(10) || '{0}Suppressed findings: ' || hidden else '' end"""
_PLACES = "map(['brokenImports', 'deletionCandidates', 'orphanFiles', 'deadExports', 'unusedImports', 'routeEntrypoints'], {0})[section]"


@query(_PREVIEWS + f""", {_COUNTED},
blocks as (
  select root, {_PLACES.format("[1, 2, 3, 4, 5, 6]")} as block, chr(10) || {_PLACES.format("['Broken imports', 'Top cleanup candidates', 'Orphan files', 'Dead exports', 'Unused imports', 'Route entrypoints']")} || ':' || chr(10) || string_agg(line, chr(10) order by place) as text
  from previews group by root, section)
select i.root, 'Report.' || chr(10) || chr(10) || 'Impact: ' || headline || chr(10) || 'Best next move: ' || move || chr(10) || chr(10) || 'Root: ' || i.root || chr(10) || {_LABELLED.format("")}
    || chr(10) || chr(10) || 'Saved report: {PATH}' || chr(10) || chr(10) || 'Next steps:' || chr(10) || '- Preview cleanup: refgraph clean ''{PATH}''' || chr(10) || '- Shareable markdown: refgraph report ''{PATH}'' --format md'
    || coalesce(chr(10) || (select string_agg(text, chr(10) order by block) from blocks k where k.root = i.root), '') as text
from impact i""")
def report_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report as text, sections as previews."""
    return ops.summary_texts(_reports(spark, sf_dir), _findings(spark, sf_dir), F.lit(PATH))


_CODE = """case section when 'brokenImports' then rel || ' -> `' || source || '`' when 'orphanFiles' then rel || ' (' || reason || ')' when 'deadExports' then rel || ' -> `' || exportName || '`'
  when 'unusedImports' then rel || ' -> `' || case when local = imported then local else imported || ' as ' || local end || '` from `' || source || '`'
  when 'routeEntrypoints' then rel || ' (' || kind || ')' else rel || ' (' || reason || ', confidence ' || printf('%.2f', round(confidence::double, 2)) || ')' end"""


@query(f"""
with {_FOUND}, {_COUNTED},
blocks as (select root, section, string_agg('- ' || {_CODE}, chr(10) order by n) as text from numbered group by root, section),
titles as (select * from (values (1, 'brokenImports', 'Broken imports'), (2, 'orphanFiles', 'Orphan files'), (3, 'deadExports', 'Dead exports'), (4, 'unusedImports', 'Unused imports'), (5, 'routeEntrypoints', 'Route entrypoints'), (6, 'deletionCandidates', 'Deletion candidates')) v(block, section, title)),
bodies as (
  select i.root, string_agg(chr(10) || '## ' || title || chr(10) || chr(10) || coalesce(k.text, '- none'), chr(10) order by block) as body
  from impact i cross join titles t left join blocks k on k.root = i.root and k.section = t.section group by i.root)
select i.root, '# Report' || chr(10) || chr(10) || '> ' || headline || chr(10) || chr(10) || '- Generated at: 2024-05-01T00:00:00.000Z' || chr(10) || '- Root: ' || i.root || chr(10) || '- Report: {PATH}' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
    || '- ' || {_LABELLED.format("- ")} || chr(10) || chr(10) || '## Impact' || chr(10) || chr(10) || '- ' || headline || chr(10) || '- Best next move: ' || move || chr(10) || '- Preview cleanup: `refgraph clean ''{PATH}''`' || chr(10)
    || '- Refresh markdown: `refgraph report ''{PATH}'' --format md`' || chr(10) || body as text
from impact i join bodies using (root)""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report in Markdown, whole."""
    return ops.markdown_texts(_reports(spark, sf_dir), _findings(spark, sf_dir), F.lit(PATH))


@query(f"""
with {_FOUND},
keyed as (
  select root, section, n, concat_ws('|', rel, source, kind, local, imported, exportName, reason, case confidence when 0.92::float then '1064011039' when 0.84::float then '1062668861' when 0.88::float then '1063339950' end, safe::varchar) as key
  from numbered),
was as (select *, row_number() over (partition by root, section, key order by n) as occurrence from keyed where n % 5 <> 0),
now as (select *, row_number() over (partition by root, section, key order by n) as occurrence from keyed where n % 7 <> 0),
changed as (
  select root, section, key, occurrence, case when w.n is null then 'introduced' when a.n is null then 'resolved' else 'persisted' end as change from was w full join now a using (root, section, key, occurrence))
select root, section, key, occurrence::int as occurrence, change, (row_number() over (partition by root, section, change order by key, occurrence))::int as place from changed""")
def report_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two reports of every root, in the order of a diff: the first lacks every fifth finding, the second every
    seventh."""
    found = placed(_findings(spark, sf_dir), [F.col("ord")], "n", ["root", "section"]).withColumn("ord", F.col("n"))
    return ops.changes(found.where("n % 5 <> 0"), found.where("n % 7 <> 0"), ["root"]).select("root", "section", "key", "occurrence", "change", "place")
