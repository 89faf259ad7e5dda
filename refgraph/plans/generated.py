"""Queries over modules and paths that are generated from keys, so that the operators on source trees run over the tables.

A row's key picks one of a list of cases and stands in it wherever `#` does. The SQL holds what each case must give, written
down by hand beside the case; it computes nothing in the way that the operators do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.operators import classify
from refgraph.operators import reference as ops
from refgraph.sources.config import ProjectConfig

from . import compare, project
from .catalogue import query, table


@dataclass(frozen=True)
class Cases:
    """Cases with what they must give: a tuple, or several for a case of several rows."""

    rows: list[tuple]

    def pick(self, key: Column, field: int = 0) -> Column:
        """A field of the key's case."""
        chosen = F.get(F.array(*(F.lit(r[field]) for r in self.rows)), (key % len(self.rows)).cast("int"))
        return F.replace(chosen, F.lit("#"), key.cast("string"))

    def sql(self, columns: str, each: bool = False) -> str:
        """The cases as SQL values (i, columns). each: the last field of a case is a list of rows."""
        value = lambda v: "null" if v is None else str(v).lower() if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"
        found = [(k, *more) for k, r in enumerate(self.rows) for more in (r[-1] if each else [r])]
        return "(values " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in found) + f") as c(i, {columns})"


def _filled(*columns: str) -> str:
    return ", ".join(f"replace({c}, '#', p_partkey::varchar) as {c}" for c in columns)


ENTRIES = Cases([
    ("src/app/x#/page.tsx", "next-app-route"), ("app/api#/route.ts", "next-app-route"), ("packages/p#/app/layout.tsx", "next-app-route"), ("lib#/app/page.tsx", None), ("app/x#/page.test.tsx", "tooling-entry"),
    ("app/x#/opengraph-image.tsx", "next-app-route"), ("app/x#/helper.ts", None), ("pages/p#.tsx", "next-pages-route"), ("src/pages/a#.test.ts", "next-pages-route"), ("apps/a#/pages/i.tsx", "next-pages-route"),
    ("other#/pages/x.tsx", None), ("main.ts", "app-entry"), ("pkg#/src/index.ts", "app-entry"), ("pkg#/index.ts", None), ("src/cli.mjs", "app-entry"), ("src/cli#.mjs", None),
    ("w#/vite.config.ts", "tooling-entry"), ("w#/vite.config.d.ts", None), ("w#/other.config.ts", None), ("src/__tests__/a#.ts", "tooling-entry"), ("src/A#.SPEC.ts", "tooling-entry"), ("src/spec#.ts", None),
    ("scripts/verify-x#.ts", "tooling-entry"), ("scripts/a-smoke#.sh", "tooling-entry"), ("scripts/build#.ts", None), ("middleware.ts", "framework-entry"), ("instrumentation.js", "framework-entry"), ("src/middleware.ts", None),
])


@query(f"""
select p_partkey, case when p_partkey % 37 = 0 then 'user-entry' when p_partkey % 41 = 0 then 'package-entry' else kind end as kind
from part join {ENTRIES.sql("path, kind")} on i = p_partkey % {len(ENTRIES.rows)}""")
def entry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", classify.entry_kind(ENTRIES.pick(key), key % 37 == 0, key % 41 == 0).alias("kind"))


ORPHANS = Cases([
    ("src/components/a#.ts", "orphan-component"), ("src/Button#.tsx", "orphan-component"), ("src/COMPONENTS/x#.ts", "orphan-component"), ("src/Ärger#.ts", "orphan-component"), ("components/a#.ts", "orphan-module"),
    ("src/routes/a#.ts", "orphan-route-module"), ("src/user-page.#.ts", "orphan-route-module"), ("src/Route.ts", "orphan-component"), ("src/route_#.ts", "orphan-route-module"), ("src/homepage#.ts", "orphan-module"),
    ("src/util#.ts", "orphan-module"), ("util", "orphan-module"), ("src/page", "orphan-route-module"),
])


@query(f"""
select p_partkey, kind, case kind when 'orphan-component' then 'Component-like module has no inbound references.' when 'orphan-route-module' then 'Route-like module is not connected to any router entry.'
  else 'Module has no inbound references and is not treated as an entrypoint.' end as reason,
  (case kind when 'orphan-component' then 0.92 when 'orphan-route-module' then 0.84 else 0.88 end)::float as confidence
from part join {ORPHANS.sql("path, kind")} on i = p_partkey % {len(ORPHANS.rows)}""")
def orphan_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", classify.orphan_kind(ORPHANS.pick(F.col("p_partkey"))).alias("kind"))
    return found.select("p_partkey", "kind", classify.orphan_reason(F.col("kind")).alias("reason"), classify.orphan_confidence(F.col("kind")).alias("confidence"))


# Reasons and what is displayed for them.
REASONS = Cases([
    ("Component-like module has no inbound references.", "컴포넌트로 보이는 모듈에 참조가 없습니다."), ("Route-like module is not connected to any router entry.", "라우트로 보이는 모듈이 어떤 라우터 진입점에도 연결되지 않았습니다."),
    ("Module has no inbound references and is not treated as an entrypoint.", "모듈에 참조가 없고 진입점으로 취급되지 않습니다."), ("another reason #", "another reason #"),
])


@query(f"""select p_partkey, {_filled("displayed")} from part join {REASONS.sql("reason, displayed")} on i = p_partkey % {len(REASONS.rows)}""")
def displayed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", classify.displayed_reason(REASONS.pick(F.col("p_partkey"))).alias("displayed"))


CONSUMED = Cases([
    ("next-app-route", "app/a#/page.tsx", "default", True), ("next-app-route", "app/a#/page.tsx", "metadata", True), ("next-app-route", "app/a#/page.tsx", "helper", False), ("next-app-route", "app/a#/route.ts", "GET", True),
    ("next-app-route", "app/a#/route.ts", "default", False), ("next-app-route", "app/a#/page.tsx", "GET", False), ("next-app-route", "app/icon.tsx", "size", True), ("next-app-route", "app/icon.tsx", "alt", False),
    ("next-app-route", "app/sitemap.ts", "generateSitemaps", True), ("next-app-route", "app/robots.ts", "revalidate", True), ("next-app-route", "app/layout.tsx", "generateStaticParams", True), ("next-app-route", "app/error.tsx", "revalidate", False),
    ("next-pages-route", "pages/a#.tsx", "getStaticProps", True), ("next-pages-route", "pages/a#.tsx", "GET", False), ("next-pages-route", "pages/a#.tsx", "config", True), ("app-entry", "main.ts", "default", False), (None, "app/a#/page.tsx", "default", False),
])


@query(f"""select p_partkey, export, consumed from part join {CONSUMED.sql("kind, path, export, consumed")} on i = p_partkey % {len(CONSUMED.rows)}""")
def framework_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, path, export = (CONSUMED.pick(F.col("p_partkey"), k) for k in range(3))
    return table(spark, sf_dir, "part").select("p_partkey", export.alias("export"), classify.framework_consumes(kind, path, export).alias("consumed"))


#: Modules, and their imports (source, kind, specifier kind, imported, local), exports (name, kind) and unused imports (source, local, imported).
MODULES = [
    ("import d#, { n# as l# } from './a#';\nd#(l#);\nexport default d#;", [("./a#", "static", "Default", "default", "d#"), ("./a#", "static", "Named", "n#", "l#")], [("default", "Default")], []),
    ("import * as s# from './b#';\nexport const v# = s#.go();\nexport function f#() {}", [("./b#", "static", "Namespace", "*", "s#")], [("v#", "Named"), ("f#", "Named")], []),
    (
        "import './side#';\nexport { x# as y# } from './c#';\nexport * from './e#';",
        [("./side#", "side-effect", None, None, None), ("./c#", "reexport", "Named", "x#", "y#"), ("./e#", "reexport-all", "Unknown", "*", "*")], [("y#", "Reexport"), ("*", "ReexportAll")], [],
    ),
    (
        "const r# = require('./r#');\nconst { p#: q# } = require('./p#');\nmodule.exports = { r#, q# };",
        [("./r#", "require", "Unknown", None, "r#"), ("./p#", "require", "Named", "p#", "q#")], [("default", "Default"), ("r#", "Named"), ("q#", "Named")], [],
    ),
    ("async function go() { const m# = await import('./dyn#'); return m#.named#; }\nexport class C# {}\nexport type T# = string;", [("./dyn#", "dynamic", None, None, None)], [("C#", "Named"), ("T#", "Named")], []),
    (
        "import { gone#, kept# } from '@s/pkg#/sub';\nimport type { Ty# } from 'lib#';\nexport const z# = kept# as Ty#;",
        [("@s/pkg#/sub", "static", "Named", "gone#", "gone#"), ("@s/pkg#/sub", "static", "Named", "kept#", "kept#"), ("lib#", "static", "Named", "Ty#", "Ty#")], [("z#", "Named")], [("@s/pkg#/sub", "gone#", "gone#")],
    ),
    ("export * from './only#';", [("./only#", "reexport-all", "Unknown", "*", "*")], [("*", "ReexportAll")], []),
    ("// import x# from './no#';\nconst t = `import y from './no#'`; /import '.\\/no'/.test(t);", [], [], []),
    ("import a# from './unused#';\nimport { b#, c# as d# } from './unused#';\nexport { d# };", [("./unused#", "static", "Default", "default", "a#"), ("./unused#", "static", "Named", "b#", "b#"), ("./unused#", "static", "Named", "c#", "d#")], [("d#", "Named")], [("./unused#", "a#", "default"), ("./unused#", "b#", "b#")]),
    ("", [], [], []),
]
TEXTS = Cases([(m[0],) for m in MODULES])


def _cases(field: int) -> Cases:
    return Cases([(m[field],) for m in MODULES])


def _spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table's keys in as many parts as shuffles have: a file of few bytes is one task to read, but makes many modules."""
    return table(spark, sf_dir, name).select(key).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return project.parse_sources(_spread(spark, sf_dir, "part", "p_partkey").select(F.format_string("/p/m%d.ts", key).alias("file"), TEXTS.pick(key).alias("content")))


@query(f"""
select '/p/m' || p_partkey || '.ts' as file, {_filled("source", "kind", "specifier", "imported", "local")}
from part join {_cases(1).sql("source, kind, specifier, imported, local", each=True)} on i = p_partkey % {len(MODULES)}""")
def module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _parsed(spark, sf_dir).select("file", F.explode("imports").alias("i")).select("file", "i.source", "i.kind", F.explode_outer("i.specifiers").alias("s"))
    return found.select("file", "source", "kind", F.col("s.kind").alias("specifier"), "s.imported", "s.local")


@query(f"""select '/p/m' || p_partkey || '.ts' as file, {_filled("name", "kind")} from part join {_cases(2).sql("name, kind", each=True)} on i = p_partkey % {len(MODULES)}""")
def module_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("file", F.explode("exports").alias("e")).select("file", "e.name", "e.kind")


@query(f"""select '/p/m' || p_partkey || '.ts' as file, {_filled("source", "local", "imported")} from part join {_cases(3).sql("source, local, imported", each=True)} on i = p_partkey % {len(MODULES)}""")
def module_unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("file", F.explode("unused").alias("u")).select("file", "u.source", "u.local", "u.imported")


#: The request of /p/src/f#.ts, what it is, and the file that it finds. On the disk are, for every key, those below.
REQUESTS = Cases([
    ("./m#", "source", "/p/src/m#.ts"), ("./m#.ts", "source", "/p/src/m#.ts"), ("../lib/d#", "source", "/p/lib/d#/index.tsx"), ("./m#.js", "missing", None), ("./style#.css", "asset", "/p/src/style#.css"), ("./gone#", "missing", None),
    ("@/m#", "source", "/p/src/m#.ts"), ("@/gone#", "missing", None), ("cfg", "source", "/p/lib/d1/index.tsx"), ("/lib/d#", "source", "/p/lib/d#/index.tsx"), ("node:fs", "external", None), ("fs", "external", None), ("fs/promises", "external", None),
    ("react#", "missing", None), ("react", "external", None), ("@scope/pkg/sub#", "external", None), ("@scope/other#", "missing", None), ("lib/d#", "source", "/p/lib/d#/index.tsx"), ("nested", "external", None), ("./a#/../m#", "source", "/p/src/m#.ts"),
])
DISK = ["/p/src/m#.ts", "/p/src/m#.tsx", "/p/lib/d#/index.tsx", "/p/src/style#.css", "/p/src/f#.ts"]


@query(f"""
select '/p/src/f' || p_partkey || '.ts' as file, {_filled("source", "kind", "path")} from part join {REQUESTS.sql("source, kind, path")} on i = p_partkey % {len(REQUESTS.rows)}""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    part = _spread(spark, sf_dir, "part", "p_partkey")
    config = ProjectConfig("/p", base_url="/p", aliases=[("@/*", "/p/src/*"), ("cfg", "/p/lib/d1")], external_packages={"react", "@scope/pkg"})
    asked = part.select(F.format_string("/p/src/f%d.ts", key).alias("file"), REQUESTS.pick(key).alias("source"))
    disk = part.select(F.explode(F.array(*(F.replace(F.lit(d), F.lit("#"), key.cast("string")) for d in DISK))).alias("path"))
    found = project.resolve(asked, disk, config, {"/p/src": {"nested"}, "/p/other": {"gone"}})
    return found.select("file", "source", F.col("res_kind").alias("kind"), F.col("res_path").alias("path"))


def _graph(spark: SparkSession, sf_dir: str, suppressions: tuple = ()) -> project.Scan:
    """Module k imports a of module 2k, and every fifth leaves it unused; module 3k is imported as a whole by every seventh;
    every eleventh is a page. Every module exports a and b."""
    key, customers = F.col("c_custkey"), _spread(spark, sf_dir, "customer", "c_custkey")
    name = lambda k: F.when(k % 11 == 0, F.format_string("app/x%d/page", k)).otherwise(F.format_string("lib/m%d", k))
    text = F.concat(
        F.lit("import { a } from '@/"), name(2 * key), F.lit("';\n"), F.when(key % 5 > 0, F.lit("a();\n")).otherwise(F.lit("")),
        F.when(key % 7 == 0, F.concat(F.lit("import * as all from '@/"), name(3 * key), F.lit("';\nall.go();\n"))).otherwise(F.lit("")), F.lit("const own = 1;\nexport { own as a };\nexport function b() {}\n"),
    )
    sources = customers.select(F.concat(F.lit("/p/"), name(key), F.lit(".ts")).alias("file"), text.alias("content"))
    config = ProjectConfig("/p", aliases=[("@/*", "/p/*")], keep_patterns=["lib/m*3.ts"], suppressions=list(suppressions))
    parsed = project.written(project.parse_sources(sources), "graph-parsed")
    return project.analyze(parsed, parsed.select(F.col("file").alias("path")), config)


_GRAPH = """
with c as (select c_custkey as k, case when c_custkey % 11 = 0 then 'app/x' || c_custkey || '/page' else 'lib/m' || c_custkey end as name from customer),
asked as (select k, 2 * k as t from c union all select k, 3 * k from c where k % 7 = 0),
edges as (select a.k, a.t from asked a join c on c.k = a.t)
"""


@query(_GRAPH + """select '/p/' || c.name || '.ts' as file, '@/' || case when t % 11 = 0 then 'app/x' || t || '/page' else 'lib/m' || t end as source, 'static' as kind
from asked join c using (k) where t not in (select k from c)""")
def graph_broken_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).findings["brokenImports"].select("file", "source", "kind")


@query(_GRAPH + """select '/p/' || name || '.ts' as file, 'orphan-module' as kind, 0.88::float as confidence from c
where k not in (select t from edges) and k % 11 <> 0 and name not like 'lib/m%3'""")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).findings["orphanFiles"].select("file", "kind", "confidence")


@query(_GRAPH + """, whole as (select 3 * k as k from c where k % 7 = 0)
select '/p/' || name || '.ts' as file, e as "exportName" from c, (values ('a'), ('b')) x(e)
where k not in (select k from whole) and not (e = 'a' and k in (select 2 * k from c))""")
def graph_dead_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).findings["deadExports"].select("file", "exportName")


@query(_GRAPH + """, degree as (select t as k, count(distinct k) as n from edges group by t), outgoing as (select k, count(*) as n from edges group by k)
select '/p/' || name || '.ts' as file, case when k % 11 = 0 then 'next-app-route' end as kind, coalesce(degree.n, 0)::bigint as "importedBy", coalesce(outgoing.n, 0)::bigint as imports, 2::bigint as exports
from c left join degree using (k) left join outgoing using (k)""")
def graph_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).modules.select("file", F.col("entrypointKind").alias("kind"), F.col("importedByCount").alias("importedBy"), F.col("importCount").alias("imports"), F.col("exportCount").alias("exports"))


@query(_GRAPH + """, whole as (select 3 * k as k from c where k % 7 = 0),
orphan as (select * from c where k not in (select t from edges) and k % 11 <> 0 and name not like 'lib/m%3'),
dead as (select k, e from c, (values ('a'), ('b')) x(e) where k not in (select k from whole) and not (e = 'a' and k in (select 2 * k from c))),
unused as (select k from c where k % 5 = 0), hidden as (select (select count(*) from orphan where k = 1) + (select count(*) from dead where k = 5) + (select count(*) from unused where k = 10) as n)
select (select count(*) from c) as files, (select count(*) from c where k % 11 = 0) as entries, (select count(*) from asked where t not in (select k from c)) as broken,
  (select count(*) from orphan where k <> 1) as orphans, (select count(*) from dead where k <> 5) as dead, (select count(*) from unused where k <> 10) as unused, n::bigint as suppressed from hidden""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda kind, k, local=None: {"kind": kind, "file": f"/p/lib/m{k}.ts", "source": None, "local": local, "export": None}
    summary = _graph(spark, sf_dir, (rule("orphanFile", 1), rule("deadExport", 5), rule("unusedImport", 10, "a"))).summary
    return summary.select(
        F.col("filesScanned").alias("files"), F.col("entrypoints").alias("entries"), F.col("brokenImports").alias("broken"), F.col("orphanFiles").alias("orphans"), F.col("deadExports").alias("dead"),
        F.col("unusedImports").alias("unused"), F.col("suppressedFindings").alias("suppressed"),
    )


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("section"), F.format_string("%d|%d", "l_partkey", "l_linenumber").alias("key"), F.col("l_orderkey").alias("ord"), F.col("l_orderkey").cast("string").alias("item"), "l_shipdate")
    old = F.col("l_shipdate") < F.expr("timestamp_ntz '1994-06-01'")
    return compare.changes(lines.where(old).drop("l_shipdate"), lines.where(~old).drop("l_shipdate"))


_CHANGES = """
with n as (select l_returnflag as section, l_partkey || '|' || l_linenumber as key, l_orderkey::varchar as item, l_shipdate < timestamp '1994-06-01' as old,
  row_number() over (partition by l_returnflag, l_partkey, l_linenumber, l_shipdate < timestamp '1994-06-01' order by l_orderkey)::int as occurrence from lineitem),
changes as (select section, case when a.item is null then 'resolved' when b.item is null then 'introduced' else 'persisted' end as change, key, occurrence, coalesce(a.item, b.item) as item
  from (select * from n where old) b full join (select * from n where not old) a using (section, key, occurrence))
"""


@query(_CHANGES + "select * from changes")
def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(_CHANGES + """select coalesce(section, 'totals') as section, count(*) filter (where change = 'introduced') as introduced, count(*) filter (where change = 'resolved') as resolved,
  count(*) filter (where change = 'persisted') as persisted from changes group by rollup (section)""")
def report_change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.summary(_changes(spark, sf_dir))


NORMAL = Cases([
    ("/a#/./b//c", "/a#/b/c"), ("/a#/../../b", "/b"), ("a#/../..", ".."), ("../a#/../b", "../b"), ("./", "."), ("/", "/"), ("a#/b/../../..//c", "../c"), ("/..", "/"), ("x#", "x#"), ("", "."),
])


@query(f"""select p_partkey, {_filled("path")} from part join {NORMAL.sql("raw, path")} on i = p_partkey % {len(NORMAL.rows)}""")
def paths_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", project.normalize_path(NORMAL.pick(F.col("p_partkey"))).alias("path"))


NAMES = Cases([("lodash#/fp", "lodash#"), ("@scope#/pkg/sub/x", "@scope#/pkg"), ("@scope#/pkg", "@scope#/pkg"), ("@scope#", "@scope#"), ("react", "react")])


@query(f"""select p_partkey, {_filled("package")} from part join {NAMES.sql("request, package")} on i = p_partkey % {len(NAMES.rows)}""")
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", project.package_name(NAMES.pick(F.col("p_partkey"))).alias("package"))


IGNORED = Cases([
    ("dist/a#.js", True), ("src/dist/a#.js", True), ("src/dist", True), ("keep/a#.log", False), ("a#.log", True), ("x/y/a#.log", True), ("docs/a#/b.md", True), ("sub/docs/a#.md", False), ("src/gen/x#/a.ts", True), ("src/gen/a.ts", True),
    ("src/general#.ts", False), ("tmp1/a#", True), ("tmp12/a#", False), ("src/a#.ts", False),
])
RULES = ["dist", "*.log", "/docs/", "src/gen/**", "tmp?", "!keep/*.log"]


@query(f"""select p_partkey, ignored from part join {IGNORED.sql("path, ignored")} on i = p_partkey % {len(IGNORED.rows)}""")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by name, by place, for folders, across folders, and one that is lifted again."""
    return table(spark, sf_dir, "part").select("p_partkey", project.ignored(IGNORED.pick(F.col("p_partkey")), project.rules(RULES)).alias("ignored"))


@query("select p_partkey, (p_retailprice / 3000)::float as confidence from part where (p_retailprice / 3000)::float >= 0.4::float")
def deletion_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a clean-up whose confidence reaches a least one, as 32-bit numbers."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 3000).cast("float").alias("confidence"))
    return ops.threshold_split(rows, "confidence", 0.4).where("eligible").drop("eligible")
