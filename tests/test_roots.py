"""The analysis of many roots against the analysis of one, and cases that only relations show."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from refgraph.operators import reports
from refgraph.plans import project, roots
from refgraph.plans.catalogue import ORACLE_SQL
from refgraph.sources import report as one
from refgraph.sources.config import ProjectConfig

SPEC = "array<struct<kind: string, imported: string, local: string>>"
MODULES = "root string, path string, barrel boolean, exports array<struct<name: string, kind: string>>, unused array<struct<source: string, local: string, imported: string>>"
NAMED, WHOLE = [("Named", "a", "a")], [("Namespace", "*", "all")]
#: path, exports, unused, imports
TREE = {
    "src/main.ts": (["a"], [("./b", "x", "a")], [("./b", NAMED), ("@/lib", WHOLE), ("./gone", NAMED), ("react", []), ("./style.css", []), ("node:fs", [])]),
    "src/b.ts": (["a", "b"], [], [("@/gone", NAMED), ("/src/c.ts", NAMED)]), "src/c.ts": (["a", "b"], [], []), "lib/index.tsx": (["z"], [], []), "src/components/Old.tsx": (["default"], [], []), "kept/x.ts": (["q"], [], []),
    "app/page.tsx": (["default", "other"], [], []), "tools/jest.config.ts": (["n"], [], []), "extra/user.ts": (["n"], [], []), "extra/pkg.ts": (["n"], [], []), "src/bar.ts": (["*", "o"], [], []),
}


@pytest.fixture(scope="module")
def analysed(spark):
    names = ["r0", "r1", "/deep/r2"]
    modules = [(r, p, p == "src/bar.ts", [(e, "named") for e in ex], un) for r in names for p, (ex, un, _) in TREE.items()]
    imports = [(r, p, k, s, "static", spec) for r in names for p, (_, _, im) in TREE.items() for k, (s, spec) in enumerate(im)]
    disk = [(r, p) for r in names for p in [*TREE, "src/style.css"]]
    hides = [("r1", "orphanFiles", "src/components/Old.tsx", "ignored", None, None), ("r1", "deadExports", "src/c.ts", None, None, "b"), ("r1", "brokenImports", "src/b.ts", None, None, None), ("r1", "routeEntrypoints", "app/page.tsx", None, None, None)]
    return roots.analyze_roots(
        spark.createDataFrame(disk, "root string, path string"), spark.createDataFrame(modules, MODULES), spark.createDataFrame(imports, f"root string, path string, pos int, source string, kind string, specifiers {SPEC}"),
        spark.createDataFrame([(r, 0, "@/*", "*") for r in names], "root string, ord int, alias string, target string"),
        spark.createDataFrame([(r, "extra/user.ts", "user-entry") for r in names] + [(r, "extra/pkg.ts", "package-entry") for r in names] + [("r0", "src/c.ts", "package-entry"), ("r0", "extra/user.ts", "package-entry")], "root string, path string, kind string"),
        spark.createDataFrame([(r, 0, "kept/") for r in names], "root string, ord int, line string"), spark.createDataFrame(hides, "root string, section string, path string, source string, local string, exportName string"),
    )


def _one(spark, root, entries):
    parsed = [(f"{root}/{p}", [(s, "static", spec) for s, spec in im], [(e, "named") for e in ex], un, p == "src/bar.ts") for p, (ex, un, im) in TREE.items()]
    config = ProjectConfig(root, aliases=[("@/*", f"{root}/*")], explicit_entries=[f"{root}/extra/user.ts"], package_entries=[f"{root}/extra/pkg.ts", *entries], keep_patterns=["kept/"])
    return project.analyze(spark.createDataFrame(parsed, project.PARSED), spark.createDataFrame([(f"{root}/{p}",) for p in [*TREE, "src/style.css"]], "path string"), config)


@pytest.mark.parametrize(("root", "entries"), [("r0", ["r0/src/c.ts"]), ("/deep/r2", [])])
def test_equals_the_analysis_of_one(spark, analysed, root, entries):
    scan = _one(spark, root, entries)
    for section, spec in one.SECTIONS.items():
        got = analysed.findings.where((F.col("root") == root) & (F.col("section") == section)).select(*spec)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scan.findings[section].select(*spec).collect())), section
    got = analysed.modules.where(F.col("root") == root).select("file", "kind", "importedByCount", "importCount", "exportCount")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, scan.modules.select("file", "entrypointKind", "importedByCount", "importCount", "exportCount").collect()), key=repr)


def test_entries_by_membership(analysed):
    kinds = {(r.root, r.path): r.kind for r in analysed.modules.collect()}
    assert kinds["r0", "extra/user.ts"] == "user-entry" and kinds["r1", "extra/pkg.ts"] == "package-entry"
    assert kinds["r0", "src/c.ts"] == "package-entry" and kinds["r1", "src/c.ts"] is None
    assert kinds["r1", "tools/jest.config.ts"] == "tooling-entry"


def test_entries_keep_their_exports(analysed):
    """Exports of user, package and tooling entries are never dead; those of pages are, unless the framework takes them."""
    dead = {(r.root, r.file, r.exportName) for r in analysed.findings.where("section = 'deadExports'").collect()}
    assert not [d for d in dead if d[1].endswith(("user.ts", "pkg.ts", "config.ts", "main.ts"))]
    assert {d for d in dead if d[0] == "r1"} == {("r1", f"r1/{p}", e) for p, e in [("src/b.ts", "b"), ("src/components/Old.tsx", "default"), ("kept/x.ts", "q"), ("app/page.tsx", "other")]}
    assert ("r0", "r0/src/c.ts", "b") not in dead and ("/deep/r2", "/deep/r2/src/c.ts", "b") in dead


def test_suppressed(analysed):
    """A rule's fields that its section does not have are not looked at."""
    found = {(r.root, r.section, r.file) for r in analysed.findings.collect()}
    assert ("r1", "orphanFiles", "r1/src/components/Old.tsx") not in found and ("r1", "brokenImports", "r1/src/b.ts") not in found
    assert ("r1", "deletionCandidates", "r1/src/components/Old.tsx") in found and ("r1", "routeEntrypoints", "r1/app/page.tsx") in found
    assert {r.root: r.suppressedFindings for r in analysed.reports.collect()} == {"r0": 0, "r1": 3, "/deep/r2": 0}


def test_documents(analysed):
    made = {r.root: one.parse(r.report) for r in roots.documents(analysed).collect()}
    assert set(made) == {"r0", "r1", "/deep/r2"}
    assert made["r1"]["summary"]["suppressedFindings"] == 3
    assert [m["file"] for m in made["r0"]["graph"]["modules"]] == sorted((f"r0/{p}" for p in TREE), key=lambda f: f.split("/"))
    assert json.dumps(made["r0"]["findings"]["brokenImports"]) == json.dumps([{"file": "r0/src/b.ts", "source": "@/gone", "kind": "static"}, {"file": "r0/src/main.ts", "source": "./gone", "kind": "static"}])


def test_based_requests(spark):
    rows = spark.createDataFrame([("r", "r/src/a.ts", s) for s in ("lib/b", "fs", "react/x", "gone", "@s/p/q", "node:x")] + [("t", "t/a.ts", "react/x")], "root string, file string, source string")
    files = spark.createDataFrame([("r", "lib/b.ts")], "root string, path string")
    externals = spark.createDataFrame([("r", "react"), ("r", "@s/p"), ("r", "react")], "root string, name string")
    got = {(r.root, r.source): (r.res_kind, r.res_path) for r in roots.resolve_roots(rows, files, None, externals, based=True).collect()}
    assert got == {("r", "lib/b"): ("source", "r/lib/b.ts"), ("r", "fs"): ("external", None), ("r", "react/x"): ("external", None), ("r", "gone"): ("missing", None), ("r", "@s/p/q"): ("external", None), ("r", "node:x"): ("external", None), ("t", "react/x"): ("missing", None)}


def test_findings_read_back(analysed):
    again = reports.read_reports(roots.documents(analysed), "root", "report")
    assert again.rejects.count() == 0
    key = lambda df: {(r.root, r.key) for r in df.withColumn("key", F.concat("section", F.lit(" "), reports.finding_key())).collect()}
    assert key(again.findings) == key(analysed.findings)


def test_closed_and_dotted(spark):
    """By default `..` leads out of a root and a dot begins an extension; a closed root ends it, and dotted names get extensions."""
    asked = [("/r", "/r/a.ts", "../s/b"), ("/r", "/r/a.ts", "../../x"), ("/r", "/r/lib/a.ts", "./jest.config"), ("/r", "/r/lib/a.ts", "../lib/jest.config.ts"), ("/r", "/r/lib/a.ts", "../../../lib"), ("q", "q/lib/a.ts", "../../y")]
    rows = spark.createDataFrame(asked, "root string, file string, source string")
    files = spark.createDataFrame([("/r", "x.ts"), ("/r", "lib/jest.config.ts"), ("/r", "lib/index.ts"), ("/s", "b.ts"), ("q", "y.ts")], "root string, path string")
    found = lambda **how: [{r.source: r.res_path for r in roots.resolve_roots(rows, files, **how).collect()}.get(s) for _, _, s in asked]
    assert found() == ["/s/b.ts", None, None, "/r/lib/jest.config.ts", None, None]
    assert found(closed=True) == [None, "/r/x.ts", None, "/r/lib/jest.config.ts", "/r/lib/index.ts", "q/y.ts"]
    assert found(dotted=True) == ["/s/b.ts", None, "/r/lib/jest.config.ts", "/r/lib/jest.config.ts", None, None]


def test_many_modules(spark, tmp_path):
    """Modules that ask for configurations, and for more folders up than there are: 15,000 customers' keys of three roots."""
    spark.range(15_000).where("id % 40 in (0, 1, 13)").select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    want = duckdb.connect()
    want.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = [repr(tuple(r)) for r in roots.roots_findings(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(map(repr, want.execute(ORACLE_SQL["roots_findings"]).fetchall()))
