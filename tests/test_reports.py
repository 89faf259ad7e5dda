"""Reports as tables, against the reader and the templates for one document."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from refgraph.operators import reports as ops
from refgraph.operators.reference import placed
from refgraph.plans import compare
from refgraph.plans import reports as queries
from refgraph.sources import report as one

DATA = "/root/testdata/sf0.001"


def document(root="/p", **changes):
    found = {
        "brokenImports": [{"file": f"{root}/a{k}.ts", "source": "./x", "kind": "static"} for k in range(7)], "orphanFiles": [{"file": f"{root}/o.ts", "kind": "orphan-module", "reason": "none", "confidence": 0.88}], "deadExports": [],
        "unusedImports": [{"file": "/other/u.ts", "source": "s", "local": "a", "imported": "b"}, {"file": f"{root}/u.ts", "source": "s", "local": "a", "imported": "a"}], "routeEntrypoints": [{"file": f"{root}/r.ts", "kind": "app-entry"}],
        "deletionCandidates": [{"file": f"{root}/o.ts", "reason": "none", "confidence": 1, "safe": False}],
    }
    modules = [{"file": f"{root}/m.ts", "relativePath": "m.ts", "entrypointKind": None, "importedByCount": 1, "importCount": 2, "exportCount": 3}]
    made = {"schemaVersion": 2, "generatedAt": None, "project": {"root": root, "configPath": "c"}, "summary": {"filesScanned": 1, "entrypoints": 2} | {k: len(v) for k, v in found.items()}, "findings": found, "graph": {"modules": modules}}
    for path, value in changes.items():
        at = made
        *above, last = path.split("__")
        for k in above:
            at = at[int(k) if k.isdigit() else k]
        last = int(last) if last.isdigit() else last
        if value is KeyError:
            del at[last]
        else:
            at[last] = value
    return made


BAD = [
    (None, "no JSON"), ("{", "no JSON"), ("", "no JSON"), ("[1]", "no version"), ('{"schemaVersion": "2"}', "no version"), ('{"schemaVersion": null, "version": 1}', "no version"), ('{"schemaVersion": -1}', "no version"), ('{"version": 1}', "no root"),
    ('{"version": 1, "project": {"root": 5}, "root": "x"}', "no root"), ('{"version": 1, "root": "x", "generatedAt": 3}', "generatedAt is no text"),
    (document(project=3), "project is missing or no object"), (document(project__root=KeyError), "no root"), (document(project__configPath=[]), "project.configPath is no text"), (document(summary=KeyError), "summary is missing or no object"),
    (document(summary__entrypoints=1.5), "summary.entrypoints is missing or no count"), (document(summary__suppressedFindings="1"), "summary.suppressedFindings is no count"), (document(findings=[]), "findings is missing or no object"),
    (document(findings__deadExports={}), "findings.deadExports is missing or no array"), (document(findings__brokenImports__3__kind="new"), "findings.brokenImports[3] is wrong"), (document(findings__brokenImports__0=5), "findings.brokenImports[0] is wrong"),
    (document(findings__orphanFiles__0__confidence="0.5"), "findings.orphanFiles[0] is wrong"), (document(findings__deletionCandidates__0__safe=KeyError), "findings.deletionCandidates[0] is wrong"), (document(graph=KeyError), "graph.modules is missing or no array"),
    (document(graph__modules__0__exportCount=-1), "graph.modules[0] is wrong"), (document(graph__modules__0__entrypointKind="odd"), "graph.modules[0] is wrong"),
]


def sent(spark, documents):
    rows = [(k, d if isinstance(d, str) or d is None else json.dumps(d), "x") for k, d in documents]
    return spark.createDataFrame(rows, "id string, text string, root string")


def test_rejects(spark):
    got = ops.read_reports(sent(spark, [(str(k), d) for k, (d, _) in enumerate(BAD)]))
    assert {int(r.id): r.problem for r in got.rejects.collect()} == {k: why for k, (_, why) in enumerate(BAD)}
    assert got.reports.count() == got.findings.count() == got.modules.count() == 0


def test_strict_and_later_versions(spark):
    got = ops.read_reports(sent(spark, [("a", document("/p")), ("b", document("/q", schemaVersion=7, summary__suppressedFindings=4, project__configPath=None))]))
    assert got.rejects.count() == 0
    assert {(r.id, r.version, r.root, r.configPath, r.filesScanned, r.entrypoints, r.brokenImports, r.suppressedFindings) for r in got.reports.collect()} == {("a", 2, "/p", "c", 1, 2, 7, 0), ("b", 7, "/q", None, 1, 2, 7, 4)}
    for key, root in (("a", "/p"), ("b", "/q")):
        want = document(root)["findings"]
        for section, items in want.items():
            rows = [r.asDict() for r in got.findings.where((F.col("id") == key) & (F.col("section") == section)).orderBy("ord").collect()]
            assert [r["ord"] for r in rows] == list(range(len(items)))
            assert [{f: np.float32(v) if f == "confidence" else v for f, v in i.items()} for i in items] == [{f: r[f] for f in i} for r, i in zip(rows, items, strict=True)]
    assert [(r.ord, r.relativePath, r.entrypointKind, r.exportCount) for r in got.modules.where("id = 'a'").collect()] == [(0, "m.ts", None, 3)]


def test_old_documents(spark):
    old = {"version": 1, "root": "/r", "findings": {
        "brokenImports": [{"file": "f", "source": "s", "kind": "odd"}, {"file": "f"}, 3], "orphanFiles": [{"file": "o"}, {"kind": "orphan-module"}], "deadExports": {}, "routeEntrypoints": [{"file": "r", "kind": "odd"}, {"file": "r", "kind": "app-entry"}],
        "deletionCandidates": [{"file": "d", "confidence": 1}]}, "modules": [{"file": "m"}, {}], "summary": {"filesScanned": "x", "entrypoints": 3}}
    got = ops.read_reports(sent(spark, [("a", old), ("b", {"schemaVersion": 0, "project": {"root": "/z"}})]))
    assert {(r.id, r.version, r.root, r.filesScanned, r.entrypoints) for r in got.reports.collect()} == {("a", 2, "/r", 0, 3), ("b", 2, "/z", 0, 0)}
    found = {(r.section, r.ord, r.file, r.kind, r.reason, r.confidence, r.safe) for r in got.findings.collect()}
    assert found == {("brokenImports", 0, "f", "unknown", None, None, None), ("orphanFiles", 0, "o", "orphan-module", "", 0.0, None), ("routeEntrypoints", 0, "r", "app-entry", None, None, None), ("deletionCandidates", 0, "d", None, "", 1.0, False)}
    assert [(r.file, r.relativePath, r.importCount) for r in got.modules.collect()] == [("m", "", 0)]


@pytest.fixture(scope="module")
def read(spark):
    many = [document("/p"), document("/q", findings__brokenImports=[], summary__brokenImports=0, summary__suppressedFindings=2, generatedAt="now"), document("/r", findings={s: [] for s in one.SECTIONS}, summary={c: 0 for c in one.COUNTS} | {"filesScanned": 1})]
    return {d["project"]["root"]: d for d in many}, ops.read_reports(sent(spark, [(d["project"]["root"], d) for d in many]))


def _bare(read):
    reports = read.reports.select("root", "generatedAt", "configPath", "filesScanned", "entrypoints", "suppressedFindings")
    return reports, read.findings


def test_texts_equal_the_templates(read):
    many, found = read
    for made, template in ((ops.summary_texts(*_bare(found), F.lit("it's here.json")), one.summary_text), (ops.markdown_texts(*_bare(found), F.lit("it's here.json")), one.markdown)):
        got = {r.root: r.text for r in made.collect()}
        assert got == {root: template(one.parse(json.dumps(d)), "it's here.json") for root, d in many.items()}


def test_documents_are_read_again(spark, read, tmp_path):
    many, found = read
    made = ops.documents(*_bare(found), found.modules)
    for r in made.collect():
        assert one.parse(r.report) == one.parse(json.dumps(many[r.root]))
        assert ("suppressedFindings" in r.report) == (r.root == "/q")
    ops.write_documents(made, str(tmp_path / "documents"), F.right("root", F.lit(1)))
    again = spark.read.text(str(tmp_path / "documents"))
    assert {(r.part, one.parse(r.value)["project"]["root"]) for r in again.collect()} == {("p", "/p"), ("q", "/q"), ("r", "/r")}
    ops.write_findings(found.findings, str(tmp_path / "findings"))
    assert spark.read.json(str(tmp_path / "findings")).count() == found.findings.count()


def test_keys_equal_those_of_one_report(read):
    many, found = read
    got = {(r.root, r.section, r.ord, r.key) for r in found.findings.withColumn("key", ops.finding_key()).collect()}
    assert got == {(root, s, k, compare._key(s, i, root)) for root, d in many.items() for s, items in d["findings"].items() for k, i in enumerate(items)}


def test_changes(spark):
    fields = {f: None for f in ops.FIELDS}
    row = lambda root, ord, name: {"root": root, "section": "deadExports", "ord": ord} | fields | {"file": f"{root}/f", "exportName": name}
    schema = f"root string, section string, ord int, {', '.join(f'{f} {t}' for f, t in ops.TYPES.items())}"
    before = spark.createDataFrame([row("/a", 0, "x"), row("/a", 1, "x"), row("/a", 2, "y"), row("/b", 0, "x")], schema)
    after = spark.createDataFrame([row("/a", 0, "x"), row("/a", 1, "z")], schema)
    got = {(r.root, r.key, r.change, r.occurrence, r.place) for r in ops.changes(before, after, ["root"]).collect()}
    assert got == {("/a", "f|x", "persisted", 1, 1), ("/a", "f|x", "resolved", 2, 1), ("/a", "f|y", "resolved", 1, 2), ("/a", "f|z", "introduced", 1, 1), ("/b", "f|x", "resolved", 1, 1)}


def test_places_of_large_sections(spark):
    """A section is numbered over several ranges, with repeats, nulls and small sections beside it, and no window holds one whole."""
    rows = spark.range(4000).select(F.when(F.col("id") % 50 > 0, "/big").when(F.col("id") % 100 > 0, "/small").alias("root"), F.pmod(F.xxhash64("id"), F.lit(1500)).alias("k"), "id")
    got = placed(rows, [F.col("k")], "n", ["root"])
    assert got.columns == ["root", "k", "id", "n"]
    made = got.collect()
    assert sorted((r.id for r in made)) == list(range(4000))
    for root in ("/big", "/small", None):
        mine = sorted((r.n, r.k) for r in made if r.root == root)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [k for _, k in mine] == sorted(k for _, k in mine)
    assert placed(rows.limit(0), [F.col("k")], "n", ["root"]).count() == 0
    plan = queries.report_differences(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert not any("key" not in line.split("windowspecdefinition")[-1] for line in windows) and not any("place" in line for line in windows)


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(queries.report_previews(spark, DATA))
    for q in (queries.report_previews, queries.report_documents, queries.report_summaries, queries.report_markdown, queries.report_differences):
        text = plan(q(spark, DATA))
        assert not any(x in text for x in ("Python", "NestedLoop", "Cartesian", "SinglePartition")), q.__name__


def test_no_reports(spark):
    empty = ops.read_reports(sent(spark, []))
    assert ops.summary_texts(*_bare(empty), F.lit("p")).count() == ops.documents(*_bare(empty), empty.modules).count() == ops.read_reports(sent(spark, [])).rejects.count() == 0
