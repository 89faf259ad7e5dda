"""A small application end to end, and configuration cases."""

import json

import pytest
from pyspark.sql import functions as F

from refgraph.plans import clean, compare, project
from refgraph.sources import commands, jsonc, listing, report
from refgraph.sources.config import ConfigError, clean_threshold, load_config
from refgraph.streaming.rescan import Rescan

DEMO = {
    "pages/home.tsx": "import { sum } from '../src/lib/math';\nimport { LiveCard } from '../src/components/LiveCard';\nexport default function Home() { return <LiveCard n={sum(1, 2)} />; }\n",
    "src/components/LiveCard.tsx": "export function LiveCard(props) { return <p>{props.n}</p>; }\n",
    "src/components/DeadWidget.tsx": "export function DeadWidget() { return null; }\n",
    "src/lib/math.ts": "export const sum = (a: number, b: number) => a + b;\nexport const multiply = (a: number, b: number) => a * b;\n",
    "src/lib/broken.ts": "import { help } from './missing-helper';\nexport const brokenFeature = () => help();\n",
}


def tree(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def scanned(spark, root):
    out = project.report(project.scan(spark, root))
    short = lambda f: f[len(root) + 1 :]
    return out, {k: [(short(i["file"]), *(v for n, v in i.items() if n != "file")) for i in v] for k, v in out["findings"].items()}


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    root = tree(tmp_path_factory.mktemp("demo"), DEMO)
    return root, *scanned(spark, root)


def test_demo_findings(demo):
    _, out, found = demo
    assert found["brokenImports"] == [("src/lib/broken.ts", "./missing-helper", "static")]
    assert [(f, k, c) for f, k, _, c in found["orphanFiles"]] == [("src/components/DeadWidget.tsx", "orphan-component", 0.92), ("src/lib/broken.ts", "orphan-module", 0.88)]
    assert found["deadExports"] == [("src/components/DeadWidget.tsx", "DeadWidget"), ("src/lib/broken.ts", "brokenFeature"), ("src/lib/math.ts", "multiply")]
    assert found["routeEntrypoints"] == [("pages/home.tsx", "next-pages-route")]
    assert [c[-1] for c in found["deletionCandidates"]] == [True, True]
    assert out["summary"] == {"filesScanned": 5, "entrypoints": 1, "brokenImports": 1, "orphanFiles": 2, "deadExports": 3, "unusedImports": 0, "routeEntrypoints": 1, "deletionCandidates": 2}
    assert [tuple(m.values())[1:] for m in out["graph"]["modules"]] == [
        ("pages/home.tsx", "next-pages-route", 0, 2, 1), ("src/components/DeadWidget.tsx", None, 0, 0, 1), ("src/components/LiveCard.tsx", None, 1, 0, 1),
        ("src/lib/broken.ts", None, 0, 0, 1), ("src/lib/math.ts", None, 1, 0, 2),
    ]


def test_report_round_trip_and_text(demo, tmp_path):
    root, out, _ = demo
    path = str(tmp_path / "r.json")
    report.write(out, path)
    assert report.read(path) == out
    text = report.summary_text(out, path, "Scan complete.")
    assert "Impact: 6 actionable findings: 1 broken import, 2 cleanup candidates, 3 dead exports." in text
    assert "- src/components/DeadWidget.tsx (confidence 0.92, Component-like module has no inbound references.)" in text
    assert "- src/lib/math.ts -> `multiply`" in report.markdown(out, path) and "## Unused imports\n\n- none" in report.markdown(out, path)


@pytest.mark.parametrize("spoil", [lambda r: r["findings"].pop("deadExports"), lambda r: r["summary"].pop("entrypoints"), lambda r: r["project"].pop("root"), lambda r: r["findings"]["orphanFiles"][0].update(kind="odd"), lambda r: r.update(generatedAt=3)])
def test_strict_reports(demo, spoil):
    bad = json.loads(json.dumps(demo[1]))
    spoil(bad)
    with pytest.raises(report.ReportError):
        report.parse(json.dumps(bad))


def test_old_reports_are_read_leniently():
    old = report.parse('{"version": 1, "root": "/r", "findings": {"deadExports": [{"file": "/r/a.ts", "exportName": "x"}]}, "modules": []}')
    assert old["schemaVersion"] == 2 and old["project"]["root"] == "/r" and old["summary"]["deadExports"] == 1
    with pytest.raises(report.ReportError):
        report.parse("{}")


def test_diff(spark, demo):
    _, out, _ = demo
    later = json.loads(json.dumps(out).replace(out["project"]["root"], "/elsewhere"))
    later["findings"]["deadExports"] = later["findings"]["deadExports"][1:] * 2
    diff = compare.diff_reports(spark, out, later)
    assert diff["summary"]["deadExports"] == {"introduced": 2, "resolved": 1, "persisted": 2}
    assert diff["summary"]["totals"] == {"introduced": 2, "resolved": 1, "persisted": 8}
    assert diff["findings"]["deadExports"]["persisted"][0]["file"].startswith("/elsewhere")
    assert "Dead exports: introduced 2, resolved 1, persisted 2" in compare.summary_text(diff) and "### Introduced" in compare.markdown(diff)
    counts = {r["section"]: tuple(r)[1:] for r in compare.summary(compare.changes(compare.findings(spark, out), compare.findings(spark, later))).collect()}
    assert counts["totals"] == (2, 1, 8)


def test_clean(tmp_path):
    root = tree(tmp_path / "p", {"src/a/dead.ts": "one\ntwo\n", "src/keep.ts": "x"})
    (tmp_path / "out.ts").write_text("outside")
    (tmp_path / "p/link").symlink_to(tmp_path)
    made = lambda f, c: {"file": f, "reason": "r", "confidence": c, "safe": True}
    found = {"project": {"root": root}, "findings": {"deletionCandidates": [made(f"{root}/src/a/dead.ts", 0.92), made(f"{root}/src/keep.ts", 0.5), made(f"{root}/../out.ts", 0.95), made(f"{root}/link/out.ts", 0.99)]}}
    assert len(clean.plan(found, 0.92).targets) == 3  # 0.92 reaches 0.92 in 32 bits
    p = clean.preview(found, 0.9)
    assert [(i["relativePath"], i["excerpt"]) for i in p["targets"]] == [("src/a/dead.ts", "one\ntwo")] and len(p["outside"]) == 2
    assert "Threshold-skipped targets: 1" in clean.plan_text(clean.plan(found, 0.9))
    deleted, left = clean.apply(found, 0.9)
    assert deleted == [f"{root}/src/a/dead.ts"] and len(left) == 2 and (tmp_path / "out.ts").exists()
    assert not (tmp_path / "p/src/a").exists() and (tmp_path / "p/src/keep.ts").exists()


def test_excerpts(tmp_path):
    (tmp_path / "b").write_bytes(b"a\0b")
    (tmp_path / "l").write_text("x\n" * 50)
    (tmp_path / "w").write_text("é" * 20_000)
    assert clean.excerpt(str(tmp_path / "b")) == (True, clean.BINARY)
    assert clean.excerpt(str(tmp_path / "l"))[1].count("x") == 20
    assert clean.excerpt(str(tmp_path / "w"))[1] == "é" * 8192
    assert clean.excerpt(str(tmp_path / "none")) == (False, clean.MISSING)


def test_resolution_and_suppressions(spark, tmp_path):
    root = tree(tmp_path, {
        "tsconfig.json": '{ "compilerOptions": { "baseUrl": "src", "paths": { "@/*": ["*"], "@cfg": ["config.ts"], }, } /* trailing commas */ }',
        "package.json": '{"main": "./lib/entry", "dependencies": {"react": "1"}, "scripts": {"go": "node tools/run.mjs && npm run sub", "sub": "tsx ./tools/sub.ts"}}',
        "refgraph.config.json": '{"keepPatterns": ["src/kept.ts"], "suppressions": [{"kind": "deadExport", "file": "src/lib/a.ts", "reason": "public"}, {"kind": "bad", "file": "x"}]}',
        "src/main.ts": "import 'react'; import 'undeclared'; import {a} from 'lib/a'; import '@/lib/b'; import '@cfg'; import './lib'; import './pic.svg'; import 'node:fs'; import 'fs/promises'; import '/src/abs'; import './x.js'; a();",
        "src/lib/a.ts": "export const a = 1, spare = 2;", "src/lib/b.ts": "export default 1;", "src/lib/index.ts": "export * from './a'; export * from './c'", "src/lib/c.ts": "export const c = 1",
        "src/config.ts": "export const x = 1;", "src/pic.svg": "<svg/>", "src/abs.ts": "", "src/kept.ts": "export const k = 1", "src/x.ts": "", "lib/entry.ts": "export const api = 1", "tools/run.mjs": "", "tools/sub.ts": "",
        "node_modules/react/index.js": "module.exports = {}", "dist/x.ts": "",
    })
    out, found = scanned(spark, root)
    assert sorted(s for _, s, _ in found["brokenImports"]) == ["./x.js", "undeclared"]
    assert [f for f, *_ in found["orphanFiles"]] == ["src/x.ts"]
    assert found["deadExports"] == [("src/config.ts", "x"), ("src/kept.ts", "k"), ("src/lib/b.ts", "default")]
    kinds = {m["relativePath"]: m["entrypointKind"] for m in out["graph"]["modules"]}
    assert kinds["lib/entry.ts"] == kinds["tools/run.mjs"] == kinds["tools/sub.ts"] == "package-entry" and kinds["src/main.ts"] == "app-entry"
    assert "dist/x.ts" not in kinds and out["summary"].get("suppressedFindings") is None


def test_imports_that_leave_the_root_or_pass_links(spark, tmp_path):
    tree(tmp_path, {"shared/x.ts": "export const x = 1", "shared/pic.svg": "<svg/>", "store/pkg/index.ts": "export const p = 1"})
    root = tree(tmp_path / "app", {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@shared/*": ["../shared/*"]}}}',
        "main.ts": "import '../shared/x'; import '@shared/x'; import '../shared/pic.svg'; import './linked/pkg'; import '../shared/none'; import './own.css'", "own.css": "",
    })
    (tmp_path / "app" / "linked").symlink_to(tmp_path / "store")
    out, found = scanned(spark, root)
    assert [s for _, s, _ in found["brokenImports"]] == ["../shared/none"]
    assert [m["relativePath"] for m in out["graph"]["modules"]] == ["main.ts"]
    rescan = Rescan(spark, str(tmp_path / "out"))
    config = load_config(root)
    rescan.add(listing.read_sources(spark, listing.source_files(config)), 0)
    assert [r.source for r in rescan.scan(config).findings["brokenImports"].collect()] == ["../shared/none"]


def test_suppressed_findings_are_counted(spark, tmp_path):
    root = tree(tmp_path, {"a.ts": "import './none'; import {q} from './b'", "b.ts": "export const z = 1", ".refgraph/suppressions.json": '{"suppressions": [{"kind": "brokenImport", "file": "a.ts", "reason": "later"}, {"kind": "orphanFile", "file": "a.ts", "reason": "ok"}]}'})
    out, found = scanned(spark, root)
    assert not found["brokenImports"] and not found["orphanFiles"] and len(found["deletionCandidates"]) == 1
    assert out["summary"]["suppressedFindings"] == 2 and found["unusedImports"] == [("a.ts", "./b", "q", "q")] and found["deadExports"] == [("b.ts", "z")]


def test_empty_project(spark, tmp_path):
    out, _ = scanned(spark, str(tmp_path))
    assert out["summary"]["filesScanned"] == 0 and report.impact(out["summary"])[0].startswith("No actionable")


def test_jsonc():
    assert jsonc.loads('{"a": "// no", /* c */ "b": [1, 2,], // d\n}') == {"a": "// no", "b": [1, 2]}
    for bad in ("{'a': 1}", "{,}", "{/*", "[1 2]"):
        with pytest.raises(ValueError):
            jsonc.loads(bad)


def test_config_errors(tmp_path):
    root = tree(tmp_path, {"refgraph.config.json": '{"roots": [1]}'})
    with pytest.raises(ConfigError):
        load_config(root)
    (tmp_path / "refgraph.config.json").write_text('{"thresholds": {"cleanMinConfidence": 2}}')
    with pytest.raises(ConfigError):
        clean_threshold(root)
    (tmp_path / "refgraph.config.json").write_text('{"thresholds": {"cleanMinConfidence": 0.88}}')
    assert abs(clean_threshold(root) - 0.88) < 1e-6


def test_listing(tmp_path):
    root = tree(tmp_path, {"a.ts": "", "b.d.ts": "", "c.css": "", "dist/d.ts": "", "build/keep/e.ts": "", "gen/f.ts": "", "gen/g.ts": "", "_app.tsx": "", ".gitignore": "# c\ngen/*\n!gen/g.ts\n", "refgraph.config.json": '{"ignorePatterns": ["!build/keep/**"]}'})
    (tmp_path / "link.ts").symlink_to(tmp_path / "a.ts")
    short = [p[len(root) + 1 :] for p in listing.source_files(load_config(root))]
    assert short == ["_app.tsx", "a.ts", "b.d.ts", "build/keep/e.ts", "gen/g.ts"]
    (tmp_path / "refgraph.config.json").write_text('{"roots": ["dist"]}')
    assert [p[len(root) + 1 :] for p in listing.source_files(load_config(root))] == ["dist/d.ts"]


def test_commands():
    assert commands.shell_words("a 'b c' \"d\"&&e\\ f # g") == ["a", "b c", "d", "e f", "g"]
    found = []
    commands.command_scripts("node -r ./pre.js --env-file=.env src/x.ts && yarn go; bash -c 'no.sh'", {"go": "tsx y.ts", "loop": "npm run loop"}, lambda p, inside: found.append((p, inside)))
    assert list(dict.fromkeys(found)) == [("./pre.js", False), ("src/x.ts", False), ("y.ts", True)]  # some are met twice
    commands.command_scripts("npm run loop", {"loop": "npm run loop"}, lambda *a: None)
    steps = commands.run_steps("steps:\n  - name: x\n    working-directory: tools\n    run: node a.mjs\n  - run: |\n      node b.mjs\n      node c.mjs\n")
    assert steps == [("node a.mjs", "tools"), ("node b.mjs\nnode c.mjs\n", "tools")]  # a step that starts with `- run:` sees the one above
    assert commands.with_action_path("${{ github.action_path }}/x.sh $ACTION_PATH", "/r") == "/r/x.sh /r"


def test_modules_of_small_files_are_spread(spark):
    """Tables of few bytes are parsed by as many tasks as shuffles have, not by one for each file."""
    from refgraph.plans import generated

    assert generated._parsed(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    assert generated._spread(spark, "/root/testdata/sf0.001", "customer", "c_custkey").rdd.getNumPartitions() == 4


@pytest.mark.parametrize("dotted", [False, True])
def test_found_paths_are_the_first_tried(spark, dotted):
    """Files offered to bases give what a look at each tried path in order gives, for a base that many ask for and null ones too."""
    disk = [
        "/p/a", "/p/a.ts", "/p/a.js", "/p/a/index.tsx", "/p/b/index.ts", "/p/b/index.cts", "/p/c.tsx", "/p/c/index.js", "/p/d.e.ts", "/p/d.e/index.ts", "/p/.f.ts", "/p/g.mjs", "/p/g.mjs.ts", "/p/index.ts", "/p/index", "/p/h.css", "/p/h.", "/p/ts", "/p/.ts", "/index.js",
        "index.ts", "ts", ".ts", "/p/i/index/index.ts", "/p/jindex.ts", "/p/k.d.ts", "/p/l.TS", "/p/m\n.ts", None, "/p/a.ts",
    ]
    bases = ["/p/a", "/p/a.ts", "/p/b", "/p/c", "/p/c.tsx", "/p/d.e", "/p/d", "/p/.f", "/p/g", "/p/g.mjs", "/p", "/p/index", "/p/h", "/p/h.css", "/p/h.", "/p/ts", "/p/", "/", "", ".", "ts", "/p/i", "/p/i/index", "/p/j", "/p/jindex", "/p/k", "/p/k.d", "/p/l", "/p/m\n", "/p/none", None]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(bases)], "k long, base string").union(spark.range(100, 2600).select("id", F.when(F.col("id") % 25 > 0, "/p/b")))
    known = {p for p in disk if p is not None}
    got = project.found_paths(rows, "base", spark.createDataFrame([(p,) for p in disk], "path string"), "path", "out", dotted)
    assert got.columns == ["k", "base", "out"]
    tried = {r.k: next((p for p in r.tried if p in known), None) for r in rows.select("k", project.tried_paths(F.col("base"), dotted).alias("tried")).collect()}
    found = got.collect()
    assert len(found) == len(tried) and {r.k: r.out for r in found} == tried
    assert sum(v is not None for v in tried.values()) > 2400


def test_requests_are_shuffled_without_their_paths(spark):
    """Lists of tried paths, 17 for a request, are no keys of joins or groups, nothing is made for each of them, and the disk is not
    broadcast."""
    from refgraph.plans import generated

    plan = generated.import_resolution(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "__tried" not in plan and "posexplode" not in plan and "Cartesian" not in plan
    assert any("SortMergeJoin" in line and "__salt" in line for line in plan.splitlines())
