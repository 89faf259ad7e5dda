from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refgraph.operators import classify
from refgraph.operators import reference as ops


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_unreferenced_with_null_keys(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, n string")
    edges = spark.createDataFrame([(1,), (None,)], "t int")
    assert rows(ops.unreferenced(nodes, edges, "k", "t")) == sorted([(2, "b"), (None, "c")], key=repr)
    assert rows(ops.unreferenced(nodes, edges, "k", "t", exempt=F.col("n") == "b")) == [(None, "c")]


def test_suppressed_wildcard(spark):
    found = spark.createDataFrame([("f", "x"), ("f", "y"), ("g", None)], "file string, source string")
    rules = spark.createDataFrame([("f", "x"), ("g", None)], "file string, source string")
    assert rows(ops.suppressed(found, rules, ["file"], ["source"])) == [("f", "y")]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_bag_diff_laws(spark, before, after):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in (before, after))
    diff = ops.bag_diff(a, b, ["k"])
    got = {c: Counter(r.k for r in ops.bag_rows(diff, c).collect()) for c in ("introduced", "resolved", "persisted")}
    was, now = Counter(before), Counter(after)
    assert got == {"introduced": now - was, "resolved": was - now, "persisted": was & now}


def test_first_match(spark):
    requests = spark.createDataFrame([(["a", "b"],), (["c"],), (["b", "a"],)], "tried array<string>")
    known = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in ops.first_match(requests, F.col("tried"), known, "path").orderBy("tried").collect()] == ["a", "b", None]


def test_alias_longest_first(spark):
    aliases = [("@/*", "/r/src/*"), ("@/lib/*", "/r/lib/*"), ("cfg", "/r/config.ts"), ("*", "/any/*")]
    names = ["@/a", "@/lib/b", "cfg", "lodash"]
    df = spark.createDataFrame([(n,) for n in names], "r string")
    assert [r[0] for r in df.select(ops.alias_match(F.col("r"), aliases)).collect()] == ["/r/src/a", "/r/lib/b", "/r/config.ts", "/any/lodash"]


ENTRIES = {
    "app/page.tsx": "next-app-route", "src/app/x/route.ts": "next-app-route", "packages/web/app/page.tsx": "next-app-route", "lib/app/page.tsx": None,
    "app/page.test.tsx": "tooling-entry", "pages/foo.test.tsx": "next-pages-route", "pages/_app.tsx": "next-pages-route", "main.ts": "app-entry",
    "pkg/src/index.ts": "app-entry", "lib/index.ts": None, "vite.config.ts": "tooling-entry", "vite.config.d.ts": None, "src/__tests__/a.ts": "tooling-entry",
    "src/A.SPEC.ts": "tooling-entry", "scripts/verify-x.ts": "tooling-entry", "scripts/build.ts": None, "middleware.ts": "framework-entry", "src/middleware.ts": None,
}


def test_entry_kinds(spark):
    df = spark.createDataFrame([(p,) for p in ENTRIES], "p string")
    got = dict(df.select("p", classify.entry_kind(F.col("p"), F.lit(False), F.lit(False))).collect())
    assert got == ENTRIES


def test_orphan_kinds(spark):
    want = {"src/components/x.ts": "orphan-component", "components/x.ts": "orphan-module", "src/Éa.ts": "orphan-component", "src/routes/a.ts": "orphan-route-module", "src/my-page.ts": "orphan-route-module", "src/pages.ts": "orphan-module"}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert dict(df.select("p", classify.orphan_kind(F.col("p"))).collect()) == want


def test_framework_exports(spark):
    df = spark.createDataFrame([("next-app-route", "app/route.ts", "GET", True), ("next-app-route", "app/page.tsx", "GET", False), ("next-pages-route", "pages/a.tsx", "config", True), (None, "a.ts", "default", False)], "k string, p string, e string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", classify.framework_consumes(F.col("k"), F.col("p"), F.col("e"))).collect())
