import os.path
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refgraph.functions.globs import Rule, glob_regex, is_ignored, rules
from refgraph.functions.paths import normalize, normalize_path, package_name, path_order, route_stem
from refgraph.sources.listing import wanted


def test_normalize_path_column(spark):
    paths = ["a/./b/../c", "../../x", "/../x", "/a/b/../../..", "", ".", "a/..", "a//b/", "../a/../b"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(normalize_path(F.col("p"))).collect()]
    assert got == [normalize(p) for p in paths]
    assert got[:4] == ["a/c", "../../x", "/x", "/"]
    assert normalize("/../x", keep_up=True) == "/../x"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "..", ".", ""]), max_size=8), st.booleans())
def test_normalize_laws(parts, rooted):
    path = ("/" if rooted else "") + "/".join(parts)
    once = normalize(path)
    assert normalize(once) == once
    if path and not path.startswith("//"):
        assert once == os.path.normpath(path).replace("//", "/")


def test_names(spark):
    rows = spark.createDataFrame([("@s/p/x", "page.tsx"), ("lodash/fp", "page.test.tsx"), ("@s", ".env")], "r string, f string")
    got = rows.select(package_name(F.col("r")), route_stem(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("@s/p", "page"), ("lodash", ""), ("@s", "")]


def test_path_order(spark):
    rows = spark.createDataFrame([("a-b",), ("a/b",), ("a",)], "p string")
    assert [r.p for r in rows.orderBy(path_order(F.col("p"))).collect()] == ["a", "a/b", "a-b"]


def test_globs():
    hit = lambda g, p: bool(re.fullmatch(glob_regex(g), p, re.S))
    assert hit("src/**/x.ts", "src/x.ts") and hit("src/**/x.ts", "src/a/b/x.ts") and not hit("src/*/x.ts", "src/a/b/x.ts")
    assert hit("a?c", "abc") and not hit("a?c", "a/c") and hit("**", "a/b") and not hit("[ab]", "a")


def test_ordered_rules():
    ordered = rules(["*.gen.ts", "!keep.gen.ts", "/build", "logs/", "!logs/"])
    assert is_ignored("a/x.gen.ts", ordered) and not is_ignored("a/keep.gen.ts", ordered)
    assert is_ignored("build/a/b.ts", ordered) and not is_ignored("src/build/a.ts", ordered)
    assert is_ignored("a/logs/b.ts", ordered)  # a negated folder rule reopens no file
    assert not is_ignored("logs", ordered)


def test_rules_by_name_look_inside_the_root():
    ordered = [Rule.parse("dist/", by_name=True)]
    assert not wanted("dist/a.ts", "dist/a.ts", ordered) and wanted("dist/a.ts", "a.ts", ordered)
