"""Rules as tables, against one rule at a time."""

import random
import re

import pytest

from refgraph.functions.globs import glob_regex, is_ignored
from refgraph.functions.globs import rules as parsed
from refgraph.operators import rules as ops
from refgraph.plans import rules as queries

SEGMENTS = ["a", "b", "ab", "x.ts", "c.ts", "gen", "src"]
PATTERNS = ["a", "*.ts", "a/", "/src", "src/*", "src/**", "**/b", "**/gen/*.ts", "src/**/x.ts", "s?c/a", "/gen/a/", "src/gen/", "*b", "src/ge*/x.ts", "a/**/b/**", "./b", "*/gen", "?"]


def lists(seed, n=12):
    r = random.Random(seed)
    return {k: [("!" * (r.random() < 0.4)) + r.choice(PATTERNS) for _ in range(r.randrange(1, 6))] for k in range(n)}


def paths(seed, n=40):
    r = random.Random(seed)
    return sorted({"/".join(r.choice(SEGMENTS) for _ in range(r.randrange(1, 5))) for _ in range(n)})


def tables(spark, found, names=()):
    rows = [(k, n - 10, f"{name}", True) for k in found for n, name in enumerate(names)] + [(k, n, line, False) for k, lines in found.items() for n, line in enumerate(lines)]
    return ops.compiled_rules(spark.createDataFrame(rows, "root int, ord int, line string, name boolean"), by_name="name")


def test_ignored_paths(spark):
    found, asked = lists(1), paths(2)
    rows = spark.createDataFrame([(k, p) for k in found for p in asked] + [(0, None), (99, "a")], "root int, path string")
    got = {(r.root, r.path): r.ignored for r in ops.ignored_paths(rows, tables(spark, found)).collect()}
    assert got.pop((0, None)) is False and got.pop((99, "a")) is False
    assert got == {(k, p): is_ignored(p, parsed(lines)) for k, lines in found.items() for p in asked}
    assert set(got.values()) == {True, False}


def test_repeated_lines(spark):
    """Of equal lines the last is a rule, so repeating a list does not make more of them; strings are spread however few bytes they have."""
    lines = ["a", "!a", "b/", "*.ts"]
    rows = spark.range(4000).selectExpr("cast(id % 2 as int) as root", "id as ord", f"array({', '.join(map(repr, lines))})[cast(id / 2 as int) % 4] as line")
    compiled = ops.compiled_rules(rows)
    assert sorted((r.owner, r.ord) for r in compiled.collect()) == sorted((k % 2, 3992 + k) for k in range(8))
    asked = spark.createDataFrame([(k, p) for k in (0, 1) for p in ("a", "b", "b/x", "x.ts", "a/b.ts")], "root int, path string")
    assert {(r.root, r.path): r.ignored for r in ops.ignored_paths(asked, compiled).collect()} == {(k, p): i for k in (0, 1) for p, i in (("a", False), ("b", False), ("b/x", True), ("x.ts", True), ("a/b.ts", True))}
    assert "REPARTITION_BY_NUM" in plan(ops.ignored_paths(asked, compiled))


class Walk:
    """One list, one path at a time, with recursion over segments."""

    def __init__(self, names, lines):
        self.rules = [(r, True) for r in parsed([f"{n}/" for n in names])] + [(r, False) for r in parsed(lines)]

    @staticmethod
    def on(r, path):
        if r.deep:
            return re.fullmatch(glob_regex(r.pattern), path) is not None
        return any(re.fullmatch(glob_regex(r.pattern, crossing=False), s) for s in path.split("/"))

    def match(self, r, path, is_dir):
        above = ["/".join(path.split("/")[:k]) for k in range(1, path.count("/") + 1)]
        if r.folder_only and not is_dir:
            return not r.negated and any(self.on(r, a) for a in above)
        return self.on(r, path) or (not is_dir and not r.negated and any(self.on(r, a) for a in above))

    def ignored(self, path, is_dir=False):
        return next((not r.negated for r, _ in reversed(self.rules) if self.match(r, path, is_dir)), False)

    def synth(self, pattern, need):
        if not pattern:
            return None if need else []
        if pattern[0] == "**":
            found = self.synth(pattern[1:], need)
            return found if found is not None else ["sample", *self.synth(pattern[1:], False)]
        return [pattern[0].replace("*", "sample").replace("?", "x"), *self.synth(pattern[1:], False)]

    def below(self, pattern, folder, need):
        if not folder:
            return self.synth(pattern, need)
        if not pattern:
            return None
        if pattern[0] == "**":
            found = self.below(pattern[1:], folder, need)
            return found if found is not None else self.below(pattern, folder[1:], need)
        return self.below(pattern[1:], folder[1:], need) if re.fullmatch(glob_regex(pattern[0], crossing=False), folder[0]) else None

    def entered(self, folder):
        if not self.ignored(folder, True) and not self.ignored(f"{folder}/__other__"):
            return True
        named = any(by and self.match(r, folder, True) for r, by in self.rules)
        for r, _ in self.rules:
            literal = re.match("[^*?]*", r.pattern)[0].strip("/")
            explicit = "/" in r.pattern and literal != ""
            near = self.match(r, folder, True) or not explicit or literal == folder or literal.startswith(folder + "/") or folder.startswith(literal + "/")
            if not r.negated or not near or (named and not explicit):
                continue
            if r.folder_only and self.match(r, folder, True):
                sample = folder
            elif r.deep:
                rest = self.below(r.pattern.split("/"), folder.split("/"), not r.folder_only)
                sample = None if rest is None else "/".join([folder, *rest])
            else:
                sample = f"{folder}/" + r.pattern.replace("*", "sample").replace("?", "x")
            if sample and self.match(r, sample, r.folder_only) and not self.ignored(sample, r.folder_only):
                return True
        return False

    def finds(self, path):
        return not self.ignored(path) and all(self.entered("/".join(path.split("/")[:k])) for k in range(1, path.count("/") + 1))


@pytest.mark.parametrize("seed", [3, 4])
def test_walked_files(spark, seed):
    found, asked, names = lists(seed, 30), paths(seed + 10, 60), ["gen", "ab"]
    rows = spark.createDataFrame([(k, p) for k in found for p in asked] + [(0, None)], "root int, path string")
    got = {(r.root, r.path) for r in ops.walked_files(rows, tables(spark, found, names)).collect()}
    walks = {k: Walk(names, lines) for k, lines in found.items()}
    assert got == {(k, p) for k, w in walks.items() for p in asked if w.finds(p)}


def test_walk_and_file_rules(spark):
    """A walk finds what the file rules leave where nothing is negated; a broad negation does not open a folder ignored by name, one
    with a literal path does."""
    asked = ["gen/x.ts", "gen/a/x.ts", "src/x.ts", "src/gen/x.ts"]
    rows = spark.createDataFrame([(k, p) for k in range(3) for p in asked], "root int, path string")
    rules = tables(spark, {0: ["src/g*"], 1: ["!**/*.ts"], 2: ["!src/gen/x.ts"]}, ["gen"])
    walked, plain = {}, {}
    for r in ops.walked_files(rows, rules).collect():
        walked.setdefault(r.root, set()).add(r.path)
    for r in ops.ignored_paths(rows, rules).where("not ignored").collect():
        plain.setdefault(r.root, set()).add(r.path)
    assert walked[0] == plain[0] == {"src/x.ts"}
    assert plain[1] == set(asked) and walked[1] == {"src/x.ts"}
    assert walked[2] == plain[2] == {"src/x.ts", "src/gen/x.ts"}


def test_aliases(spark):
    aliases = [(1, 0, "@/*", "src"), (1, 1, "@/*", "never"), (1, 2, "@/a*b", "lib/*/x*"), (1, 3, "@/a", "one"), (1, 4, "*", "any"), (2, 0, "@/a", "two"), (2, 1, None, "x"), (None, 0, "*", "x"), (1, 5, "é*", "ü/*")]
    asked = [(1, "@/a"), (1, "@/acb"), (1, "@/ab"), (1, "@/"), (1, "zz"), (1, "zz"), (2, "@/a"), (2, "@/b"), (3, "a"), (None, "a"), (1, None), (1, "éa")]
    got = ops.alias_lookup(spark.createDataFrame(asked, "root int, request string"), spark.createDataFrame(aliases, "root int, ord int, alias string, target string"))
    want = [(1, "@/a", "@/*", "src/a"), (1, "@/acb", "@/a*b", "lib/c/x*"), (1, "@/ab", "@/a*b", "lib//x*"), (1, "@/", "@/*", "src"), (1, "zz", "*", "any/zz"), (1, "zz", "*", "any/zz"), (2, "@/a", "@/a", "two"), (2, "@/b", None, None), (3, "a", None, None), (None, "a", None, None), (1, None, None, None), (1, "éa", "é*", "ü/a")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_repeated_aliases(spark):
    """Of equal aliases the first is looked at, whatever its target."""
    rows = spark.range(4000).selectExpr("cast(id % 2 as int) as root", "id as ord", "concat('a', id % 8, '*') as alias", "if(id < 8, null, 'x') as target")
    assert sorted(map(tuple, ops.first_aliases(rows).collect())) == [(k % 2, f"a{k}*", k, None) for k in sorted(range(8), key=lambda k: (k % 2, k))]


def test_suppressions(spark):
    r = random.Random(7)
    fields = ["source", "local"]
    rows = [(r.randrange(4) if r.random() < 0.5 else 9, r.choice("abc"), r.choice(["x", "y", None]), "z") for _ in range(3000)]
    rules = [(r.randrange(12), r.choice(["a", "b", None, None]), r.choice(["x", None])) for _ in range(6)] + [(9, "c", "y")]
    got = ops.suppressed_by_table(spark.createDataFrame(rows, "file int, source string, local string, more string"), spark.createDataFrame(rules, "file int, source string, local string"), ["file"], fields)
    want = [x for x in rows if not any(x[0] == f and (s is None or s == x[1]) and (m is None or m == x[2]) for f, s, m in rules)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("many", "hot"), [(1000, 1000), (1, 1000), (1, 20), (1000, 20)])
def test_suppressions_of_keys(spark, monkeypatch, many, hot):
    """Keys with few and with many rules, hot ones and others, null fields on both sides: all are covered alike."""
    monkeypatch.setattr(ops, "MANY", many)
    monkeypatch.setattr(ops, "HOT_SHARE", hot)
    r = random.Random(8)
    rows = [(r.choice([0, 0, 0, *range(30), None]), r.choice(["a", "b", None]), r.choice(["x", "y", None])) for _ in range(600)]
    rules = [(r.choice([*range(40), None]), r.choice(["a", "b", None]), r.choice(["x", None, None])) for _ in range(25)]
    left, right = (spark.createDataFrame(x, "file int, source string, local string") for x in (rows, rules))
    got = ops.suppressed_by_table(left, right, ["file"], ["source", "local"])
    want = [x for x in rows if not any(x[0] is not None and x[0] == f and s in (None, x[1]) and m in (None, x[2]) for f, s, m in rules)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_suppressions_shuffle_once(spark):
    """Findings are shuffled once, whatever the number of sets of fields that rules name."""
    asked = spark.range(1000).selectExpr("id as file", "'a' as source", "'b' as local", "id as more")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ops.suppressed_by_table(asked, asked.selectExpr("file", "source", "if(file % 2 = 0, local, null) as local"), ["file"], ["source", "local"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "__salt" in x and "Left" not in x]
    assert len(left) <= 1 + 4  # of findings, and of the rules of each set


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """A million rules: no nested loop, no product, no Python, and rules are not broadcast."""
    k = "cast(id % 5000 as int)"
    aliases = spark.range(1_000_000).selectExpr(f"{k} as root", "id as ord", "concat('a', id, '*') as alias", "concat('b', id) as target")
    lines = spark.range(1_000_000).selectExpr(f"{k} as root", "id as ord", "concat('a', id, '/*') as line")
    rules = spark.range(1_000_000).selectExpr(f"{k} as file", "if(id % 2 = 0, concat('s', id), null) as source", "if(id % 3 = 0, 'x', null) as local")
    asked = spark.range(1_000_000).selectExpr(f"{k} as root", f"{k} as file", "concat('a', id, '/x') as request", "concat('s', id) as source", "'x' as local")
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        paths = asked.withColumnRenamed("request", "path").select("root", "path")
        compiled = ops.compiled_rules(lines)
        for df in (ops.alias_lookup(asked, aliases), ops.ignored_paths(paths, compiled), ops.walked_files(paths, compiled), ops.suppressed_by_table(asked, rules, ["file"], ["source", "local"])):
            text = plan(df)
            assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
        joins = re.findall(r"(\w+Join) (\[.*)", text)
        assert sum(j == "SortMergeJoin" and "LeftAnti" in keys for j, keys in joins) == 4
        assert all("LeftOuter" in keys for j, keys in joins if j == "BroadcastHashJoin")  # of hot keys, which are few
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_queries_find_both(spark):
    data = "/root/testdata/sf0.01"
    found = queries.alias_table(spark, data)
    assert 10 < found.where("alias is null").count() < found.count() - 50
    ignored = queries.ignore_table(spark, data)
    assert 20 < ignored.where("ignored").count() < ignored.count() - 20
    walked = queries.walked_pages(spark, data).count()
    assert 10 < walked < ignored.where("not ignored").count()
