"""Scripts and excerpts as columns, against the readers for one package and one file."""

import random

import duckdb
from pyspark.sql import functions as F

from refgraph.operators import scripts as ops
from refgraph.plans import scripts as queries
from refgraph.plans.catalogue import ORACLE_SQL
from refgraph.sources.commands import run_steps, shell_words

COMMANDS = [
    "npm run build && yarn test", "echo a#b #c ## d", "a 'b c' \"d;e\" f\\ g", "node ./x.js|tee (y)", "", "   ", "#", "yarn run --flag x", "corepack pnpm run y -- z", "npm build", "/usr/bin/npm run-script a", "x\\\\y 'un", "bun run", "pnpm run --a --b",
]


def test_words(spark):
    df = spark.createDataFrame([(c,) for c in COMMANDS] + [(None,)], "c string").select("c", ops.command_words(F.col("c")).alias("w"))
    for r in df.collect():
        assert r.w == (None if r.c is None else shell_words(r.c)), r.c


def test_calls(spark):
    df = spark.createDataFrame([("p", str(k), c) for k, c in enumerate(COMMANDS)] + [("p", "none", None)], "package string, script string, command string")
    got = {(r.script, r.at, r.callee) for r in ops.script_calls(df).collect()}
    assert got == {("0", 0, "build"), ("0", 3, "test"), ("7", 0, "x"), ("8", 0, "y"), ("8", 1, "y"), ("10", 0, "a")}


def reach(scripts, calls, root, deepest):
    out, level = [], [(root, [root], False)]
    for depth in range(deepest + 1):
        out += [(root, s, depth, tuple(p), c) for s, p, c in level]
        level = [(t, [*p, t], t in p) for s, p, c in level if not c for t in sorted(calls.get(s, ())) if t in scripts]
    return out


def test_nested(spark):
    r = random.Random(2)
    rows, want = [], []
    for package in range(6):
        names = [f"s{k}" for k in range(5)]
        calls = {n: {r.choice([*names, "gone"]) for _ in range(r.randrange(3))} for n in names}
        rows += [(package, n, " && ".join(f"npm run {c}" for c in sorted(calls[n])) or "echo") for n in names]
        want += [(package, *x) for n in names for x in reach(set(names), calls, n, 4)]
    got = ops.nested_scripts(spark.createDataFrame([*rows, (9, None, "npm run s0")], "package int, script string, command string"))
    assert sorted((x.package, x.root, x.script, x.depth, tuple(x.path), x.cycle) for x in got.collect()) == sorted(want)
    assert any(w[5] for w in want) and max(w[3] for w in want) == 4


def plain(data, lines=20, most=16_384):
    """Line by line, as one reads a file."""
    head = data[:most]
    taken = b"".join(x + b"\n" for x in head.split(b"\n")[:lines]) if head.count(b"\n") >= lines else head
    if b"\0" in taken:
        return ops.BINARY
    try:
        text = taken.decode()
    except UnicodeDecodeError as e:
        if e.reason != "unexpected end of data":
            return ops.BINARY
        text = taken[: e.start].decode()
    text = text.replace("\r\n", "\n")
    return text[:-1] if text.endswith("\n") else text


def test_excerpts(spark):
    r = random.Random(4)
    cases = [b"", b"a", b"a\n", b"\n", b"\n\n", b"a\r\nb\r\n", b"a\r", b"x\n" * 19, b"x\n" * 20, b"x\r\n" * 20, b"x\n" * 21, b"x\n" * 20 + b"\0", b"x\0", b"\xff", b"ok\n" * 20 + b"\xff", "é".encode() * 9000, b"a" + "é".encode() * 9000, "😀".encode() * 5000]
    cases += [b"a" * k + "😀".encode() * 5000 for k in (1, 2, 3)] + ["日".encode()[:2], b"ab\xe6\x97", b"\xf0\x9f\x98", b"a" * 16_383 + b"\n\xff", b"a" * 16_384 + b"\xff", b"a" * 16_383 + b"\xff\xff", b"\xed\xa0\x80", b"\xc0\x80"]
    cases += [bytes(r.choice([97, 10, 13, 195, 169, 226]) for _ in range(r.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)] + [(-1, None)], "k int, data binary").select("k", ops.bounded_excerpt(F.col("data")).alias("x"))
    got = {x.k: x.x for x in df.collect()}
    assert got.pop(-1) is None
    for k, c in enumerate(cases):
        assert got[k] == plain(c), c[:80]
    assert spark.createDataFrame([("é\nb",)], "t string").select(ops.bounded_excerpt(F.col("t"), lines=1)).first()[0] == "é"


def test_excerpts_of_full_texts(spark, tmp_path):
    """Spoiled texts of 19, 20 and 21 lines, and some next to the bound of bytes, against the SQL of the query."""
    texts = ["\n".join(["é"] * n) for n in (19, 20, 21)] + ["a" * n for n in (16_382, 16_383, 16_384)] + ["a\n" * 19 + "b" * n for n in (16_344, 16_345, 16_346)] + ["", None]
    spark.createDataFrame([(50 * k + 7, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect()
    want.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in queries.bounded_excerpts(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want.execute(ORACLE_SQL["bounded_excerpts"]).fetchall())


def test_run_steps(spark):
    r = random.Random(6)
    pieces = ["run: |", "run: >-", "run: node a.js", "- run: 'b c'", "- run: |", "- name: x", "working-directory: w", "- working-directory: \"v\"", "echo", "", "   ", "run: x", "env:"]
    texts = ["\n".join(" " * r.choice([0, 0, 2, 2, 4, 6]) + r.choice(pieces) + r.choice(["", "", " "]) for _ in range(r.randrange(14))) + r.choice(["", "\n"]) for _ in range(250)] + ["", "run:", "run: |\n", "run: |\r\n  a\r\n\r\n  b\r\n"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, text string")
    got = {}
    for x in ops.run_steps(ops.text_lines(df)).orderBy("id", "pos").collect():
        got.setdefault(x.id, []).append((x.command, x.folder))
    for k, text in enumerate(texts):
        assert got.get(k, []) == run_steps(text), text
    assert -1 not in got
