from collections import Counter, defaultdict

from pyspark.sql import functions as F

from refgraph.llm.line_dedup import LineRuns, line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\v\f\r").translate(UPPER)


def brute(rows):
    """rows: (id, text)."""
    low = float("-inf")
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(low if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 3 and max(held[key(x)]) != (low if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def check(df):
    got = line_dedup(df)
    assert got.columns == [*df.columns, "line_dedup"]
    assert Counter((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.text) for r in got.collect()) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_odd_rows(odd):
    check(odd)


def test_hot_and_repeated_lines(spark):
    hot = "this line stands in very many documents"
    rows = [(k, "\n".join([hot, f"own line number {k} of this text", hot.upper() + " \t"] + ["short"] * 3 + ([f"  shared by some: {k % 7} and more text"] * 2))) for k in range(60)]
    rows += [(None, hot), (None, hot + "\n"), (5, hot), (61, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_hot_lines_by_broadcast_or_hash(spark):
    rows = [(k, "a line that every document has here\n" + f"a line that some documents have: {k % 9}\nown {k}") for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    for heavy in (0, 5, 10**6):  # none, the one line, all
        assert Counter((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.text) for r in line_dedup(df, heavy=heavy).collect()) == want


def test_names_used_inside(spark):
    rows = [(k, "a line that every document has here\nown", k, k, k, k, k, k) for k in range(9)]
    check(spark.createDataFrame(rows, "doc_id long, text string, dropped int, of int, of_id int, id int, doc int, `lines` int"))


def test_batches_meet_runs_without_shuffling_them(spark):
    runs = LineRuns(spark)
    rows = lambda *v: spark.createDataFrame(v, "h1 long, h2 long, docs long, keeper long")
    runs.add(rows((1, 1, 2, 90), (2, 2, 1, 95)))
    merged = runs._merged([runs.runs()[0], runs._write(rows((3, 3, 1, 9)).withColumn("first", F.lit(True)))])
    assert merged.count() == 3
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_empty(none):
    assert line_dedup(none).count() == 0


def test_runs(spark):
    runs = LineRuns(spark)
    rows = lambda *v: spark.createDataFrame(v, "h1 long, h2 long, docs long, keeper long")
    runs.add(rows((1, 1, 2, 90), (2, 2, 1, 95)))
    assert [r.h1 for r in runs.unseen(rows((1, 1, 1, 5), (3, 3, 1, 5))).collect()] == [3]
    runs.add(rows((1, 1, 1, 50), (3, 3, 1, 60)))
    runs.add(rows((3, 3, 4, 10)))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert sorted(map(tuple, runs.read().select("h1", "docs", "keeper").collect())) == [(1, 3, 90), (2, 1, 95), (3, 5, 60)]
    assert runs.read().where(~F.col("first")).isEmpty()
