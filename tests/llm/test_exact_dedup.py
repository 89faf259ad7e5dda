import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from refgraph.llm import exact_dedup as exact_dedup_module
from refgraph.llm.exact_dedup import DedupState, exact_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(UPPER)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


def check(spark, path, **more):
    got = exact_dedup(spark, path, **more).collect()
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(path).collect()])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) <= {1} and set(kept) == {k[3] for k in want}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_odd_rows(spark, odd_path):
    check(spark, odd_path)


def test_clashing_digests_are_split_by_text(spark, odd_path):
    check(spark, odd_path, digest=lambda t: F.length(t).cast("string"))
    check(spark, odd_path, digest=lambda t: F.lit("same"), heavy=2)


def test_hot_text(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(k, "the one text of very many rows" if k % 3 else f"text {k % 40}", k, k, k, k) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, salt int, hot int, digest int, norm int").repartition(4).write.parquet(path)
    check(spark, path)
    check(spark, path, heavy=4)
    check(spark, path, heavy=4, digest=lambda t: F.length(t).cast("string"))


def test_texts_without_a_copy_are_not_grouped(spark, odd_path):
    """Texts leave the comparison before they are grouped: the semi join with the hits stands below every aggregate over texts."""
    plans = []
    keep = exact_dedup_module.written
    exact_dedup_module.written = lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name)
    try:
        exact_dedup(spark, odd_path)
    finally:
        exact_dedup_module.written = keep
    lines = plans[-1].splitlines()
    least = [k for k, line in enumerate(lines) if "min(norm" in line]
    semi = [k for k, line in enumerate(lines) if "LeftSemi" in line]
    assert len(least) == len(semi) == 2 and least[0] < semi[0] < least[1] < semi[1]


def test_batches_continue_the_state(spark, odd, tmp_path):
    path = str(tmp_path / "documents.parquet")
    odd.repartition(3).write.parquet(path)
    state = DedupState(spark)
    state.ingest(path, max_files=1)
    odd.limit(4).write.mode("append").parquet(path)
    check(spark, path, state=state)


def test_empty(spark, none_path):
    assert exact_dedup(spark, none_path).count() == 0
