import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from refgraph.llm import sharding
from refgraph.llm.sharding import accepted, shard


def check(df, shards):
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    got = shard(df, shards=shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    return got


def test_odd_rows(odd):
    check(odd, 24)
    check(odd, 3)


def test_groups_stay_together(spark):
    rows = [(k, "the hot text") for k in range(400)] + [(1000 + k, f"pair {k // 2}") for k in range(400)] + [(5000 + k, f"alone {k}") for k in range(400)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 12)
    where = defaultdict(Counter)
    for r in got:
        where[r.text_crc32][r.shard] += 1
    hot = where[zlib.crc32(b"the hot text")]
    together = sum(n * n for n in hot.values()) / 400**2
    assert together >= 1.5 / 12 and sum(n for _, n in hot.most_common(6)) >= 360  # chance gives 1 / 12 and about 220
    assert sum(len(w) > 1 for w in where.values()) <= 21  # chance parts 11 of 12 pairs, quotas leave about a tenth apart


def test_empty(none):
    assert shard(none).count() == 0


def parted(spark, rows, shards):
    """Where each text's rows are, and how many of the groups that would fit in a shard sit in several."""
    where = defaultdict(Counter)
    for r in check(spark.createDataFrame(rows, "doc_id long, text string"), shards):
        where[r.text_crc32][r.shard] += 1
    return where, sum(len(w) > 1 for w in where.values() if sum(w.values()) <= len(rows) // shards)


def test_groups_stay_whole_to_the_bound(spark):
    rows = [(k, "the hot text") for k in range(400)] + [(1000 + k, f"pair {k // 2}") for k in range(400)] + [(5000 + k, f"alone {k}") for k in range(400)]
    where, n = parted(spark, rows, 12)
    assert n <= 12  # a border for each shard
    assert len(where[zlib.crc32(b"the hot text")]) <= 6


def test_pairs_stay_whole_beside_a_hot_text(spark):
    rows = [(k, "the hot text") for k in range(4000)] + [(10_000 + k, f"pair {k // 2}") for k in range(7920)] + [(50_000 + k, f"alone {k}") for k in range(80)]
    where, n = parted(spark, rows, 24)
    print("parted pairs beside a hot text", n, "of 3960; hot text in", len(where[zlib.crc32(b"the hot text")]), "shards")
    assert n <= 24
    assert len(where[zlib.crc32(b"the hot text")]) <= 12


def test_small_groups_stay_whole(spark):
    rows = [(k, f"pair {k // 2}") for k in range(10_800)] + [(50_000 + k, f"alone {k}") for k in range(1200)]
    _, n = parted(spark, rows, 24)
    print("parted pairs", n, "of 5400")
    assert n <= 24


def test_middling_groups_stay_whole(spark):
    rows = [(k, f"text {k % 60}") for k in range(6000)] + [(50_000 + k, f"alone {k}") for k in range(600)]
    _, n = parted(spark, rows, 24)
    print("parted groups", n, "of 60")
    assert n <= 24


def test_accepted():
    wish = np.array([[0, 10, 4], [6, 0, 0], [0, 5, 0]], float)
    share = accepted(wish, np.array([0.0, 3.0, 2.0]))
    assert np.allclose(wish * share, [[0, 6 + 4 * 3 / 9, 2], [6, 0, 0], [0, 5 * 3 / 9, 0]])
    moved = wish * share
    assert (moved.sum(axis=0) <= moved.sum(axis=1) + [0, 3, 2] + 1e-9).all()
    assert (accepted(np.zeros((2, 2)), np.ones(2)) == 0).all()


def cut_edges(parts):
    return sum(r.n * (r["size"] - r.n) for r in parts.collect()) // 2


def test_rounds_follow_the_neighbours(spark, monkeypatch):
    """Each round has fewer edges between shards than the one before, sizes stay near the quota, and in the end most groups are in
    one part: before the last step nearly all of them."""
    seen = []

    def watched(df, name):
        out = written(df, name)
        if name.startswith(("shard-parts", "shard-round")):
            seen.append(out)
        return out

    written = sharding.written
    monkeypatch.setattr(sharding, "written", watched)
    rows = [(k, f"text {k // 4}") for k in range(8000)] + [(50_000 + k, f"alone {k}") for k in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    cuts = [cut_edges(p) for p in seen]
    assert len(cuts) > 3 and all(b < a for a, b in zip(cuts[:-1], cuts[1:-1], strict=False)) and cuts[-1] < 0.05 * cuts[0]
    assert seen[-1].where("n = size").count() > 1900
    for p in seen:
        held = [r.n for r in p.groupBy("shard").agg(F.sum("n").alias("n")).collect()]
        assert max(held) < 1.15 * 8400 / 8


def test_without_neighbours_nothing_moves(spark, monkeypatch):
    """What comes out depends on the rounds: where none is accepted, groups are placed by room alone."""
    rows = [(k, f"pair {k // 2}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r.pulled for r in shard(df).collect()}
    monkeypatch.setattr(sharding, "accepted", lambda wish, room: np.zeros_like(wish))
    second = {r.doc_id: r.pulled for r in shard(df).collect()}
    assert sum(first[k] != second[k] for k in first) > 2000
