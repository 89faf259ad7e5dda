import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from refgraph.llm import mixing
from refgraph.llm.mixing import mix, mixed_documents, split_quotas
from refgraph.llm.queries import op3_mixing


def brute_targets(sizes):
    """Share by weight, cap at three times the size, and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / (sum(weight[s] for s in open_) or 1)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**{s: level * weight[s] for s in open_}, **capped}
        capped |= {s: 3 * sizes[s] for s in over}


def n_words(text):
    return len((text or "").encode().split())


def check(df):
    rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += n_words(t)
    want = brute_targets(sizes)
    got = mix(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, n_words(t)) for i, s, t in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert len(r.copies) == math.ceil(r.taken / r.size if r.size else 0) and all(0 <= c.shard < 16 and 0 < c.words <= r.size for c in r.copies)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = Counter((r.doc_id, r.taken, tuple(r.copies)) for r in mix(df).collect())
    assert again == Counter((r.doc_id, r.taken, tuple(r.copies)) for r in got)
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += n_words(r.text)
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_odd_rows(odd):
    check(odd)


def test_documents(documents):
    check(documents)


def test_a_small_source_of_great_weight_is_capped(spark):
    check(spark.createDataFrame([(k, "w " * 50, "a") for k in range(40)] + [(100, "x y", "b"), (101, "z", "c"), (102, None, "c")], "doc_id long, text string, source string"))


def test_one_id_and_text_in_two_sources(spark):
    rows = [(k, "one two three four", s, lang) for k in [*range(30), None] for s, lang in (("a", "en"), ("b", "de"), ("b", "fr"), (None, "en"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    check(df)
    whole = Counter((r.doc_id, r.source) for r in mix(df).where("taken >= size").collect())
    kept = Counter((r.doc_id, r.source) for r in mixed_documents(df).where("text = 'one two three four'").select("doc_id", "source", "lang").distinct().collect())
    assert kept == whole  # each row stands for itself, with its own columns


def test_many_blocks_by_shuffle(odd):
    """What the mix holds does not depend on how blocks reach the documents."""
    one, two = mixed_documents(odd), mixed_documents(odd, broadcast_blocks=0)
    assert Counter(one.collect()) == Counter(two.collect())


def test_the_tree_decides(spark, documents, monkeypatch):
    """Shards hold equal numbers of draws, disjoint ones; with another tree the mix and the query are others, without one nothing is
    taken."""
    df = documents.select("doc_id", "text", "source")
    drawn = Counter((c.shard, r.source, r.doc_id, n) for r in mix(df).collect() for n, c in enumerate(r.copies))
    assert set(drawn.values()) == {1} and {s for s, *_ in drawn} == set(range(16))
    told = lambda: {(r.doc_id, r.taken, r.shard_words) for r in op3_mixing(spark, "/root/testdata/sf0.001").collect()}
    first = told()
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: quotas.where("quota > 0").select("place", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("first"), F.col("quota").alias("end")))
    second = told()
    assert {x[:2] for x in first} == {x[:2] for x in second} and len(first & second) < len(first) / 4
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: spark.createDataFrame([], "place int, shard int, first long, end long"))
    assert mix(df).where("taken > 0").isEmpty() and mixed_documents(df).isEmpty()


def test_shards_are_dealt_out_in_their_order(documents):
    df = documents.where("source is not null").select("doc_id", "text", "source")
    copies = {r.doc_id: r.copies for r in mix(df).collect()}
    rows = mixed_documents(df).select(F.spark_partition_id().alias("part"), "doc_id").collect()
    by_part = defaultdict(list)
    for r in rows:
        by_part[r.part].append(r.doc_id)
    for ids in by_part.values():  # some order of the copies' (shard, run, order) is that of the rows
        held = Counter(ids)
        want = sorted((c.shard, (c.order % 2**64) >> 54, c.order, i) for i in held for c in copies[i])
        want = [i for *_, i in want]
        assert [i for i in want if len(copies[i]) == 1] == [i for i in ids if len(copies[i]) == 1]


def test_names_used_inside(spark):
    rows = [(k, f"text {k} of words", "ab"[k % 2], k, k, k, k) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block int, doc int, `__rows` int, `copy.order` int")
    check(df)


def test_empty(none):
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0


def plain_tree(quotas, shards, seed):
    """{(place, shard): number of draws}, node by node."""
    out = {}

    def divide(items, low, high):
        if high - low == 1:
            for place, _ in items:
                out[place, low] = out.get((place, low), 0) + 1
            return
        middle = (low + high) // 2
        items = sorted(items, key=lambda x: (hashlib.md5(f"{seed}:{low}:{high}:{x[0]}:{x[1]}".encode()).hexdigest(), x))
        n = len(items) * (middle - low) // (high - low)
        divide(items[:n], low, middle)
        divide(items[n:], middle, high)

    divide([(p, k) for p, q in quotas.items() for k in range(q)], 0, shards)
    return out


@pytest.mark.parametrize(("shards", "seed"), [(1, 0), (2, 1), (7, 2), (16, 3)])
def test_splitting_tree(spark, shards, seed):
    quotas = {1: 40, 2: 0, 3: 1, 4: 333}
    rows = split_quotas(spark.createDataFrame(list(quotas.items()), "place int, quota long"), shards, seed).collect()
    assert {(r.place, r.shard): r.end - r.first for r in rows} == plain_tree(quotas, shards, seed)
    for p, q in quotas.items():  # runs follow each other, by shard, and are all of the draws
        own = sorted((r.shard, r.first, r.end) for r in rows if r.place == p)
        assert [x[1] for x in own] == [0, *(x[2] for x in own)][: len(own)] and (own[-1][2] if own else 0) == q
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.end - r.first
    assert max(sizes.values()) - min(sizes.values()) <= math.ceil(math.log2(shards)) + 1 if shards > 1 else True


def test_splitting_tree_is_fair():
    left = [plain_tree({1: 30, 2: 10}, 2, s) for s in range(400)]
    assert np.mean([x.get((2, 0), 0) for x in left]) == pytest.approx(5, abs=0.4) and all(x.get((1, 0), 0) + x.get((2, 0), 0) == 20 for x in left)
    assert np.var([x.get((2, 0), 0) for x in left]) == pytest.approx(20 * 0.25 * 0.75 * 20 / 39, rel=0.3)  # of a hypergeometric sample
