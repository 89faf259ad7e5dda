import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from refgraph.llm import jaccard_join
from refgraph.llm.jaccard_join import EDGES, PIECE, band, bitmap, deduplicated, jaccard_classes, possible, prefix, shingle_sets, similar


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(id, set size, smallest id of the class) per row."""
    sets = [shingles(t) for _, t in rows]
    holds, up = defaultdict(list), list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in enumerate(sets):
        for other, shared in Counter(o for x in s for o in holds[x]).items():
            if 100 * shared >= 80 * (len(s) + len(sets[other]) - shared):
                up[find(k)] = find(other)
        for x in s:
            holds[x].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def check(df, **more):
    got = jaccard_classes(df, **more).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_documents(documents):
    check(documents)


def test_odd_rows(odd):
    check(odd)


def near_copies(n, seed):
    """Copies of a text with edits around the threshold, chains of edits, and others that share a passage only."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(120)]
    passage = [f"p{k}" for k in range(30)]
    rows, chain = [], list(base)
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append(copy)
        chain = list(chain)
        chain[rng.randrange(120)] = f"c{k}"
        rows.append(chain)
        rows.append([f"o{k}-{j}" for j in range(rng.randrange(4, 60))] + passage)
        rows.append(passage + [f"s{k}"] * rng.randrange(3))
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_near_copies(spark):
    df = spark.createDataFrame(near_copies(60, 1), "doc_id long, text string")
    check(df)
    check(df, star_rounds=1, block=16, one_task=0)  # blocks and joins do the work


def test_deduplicated(spark, odd):
    df = spark.createDataFrame(near_copies(10, 2), "doc_id long, text string")
    kept = {r.doc_id for r in deduplicated(df).collect()}
    assert kept == {c for _, _, c in brute([(r.doc_id, r.text) for r in df.collect()])}
    out = deduplicated(odd)
    rows = out.collect()
    assert out.columns == odd.columns
    assert Counter((r.doc_id, (r.text or "")[:9]) for r in rows) == Counter([(1, ""), (2, ""), (3, " \t\n "), (4, "one two t"), (6, "word0 and"), (8, "É grün\nna"), (9, "same text"), (10, "the other"), (None, "a row wit"), (None, "")])


def test_names_used_inside(spark):
    rows = [(k, f"some words of a text that {'all' if k % 2 else k} have here", k, k, k, k, k, k) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `of` int, id int, ent int, doc int, __of int, kept_id int")
    out = deduplicated(df)
    assert out.columns == df.columns and sorted((r.doc_id, r["__of"], r.id) for r in out.collect()) == [(k, k, k) for k in (0, 1, 2, 4, 6)]


def test_a_large_cluster_stays_linear(spark, monkeypatch):
    """Of 2,000 edited copies of a text, fewer pairs are held against each other in blocks than there are copies."""
    rng, base = random.Random(3), [f"b{k}" for k in range(150)]
    rows = []
    for k in range(2000):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 8))):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = {}
    keep = jaccard_join.written

    def noted(df, name):
        made[name] = keep(df, name)
        return made[name]

    monkeypatch.setattr(jaccard_join, "written", noted)
    check(df)
    assert made["join-groups"].count() <= 3 * len(rows)
    assert all(made[name].count() <= len(rows) for name in made if name.startswith("join-pairs"))


def test_sets_that_share_half_of_their_digest(spark, monkeypatch):
    """Different sets of one entity number are told apart by the other half."""
    whole = jaccard_join.entity
    monkeypatch.setattr(jaccard_join, "entity", lambda shingles: (len(shingles) % 3, whole(shingles)[1]))
    check(spark.createDataFrame(near_copies(8, 5), "doc_id long, text string"))


def test_empty(none):
    assert jaccard_classes(none).count() == 0


def test_long_texts_in_pieces():
    words = b" ".join(b"w%d" % (k * 7919 % 100_003) for k in range(400_000))
    assert len(words) > 2 * PIECE
    texts = [words, b"x" * (PIECE + 10) + b" a b c d e f", b"", b"a b"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t.decode())) for t in texts]
    assert (next(shingle_sets([words])) == next(shingle_sets([words.replace(b" ", b"\n")]))).all()


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), min_size=1, max_size=40), st.randoms())
def test_filters_lose_no_pair(a, b, rng):
    mix = {k: rng.getrandbits(64) for k in range(61)}
    x, y = (np.unique(np.array([mix[k] for k in s], np.uint64)) for s in (a, b))
    if similar(len(x), len(y), len(np.intersect1d(x, y))):
        assert possible(len(x), bitmap(x), len(y), bitmap(y)) and abs(band(len(x)) - band(len(y))) <= 1
        counts = {int(v): rng.randrange(4) for v in np.union1d(x, y)}
        first = [set(prefix(s, np.array([counts[int(v)] for v in s])).tolist()) for s in (x, y)]
        assert first[0] & first[1]


def test_bands():
    for n in list(range(1, 3000)) + [10**6]:
        assert EDGES[band(n)] <= n < EDGES[band(n) + 1]
        assert band(n * 5 // 4) <= band(n) + 1
