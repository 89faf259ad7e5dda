import hashlib
import operator
import random
import zlib
from fractions import Fraction

from refgraph.llm.periodic_runs import collapsed, find_runs, lyndon_edges, periodic_runs, strongest
from refgraph.llm.queries import op13_periodic_runs


def brute(words, least_length=6, least_exponent=4):
    """Every period by itself: maximal stretches, without those that a smaller period has."""
    n, out = len(words), []
    for p in range(1, n // least_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least_length, least_exponent * p) and not any(all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_against_brute_force():
    r = random.Random(3)
    for _ in range(3000):
        words = [r.choice("abcd"[: r.choice([1, 2, 2, 3, 4])]) for _ in range(r.randrange(70))]
        if words and r.random() < 0.5:
            a, p = r.randrange(len(words)), r.randrange(1, 7)
            for i in range(a, len(words)):
                words[i] = words[a + (i - a) % p]
        for limits in ((6, 4), (2, 2), (5, 3)):
            assert periodic_runs(words, *limits) == brute(words, *limits)


class Counted(str):
    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return str.__eq__(self, other)

    def __lt__(self, other):
        Counted.n += 1
        return str.__lt__(self, other)

    __hash__ = None


def test_linear_number_of_comparisons():
    fib = ["a", "ab"]
    while len(fib[-1]) < 8000:
        fib.append(fib[-1] + fib[-2])
    for text in (fib[-1], "a" * 8000, "ab" * 4000, "".join("a" * k + "b" for k in range(120)), "".join("a" * k + "b" for k in range(120, 0, -1)), ("ab" * 40 + "c") * 100, "".join("ab"[k.bit_count() % 2] for k in range(8000))):
        words = list(map(Counted, text))
        Counted.n = 0
        list(lyndon_edges(words, operator.lt, 2))
        assert Counted.n <= 8 * len(words), text[:20]


def test_strongest_and_collapsed():
    runs = [(0, 8, 2), (10, 12, 3), (30, 9, 2)]
    assert strongest(runs) == (30, 9, 2)
    assert strongest(runs[:2]) == (0, 8, 2) and strongest([]) is None
    words = b"x a b a b a b a b y".split()
    assert periodic_runs(words) == [(1, 8, 2)]
    assert collapsed(words, [(1, 8, 2)]) == b"x a b y"


def test_odd_input(spark, odd, none):
    got = find_runs(odd.withColumnRenamed("text", "runs"), text_col="runs")
    rows = got.collect()
    assert got.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"] and len(rows) == odd.count()
    texts = {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    want = {(i, len((t or "").split()), tuple(brute((t or "").split()) if len(t or "") < 1000 else ())) for i, t in texts}
    assert {(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs)) for r in rows if r.n_words < 1000} == {w for w in want if w[1] < 1000}
    assert [r.collapsed for r in rows if r.doc_id == 1] == [""] and [r.strongest for r in rows if r.doc_id == 1] == [None]
    assert find_runs(none).count() == 0
    named = spark.createDataFrame([("k", "a " * 10)], "`a.b` string, `c.d` string")
    assert [tuple(r.runs[0]) for r in find_runs(named, "a.b", "c.d").collect()] == [(0, 10, 1)]


def test_query(spark, texts):
    got = {r.doc_id: r for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    found = 0
    for i, text in texts.items():
        h, words = zlib.crc32(str(i).encode()), (text or "").encode().split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words) if n < 3000 else periodic_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want, i
        found += len(runs)
    assert found > 5
