import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from refgraph.llm.fingerprint import SCALE, compared, containment, fingerprint_edits, likeness, merged, spelled, with_sketch
from refgraph.llm.queries import op6_fingerprint


def shingles(text):
    w = (text or "").split(" ")
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def hashed(values):
    """xxhash64 of a column of an array of longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain(text):
    """A sketch made word by word: the hash of all words, and the shingle hashes in the lowest part of the range."""
    w = [signed(xxhash.xxh64_intdigest(x, 42)) for x in (text or "").encode().split()]
    all_ = {hashed(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({hashed(w)} if w else set())
    return hashed(w) if w else None, {h for h in all_ if h < -(2**63) + 2**64 // SCALE}


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    return len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] | b[1] else 0.0


def plain_spelled(sketch):
    spell = lambda h: f"{h % 2**64:X}"
    return ("" if sketch[0] is None else spell(sketch[0])) + ":" + ",".join(spell(h) for h in sorted(sketch[1]))


def test_query_against_a_plain_version(spark, texts):
    ids = sorted(texts, reverse=True)
    nxt = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    got = op6_fingerprint(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    errors = []
    for r in got:
        t, other = texts[r.doc_id] or "", texts[nxt[r.doc_id]] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + other[:h]
        a, b, c = plain(t), plain(edited), plain(other)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_spelled(a), plain_spelled(b))
        assert math.isclose(r.near_edited, plain_likeness(a, b)) and math.isclose(r.near_next, plain_likeness(a, c))
        errors += [abs(r.near_edited - jaccard(shingles(t), shingles(edited))), abs(r.near_next - jaccard(shingles(t), shingles(other)))]
    assert sum(errors) / len(errors) < 0.05


def test_equal_texts_without_a_kept_hash(spark):
    """Likeness is 1 for equal texts and for empty ones, 0 for others of which nothing is kept."""
    rows = [(f"word{k}", f"word{k}", f"other{k}", "", " ") for k in range(40)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    for c in df.columns:
        df = with_sketch(df, c, f"s_{c}")
    got = df.select(F.size("s_a.hashes").alias("n"), *(likeness("s_" + x, "s_" + y).alias(x + y) for x, y in ("ab", "ac", "ad", "de")), containment("s_a", "s_c").alias("held"), containment("s_d", "s_a").alias("none"), (spelled("s_a") == spelled("s_b")).alias("equal")).collect()
    assert {r.n for r in got} == {0, 1}
    for r in got:
        assert (r.ab, r.ac, r.ad, r.de, r.none, r.equal) == (1.0, 0.0, 0.0, 1.0, 1.0, True) and r.held == (0.0 if r.n else None)


def test_odd_rows(odd):
    got = fingerprint_edits(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[1, 0].sketch == by[2, 0].sketch and by[1, 0].sketch.hashes == []
    assert by[1, 0].sketch.whole is None and len(by[4, 13].sketch.hashes) <= 1 and by[4, 13].sketch.whole is not None


def test_sketches(spark):
    words = [f"w{k}" for k in range(3000)]
    rows = spark.createDataFrame([(" ".join(words), " ".join(words[:1500]), " ".join(words[1500:]), " ".join(words[:9]))], "whole string, a string, b string, few string")
    for c in rows.columns:
        rows = with_sketch(rows, c, f"s_{c}")
    r = rows.select(
        "s_whole", containment("s_a", "s_whole").alias("in_whole"), containment("s_whole", "s_a").alias("held"), likeness("s_a", "s_b").alias("apart"),
        merged(F.col("s_a"), F.col("s_b"), F.col("s_whole.whole")).alias("m"),
    ).first()
    assert r.in_whole == 1.0 and abs(r.held - 0.5) < 0.15 and r.apart == 0.0
    assert abs(len(r.s_whole.hashes) - 2996 / SCALE) < 150 and r.m.whole == r.s_whole.whole
    assert len(set(r.s_whole.hashes) - set(r.m.hashes)) <= 4  # but for shingles across the seam


def test_empty(none):
    assert fingerprint_edits(none).count() == 0


def test_short_texts_in_a_long_one(spark):
    """A contained text is never reported as less than whole; what cannot be compared is null, and rarer the longer the text is."""
    words = [f"w{k}" for k in range(20_000)]
    rows = [(n, " ".join(words[a : a + n + 4])) for n in (5, 15, 30) for a in range(0, 19_000, 95)]
    long = spark.createDataFrame([(" ".join(words),)], "whole string")
    df = spark.createDataFrame(rows, "n long, few string").crossJoin(with_sketch(long, "whole", "s_whole").select("s_whole"))
    got = with_sketch(df, "few", "s_few").select("n", containment("s_few", "s_whole").alias("c"), compared("s_few").alias("m")).collect()
    assert all((r.c is None) == (r.m == 0) and r.c in (None, 1.0) for r in got)
    unknown = Counter(r.n for r in got if r.c is None)
    print("unknown of 200:", dict(unknown))
    assert unknown[5] <= 45 and unknown[15] <= 3 and unknown[30] == 0


def test_error_by_comparable_hashes(spark):
    """Of texts held by half, the error stays about sqrt(c (1 - c) / m)."""
    rng, words = random.Random(1), [f"w{k}" for k in range(20_000)]
    rows = []
    for k in range(400):
        n, a = rng.choice((20, 40, 80, 160)), rng.randrange(19_000)
        rows.append((" ".join([*words[a : a + n], *(f"x{k}-{j}" for j in range(n))]), (n - 4) / (2 * n - 4)))
    long = spark.createDataFrame([(" ".join(words),)], "whole string")
    df = spark.createDataFrame(rows, "half string, truth double").crossJoin(with_sketch(long, "whole", "s_whole").select("s_whole"))
    got = with_sketch(df, "half", "s_half").select("truth", containment("s_half", "s_whole").alias("c"), compared("s_half").alias("m")).where("m > 0").collect()
    errors = defaultdict(list)
    for r in got:
        errors[r.m.bit_length()].append(((r.c - r.truth) ** 2, r.truth * (1 - r.truth) / r.m))
    assert len(errors) >= 3
    for e in errors.values():
        if len(e) >= 30:
            assert math.sqrt(sum(x for x, _ in e)) <= 1.3 * math.sqrt(sum(y for _, y in e))


def test_nothing_is_held_by_an_empty_text(spark):
    df = spark.createDataFrame([("one two three four five six", "")], "a string, b string")
    r = with_sketch(with_sketch(df, "a", "s_a"), "b", "s_b").select(containment("s_a", "s_b").alias("c"), containment("s_b", "s_a").alias("d")).first()
    assert r.c == 0.0 and r.d == 1.0
