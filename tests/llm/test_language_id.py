import zlib

import numpy as np

from refgraph.llm.language_id import SEGMENT, UNKNOWN, Network, identify, learned, least_score, pooled, recognised, train
from refgraph.llm.queries import op1_language_id


def test_held_out_accuracy(spark, documents):
    lang = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    got = op1_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) >= 0.95


def test_gradients():
    rng = np.random.default_rng(1)
    net = Network(["a", "b", "c"])
    x, y, mask = rng.integers(97, 105, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((6, 5), np.float32)
    _, g = net.step(x, y, mask)
    for name, w in net.w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old, e = w[at], 1e-2
        w[at] = old + e
        up = net.step(x, y, mask)[0]
        w[at] = old - e
        down = net.step(x, y, mask)[0]
        w[at] = old
        assert abs((up - down) / 2 / e - g[name][at]) < 2e-3, name


def test_positions_and_pooling():
    net = train(["aaaa bbbb aaab"] * 4 + ["xyxy zzyx xxyz"] * 4, ["one"] * 4 + ["two"] * 4, steps=60)
    langs, scores = pooled(net, ["aabb aaab " * 9, "xyz zyx " * 90_000, "", "123 !", "日本"])
    assert langs[:4] == ["one", "two", UNKNOWN, UNKNOWN] and langs[4] in ("one", "two")
    assert scores[2:4] == [0.0, 0.0] and all(0 <= s <= 1 for s in scores)
    p = net.positions(np.frombuffer(b"aabb", np.uint8).reshape(4, 1))
    assert p.shape == (4, 1, 2) and np.allclose(p.sum(axis=2), 1, atol=1e-4)


def test_odd_rows(odd, none):
    net = learned(odd)
    got = identify(odd, net)
    assert got.columns == [*odd.columns, "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {UNKNOWN}
    assert recognised(odd, net, excess=0.0).columns == odd.columns
    assert identify(none, net).count() == 0
    assert {r.lang_pred for r in identify(odd, learned(none)).collect()} == {UNKNOWN}


def plain(net, text):
    """The average of all positions, segment by segment."""
    if not any(map(str.isalpha, text or "")):
        return UNKNOWN, 0.0
    raw, total = text.encode(), np.zeros(len(net.languages))
    for a in range(0, len(raw), SEGMENT):
        part = np.frombuffer(raw[a : a + SEGMENT].ljust(SEGMENT, b"\0"), np.uint8).reshape(-1, 1)
        total += net.positions(np.ascontiguousarray(part))[: len(raw) - a, 0].sum(axis=0)
    return net.languages[int(total.argmax())], float(total.max() / len(raw))


def test_query_against_a_plain_version(spark, documents, texts):
    net = learned(documents)
    for r in op1_language_id(spark, "/root/testdata/sf0.001").collect():
        lang, score = plain(net, texts[r.doc_id])
        assert (r.lang_pred == lang or abs(score - 0.5) < 1e-3) and abs(r.score - score) < 1e-4


def test_rejection(spark):
    """Texts of the learned languages stay, at any number of languages; noise of many scripts goes from four."""
    assert [round(least_score(n), 3) for n in (0, 1, 2, 4)] == [0.0, 0.0, 0.565, 0.348]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = learned(docs)
    lettered = docs.where("text rlike '[A-Za-z]'")
    assert recognised(lettered, net).count() >= 0.999 * lettered.count()


def test_names_used_inside(spark, documents):
    net = learned(documents)
    rows = [(1, "some words here", "x", 0.5, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, doc int")
    assert [tuple(r) for r in recognised(df, net, excess=-1.0).collect()] == rows and identify(df, net).columns == ["doc_id", "text", "doc", "lang_pred", "score"]
