import random

import numpy as np
from pyspark.sql import functions as F

from refgraph.llm.queries import op5_token_counts
from refgraph.llm.token_counts import Counter, TokenTree, edited, vocabulary, with_trees

COUNTER = Counter(*vocabulary())


def full(text):
    return len(COUNTER.encoding.encode_ordinary(text or ""))


def leaves(tree):
    return np.concatenate([a for a, _ in tree.slots]).tolist()


def test_edits_equal_new_counts():
    random.seed(3)
    bits = [" ", "  ", "\n", "a", "the", "'s", "'", "1", "é", "!?", "\t\n ", " x", "日本"]
    make = lambda n: "".join(random.choice(bits) for _ in range(random.randrange(n)))
    for _ in range(400):
        text = make(random.choice([3, 30, 600]))
        tree = TokenTree.of(text, COUNTER)
        for _ in range(5):
            at = random.randrange(len(text) + 1)
            end, new = min(len(text), at + random.choice([0, 1, 3, 200])), make(12)
            text = text[:at] + new + text[end:]
            tree.edit(text, at, end, len(new), COUNTER)
            tree = TokenTree.unpack(tree.pack())
            want = TokenTree.of(text, COUNTER)
            assert tree.total == want.total == full(text) and leaves(tree) == leaves(want)
            assert tree.tokens[1] == sum(int(b.sum()) for _, b in tree.slots) and tree.chars[1] == len(text)


def test_an_edit_encodes_few_pieces():
    text = "some words of a long text " * 5000
    tree = TokenTree.of(text, COUNTER)
    assert tree.edit(text[:70_000] + "X" + text[70_001:], 70_000, 70_001, 1, COUNTER) < 8


def test_odd_rows(odd):
    rows = with_trees(odd).withColumns({"at": F.lit(2), "end": F.when(F.col("doc_id") == 4, None).otherwise(F.lit(10**9)), "insert": F.lit(" new é")})
    got = edited(rows, "at", "end", "insert").collect()
    assert len(got) == odd.count()
    for before, r in zip(sorted(rows.collect(), key=repr), sorted(got, key=repr), strict=True):
        assert before.n_tokens == full(before.text)
        assert r.n_tokens == full(r.text)
    assert {r.text for r in got if r.doc_id in (1, 4)} == {" new é", "one two three"}


def test_query(spark, texts):
    for r in op5_token_counts(spark, "/root/testdata/sf0.001").collect():
        t = texts[r.doc_id]
        m = len(t) // 2
        assert r.n_tokens == full(t) and r.n_tokens_edited == full(t[:m] + t[:16] + t[m + 16 :])


def test_empty(none):
    assert with_trees(none).count() == 0
