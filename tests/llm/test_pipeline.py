"""Each stage of the pipeline against a plain version on its own input."""

import hashlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from refgraph.llm.bpe import tokenizer_file
from refgraph.llm.common import written

from .test_jaccard_join import brute as near_brute
from .test_line_dedup import brute as line_brute

DATA = "/root/testdata/sf0.001"


def words(rows):
    return sum(len((t or "").encode().split()) for _, t in rows)


def check_stages(spark, docs, strict):
    """Each stage on what the one before kept. strict: ids are unique, and all texts with letters are of a learned language."""
    tokenizer, columns, sizes = Tokenizer.from_file(tokenizer_file()), docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, DATA)
        if name != "bpe":
            assert out.columns == columns
            out = written(out, f"test-{name}")
            after = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
            sizes.append(len(after))
        if name == "language_id":
            assert not Counter(after) - Counter(before)
            gone = Counter(before) - Counter(after)
            assert all(any(map(str.isalpha, t or "")) for _, t in after) and (not strict or not any(any(map(str.isalpha, t or "")) for _, t in gone))
        elif name == "line_dedup":
            want = Counter()
            for (i, _, _, t), n in line_brute(before).items():
                want[i, t] += n
            assert Counter(after) == want
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_copies":
            classes = near_brute(before)
            assert {i for i, _ in after} == {c for _, _, c in classes} and not Counter(after) - Counter(before)
            assert not strict or len(after) == len({c for _, _, c in classes})
        elif name == "mixing":
            assert {i for i, _ in after} <= {i for i, _ in before}
            assert abs(words(after) - words(before)) <= 20
        else:
            want = Counter()
            for i, t in before:
                ids = tokenizer.encode(t or "", add_special_tokens=False).ids
                want[i, len(ids), tuple(ids), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
            assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in out.collect()) == want
        docs = out
    return sizes


def test_stages(spark, documents):
    assert min(check_stages(spark, documents, True)) > 0


def test_odd_rows(spark, odd):
    assert min(check_stages(spark, odd, False)) > 0


def test_empty(spark, none):
    assert check_stages(spark, none, False) == [0, 0, 0, 0]


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5
