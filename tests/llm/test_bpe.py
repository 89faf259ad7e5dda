from collections import Counter

import pytest
from tokenizers import Tokenizer

from refgraph.llm.bpe import Splitter, encode_decode, tokenizer_file


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def check(df, library, **more):
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encode_decode(df, **more).collect()) == want


def test_documents(documents, library):
    check(documents, library, chunk_chars=50_000)


def test_odd_rows(odd, library):
    check(odd, library)


def test_odd_texts(spark, library):
    texts = ["<|endoftext|>a<|ENDOFTEXT|> <|startoftext|>", "it's I'LL 'S we'd", "ΣΑΣ İstanbul ǅ ß", "á ȩ́ é", "12 ½ ²  x\x1cy\x85z w", "…—“x” €5", "नमस्ते 日本 العربية", "֋ x", "İ͓x"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), library)


def test_unknown_splitters_are_refused():
    with pytest.raises(ValueError):
        Splitter({"normalizer": {"normalizers": []}, "pre_tokenizer": {"pretokenizers": [{"type": "Other", "invert": False, "behavior": ""}]}, "added_tokens": []})


def test_empty(none):
    assert encode_decode(none).count() == 0
