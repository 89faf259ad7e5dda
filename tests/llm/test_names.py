"""Operators on tables whose other columns have dots in their names, or names that operators use inside."""

import pytest
from pyspark.sql import functions as F

from refgraph.llm.bpe import encode_decode
from refgraph.llm.exact_dedup import exact_dedup
from refgraph.llm.fingerprint import fingerprint_edits
from refgraph.llm.language_id import identify, train
from refgraph.llm.line_dedup import line_dedup
from refgraph.llm.secret_scan import scan
from refgraph.llm.sharding import shard
from refgraph.llm.token_counts import edited, with_trees

INNER = ["id", "of", "n", "g1", "g2", "u", "shard", "size", "to", "place", "kind", "start", "end", "words", "__words", "chunk", "bucket", "data", "ids", "counts", "text_of", "prev_id", "part", "c0", "c1", "tree", "spans", "base", "digest", "norm", "file", "row", "a.b", "_metadata"]
ROWS = [(k, f"some words of text number {k % 3} password = abcdefghijkl{k}") for k in range(12)]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="module")
def named(spark, plain):
    return plain.select("*", *(F.lit("x").alias(c) for c in INNER))


def rows(df, keep):
    return sorted(repr(tuple(r[c] for c in keep)) for r in df.collect())


@pytest.mark.parametrize("operator", [scan, fingerprint_edits, encode_decode, shard], ids=lambda f: f.__name__)
def test_other_columns_change_nothing(plain, named, operator):
    want = operator(plain)
    assert rows(operator(named), want.columns) == rows(want, want.columns)


def test_columns_stay(plain, named):
    net = train(["some words of text", "andere woorden van tekst"], ["a", "b"])
    for operator in (lambda d: identify(d, net), lambda d: with_trees(d), line_dedup):
        want, got = operator(plain), operator(named)
        assert rows(got, want.columns) == rows(want, want.columns)
        made = [c for c in want.columns if c not in plain.columns]
        left = [c for c in INNER if c not in made]
        assert got.columns == ["doc_id", "text", *left, *made]
        assert {r[c] for r in got.select(*(f"`{c}`" for c in left)).toDF(*map(str, range(len(left)))).collect() for c in map(str, range(len(left)))} == {"x"}


def test_edits_keep_columns(named):
    made = edited(with_trees(named).withColumns({"at": F.lit(0), "end": F.lit(4), "insert": F.lit("any")}), "at", "end", "insert")
    assert {r.text.split(" number")[0] for r in made.collect()} == {"any words of text"} and "a.b" in made.columns


def test_exact_dedup(spark, plain, named, tmp_path):
    plain.write.parquet(str(tmp_path / "plain"))
    named.write.parquet(str(tmp_path / "named"))
    want = exact_dedup(spark, str(tmp_path / "plain"))
    assert rows(exact_dedup(spark, str(tmp_path / "named")), want.columns) == rows(want, want.columns)
    named.withColumnsRenamed({"doc_id": "d.id", "text": "t.x"}).write.parquet(str(tmp_path / "dots"))
    assert exact_dedup(spark, str(tmp_path / "dots"), "d.id", "t.x").count() == len(ROWS)
