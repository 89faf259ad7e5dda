"""A corpus pipeline of five stages over documents: each stage works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.llm.bpe import encode_decode
from refgraph.llm.common import documents, written
from refgraph.llm.jaccard_join import deduplicated
from refgraph.llm.language_id import learned, recognised
from refgraph.llm.line_dedup import line_dedup
from refgraph.llm.mixing import mixed_documents


#: Characters of a chunk in the last stage: half of the operator's own, as its workers stand beside what the stages before left in memory.
CHUNK_CHARS = 4_000_000


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: texts without a letter, null and empty ones too, and those whose score is near
    chance. Very long texts are read whole; equal texts fare alike; all columns stay, whatever their names."""
    return recognised(docs, learned(docs))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the one with the largest id; a null text becomes an empty one. Rows of one id
    and text count once as holders and are cut alike."""
    return _counted(line_dedup(docs).drop("line_dedup"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the smallest id stays, of rows with that id one; texts without words, null ones too, are copies of
    nothing and stay. Links chain, so a group may hold texts that are not alike."""
    return deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target weight asks for: up to three times, one of them cut to its first words. A null source
    is one of its own; texts without words are never taken; without any words the mix is empty."""
    return _counted(mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and a digest of the decoded text, one row per row of the mix. Null and empty texts have no ids; repeated rows
    (a mix repeats documents) are rows of their own; other columns are left out."""
    found = encode_decode(docs, chunk_chars=CHUNK_CHARS)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A trained network and a tokenizer cannot be expressed in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
