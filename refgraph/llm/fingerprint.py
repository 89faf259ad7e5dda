"""Fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, one in SCALE. So it grows with its document,
sketches of parts merge by union, and containment can be estimated between documents of very unequal length: what a sketch holds
is a uniform sample of the document's shingles, the same one in every document. Beside it stands a hash of the document's words
in order, by which equal documents are known even where no shingle is kept.

An estimate rests on the m hashes that can be compared (compared()); the standard error of a containment c is sqrt(c (1 - c) / m).
Of a text of n shingles m is about n / SCALE. None is kept with probability (1 - 1 / SCALE)^n: 13% for 5 shingles, 0.2% for 15,
0.03% for 20. The containment is then unknown, which is null and not 0, unless the texts are equal; the likeness, a number in
any case, is then 1 for equal texts and else 0.

Words are parted by space and tab to carriage return. A text of fewer words than a shingle has is one shingle; a text without
words has an empty sketch. Nulls: a null text is an empty one; a row of null id stands below all others. Very long texts are
sketched whole. Ties: rows that repeat (id and text) are one document of the order, returned as often as they occur; rows of one
id follow each other by text. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

SHINGLE, SCALE = 5, 3


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Adds out: struct<whole bigint, hashes array<bigint>>, hashes sorted. whole: of the words in order, null if there are none."""
    below = -(2**63) + 2**64 // scale
    hashes = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    df = df.withColumn("__words", hashes)
    n = F.size("__words")
    all_ = F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, F.array(F.xxhash64("__words"))).otherwise(
        F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: F.xxhash64(F.slice("__words", i, shingle)))
    )
    kept = F.sort_array(F.array_distinct(F.filter(all_, lambda h: h < below)))
    return df.withColumn(out, F.struct(F.when(n > 0, F.xxhash64("__words")).alias("whole"), kept.alias("hashes"))).drop("__words")


def likeness(a: str, b: str) -> Column:
    """The estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_intersect(f"{a}.hashes", f"{b}.hashes"))
    union = F.size(f"{a}.hashes") + F.size(f"{b}.hashes") - both
    equal = F.col(f"{a}.whole").eqNullSafe(F.col(f"{b}.whole"))
    return F.when(equal, 1.0).when(union == 0, 0.0).otherwise(both / union)


def containment(a: str, b: str) -> Column:
    """The estimated part of a's shingles that b holds; 1 for an a without words, null where a keeps no hash."""
    equal = F.col(f"{a}.whole").eqNullSafe(F.col(f"{b}.whole")) | F.col(f"{a}.whole").isNull()
    return F.when(equal, 1.0).when(F.size(f"{a}.hashes") > 0, F.size(F.array_intersect(f"{a}.hashes", f"{b}.hashes")) / F.size(f"{a}.hashes"))


def compared(a: str) -> Column:
    """How many hashes a containment of a rests on."""
    return F.size(f"{a}.hashes")


def merged(a: Column, b: Column, whole: Column) -> Column:
    """The sketch of two parts together; whole: as of the words of both."""
    return F.struct(whole.alias("whole"), F.sort_array(F.array_distinct(F.concat(a["hashes"], b["hashes"]))).alias("hashes"))


def spelled(sketch: str) -> Column:
    return F.concat(F.coalesce(F.hex(f"{sketch}.whole"), F.lit("")), F.lit(":"), F.array_join(F.transform(f"{sketch}.hashes", lambda h: F.hex(h)), ","))


def neighbours(docs: DataFrame) -> DataFrame:
    """docs: (id, of, n). Gives, per distinct (id, of): prev_id, prev_of, prev_n, of the document whose next one it is, in falling
    order of (id, of), the first following the last. Runs in ranges of the order; only the ranges' ends meet in one task."""
    rows = docs.groupBy("id", "of").agg(F.max("n").alias("n"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = written(rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), "of").withColumn("part", F.spark_partition_id()), "sketch-order")
    here = F.struct("id", "of", "n")
    w = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "of")
    inside = rows.select("*", F.lead(here).over(w).alias("above"))
    ends = rows.groupBy("part").agg(F.min(here).alias("lowest"))
    up = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("lowest").over(up), F.first("lowest").over(up)).alias("over"))
    inside = inside.join(F.broadcast(ends), "part")  # one row per range
    above = F.coalesce("above", "over")
    return inside.select("id", "of", above["id"].alias("prev_id"), above["of"].alias("prev_of"), above["n"].alias("prev_n"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_chars, edited, sketch, edited_sketch, next_sketch), one per row of docs. edited: the text whose last half
    (floor of code points) gives way to as much of the start of the next document."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("of"), "text")
    order = neighbours(base.select("id", "of", F.char_length("text").cast("long").alias("n")))
    repeated = order.count() < base.count()

    same = lambda a, i, o: a["id"].eqNullSafe(i) & (a["of"] == o)
    order = order.select(F.col("id").alias("o_id"), F.col("of").alias("o_of"), "prev_id", "prev_of", "prev_n")
    donors = with_sketch(base.join(order, same(base, order["o_id"], order["o_of"])), "text", "next_sketch")  # sketches are made where they are used: texts travel once
    donors = donors.select("prev_id", "prev_of", F.left("text", F.floor(F.col("prev_n") / 2).cast("int")).alias("head"), "next_sketch")
    if repeated:
        donors = donors.dropDuplicates(["prev_id", "prev_of"])
    pairs = with_sketch(base.join(donors, same(base, donors["prev_id"], donors["prev_of"])), "text", "sketch")
    n = F.char_length("text")
    edited = F.concat(F.left("text", (n - F.floor(n / 2)).cast("int")), F.col("head"))
    pairs = pairs.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return with_sketch(pairs, "edited", "edited_sketch").withColumnRenamed("id", id_col)
