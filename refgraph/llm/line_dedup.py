"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; keys under LEAST_CHARS code points are left alone.
Keys stand as two 64-bit hashes. Documents come in batches of falling ids. Each batch is reduced to its keys (documents,
largest id) and merge-joined with the runs so far: keys that no run holds are new, and as ids fall, the batch's largest id is
the one that keeps the line; the others only add to the number of documents. Both make the batch's own run on level 0. A level
with FANOUT runs is compacted, by a merge, to one run of the next level. Keys of LEAST_DOCS documents or more lose all their
lines except in the document that keeps them.

A run is a bucketed table, sorted by hash in each bucket, so that a batch, dealt out by the same hash, meets all runs without
any of them being shuffled. Its name leaves the catalogue at once; its files stay in the working folder. Lines of a key that
more than one part in HEAVY of all lines have find their keeper by broadcast (there are HEAVY such keys at most), all others by
hash.

Nulls: a null text is one empty line. Rows of null id count as one document, below all others. Ties: rows of one id count as one
document; each keeps its own text. Rows that repeat lose the same lines. Very long texts are split whole. An empty table gives
an empty result. Other columns are kept, whatever their names, but for one called line_dedup, which is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, join_hot, lower_ascii, work_dir, written

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
#: Keys of more than one part in so many of all lines find their keeper by broadcast.
HEAVY = 4096


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


class LineRuns:
    """Sorted runs of (h1, h2, docs, keeper, first) in levels. first: this run met the key first and holds its keeper."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def _write(self, rows: DataFrame) -> DataFrame:
        return bucketed(rows.select("h1", "h2", "docs", "keeper", "first"), "line-run", "h1", "h2")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Run by run, a merge join of both."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = (x.select("h1", "h2", *(F.col(c).alias(f"{c}_{side}") for c in ("docs", "keeper", "first"))) for x, side in ((a, "a"), (b, "b")))
            return a.hint("merge").join(b, ["h1", "h2"], "full").select(
                "h1", "h2", (F.coalesce("docs_a", F.lit(0)) + F.coalesce("docs_b", F.lit(0))).alias("docs"), F.greatest("keeper_a", "keeper_b").alias("keeper"),
                (F.coalesce("first_a", F.lit(False)) | F.coalesce("first_b", F.lit(False))).alias("first"),
            )

        return reduce(merge, runs)

    def read(self) -> DataFrame:
        """All runs merged: one row per key."""
        return self._merged(self.runs())

    def marked(self, keys: DataFrame) -> DataFrame:
        """Adds seen to keys: whether a run holds the key."""
        keys = keys.withColumn("seen", F.lit(False))
        for run in self.runs():
            known = run.where("first").select("h1", "h2", F.lit(True).alias("here"))
            keys = keys.hint("merge").join(known, ["h1", "h2"], "left").withColumn("seen", F.col("seen") | F.coalesce("here", F.lit(False))).drop("here")
        return keys

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys that no run holds."""
        return self.marked(keys).where("not seen").drop("seen")

    def add(self, keys: DataFrame) -> None:
        """keys: (h1, h2, docs, keeper), one row per key of a batch whose ids are all below those of the batches before."""
        own = self.marked(keys).withColumns({"keeper": F.when(~F.col("seen"), F.col("keeper")), "first": ~F.col("seen")}).drop("seen")
        self._place(self._write(own), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            self._place(merged, level + 1)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, heavy: int = HEAVY) -> DataFrame:
    """The rows and columns of docs with dropped lines cut from text_col, and last a struct line_dedup (n_lines before, n_dropped);
    a column of that name is replaced. Ids are numbers, as batches are cut at quantiles of them."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("of"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars).select("id", "of", "pos", *_hashes(F.col("key")))

    cuts = docs.agg(F.percentile_approx(f"`{id_col}`", [(batches - k) / batches for k in range(1, batches)], 10_000)).first()[0] or []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.coalesce(F.col("id") <= F.lit(cut), F.lit(True)).cast("int")
    path = work_dir(spark, "line-keys")
    keys.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("id {}, of long, pos int, h1 long, h2 long, batch int".format(docs.schema[id_col].dataType.simpleString())).parquet(path)

    runs = LineRuns(spark)
    for k in range(len(cuts) + 1):
        once = keys.where(F.col("batch") == k).select("h1", "h2", "id").distinct()
        runs.add(once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper")))
    common = written(runs.read().where(F.col("docs") >= least_docs).select("h1", "h2", "docs", "keeper"), "line-common")
    hot = F.col("docs") * heavy > F.lit(keys.count())  # fewer than `heavy`, as a document has a key in one line at least
    dropped = join_hot(keys, common, ["h1", "h2"], hot)
    dropped = dropped.where(~F.col("id").eqNullSafe(F.col("keeper")))
    dropped = dropped.groupBy(F.col("id").alias("of_id"), "of").agg(F.collect_set("pos").alias("dropped"))

    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    of_doc = lambda c: F.col("doc").getField(c)
    marked = docs.select(doc).withColumns({"id": of_doc(id_col), "text_of": F.xxhash64(of_doc(text_col))})
    found = marked.join(dropped, marked["id"].eqNullSafe(dropped["of_id"]) & (marked["text_of"] == dropped["of"]), "left")
    split = found.select("doc", F.split(F.coalesce(of_doc(text_col), F.lit("")), "\n", -1).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped"), lambda k: F.get("lines", k))
    text = F.when(F.size("dropped") == 0, F.coalesce(of_doc(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    counts = F.struct(F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped")).alias("line_dedup")
    return split.select(*((text if c == text_col else of_doc(c)).alias(c) for c in docs.columns if c != "line_dedup"), counts)
