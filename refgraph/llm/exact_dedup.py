"""Exact deduplication as a stateful stream.

Every row is reduced to a digest of its normalised text. A streaming aggregation without watermark keeps, per digest, the
number of rows and the row that stays (the largest id) with the place of its content (file and row). The state lives in
RocksDB on the executors' disks with its log in the checkpoint folder, so it is never held in memory as a whole, never
expires, and later batches continue it. Where a digest was hit more than once, the full texts are compared; digests that
stand for different texts are split by text.

Rows meet the state and each other by digest. A digest with more than one row in HEAVY has its rows dealt out over as many
salts; there are HEAVY such digests at most, which are broadcast. Only texts that were hit take part in a comparison.

Nulls: a null text counts as empty. A null id never stays while its group has an id. Ties: of rows with the largest id one
stays, that of the last file and row. Very long texts are compared whole. Rows that repeat, ids included, count one by one and
exactly one stays. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, work_dir, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A digest with more than one part in so many of all rows is dealt out over as many tasks.
HEAVY = 1024


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per input row: id, norm, digest, and the place (file, row) of its content."""
    at = df.metadataColumn("_metadata")  # whatever columns the table has
    return df.select(
        F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"), at.getField("file_path").alias("file"), at.getField("row_index").alias("row")
    ).withColumn("digest", digest(F.col("norm")))


class DedupState:
    """The keyed state of all texts seen. ingest() may be called again when files were added; it reads the new ones only."""

    def __init__(self, spark: SparkSession, state_dir: str | None = None, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.dir, self.digest = spark, state_dir or work_dir(spark, "dedup-state"), digest
        self.id_col, self.text_col = id_col, text_col

    def _session(self) -> SparkSession:
        session = self.spark.newSession()
        for key, value in {
            "spark.sql.shuffle.partitions": self.spark.conf.get("spark.sql.shuffle.partitions"),
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
            "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
            "spark.sql.streaming.noDataMicroBatches.enabled": "false",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores
        }.items():
            session.conf.set(key, value)
        return session

    def ingest(self, path: str, max_bytes: int = 64 << 30, max_files: int | None = None) -> None:
        batch, stream = self.spark.read.parquet(path), self._session()
        limit = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", str(max_bytes))
        source = stream.readStream.schema(batch.schema).option(*limit)
        folder, _, name = path.rstrip("/").rpartition("/")
        if any(file.rpartition("/")[2] == name for file in batch.inputFiles()):  # one file; streams read folders
            source = source.option("pathGlobFilter", name).parquet(folder)
        else:
            source = source.parquet(path)
        rows = _rows(source, self.id_col, self.text_col, self.digest).select("digest", F.struct("id", "file", "row").alias("place"))
        state = rows.groupBy("digest").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.dir).trigger(availableNow=True).start()
        run.awaitTermination()

    def read(self, id_type: T.DataType) -> DataFrame:
        """The state as rows of a written table: digest, keep (id, file, row), n."""
        raw = self._session().read.format("statestore").load(self.dir)
        place, count = (f"value.`{name}`" for name in raw.schema["value"].dataType.names)
        keep = T.StructType([T.StructField("id", id_type), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
        rows = raw.select(F.col("key").getField(raw.schema["key"].dataType.names[0]).alias("digest"), F.col(place).cast(keep).alias("keep"), F.col(count).alias("n"))
        out = work_dir(self.spark, "dedup-kept")
        rows.write.parquet(out)
        return self.spark.read.schema(rows.schema).parquet(out)


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: DedupState | None = None, max_files: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """Rows (id_col, keep_id, group_size, kept, digest, text_sha256), one per row of the Parquet table at path."""
    docs = spark.read.parquet(path)
    state = state or DedupState(spark, digest=digest, id_col=id_col, text_col=text_col)
    state.ingest(path, max_files=max_files)
    kept = state.read(docs.schema[id_col].dataType)
    total = kept.agg(F.sum("n")).first()[0] or 0
    hot = kept.where(F.col("n") * heavy > total).select("digest", F.lit(True).alias("hot"))  # fewer than `heavy`
    salts = F.when(F.col("n") * heavy > total, F.sequence(F.lit(0), F.lit(heavy - 1))).otherwise(F.array(F.lit(0)))
    kept = kept.withColumn("salt", F.explode(salts))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("file", "row"), F.lit(heavy))).otherwise(F.lit(0)).cast("int")
    rows = _rows(docs, id_col, text_col, digest).join(F.broadcast(hot), "digest", "left").withColumn("salt", salt)

    # the texts of a digest are one if the least and the largest are
    hits = kept.where("n > 1").select("digest", "salt")
    texts = rows.select("digest", "salt", "hot", "norm").join(hits, ["digest", "salt"], "left_semi")
    texts = texts.groupBy("digest", "salt").agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.bool_or("hot").alias("hot"))
    once = texts.where("hot is null and low <> high").select("digest")
    dealt = texts.where("hot").groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("digest")
    clashing = written(once.union(dealt), "dedup-clashes")

    def result(part: DataFrame) -> DataFrame:
        stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        whole = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
        return part.select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.col("digest"), whole.alias("text_sha256"))

    if clashing.isEmpty():
        return result(rows.join(kept, ["digest", "salt"]))
    split = rows.join(clashing, "digest", "left_semi")
    groups = split.groupBy("digest", "norm").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    return result(rows.join(clashing, "digest", "left_anti").join(kept, ["digest", "salt"])).union(result(split.join(groups, ["digest", "norm"])))
