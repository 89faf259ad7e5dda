"""Following a stream of source files: an extension; the batch plan is refgraph.plans.project.

Each micro-batch of (file, content) is parsed and the parsed rows replace those of the same file in a keyed table of parsed
modules. Findings are then those of the batch plan over that table, so a stream of all files ends where one scan does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refgraph.plans.project import PARSED, Scan, analyze, nested_packages, parse_sources, with_unlisted
from refgraph.sources.config import ProjectConfig
from refgraph.sources.listing import all_files


class Rescan:
    """The parsed modules so far, as a table of epochs in the folder; one of the same folder goes on where another ended."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], PARSED).write.mode("ignore").parquet(self._of(-1))  # so that there is a table to read

    def _of(self, epoch: int) -> str:
        return f"{self.folder}/parsed/epoch={epoch}"

    def add(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch: parses a batch; the later of two rows for a file counts. A repeated epoch changes nothing."""
        parse_sources(batch).write.mode("overwrite").parquet(self._of(epoch))

    def parsed(self) -> DataFrame:
        rows = self.spark.read.schema(f"{PARSED}, epoch long").parquet(f"{self.folder}/parsed")
        latest = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("epoch")))
        return rows.withColumn("__n", latest).where("__n = 1").drop("__n", "epoch")

    def scan(self, config: ProjectConfig, disk: DataFrame | None = None) -> Scan:
        """disk: (path) of every file that imports can resolve to; without it the parsed files and what lies on the disk, as in a scan."""
        parsed, files = self.parsed(), []
        if disk is None:
            files = all_files(config.root)
            listed = self.spark.createDataFrame([(p,) for p in files], "path string")
            disk = with_unlisted(listed.union(parsed.select("file")).distinct(), parsed, config)
        return analyze(parsed, disk, config, nested_packages(files))


def follow(source: DataFrame, rescan: Rescan, checkpoint: str | None = None):
    """Starts the stream of (file, content) rows into rescan; the query's handle."""
    at = checkpoint or f"{rescan.folder}/log-{uuid.uuid4().hex}"
    return source.writeStream.foreachBatch(rescan.add).option("checkpointLocation", at).trigger(availableNow=True).start()
