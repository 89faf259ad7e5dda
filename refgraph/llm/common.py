"""What the operators of this package share: text rules, working folders, written tables."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.operators.tables import shared_dir, work_dir, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The code points that part words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

def lower_ascii(text: Column) -> Column:
    """A-Z only. Texts of ASCII alone take the fast path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; none for null or white space alone."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value made once, however often body and the functions in it refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Cuts lineage: the rows as a table in buckets of keys, sorted by them, so that joins by keys don't shuffle it. The table's
    name leaves the catalogue at once; as it has a path, its files stay in the shared folder."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    table, buckets = path.rpartition("/")[2].replace("-", "_"), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """The inner join of left with right, which has a row for a key at most. hot: of right, keys that many rows of left have; their
    number must be bounded, as they are broadcast, so that the rows of one key needn't meet in a task."""
    often = F.broadcast(right.where(hot))
    return left.join(often, keys).unionByName(left.join(often.select(*keys), keys, "left_anti").join(right.where(~hot), keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_value(module: str) -> None:
    """Functions of the module go to executors as they are, so the package needn't be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
