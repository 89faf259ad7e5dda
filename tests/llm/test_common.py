from collections import Counter

from pyspark.sql import functions as F

from refgraph.llm.common import bucketed, join_hot, let


def test_join_hot_is_an_inner_join(spark):
    left = spark.createDataFrame([(k % 5 if k % 2 else 0, k) for k in range(60)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}", 30 if k == 0 else 6) for k in range(4)], "k int, name string, n int")
    want = Counter(map(tuple, left.join(right, "k").collect()))
    for least in (0, 10, 100):  # all keys, one, none
        assert Counter(map(tuple, join_hot(left, right, ["k"], F.col("n") > least).collect())) == want


def test_bucketed_tables_join_without_a_shuffle(spark):
    a, b = (bucketed(spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias(name)).dropDuplicates(["k"]), f"test-{name}", "k") for name in "ab")
    both = a.hint("merge").join(b, "k")
    assert both.count() == 50 and not [t for t in spark.catalog.listTables() if t.name.startswith("test_")]
    assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()


def test_let_makes_its_value_once(spark):
    df = spark.range(1).select(let(F.rand(), lambda x: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: x)).alias("same"))
    assert len(set(df.first().same)) == 1
