import random
from collections import Counter

from pyspark.sql import Window as W, functions as F

from riskloom.operators import spread


def test_joins_keep_every_row(spark):
    """Hot keys on either side, one and many cells, one and many salts."""
    r = random.Random(3)
    big = [(0 if r.random() < 0.4 else r.randint(1, 30), i) for i in range(3000)]
    other = [(1 if r.random() < 0.4 else r.randint(0, 30), f"o{j}") for j in range(300)]
    a = spark.createDataFrame(big, "k int, i int")
    b = spark.createDataFrame(other, "k int, o string")
    want = Counter(tuple(x) for x in a.join(b, "k").collect())
    for block in (7, 100, 10**6):
        assert Counter(tuple(x) for x in spread.skew_join(a, b, ["k"], ["i"], ["o"], block).collect()) == want
        assert Counter((x.k, x.i, x.o) for x in spread.skew_join(b, a, ["k"], ["o"], ["i"], block).collect()) == want
    for salts in (1, 5, 16):
        assert Counter(tuple(x) for x in spread.spread_join(a, b, ["k"], ["i"], salts).collect()) == want


def test_hot_keys_are_cut_on_both_sides(spark):
    a = spark.range(1000).selectExpr("1 as k", "id as i")
    b = spark.range(500).selectExpr("1 as k", "id as j")
    met = spread.skew_join(a, b, ["k"], ["i"], ["j"], 100)
    assert met.count() == 500_000
    assert "InMemory" not in met._jdf.queryExecution().toString()


def test_few_rows_that_make_many_are_dealt_over_tasks(spark):
    """Both sides are small and come out of a shuffle: Spark would put all their keys together in one task."""
    a = spark.range(600).selectExpr("id % 6 as k", "id as i").distinct()
    b = spark.range(300).selectExpr("id % 6 as k", "id as j").distinct()
    met = spread.skew_join(a, b, ["k"], ["i"], ["j"], 20).withColumn("task", F.spark_partition_id())
    per_task = [r["count"] for r in met.groupBy("task").count().collect()]
    assert sum(per_task) == 600 * 50 and len(per_task) > 1 and max(per_task) < 600 * 50 * 0.6


def test_numbering_of_a_hot_key_matches_the_window(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i % 11 or None, i % 5) for i in range(2000)]  # full of copies
    df = spark.createDataFrame(rows, "k string, a int, b int")
    want = Counter(tuple(r) for r in df.withColumn("n", F.row_number().over(
        W.partitionBy("k").orderBy("a", "b"))).collect())
    assert Counter(tuple(r) for r in spread.number_within(df, ["k"], ["a", "b"], "n").collect()) == want
    one = Counter((r.k, r.a, r.n) for r in spread.number_within(df.drop("b"), ["k"], ["a"], "n").collect())
    assert sum(one.values()) == 2000 and max(n for _, _, n in one) == sum(1 for r in rows if r[0] == "hot")


def test_rows_below_is_exact(spark):
    r = random.Random(5)
    values = [r.choice([0, 0, 7, -3, 2**21, 2**45 + 1, r.randint(-10**9, 10**15)]) for _ in range(500)]
    got = {x["v"]: (x["n"], x["below"]) for x in
           spread.rows_below(spark.createDataFrame([(v,) for v in values], "v bigint"), "v").collect()}
    assert got == {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}
