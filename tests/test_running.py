"""Distributed running sums against a sequential loop."""

import random

from pyspark.sql import functions as F

from shoal.operators.running import running_sums, sums_within


def test_sums_over_the_whole_table(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), k, rng.choice([None, 0, 1, 2**40])) for k in range(2000)]
    rng.shuffle(rows)
    have = running_sums(spark.createDataFrame(rows, "at long, id long, n long").repartition(7), ["at", "id"], {"before": F.col("n"), "rank": F.lit(1)}).collect()
    total, want = 0, {}
    for rank, (at, k, n) in enumerate(sorted(rows, key=lambda r: r[:2])):
        want[k] = (total, rank)
        total += n or 0
    assert {r["id"]: (r["before"], r["rank"]) for r in have} == want


def test_sums_within_a_key_that_holds_most_rows(spark):
    rows = [("hot" if k % 3 else f"k{k}", k % 100, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, at long, id long")
    have = sums_within(df, ["key"], ["at", "id"], {"before": F.col("id")})
    totals, want = {}, {}
    for key, _, k in sorted(rows):
        want[k] = totals.get(key, 0)
        totals[key] = want[k] + k
    assert {r["id"]: r["before"] for r in have.collect()} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "key string, id long")
    assert running_sums(df, ["id"], {"n": F.lit(1)}).collect() == sums_within(df, ["key"], ["id"], {"n": F.lit(1)}).collect() == []


def test_no_task_reads_all_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else four small partitions become one
    try:
        rows = running_sums(spark.range(100_000).selectExpr("id % 10 AS at", "id"), ["at", "id"], {"n": F.lit(1)})
        most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 60_000
