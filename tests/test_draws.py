from pyspark.sql import functions as F

import weftsample as ws

from .conftest import rows_of


def test_copies_of_one_row_are_all_there(spark):
    """More copies than one block, and rows with a single copy beside it."""
    rows = spark.createDataFrame([(1, 200_000), (2, 1), (3, 65_536), (4, 65_537)], "id int, copies long")
    for spread in (None, ["id"]):
        found = (
            ws.expand_copies(rows, spread_by=spread)
            .groupBy("id")
            .agg(F.count("*"), F.countDistinct("copy"), F.min("copy"), F.max("copy"))
        )
        assert sorted(map(tuple, found.collect())) == [
            (1, 200_000, 200_000, 1, 200_000),
            (2, 1, 1, 1, 1),
            (3, 65_536, 65_536, 1, 65_536),
            (4, 65_537, 65_537, 1, 65_537),
        ]


def test_blocks_of_one_row_go_to_several_partitions(spark):
    one = spark.createDataFrame([(1, 2_000_000)], "id int, copies long")
    parts = ws.expand_copies(one, spread_by=["id"]).select(F.spark_partition_id().alias("p"))
    assert parts.distinct().count() > 3


def test_early_drop_changes_nothing(orders, events):
    """Draws with and without the bound that drops rows before the shuffle."""
    left = orders.withColumnsRenamed({"o_orderkey": "id", "o_custkey": "key"})
    right = events.withColumnsRenamed({"event_id": "id", "user_id": "key"})
    counts = ws.shared_key_counts(left, right, "key")
    for fraction in (0.001, 0.05, 2.0):
        how = ws.Settings(["key"], fraction, 11)
        early = ws.site_samples(left, counts, how, "left", ["id"])
        weighted = ws.attach_weights(left, counts, ["key"], "left", ids=["id"])
        late = ws.poisson_draws(weighted, fraction, ids=["id"], side="left", seed=11)
        columns = ["id", "key", "weight", "own_count", "copies"]
        assert sorted(early.select(columns).collect()) == sorted(late.select(columns).collect())
        assert early.columns == late.columns


def test_large_weights_that_overflow_a_product(spark):
    """n_left * n_right may exceed a BIGINT."""
    counts = spark.createDataFrame([("k", 4 * 10**9, 5 * 10**9)], "key string, n_left long, n_right long")
    rows = spark.range(1000).selectExpr("id", "'k' as key")
    how = ws.Settings(["key"], 1e-9, 1)
    sample = ws.site_samples(rows, counts, how, "left", ["id"])
    total = sample.agg(F.sum("copies")).collect()[0][0]
    assert abs(total - 5000) < 5 * 5000**0.5
    assert sample.filter(how.is_large("own_count", "weight")).count() == sample.count()


def test_poisson_cdf_rows(spark):
    weights = spark.createDataFrame([(1,), (1,), (40,), (10**6,)], "weight long")
    cdf = ws.poisson_cdf(weights, 0.5)
    ends = {r.weight: (r.low, r.high, r.top) for r in cdf.groupBy("weight").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("cdf").alias("top")).collect()}
    assert ends[1][0] == 0 and ends[40][0] == 0
    assert 480_000 < ends[10**6][0] < 500_000 < ends[10**6][1] < 520_000
    assert {top for *_, top in ends.values()} == {1.0}
    assert ws.poisson_cdf(weights, 0).filter("n = 0 and cdf = 1").count() == 3


def test_rows_without_copies_give_none(spark):
    rows = spark.createDataFrame([(1, 0), (2, 2)], "id long, copies long")
    assert rows_of(ws.expand_copies(rows).select("id", "copy")) == [(2, 1), (2, 2)]
