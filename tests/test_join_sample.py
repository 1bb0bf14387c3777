import pytest
from pyspark.sql import functions as F

import weftsample as ws

from .conftest import rows_of

METHODS = ["zip", "indexed"]


def sample(left, right, fraction=0.05, **options):
    options = {"seed": 3, "left_id": "o_orderkey", "right_id": "event_id"} | options
    return ws.join_sample(left, right, [("o_custkey", "user_id")], fraction, **options)


def by_hand(hand, fraction, **options):
    options = {"seed": 1, "left_id": "lid", "right_id": "rid"} | options
    return ws.join_sample(*hand, "key", fraction, **options)


@pytest.mark.parametrize("method", METHODS)
def test_pairs_are_pairs_of_the_join(orders, events, method):
    pairs = sample(orders, events, method=method)
    assert pairs.columns == ["o_custkey", "o_orderkey", "event_id"]
    join = orders.join(events, orders.o_custkey == events.user_id)
    keys = ["o_custkey", "o_orderkey", "event_id"]
    assert pairs.count() > 100
    assert pairs.join(join.select(*keys), keys, "left_anti").count() == 0


@pytest.mark.parametrize("method", METHODS)
def test_seed_decides(orders, events, method):
    once, again = sample(orders, events, method=method), sample(orders, events, method=method)
    other = sample(orders, events, method=method, seed=4)
    assert rows_of(once) == rows_of(again) != rows_of(other)


@pytest.mark.parametrize("method", METHODS)
def test_result_does_not_depend_on_how_large_keys_are_cut(orders, events, method):
    whole = rows_of(sample(orders, events, 0.3, method=method))
    cut = sample(orders, events, 0.3, method=method, slot_rows=7, part_rows=3)
    assert rows_of(cut) == whole


@pytest.mark.parametrize("method", METHODS)
def test_result_does_not_depend_on_layout(spark, orders, events, method):
    whole = rows_of(sample(orders, events, method=method))
    scattered = orders.repartition(13, F.rand(1)), events.repartition(5, F.rand(2))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    try:
        for partitions, adaptive in (("1", "true"), ("64", "false"), ("8", "true")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            assert rows_of(sample(*scattered, method=method)) == whole
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("method", METHODS)
def test_one_key_with_most_rows(spark, method):
    """One key has 10,000 x 3 rows, and each of its right rows draws many copies."""
    left = spark.range(12_000).selectExpr("id as lid", "if(id < 10000, 0, id) as key")
    right = spark.range(9_000).selectExpr("id as rid", "if(id < 3, 0, id + 2000) as key")
    cut = dict(slot_rows=100, part_rows=100)
    options = dict(seed=5, left_id="lid", right_id="rid", method=method)
    pairs = ws.join_sample(left, right, "key", 0.5, **options, **cut)
    whole = ws.join_sample(left, right, "key", 0.5, **options)
    assert rows_of(pairs) == rows_of(whole)
    hot = pairs.filter("key = 0")
    assert 13_500 < hot.count() < 16_000
    assert hot.select("rid").distinct().count() == 3


@pytest.mark.parametrize("method", METHODS)
def test_zero_fraction_is_empty(hand, method):
    assert by_hand(hand, 0, method=method).count() == 0


@pytest.mark.parametrize("method", METHODS)
def test_fraction_above_one_repeats_rows(hand, method):
    pairs = by_hand(hand, 50.0, method=method)
    a = pairs.filter("key = 'a'")
    assert 200 < a.count() < 400
    assert a.distinct().count() == 6


def test_unmatched_keys_and_nulls_give_nothing(hand):
    keys = {r.key for r in by_hand(hand, 20.0).collect()}
    assert keys == {"a", "b"}


@pytest.mark.parametrize("method", METHODS)
def test_null_safe_pairs_nulls(hand, method):
    pairs = by_hand(hand, 20.0, null_safe=True, method=method)
    assert {r.key for r in pairs.collect()} == {"a", "b", None}
    nulls = {(r.lid, r.rid) for r in pairs.filter("key is null").collect()}
    assert nulls == {(7, 18), (7, 19)}
    cut = by_hand(hand, 20.0, null_safe=True, method=method, slot_rows=4, part_rows=1)
    assert rows_of(cut) == rows_of(pairs)


@pytest.mark.parametrize("method", METHODS)
def test_empty_and_disjoint_inputs(hand, method):
    left, right = hand
    assert by_hand((left.limit(0), right), 1.0, method=method).count() == 0
    apart = right.withColumn("key", F.concat(F.lit("x"), "key"))
    assert by_hand((left, apart), 1.0, method=method).count() == 0


@pytest.mark.parametrize("method", METHODS)
def test_rows_without_ids(spark, method):
    """Equal rows fold into one draw and still count as many rows."""
    left = spark.createDataFrame([("k", "x")] * 60 + [("k", "y")] * 20, "key string, v string")
    right = spark.createDataFrame([("k", "p")] * 30 + [("k", "q")] * 10, "key string, v string")
    pairs = ws.join_sample(left, right, "key", 1.0, seed=2, method=method)
    assert pairs.columns == ["key", "v_1", "v_2"]
    counts = {(r.v_1, r.v_2): r["count"] for r in pairs.groupBy("v_1", "v_2").count().collect()}
    total = sum(counts.values())
    assert total == pytest.approx(3200, abs=300)
    assert counts["x", "p"] / total == pytest.approx(9 / 16, abs=0.05)
    assert counts["y", "q"] / total == pytest.approx(1 / 16, abs=0.03)
    cut = ws.join_sample(left, right, "key", 1.0, seed=2, method=method, slot_rows=50, part_rows=5)
    assert rows_of(cut) == rows_of(pairs)


def test_several_keys_and_suffixes(spark):
    left = spark.createDataFrame([(1, "a", "l1"), (1, "b", "l2")], "x int, y string, v string")
    right = spark.createDataFrame([(1, "a", "r1"), (1, "c", "r2")], "x int, z string, v string")
    pairs = ws.join_sample(
        left, right, ["x", ("y", "z")], 30.0, left_id="v", right_id="v", suffixes=("_l", "_r")
    )
    assert pairs.columns == ["x", "y", "v_l", "v_r"]
    assert set(map(tuple, pairs.collect())) == {(1, "a", "l1", "r1")}


def test_key_as_id(spark):
    left = spark.createDataFrame([(1,), (2,)], "a int")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "b int, v string")
    pairs = ws.join_sample(left, right, [("a", "b")], 20.0, left_id="a", right_id="b")
    assert set(map(tuple, pairs.collect())) == {(1, "x")}


@pytest.mark.parametrize("fraction", [-0.1, float("nan"), float("inf")])
def test_bad_fractions(hand, fraction):
    with pytest.raises(ValueError, match="fraction"):
        by_hand(hand, fraction)


def test_bad_arguments(hand):
    left, right = hand
    with pytest.raises(ValueError, match="method"):
        by_hand(hand, 0.1, method="other")
    with pytest.raises(ValueError, match="no key column"):
        ws.join_sample(left, right, "nope", 0.1)
    with pytest.raises(ValueError, match="id columns"):
        ws.join_sample(left, right, "key", 0.1, left_id="nope")
    with pytest.raises(ValueError, match="reserved"):
        ws.join_sample(left.withColumn("weight", F.lit(1)), right, "key", 0.1)
    with pytest.raises(ValueError, match="not distinct"):
        ws.join_sample(left.withColumnRenamed("lid", "v"), right.withColumnRenamed("rid", "v"),
                       "key", 0.1, suffixes=("_1", "_1"))


@pytest.mark.parametrize("method", ["zip", "indexed"])
@pytest.mark.parametrize("types", ["int bigint", "float double", "decimal(9,2) bigint"])
def test_keys_of_unequal_type_meet(spark, types, method):
    """The pairs are those of a join, as often as a fraction above 1 draws them."""
    one, other = types.split()
    left = spark.range(60).selectExpr("id as lid", f"cast(id % 3 as {one}) as key")
    right = spark.range(60).selectExpr("id as rid", f"cast(id % 3 as {other}) as key")
    pairs = ws.join_sample(left, right, "key", 0.5, seed=3, left_id="lid", right_id="rid", method=method)
    found = pairs.collect()
    assert len(found) > 400
    assert all(r.lid % 3 == r.rid % 3 for r in found)


def test_collated_keys_meet(spark):
    left = spark.range(60).selectExpr("id as lid", "if(id % 2 = 0, 'a', 'A') collate UTF8_LCASE as key")
    right = spark.range(60).selectExpr("id as rid", "'A' collate UTF8_LCASE as key")
    pairs = ws.join_sample(left, right, "key", 0.5, seed=3, left_id="lid", right_id="rid")
    assert pairs.count() > 1500


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("null_safe", [False, True])
def test_names_with_dots_and_backticks(hand, method, null_safe):
    left, right = hand
    left = left.withColumnsRenamed({"key": "a.key", "lid": "l`id"}).withColumn("v.x", F.lit(1))
    right = right.withColumnsRenamed({"key": "b.key", "rid": "r.id"}).withColumn("v.x", F.lit(2))
    pairs = ws.join_sample(
        left, right, [("a.key", "b.key")], 20.0, seed=1, left_id="l`id", right_id="r.id",
        method=method, null_safe=null_safe, slot_rows=4, part_rows=2,
    )
    assert pairs.columns == ["a.key", "l`id", "v.x_1", "r.id", "v.x_2"]
    plain = by_hand(hand, 20.0, method=method, null_safe=null_safe)
    assert rows_of(pairs.select("`a.key`", "`l``id`", "`r.id`")) == rows_of(plain)
    ids = ws.join_sample(left, right, [("a.key", "b.key")], 1.0, method=method)
    assert ids.columns == pairs.columns and ids.count() > 0
