"""The broadcast bit set: members always pass, strangers seldom, its size is bounded."""

from pyspark.sql import functions as F

import weftsample as ws
from weftsample.operators import bitsets
from weftsample.operators.weights import near_keys


def hashed(df):
    return df.withColumn("h", F.xxhash64("id"))


def test_members_pass_and_strangers_seldom(spark):
    members = hashed(spark.range(0, 1_000_000, 10))
    pages = bitsets.bit_set(members, "h", 100_000)
    rows = hashed(spark.range(1_000_000))
    passed = bitsets.members_of(rows, F.col("h"), pages, 100_000)
    assert passed.columns == ["id", "h"]
    found = passed.groupBy((F.col("id") % 10 == 0).alias("member")).count().collect()
    found = {r.member: r["count"] for r in found}
    assert found[True] == 100_000
    assert found[False] < 0.05 * 900_000


def test_a_wrong_estimate_loses_no_member(spark):
    members = hashed(spark.range(5_000))
    pages = bitsets.bit_set(members, "h", 3)
    assert pages.count() == 1
    rows = hashed(spark.range(10_000))
    passed = bitsets.members_of(rows, F.col("h"), pages, 3)
    assert passed.filter("id < 5000").count() == 5_000


def test_empty_set_and_null(spark):
    none = hashed(spark.range(0))
    pages = bitsets.bit_set(none, "h", 0)
    rows = spark.createDataFrame([(1,), (None,)], "h long")
    assert bitsets.members_of(rows, F.col("h"), pages, 0).count() == 0


def test_every_bit_of_a_word_and_negative_hashes(spark):
    rows = spark.range(-70, 70).withColumnRenamed("id", "h")
    for one in (-64, -63, -1, 0, 1, 62, 63, 64):
        pages = bitsets.bit_set(rows.filter(F.col("h") == one), "h", 1)
        passed = bitsets.members_of(rows, F.col("h"), pages, 1)
        assert [r.h for r in passed.collect()] == [one]


def test_size_is_bounded():
    assert bitsets.bits_for(0) == bitsets.WORD_BITS * bitsets.PAGE_WORDS
    assert bitsets.bits_for(10**12) == bitsets.MOST_BITS
    assert 32 * 4_000_000 <= bitsets.bits_for(4_000_000) < 64 * 4_000_000


def test_rows_without_a_partner_go_before_the_shuffle(spark):
    """A tenth of many keys is shared: the guide's buckets are all in use, the bits are not."""
    left = spark.range(2_000_000).select(F.col("id").alias("key"))
    right = spark.range(0, 20_000_000, 10).select(F.col("id").alias("key"))
    counts = ws.shared_key_counts(left, right, "key")
    near = near_keys(left, counts, ["key"], shared=200_000)
    unmatched = near.filter("key % 10 != 0").count()
    assert near.filter("key % 10 = 0").count() == 200_000
    assert unmatched <= 0.05 * 1_800_000


def test_weights_are_the_same_with_and_without_bits(spark):
    left = spark.range(60_000).select((F.col("id") % 50_000).alias("key"), F.col("id").alias("lid"))
    right = spark.range(0, 120_000, 3).select((F.col("id")).alias("key"), F.col("id").alias("rid"))
    counts = ws.shared_key_counts(left, right, "key")
    plain = ws.attach_weights(left, counts, ["key"], "left", ids=["lid"])
    bits = ws.attach_weights(left, counts, ["key"], "left", ids=["lid"], shared=counts.count())
    assert "_words" not in plain._jdf.queryExecution().toString()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, bits.collect()))
