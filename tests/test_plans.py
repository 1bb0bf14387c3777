"""What the plans read, shuffle and broadcast."""

import re

import pytest

import weftsample as ws

from .conftest import DATA

ON = [("o_custkey", "user_id")]


@pytest.fixture
def plans(monkeypatch):
    """Plans of the tables that a call stores, by name, as they ran."""
    from weftsample.plans import sampling
    from weftsample.sources.sites import stored

    seen = {}

    def watched(df, name):
        df.collect()
        seen[name] = executed(df)
        return stored(df, name)

    monkeypatch.setattr(sampling, "stored", watched)
    return seen


def executed(df):
    final, *initial = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")
    return final, "".join(initial)


def sampled(spark, method="zip", columns=None, **options):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    pairs = ws.join_sample(
        orders, events, ON, 0.05, left_id="o_orderkey", right_id="event_id", method=method,
        **options,
    )
    pairs = pairs.select(*columns) if columns else pairs
    pairs.collect()
    return pairs


def scans(plan, table):
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", plan))


def test_each_table_is_read_once_for_counts_and_once_for_rows(spark, plans):
    final, _ = executed(sampled(spark))
    assert set(plans) == {"counts", "sample-left", "sample-right"}
    counts = plans["counts"][0]
    assert "ReadSchema: struct<o_custkey:bigint>" in counts
    assert "ReadSchema: struct<user_id:bigint>" in counts
    whole = "".join([final, *(p for p, _ in plans.values())])
    assert scans(whole, "orders") == 2 and scans(whole, "events") == 2
    assert not scans(final, "orders")


def test_indexed_numbers_keys_and_ids_and_reads_values_of_picked_rows(spark, plans):
    """Right table: keys for the counts, keys and ids for the numbers, then picked rows."""
    final, _ = executed(sampled(spark, "indexed"))
    assert set(plans) == {"counts", "picks"}
    steps = [final, *(p for p, _ in plans.values())]
    assert sum(scans(p, "orders") for p in steps) == 2
    assert [scans(p, "events") for p in (plans["counts"][0], plans["picks"][0], final)] == [1, 1, 1]
    assert not scans(final, "orders")
    # Neither the scan below the numbering nor its shuffle and window hold a value.
    assert "props" not in plans["picks"][0] and "event_type" not in plans["picks"][0]
    # Of the rows that are read in full, those without a bit go before the shuffle.
    below = final[final.index("FileScan") :] if "FileScan" in final else final
    assert "_words" in final and "props" in below


def test_indexed_without_right_ids_numbers_whole_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a")], "lid long, key string")
    right = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a")], "v string, key string")
    pairs = ws.join_sample(left, right, "key", 400.0, seed=3, left_id="lid", method="indexed")
    found = {r.v: r["count"] for r in pairs.groupBy("v").count().collect()}
    assert 1.7 < found["x"] / found["y"] < 2.3


def test_indexed_with_null_keys_and_ids_of_several_columns(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "lid long, key string")
    right = spark.createDataFrame(
        [(1, None, None, "x"), (1, "q", None, "y"), (1, "q", "a", "z")],
        "n int, m string, key string, v string",
    )
    pairs = ws.join_sample(
        left, right, "key", 300.0, seed=3, left_id="lid", right_id=["n", "m"], method="indexed",
        null_safe=True,
    )
    found = {(r.lid, r.v): r["count"] for r in pairs.groupBy("lid", "v").count().collect()}
    assert set(found) == {(1, "x"), (1, "y"), (2, "z")}
    assert all(240 < n < 360 for n in found.values())


def test_indexed_reads_no_columns_that_are_not_asked_for(spark):
    final, _ = executed(sampled(spark, "indexed", ["o_custkey", "o_orderkey", "event_type"]))
    read = " ".join(re.findall(r"ReadSchema: struct<(.*?)>", final))
    assert "event_type" in read and "props" not in read and "o_totalprice" not in read


@pytest.mark.parametrize("method", ["zip", "indexed"])
def test_no_nested_loops(spark, plans, method):
    final = executed(sampled(spark, method))
    for plan in (*final, *(p for pair in plans.values() for p in pair)):
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "sum(_size" not in final[0]  # with no large key there is nothing to count


def test_python_runs_once_per_side_and_after_the_filter(spark, plans):
    final, _ = executed(sampled(spark))
    assert "EvalPython" not in final
    for side in ("left", "right"):
        plan = plans[f"sample-{side}"][0]
        assert len(re.findall("ArrowEvalPython", plan)) == 1
        assert "EXP(" in plan.split("ArrowEvalPython")[1].split("FileScan")[0]


def test_large_keys_cost_no_second_draw(spark, plans):
    """Numbering in parts reads the stored sample; tables, Python and most shuffles stay."""
    final, _ = executed(sampled(spark, slot_rows=20, part_rows=15))
    assert "sum(_size" in final
    steps = [final, *(p for p, _ in plans.values())]
    assert sum(scans(p, "orders") + scans(p, "events") for p in steps) == 4
    assert sum(len(re.findall("ArrowEvalPython", p)) for p in steps) == 2
    assert sum(len(re.findall("Exchange hashpartitioning", p)) for p in steps) <= 16
    assert len(re.findall("Exchange hashpartitioning", final)) <= 10


def test_rows_are_spread_only_where_one_stands_for_many_copies(spark):
    """With 70,000 copies of a row the blocks are shuffled; all pairs are there."""
    left = spark.createDataFrame([(1, "a"), (2, "b")], "lid long, key string")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "rid long, key string")
    pairs = ws.join_sample(left, right, "key", 70_000.0, seed=1, left_id="lid", right_id="rid")
    found = {r.key: r["count"] for r in pairs.groupBy("key").count().collect()}
    assert set(found) == {"a", "b"} and all(68_000 < n < 72_000 for n in found.values())
    assert "_block" in executed(pairs)[0]


@pytest.mark.parametrize("method", ["zip", "indexed"])
def test_copies_are_not_broadcast(spark, plans, method):
    """A small sample of a hot key stands for many copies; they must not meet on the driver."""
    left = spark.range(60).selectExpr("id as lid", "0 as key")
    right = spark.range(50).selectExpr("id as rid", "0 as key", "'v' as v")
    pairs = ws.join_sample(
        left, right, "key", 3.0, seed=1, left_id="lid", right_id="rid", method=method,
        slot_rows=20, part_rows=15,
    )
    assert 8_000 < pairs.count() < 10_000
    pairs.collect()
    last = "".join(plans["picks"] if method == "indexed" else executed(pairs))
    joins = re.findall(r"(\w+Join) \[[^\]]*(?:slot|_part)#\d+L\], [^\n]*(?:Inner|LeftOuter)", last)
    assert "SortMergeJoin" in joins
    if method == "zip":
        assert "BroadcastExchange" not in last
    assert not re.findall(r"BroadcastHashJoin \[[^\]]*slot#", last)


def test_copies_are_spread_where_there_are_many_in_all():
    from weftsample.operators.draws import COPY_BLOCK, FEW_COPIES, many_copies

    assert not many_copies(None, None) and not many_copies(COPY_BLOCK, FEW_COPIES)
    assert many_copies(COPY_BLOCK + 1, FEW_COPIES) and many_copies(2, FEW_COPIES + 1.0)


def test_copies_are_not_spread_where_every_row_has_few():
    from weftsample.operators.draws import COPIES_A_ROW, COPY_BLOCK, FEW_COPIES, many_copies

    assert not many_copies(COPIES_A_ROW, 50.0 * FEW_COPIES, COPIES_A_ROW)
    assert not many_copies(None, None, COPIES_A_ROW)
    assert many_copies(COPIES_A_ROW + 1, FEW_COPIES + 1.0, COPIES_A_ROW)
    assert many_copies(COPY_BLOCK + 1, 0.0, COPIES_A_ROW)
