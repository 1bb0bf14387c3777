"""Entry points of the driver: a flagship query, all queries, and their SQL twins."""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries as oracle  # noqa: E402
import weftsample as ws  # noqa: E402
from weftsample.plans import jobs  # noqa: E402
from weftsample.plans.report import Shipment, site_transfer_report  # noqa: E402
from weftsample.sources import sites as files  # noqa: E402
from weftsample.sources import synth  # noqa: E402

try:
    import corpus_pipeline  # noqa: E402
    from weftsample.llm import queries as llm  # noqa: E402
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("corpus_pipeline", "weftsample.llm")):
        raise
    llm = None

SEED, SITES, FRACTION = oracle.SEED, oracle.SITES, oracle.FRACTION
ON = [("o_custkey", "user_id")]
ORDER_COLUMNS = ("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
#: Sizes at which a key of the test tables is cut into parts, as at scale.
SPLIT = dict(slot_rows=20, part_rows=15)
EVENT_COLUMNS = ("user_id", "event_id", "event_type", "value")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: a sample of orders JOIN events."""
    return _join_sample(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if llm is None:
        return own_queries()
    return own_queries() | llm.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    if llm is None:
        return oracle.all_queries()
    sql = oracle.all_queries() | llm.ORACLE_SQL
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "key_frequencies": _key_frequencies,
        "shared_key_counts": _shared_key_counts,
        "weighted_rows": _weighted_rows,
        "poisson_cdf": _poisson_cdf,
        "poisson_draws": _poisson_draws,
        "expand_copies": _expand_copies,
        "join_sample": _join_sample,
        "join_sample_mixed_types": _join_sample_mixed_types,
        "join_sample_hot_key": _join_sample_hot_key,
        "join_sample_hot_key_split": functools.partial(_join_sample_hot_key, **SPLIT),
        "join_sample_indexed": functools.partial(_join_sample, method="indexed"),
        "join_sample_indexed_split": functools.partial(_join_sample, method="indexed", **SPLIT),
        "join_sample_chain": _join_sample_chain,
        "join_sample_chain_split": functools.partial(_join_sample_chain, **SPLIT),
        "join_sample_star": _join_sample_star,
        "site_scan": _site_scan,
        "site_scan_events": functools.partial(_site_scan, table="events", id_="event_id"),
        "site_key_frequencies": _site_key_frequencies,
        "merged_key_frequencies": _merged_key_frequencies,
        "site_samples": _site_samples,
        "union_sites": _union_sites,
        "federated_join_sample": _federated_join_sample,
        "federated_phases": _federated_phases,
        "site_transfer_report": _site_transfer_report,
        "synth_keys": _synth_keys,
        "synth_uniform": functools.partial(_synth_both, make=synth.synth_uniform),
        "synth_sliced": functools.partial(_synth_both, make=synth.synth_sliced),
        "synth_zipf": _synth_zipf,
        "synth_mixed": _synth_mixed,
        "csv_roundtrip": _csv_roundtrip,
    }


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(*EVENT_COLUMNS)


def _with_site(df: DataFrame, id_: str) -> DataFrame:
    return df.withColumn("site", (F.col(id_) % SITES).cast("int"))


def _sides(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders and events as ``id, key``."""
    return {
        "left": _orders(spark, sf_dir).selectExpr("o_orderkey as id", "o_custkey as key"),
        "right": _events(spark, sf_dir).selectExpr("event_id as id", "user_id as key"),
    }


def _stack(parts: dict[str, DataFrame], name: str) -> DataFrame:
    return ws.union_sites(parts, site=name)


def _counts(sides: dict[str, DataFrame]) -> DataFrame:
    return ws.shared_key_counts(sides["left"], sides["right"], "key")


def _key_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {}
    for table, column in (
        ("orders", "o_custkey"),
        ("events", "user_id"),
        ("lineitem", "l_partkey"),
        ("lineitem", "l_suppkey"),
    ):
        rows = _table(spark, sf_dir, table).withColumnRenamed(column, "key")
        parts[f"{table}.{column}"] = ws.key_frequencies(rows, "key", name="n")
    return _stack(parts, "source")


def _shared_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(_sides(spark, sf_dir))


def _weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    counts = _counts(sides)
    return _stack(
        {
            side: ws.attach_weights(rows, counts, ["key"], side, ids=["id"]).drop("own_count")
            for side, rows in sides.items()
        },
        "side",
    )


def _poisson_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(_sides(spark, sf_dir))
    weights = counts.selectExpr("explode(array(n_left, n_right)) as weight")
    cdf = ws.poisson_cdf(weights, FRACTION)
    return cdf.selectExpr("weight", "n", "cast(floor(cdf * 1e9D + 0.5D) as bigint) as cdf_e9")


def _samples(sides: dict[str, DataFrame], fraction: float = FRACTION) -> dict[str, DataFrame]:
    how = ws.Settings(["key"], fraction, SEED)
    counts = _counts(sides)
    return {side: ws.site_samples(rows, counts, how, side, ["id"]) for side, rows in sides.items()}


def _poisson_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    counts = _counts(sides)
    drawn = {}
    for side, rows in sides.items():
        weighted = ws.attach_weights(rows, counts, ["key"], side, ids=["id"])
        sample = ws.poisson_draws(weighted, FRACTION, ids=["id"], side=side, seed=SEED)
        drawn[side] = sample.select("id", "key", "weight", "copies")
    return _stack(drawn, "side")


def _expand_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(_sides(spark, sf_dir))
    return _stack(
        {
            side: ws.expand_copies(sample, spread_by=["id"]).select("id", "key", "copy")
            for side, sample in samples.items()
        },
        "side",
    )


def _join_sample(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _sampled(_orders(spark, sf_dir), _events(spark, sf_dir), **options)


def _sampled(orders: DataFrame, events: DataFrame, **options) -> DataFrame:
    ids = dict(left_id="o_orderkey", right_id="event_id")
    return ws.join_sample(orders, events, ON, FRACTION, seed=SEED, **ids, **options)


def _join_sample_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An INT key meets a BIGINT key."""
    orders = _orders(spark, sf_dir)
    orders = orders.withColumn("o_custkey", orders.o_custkey.cast("int"))
    return _sampled(orders, _events(spark, sf_dir))


def _join_sample_hot_key(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """One key holds a third of the rows of both tables."""
    return ws.join_sample(
        _orders(spark, sf_dir).selectExpr(
            "o_orderkey", "if(o_orderkey % 3 = 0, 0L, o_custkey) as key"
        ),
        _events(spark, sf_dir).selectExpr("event_id", "if(event_id % 3 = 0, 0L, user_id) as key"),
        "key",
        oracle.HOT_FRACTION,
        seed=SEED,
        left_id="o_orderkey",
        right_id="event_id",
        **options,
    )


def _around_customer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[ws.Branch]]:
    """customer, and suppliers of its nation, its orders and its events."""
    tables = [*oracle.CHAIN, ("events", "event_id", "user_id", "c_custkey")]
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), [
        ws.Branch(_table(spark, sf_dir, name).select(id_, key), [(own, key)], id_)
        for name, id_, key, own in tables
    ]


def _join_sample_chain(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """suppliers - customers of the same nation - their orders."""
    customer, (supplier, orders, _) = _around_customer(spark, sf_dir)
    return ws.join_sample_chain(
        supplier.rows,
        customer,
        orders.rows,
        supplier.on,
        orders.on,
        FRACTION,
        seed=SEED,
        left_id=supplier.id,
        middle_id="c_custkey",
        right_id=orders.id,
        **options,
    )


def _join_sample_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, branches = _around_customer(spark, sf_dir)
    return ws.join_sample_star(
        customer, branches, oracle.HOT_FRACTION, seed=SEED, middle_id="c_custkey"
    )


def _site_files(spark: SparkSession, sf_dir: str, table: str = "orders", id_: str = "o_orderkey"):
    """A whole table, written as one CSV path per site; returns prefix and schema."""
    rows = _table(spark, sf_dir, table)
    folder = files.scratch_folder(spark, "sites")
    prefix = files.write_sites(_with_site(rows, id_), folder, table, 0, SITES, escaped=True)
    return prefix, rows.schema


def _site_scan(spark: SparkSession, sf_dir: str, **which) -> DataFrame:
    prefix, schema = _site_files(spark, sf_dir, **which)
    return files.read_sites(spark, prefix, 0, SITES, schema=schema, escaped=True)


def _union_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, schema = _site_files(spark, sf_dir)
    how = dict(schema=schema, escaped=True)
    return ws.union_sites(
        [files.read_sites(spark, prefix, 0, SITES, only=p, **how) for p in range(SITES)]
    )


def _site_counts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    sides = _sides(spark, sf_dir)
    return {
        table: ws.site_key_frequencies(_with_site(sides[side], "id"), "key", name="n")
        for table, side in (("orders", "left"), ("events", "right"))
    }


def _site_key_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(_site_counts(spark, sf_dir), "source")


def _merged_key_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _site_counts(spark, sf_dir)
    return _stack(
        {table: ws.merge_key_frequencies(c, "key", name="n") for table, c in counts.items()},
        "source",
    )


def _site_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {side: _with_site(rows, "id") for side, rows in _sides(spark, sf_dir).items()}
    samples = _samples(sides)
    return _stack(
        {side: s.select("site", "id", "key", "copies") for side, s in samples.items()}, "side"
    )


def _federated_join_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.federated_join_sample(
        _with_site(_orders(spark, sf_dir), "o_orderkey"),
        _with_site(_events(spark, sf_dir), "event_id"),
        ON,
        FRACTION,
        seed=SEED,
        left_id="o_orderkey",
        right_id="event_id",
    )


def _federated_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four phases over files: a generated table pair at two sites."""
    sites = 2
    folder = files.scratch_folder(spark, "phases")
    positions, num_keys = _positions(spark, sf_dir)
    for t in jobs.TABLES:
        rows = _uniform(positions, num_keys, t, synth.synth_uniform, sites).drop("table")
        prefix = files.write_sites(rows, f"{folder}/tables", "synth", t, sites)
    root, out = f"{folder}/phases", f"{folder}/sample"
    common = dict(fraction=FRACTION, seed=SEED)
    for p in range(sites):
        jobs.run_count(spark, prefix, root, site=p, sites=sites)
    jobs.run_merge(spark, root, sites=sites)
    for p in range(sites):
        jobs.run_sample(spark, prefix, root, site=p, sites=sites, **common)
    jobs.run_join(spark, root, out, sites=sites, out_fmt="parquet", **common)
    return spark.read.parquet(out)


def _site_transfer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type"]}
    rows = {
        "orders": _with_site(
            _table(spark, sf_dir, "orders").selectExpr(
                "o_orderkey as id", "o_custkey as key", *texts["orders"]
            ),
            "id",
        ),
        "events": _with_site(
            _table(spark, sf_dir, "events").selectExpr(
                "event_id as id", "user_id as key", *texts["events"]
            ),
            "id",
        ),
    }
    samples = _samples({"left": rows["orders"], "right": rows["events"]})
    shipments = []
    for table, side in (("orders", "left"), ("events", "right")):
        counts = ws.site_key_frequencies(rows[table], "key", name="n")
        columns = ["key", "id", *texts[table]]
        shipments += [
            Shipment("tables", table, rows[table], columns, "site"),
            Shipment("site counts", table, counts, ["key", "n"], "site"),
            Shipment(
                "global counts", table, ws.merge_key_frequencies(counts, "key", name="n"),
                ["key", "n"],
            ),
            Shipment("samples", table, samples[side], [*columns, "copies"], "site"),
        ]
    return site_transfer_report(shipments)


def _positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """One key per customer."""
    positions = _table(spark, sf_dir, "customer").selectExpr("c_custkey as key_idx")
    return positions, positions.count()


def _uniform(positions: DataFrame, num_keys: int, table: int, make, sites: int) -> DataFrame:
    return make(
        positions,
        num_keys,
        min_rpk=oracle.RPK[0],
        max_rpk=oracle.RPK[1],
        overlap=oracle.OVERLAP,
        sites=sites,
        key_size=oracle.KEY_SIZE,
        value_size=oracle.VALUE_SIZE,
        table=table,
        seed=SEED,
    )


def _synth_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, n = _positions(spark, sf_dir)
    return _stack(
        {
            t: synth.synth_keys(
                positions, n, oracle.OVERLAP, table=t, key_size=oracle.KEY_SIZE, seed=SEED
            )
            for t in jobs.TABLES
        },
        "table",
    )


def _synth_both(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    positions, n = _positions(spark, sf_dir)
    return ws.union_sites([_uniform(positions, n, t, make, SITES) for t in jobs.TABLES])


def _synth_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, n = _positions(spark, sf_dir)
    return ws.union_sites(
        [
            synth.synth_zipf(
                positions,
                n,
                zipf_param=oracle.ZIPF,
                overlap=oracle.OVERLAP,
                sites=SITES,
                key_size=oracle.KEY_SIZE,
                value_size=oracle.VALUE_SIZE,
                table=t,
                seed=SEED,
            )
            for t in jobs.TABLES
        ]
    )


def _synth_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, n = _positions(spark, sf_dir)
    return ws.union_sites(
        synth.synth_mixed(
            positions,
            n,
            min_rpk=oracle.RPK[0],
            max_rpk=oracle.RPK[1],
            zipf_param=oracle.ZIPF,
            overlap=oracle.OVERLAP,
            sites=SITES,
            key_size=oracle.KEY_SIZE,
            value_size=oracle.VALUE_SIZE,
            seed=SEED,
        )
    )


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled join of whole tables, written as headerless CSV and read back."""
    pairs = _sampled(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "events"))
    folder = files.scratch_folder(spark, "csv")
    files.write_table(pairs, folder, "csv", escaped=True)
    return files.read_table(spark, folder, "csv", pairs.schema, escaped=True)
