"""Synthetic pairs of tables with a chosen key overlap and key frequencies.

A table is a function of its key positions: every count and every letter is a
hash of (position, purpose, seed).  Keys, sites and records are unrolled with
``explode``; nothing is kept on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.hashing import BITS, letters_from, mix52, mix52_array, uniform, words_needed
from ..operators.draws import expand_copies

# Fixed values.
KEY_SIZE = 16  # letters of a key, where no size is given
POOL_BITS = 48  # keys of a table have less than 2**48 positions
ZIPF_SEED = 12345  # the Zipf counts do not depend on table, site or run
MOST_RECORDS = 2.0**62  # Zipf numbers are BIGINTs
VALUE_COLUMNS = ("value_one", "value_two", "value_three", "value_four", "value_five")


def key_positions(spark: SparkSession, num_keys: int) -> DataFrame:
    """Positions 0 ... num_keys - 1 as ``key_idx``, spread over the cluster."""
    return spark.range(num_keys).withColumnRenamed("id", "key_idx")


def synth_keys(
    positions: DataFrame,
    num_keys: int,
    overlap: float,
    *,
    table: int,
    key_size: int = KEY_SIZE,
    seed: int = 0,
) -> DataFrame:
    """``key_idx, key``: the first ``int(num_keys * overlap)`` keys are in both tables."""
    if not 0.0 <= overlap <= 1.0:
        raise ValueError(f"overlap must be between 0 and 1, not {overlap!r}")
    shared = int(num_keys * overlap)
    # A number of its own for each key of each table; a shared key has one.
    pool = (int(table) + 1) << POOL_BITS
    number = F.expr(f"coalesce(if(key_idx < {shared}, key_idx, key_idx ^ {pool}L), 0L)")
    words = {
        f"_word{i}": F.expr(mix52("_number", f"key-{i}", seed))
        for i in range(words_needed(key_size))
    }
    keyed = positions.select("key_idx", number.alias("_number")).withColumns(words)
    return keyed.selectExpr("key_idx", f"{letters_from(list(words), key_size)} as key")


def synth_uniform(
    positions: DataFrame,
    num_keys: int,
    *,
    min_rpk: int,
    max_rpk: int,
    overlap: float,
    sites: int,
    value_size: int,
    table: int,
    key_size: int = KEY_SIZE,
    seed: int = 0,
) -> DataFrame:
    """Every key at every site, with a uniform number of records drawn per site."""
    keys = synth_keys(positions, num_keys, overlap, table=table, key_size=key_size, seed=seed)
    placed = _at_every_site(keys, sites)
    counted = _uniform_records(placed, min_rpk, max_rpk, sites, table, seed)
    return _records(counted, table, value_size, seed)


def synth_sliced(
    positions: DataFrame,
    num_keys: int,
    *,
    min_rpk: int,
    max_rpk: int,
    overlap: float,
    sites: int,
    value_size: int,
    table: int,
    key_size: int = KEY_SIZE,
    seed: int = 0,
) -> DataFrame:
    """Each key at one site, by position, so both tables' shared keys meet there."""
    keys = synth_keys(positions, num_keys, overlap, table=table, key_size=key_size, seed=seed)
    width = num_keys // sites
    site = f"least(key_idx div {width}, {sites - 1})" if width else f"{sites - 1}"
    placed = keys.withColumn("site", F.expr(f"cast({site} as int)"))
    counted = _uniform_records(placed, min_rpk, max_rpk, sites, table, seed)
    return _records(counted, table, value_size, seed)


def synth_zipf(
    positions: DataFrame,
    num_keys: int,
    *,
    zipf_param: float,
    overlap: float,
    sites: int,
    value_size: int,
    table: int,
    key_size: int = KEY_SIZE,
    seed: int = 0,
) -> DataFrame:
    """Every key at every site; its Zipf count is the same at all sites and in both tables.

    An exponent near 1 gives a few keys enormous counts; a larger one tames them.
    """
    if not zipf_param > 1.0:
        raise ValueError(f"zipf_param must be above 1, not {zipf_param!r}")
    keys = synth_keys(positions, num_keys, overlap, table=table, key_size=key_size, seed=seed)
    counted = keys.withColumn("copies", _zipf_counter(zipf_param)(F.col("key_idx")))
    return _records(_at_every_site(counted, sites), table, value_size, seed)


def synth_mixed(
    positions: DataFrame,
    num_keys: int,
    *,
    min_rpk: int,
    max_rpk: int,
    zipf_param: float,
    overlap: float,
    sites: int,
    value_size: int,
    key_size: int = KEY_SIZE,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """A Zipf table 0 and a uniform table 1 over partly shared keys."""
    common = dict(
        overlap=overlap, sites=sites, value_size=value_size, key_size=key_size, seed=seed
    )
    return (
        synth_zipf(positions, num_keys, zipf_param=zipf_param, table=0, **common),
        synth_uniform(positions, num_keys, min_rpk=min_rpk, max_rpk=max_rpk, table=1, **common),
    )


def dataset_name(kind: str, **parameters: object) -> str:
    """A file name that tells how a table was made, for ``write_sites``."""
    return "_".join([kind, *(f"{name}_{value}" for name, value in parameters.items())])


def _at_every_site(keys: DataFrame, sites: int) -> DataFrame:
    return keys.withColumn("site", F.expr(f"explode(sequence(0, {int(sites) - 1}))"))


def _uniform_records(
    placed: DataFrame, min_rpk: int, max_rpk: int, sites: int, table: int, seed: int
) -> DataFrame:
    """Records per key and site: a real number between the bounds, rounded down."""
    if min_rpk > max_rpk:
        raise ValueError(f"min_rpk {min_rpk} is above max_rpk {max_rpk}")
    low, high = max(int(min_rpk / sites), 1), max(int(max_rpk / sites), 1)
    placed = _with_place(placed, seed)
    bits = placed.withColumn("_rpk", F.expr(mix52("_place", f"rpk{table}", seed)))
    records = f"cast(floor({low} + {uniform('_rpk')} * {high - low}) as bigint)"
    return bits.withColumn("copies", F.expr(records)).drop("_rpk", "_place")


def _with_place(placed: DataFrame, seed: int) -> DataFrame:
    """Add ``_place``, bits of (key position, site)."""
    position = placed.withColumn("_place", F.expr(mix52("key_idx", "position", seed)))
    return position.withColumn("_place", F.expr(mix52("(_place ^ site)", "place", seed)))


def _records(counted: DataFrame, table: int, value_size: int, seed: int) -> DataFrame:
    """Unroll ``copies`` records per key and site and fill in their values.

    Blocks of records are shuffled first: the largest key is not one task.
    """
    records = expand_copies(_with_place(counted, seed), spread_by=["key_idx", "site"])
    # Never NULL; saying so keeps null checks out of the generated code, which is
    # not compiled to machine code beyond 8,000 bytes a method.
    records = records.withColumn("_record", F.expr("coalesce(_place ^ copy, 0L)"))
    names = [f"_word{i}" for i in range(words_needed(value_size * len(VALUE_COLUMNS)))]
    words = {
        name: F.expr(mix52("_record", f"table{table}-record-{i}", seed))
        for i, name in enumerate(names)
    }
    values = [
        letters_from(names, value_size, value_size * i) + f" as {c}"
        for i, c in enumerate(VALUE_COLUMNS)
    ]
    return records.withColumns(words).selectExpr(
        f"{int(table)} as table", "site", "key", *values
    )


def _zipf_counter(exponent: float):
    """Zipf numbers by rejection from a Pareto law (Devroye 1986), one per position.

    The uniforms of each try are hashes, so a position always gets the same number.
    """
    rest = exponent - 1.0
    scale = 2.0**rest

    def draw(positions: np.ndarray) -> np.ndarray:
        drawn = np.zeros(len(positions), dtype=np.int64)
        bits = mix52_array(positions, "zipf", ZIPF_SEED)
        waiting, attempt = np.arange(len(positions)), 0
        while len(waiting):
            u, v = (
                (mix52_array(bits[waiting] ^ attempt, name, ZIPF_SEED) + 0.5) * 2.0**-BITS
                for name in ("zipf-u", "zipf-v")
            )
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(u ** (-1.0 / rest))
                ratio = (1.0 + 1.0 / x) ** rest
                fits = v * x * (ratio - 1.0) / (scale - 1.0) <= ratio / scale
            fits &= x < MOST_RECORDS
            drawn[waiting[fits]] = x[fits].astype(np.int64)
            waiting, attempt = waiting[~fits], attempt + 1
        return drawn

    @F.pandas_udf(LongType())
    def zipf(positions: pd.Series) -> pd.Series:
        return pd.Series(draw(positions.to_numpy(dtype=np.int64)))

    return zipf
