"""Poisson copies per row, and the rows they stand for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import quoted, uniform, with_row_bits
from ..functions.poisson import poisson_block, poisson_number
from .keys import check_fraction

# Fixed values.
BOUND_SLACK = 1.0 - 1e-12  # exp() of a bound and of the weight may round apart
CDF_BATCH = 100_000  # rows of distribution tables handed over at a time
COPY_BLOCK = 65_536  # copies of one row that one task unrolls in one go
FEW_COPIES = 1_000_000  # of a whole sample: they may come from one task
COPIES_A_ROW = 16  # of every row at most: not worth a shuffle of all blocks


def draws_some(fraction: float, weight: str) -> str:
    """Do ``_bits`` draw a copy?  They draw none exactly if ``u <= exp(-mean)``."""
    return f"{uniform('_bits')} > exp(-({_mean(fraction, weight)}))"


def may_draw(fraction: float) -> Callable[[str], str]:
    """The same for an upper bound of the weight: True if it might draw a copy."""
    return lambda bound: f"{draws_some(fraction, bound)} * {BOUND_SLACK!r}D"


def poisson_draws(
    weighted: DataFrame, fraction: float, *, ids: Sequence[str], side: str, seed: int
) -> DataFrame:
    """Rows that draw at least one copy, with ``copies ~ Poisson(fraction * weight)``.

    ``_bits``, the hash of the row that the draw is made of, stays as a column.
    Rows that draw nothing are dropped in the JVM; only the others go to Python.
    """
    fraction = check_fraction(fraction)
    if "_bits" not in weighted.columns:
        weighted = with_row_bits(weighted, ids, side, seed)
    if "_rows" not in weighted.columns:
        weighted = weighted.withColumn("_rows", F.lit(1).cast("long"))
    if fraction == 0.0:
        weighted = weighted.filter("false")
    drawing = weighted.filter(draws_some(fraction, "weight"))
    mean = F.expr(_mean(fraction, "weight"))
    drawn = drawing.withColumn("copies", poisson_number(F.expr(uniform("_bits")), mean))
    values = [quoted(c) for c in drawn.columns if c not in ("_rows", "_bits")]
    return drawn.select(*values, "_bits")


def expand_copies(sample: DataFrame, *, spread_by: Sequence[str] | None = None) -> DataFrame:
    """One row per copy, numbered by ``copy`` from 1.

    A row may stand for more copies than fit in memory, or than one task should
    write, so copies are unrolled in blocks.  ``spread_by`` shuffles the blocks
    first, so that the copies of one row do not all come from one task.  The
    number of partitions is fixed for it: adaptive execution would merge them by
    the size of the blocks, which says nothing about the copies in them.  Rows
    with no copies give none.  A sample that went through ``copy_blocks`` keeps its
    blocks.
    """
    blocks = sample if "_block" in sample.columns else copy_blocks(sample)
    if spread_by is not None:
        partitions = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(partitions, *map(quoted, spread_by), "_block")
    copy = F.expr(
        f"explode(sequence(_block * {COPY_BLOCK} + 1,"
        f" least(copies, (_block + 1) * {COPY_BLOCK})))"
    )
    return blocks.withColumn("copy", copy).drop("_block")


def copy_blocks(sample: DataFrame) -> DataFrame:
    """The rows with their ``_block`` numbers: from 0, one for each COPY_BLOCK copies."""
    # Not a filter: that would be pushed below, and the expression of copies with it.
    numbers = f"sequence(0L, (copies - 1) div {COPY_BLOCK})"
    block = F.expr(f"explode(if(copies > 0, {numbers}, cast(array() as array<bigint>)))")
    return sample.withColumn("_block", block)


def copy_facts() -> tuple[Column, Column]:
    """What ``many_copies`` asks for: the most copies of a row, and the copies of all."""
    return F.max("copies"), F.sum(F.col("copies").cast("double"))


def many_copies(most: int | None, total: float | None, a_row: int = 0) -> bool:
    """Should the copies be spread?  A stored sample lies in as few files as its rows
    fill, which says nothing about the copies that they stand for.  Where no row has more
    than ``a_row`` copies, no task has more than that many times the rows that it reads."""
    return (most or 0) > COPY_BLOCK or ((total or 0) > FEW_COPIES and most > a_row)


def poisson_cdf(weights: DataFrame, fraction: float) -> DataFrame:
    """Distribution of the copies for each distinct ``weight``: ``weight, n, cdf``."""
    fraction = check_fraction(fraction)

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            waiting, rows = [], 0
            for weight in batch["weight"]:
                mean = fraction * float(weight)
                first, cdf = poisson_block(mean) if mean > 0 else (0, np.ones(1))
                n = np.arange(first, first + len(cdf), dtype=np.int64)
                waiting.append(pd.DataFrame({"weight": weight, "n": n, "cdf": cdf}))
                rows += len(cdf)
                if rows >= CDF_BATCH:
                    yield pd.concat(waiting)
                    waiting, rows = [], 0
            if waiting:
                yield pd.concat(waiting)

    distinct = weights.select(F.col("weight").cast("long").alias("weight")).distinct()
    return distinct.mapInPandas(tabulate, "weight long, n long, cdf double")


def expected_pairs(fraction: float, one: str = "own_count", other: str = "weight") -> str:
    """SQL text for the mean copies of a key: fraction * rows left * rows right."""
    # The counts are multiplied as doubles: their product may not fit a BIGINT,
    # and the result is the same to the bit whichever side comes first.
    return f"{float(fraction)!r}D * (cast({one} as double) * cast({other} as double))"


def _mean(fraction: float, weight: str) -> str:
    return expected_pairs(fraction, weight, "_rows")
