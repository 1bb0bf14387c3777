"""UNION ALL of the tables, counts or samples of several sites."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sites(
    sites: Mapping[object, DataFrame] | Sequence[DataFrame], *, site: str | None = None
) -> DataFrame:
    """Stack the sites by column name; ``site`` adds a column that tells them apart.

    A sequence numbers its sites from 0.
    """
    named = dict(sites) if isinstance(sites, Mapping) else dict(enumerate(sites))
    if not named:
        raise ValueError("no sites")
    parts = [
        df if site is None else df.withColumn(site, F.lit(label)) for label, df in named.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)
