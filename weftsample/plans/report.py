"""What each phase of a federated sampled join sends: rows and bytes."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sites import rendered_bytes


@dataclass(frozen=True)
class Shipment:
    """A table that one phase produces; ``site`` names its site column, if it has one."""

    phase: str
    table: str
    data: DataFrame
    columns: Sequence[str]
    site: str | None = None


def site_transfer_report(shipments: Sequence[Shipment]) -> DataFrame:
    """``phase, table, sender, n_rows, n_bytes``: the sender is a site or the coordinator."""
    reports = []
    for s in shipments:
        sender = F.lit("coordinator") if s.site is None else F.col(s.site).cast("string")
        sized = s.data.select(
            sender.alias("sender"), rendered_bytes(s.data, s.columns).alias("_bytes")
        )
        reports.append(
            sized.groupBy("sender")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_bytes").alias("n_bytes"))
            .select(
                F.lit(s.phase).alias("phase"),
                F.lit(s.table).alias("table"),
                "sender",
                "n_rows",
                "n_bytes",
            )
        )
    return functools.reduce(DataFrame.unionByName, reports)
