"""Sampled equi-joins of two tables, over one dataset or over several sites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import mix52, quoted, uniform, with_row_bits
from ..operators.bitsets import bit_set, members_of
from ..operators.draws import (
    COPIES_A_ROW,
    copy_facts,
    expand_copies,
    expected_pairs,
    many_copies,
    may_draw,
    poisson_draws,
)
from ..operators.frequencies import shared_key_counts, site_key_frequencies
from ..operators.keys import (
    JoinKeys,
    align_keys,
    check_columns,
    check_fraction,
    identify_rows,
    join_keys,
)
from ..operators.pairing import SLOT_ROWS, number_within_key, pair_on_slot, value_names
from ..operators.unions import union_sites
from ..operators.weights import PART_ROWS, attach_large_weights, attach_weights, exceeds
from ..sources.sites import stored

METHODS = ("zip", "indexed")
Ids = str | Sequence[str] | None
Sites = DataFrame | Mapping[object, DataFrame] | Sequence[DataFrame]


@dataclass(frozen=True)
class Settings:
    """What all steps of one sampled join agree on.

    ``slot_rows`` and ``part_rows`` say how finely large keys are cut up; they
    change the work of a task, not the result.  ``shared`` and ``most`` are what
    ``knowing`` finds out about the shared keys.
    """

    keys: list[str]
    fraction: float
    seed: int = 0
    null_safe: bool = False
    slot_rows: int = SLOT_ROWS
    part_rows: int = PART_ROWS
    shared: int | None = None
    most: int | None = None

    def knowing(self, counts: DataFrame) -> Settings:
        """With the number of shared keys and the most rows that one of them has.

        ``counts`` is a stored table: one small job over two columns.
        """
        facts = counts.agg(F.count(F.lit(1)), F.max(F.greatest("n_left", "n_right"))).first()
        return replace(self, shared=facts[0], most=facts[1] or 0)

    def __post_init__(self) -> None:
        check_fraction(self.fraction)

    def is_large(self, one: str = "n_left", other: str = "n_right") -> str:
        """Predicate on a key's two counts: is its work cut into several parts?"""
        expected = expected_pairs(self.fraction, one, other)
        many_copies = f"({expected}) > {float(self.slot_rows)!r}D"
        return f"{many_copies} or greatest({one}, {other}) > {int(self.part_rows)}L"


def join_sample(
    left: DataFrame,
    right: DataFrame,
    on: JoinKeys,
    fraction: float,
    *,
    seed: int = 0,
    left_id: Ids = None,
    right_id: Ids = None,
    method: str = "zip",
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_1", "_2"),
    slot_rows: int = SLOT_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Random sample of ``left JOIN right ON on`` without computing the join.

    ``zip`` draws Poisson copies of the rows of both sides and pairs them inside
    each key; the longer side's surplus is dropped, so small keys come out short.
    ``indexed`` draws left copies only and picks a right row for each of them:
    unbiased, with replacement, but all right rows with a shared key are numbered.

    ``left_id`` and ``right_id`` name columns that tell the rows apart.  Without
    them whole rows are used.  With ``right_id``, ``indexed`` numbers keys and ids
    alone and reads the right rows that were picked afterwards, by key and id; a
    repeated id would bring all of its rows at each pick.  The result depends on the rows, the fraction and
    the seed, and on nothing else.

    Key counts and the rows that were drawn (``indexed``: the picks, where
    ``right_id`` is given) are written to the shared scratch folder when this is called, and read back: they are needed
    more than once, and no draw is repeated.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    check_columns(left, "left")
    check_columns(right, "right")
    left, right, right_id, keys = align_keys(left, right, on, right_id)
    how = Settings(keys, fraction, seed, null_safe, slot_rows, part_rows)
    left_values = [c for c in left.columns if c not in keys]
    right_values = [c for c in right.columns if c not in keys]
    value_names(keys, left_values, right_values, suffixes)
    left_rows, left_ids = identify_rows(left, left_id)
    right_rows, right_ids = identify_rows(right, right_id)
    counts = stored(shared_key_counts(left, right, keys, null_safe=null_safe), "counts")
    how = how.knowing(counts)
    if method == "zip":
        mine = _zip_slots(left_rows, counts, how, "left", left_ids)
        theirs = _zip_slots(right_rows, counts, how, "right", right_ids)
    else:
        mine = _picks(left_rows, counts, how, left_ids)
        if right_id is not None and set(right_values) - set(right_ids):
            mine, theirs = _picked_rows(mine, right, counts, how, left_values, right_ids)
        else:
            theirs = number_rows(right_rows, counts, how, right_ids)
    return pair_on_slot(
        mine, theirs, keys, left_values=left_values, right_values=right_values,
        suffixes=suffixes, null_safe=null_safe,
    )


def federated_join_sample(
    left: Sites,
    right: Sites,
    on: JoinKeys,
    fraction: float,
    *,
    site: str = "site",
    seed: int = 0,
    left_id: Ids = None,
    right_id: Ids = None,
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_1", "_2"),
    slot_rows: int = SLOT_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``join_sample`` for rows that live at several sites.

    Each input is one DataFrame with a ``site`` column, or one DataFrame per
    site.  This is one application over the rows of all sites: its weight join moves
    each row that may draw a copy.  Where only key counts and sampled rows may
    leave a site, use the four phases of ``plans.jobs``.
    With the same ids and seed the rows equal those of ``join_sample`` over all
    sites, however the rows are distributed.
    """
    if not isinstance(left, DataFrame):
        left = union_sites(left, site=site)
    if not isinstance(right, DataFrame):
        right = union_sites(right, site=site)
    check_columns(left, "left")
    check_columns(right, "right")
    left, right, right_id, keys = align_keys(left, right, on, right_id)
    how = Settings(keys, fraction, seed, null_safe, slot_rows, part_rows)
    left_values = [c for c in left.columns if c not in [*keys, site]]
    right_values = [c for c in right.columns if c not in [*keys, site]]
    value_names(keys, left_values, right_values, suffixes)
    left_rows, left_ids = identify_rows(left, left_id)
    right_rows, right_ids = identify_rows(right, right_id)
    counts = shared_key_counts(
        site_key_frequencies(left, keys, site=site),
        site_key_frequencies(right, keys, site=site),
        keys,
        name="count",
        null_safe=null_safe,
    )
    counts = stored(counts, "counts")
    how = how.knowing(counts)
    return pair_on_slot(
        _zip_slots(left_rows, counts, how, "left", left_ids),
        _zip_slots(right_rows, counts, how, "right", right_ids),
        keys, left_values=left_values, right_values=right_values, suffixes=suffixes,
        null_safe=null_safe,
    )


def site_samples(
    rows: DataFrame, counts: DataFrame, how: Settings, side: str, ids: Sequence[str]
) -> DataFrame:
    """Rows that draw at least one copy, with ``weight``, ``own_count``, ``copies``.

    ``rows`` may be one site's or all sites' rows; ``counts`` are global.
    """
    if "_rows" not in rows.columns:
        rows = rows.withColumn("_rows", F.lit(1).cast("long"))
    weighted = attach_weights(
        with_row_bits(rows, ids, side, how.seed),
        counts,
        how.keys,
        side,
        ids=ids,
        keep=may_draw(how.fraction),
        null_safe=how.null_safe,
        part_rows=how.part_rows,
        shared=how.shared,
    )
    return poisson_draws(weighted, how.fraction, ids=ids, side=side, seed=how.seed)


def zip_slots(sample: DataFrame, how: Settings, side: str, ids: Sequence[str]) -> DataFrame:
    """Copies of a sample, numbered in random order within their key.

    The sample is read up to three times, so it should be a stored one.  How many
    copies it stands for, and whether it has large keys at all, are looked
    up first: most samples need neither the shuffle that spreads their copies
    nor the sizes of a key's parts.
    """
    is_large = how.is_large("own_count", "weight")
    facts = sample.agg(*copy_facts(), F.max(F.expr(is_large))).first()
    spread = ids if many_copies(*facts[:2], COPIES_A_ROW) else None

    def copies(rows: DataFrame) -> DataFrame:
        return expand_copies(with_row_bits(rows, ids, side, how.seed), spread_by=spread)

    large = None
    if facts[2]:
        narrow = dict.fromkeys([*how.keys, *ids, "own_count", "weight", "copies"])
        if "_bits" in sample.columns:
            narrow["_bits"] = None
        large = copies(sample.filter(is_large).select(*map(quoted, narrow)))
    return number_within_key(
        copies(sample),
        large,
        how.keys,
        ids,
        purpose=f"{side}-slot",
        seed=how.seed,
        expected=expected_pairs(how.fraction),
        slot_rows=how.slot_rows,
        null_safe=how.null_safe,
    )


def _zip_slots(
    rows: DataFrame, counts: DataFrame, how: Settings, side: str, ids: Sequence[str]
) -> DataFrame:
    """Draw once, store what was drawn, number it."""
    sample = stored(site_samples(rows, counts, how, side, ids), f"sample-{side}")
    return zip_slots(sample, how, side, ids)


def _picks(left: DataFrame, counts: DataFrame, how: Settings, ids: Sequence[str]) -> DataFrame:
    """Left copies, each with the number of the right row it is paired with."""
    sample = with_row_bits(site_samples(left, counts, how, "left", ids), ids, "left", how.seed)
    pick = mix52("(_bits ^ copy)", "pick", how.seed)
    return (
        expand_copies(sample, spread_by=ids)
        .withColumn("_pick", F.expr(pick))
        .withColumn("slot", F.expr(f"floor({uniform('_pick')} * weight) + 1L"))
        .drop("_pick", "_bits")
    )


def _picked_rows(
    picks: DataFrame,
    right: DataFrame,
    counts: DataFrame,
    how: Settings,
    left_values: Sequence[str],
    ids: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Picks and the right rows they picked, both with the right row's hash as ``slot``.

    Keys and ids alone are numbered; the picks learn the id of their row and are
    stored.  Only right rows that a bit set of the picked ids lets through are
    then read in full and shuffled, however wide the table is.
    """
    own = list(dict.fromkeys([*how.keys, *ids]))
    index = number_rows(_one_each(right.select(*map(quoted, own))), counts, how, ids)
    index = index.select(*map(quoted, how.keys), "slot", F.struct(*map(quoted, own)).alias("_own"))
    kept = [*map(quoted, dict.fromkeys([*how.keys, *left_values])), "slot"]
    own_row = [*how.keys, "slot"]
    picked = join_keys(picks.select(*kept), index, own_row, null_safe=how.null_safe, unrolled=True)
    picked = stored(picked.drop("slot").withColumnRenamed("_own", "slot"), "picks")
    pages = bit_set(picked.select(F.xxhash64("slot").alias("hash")), "hash", picked.count())
    rows = right.withColumn("slot", F.struct(*map(quoted, own)))
    return picked, members_of(rows, F.xxhash64("slot"), pages, picked.count())


def _one_each(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_rows", F.lit(1).cast("long"))


def number_rows(
    right: DataFrame, counts: DataFrame, how: Settings, ids: Sequence[str], *, purpose: str = "index"
) -> DataFrame:
    """Right rows with a shared key, numbered within their key."""

    spread = ids if "_id" in ids else None  # folded rows may stand for many

    def single_rows(weighted: DataFrame) -> DataFrame:
        rows = with_row_bits(weighted, ids, "right", how.seed)
        return expand_copies(rows.withColumn("copies", F.col("_rows")), spread_by=spread)

    # Numbered here are the rows of a key, not its copies.
    is_large = exceeds(min(how.slot_rows, how.part_rows))
    rows = attach_weights(
        right,
        counts,
        how.keys,
        "right",
        ids=ids,
        null_safe=how.null_safe,
        part_rows=how.part_rows,
        shared=how.shared,
    )
    large = None
    if how.most is None or how.most > min(how.slot_rows, how.part_rows):
        large = attach_large_weights(
            _narrow(right, how.keys, ids),
            counts,
            how.keys,
            "right",
            is_large=is_large,
            null_safe=how.null_safe,
        )
    return number_within_key(
        single_rows(rows),
        None if large is None else single_rows(large),
        how.keys,
        ids,
        purpose=purpose,
        seed=how.seed,
        expected="own_count",
        slot_rows=how.slot_rows,
        null_safe=how.null_safe,
    )


def _narrow(rows: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    return rows.select(*map(quoted, dict.fromkeys([*keys, *ids, "_rows"])))
