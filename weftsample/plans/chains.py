"""Sampled equi-joins of more than two tables: one in the middle, others around it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    CalendarIntervalType,
    DataType,
    MapType,
    StructType,
    VariantType,
)

from ..functions.hashing import mix52, quoted, uniform, with_row_bits
from ..operators.draws import (
    COPY_BLOCK,
    FEW_COPIES,
    copy_blocks,
    copy_facts,
    expand_copies,
    many_copies,
    poisson_draws,
)
from ..operators.frequencies import shared_key_counts
from ..operators.keys import (
    JoinKeys,
    align_keys,
    check_columns,
    check_fraction,
    identify_rows,
    join_keys,
)
from ..operators.pairing import SLOT_ROWS
from ..operators.weights import PART_ROWS, attach_weights
from ..sources.sites import stored
from .sampling import Ids, Settings, number_rows

# Fixed values.
LIST_ROWS = 100_000  # rows of one key that a drawn row may take along
LIST_SHARE = 4  # rows in the lists of all drawn rows, for each row drawn or in the branch
CELL_COPIES = 4_000_000  # copies of one key that share a list
CELL_SHARE = 16  # and copies for each row of a list, at least

@dataclass(frozen=True)
class Branch:
    """A table joined to the middle one: ``on`` names the middle's columns first."""

    rows: DataFrame
    on: JoinKeys
    id: Ids = None
    suffix: str = ""


def join_sample_star(
    middle: DataFrame,
    branches: Sequence[Branch],
    fraction: float,
    *,
    seed: int = 0,
    middle_id: Ids = None,
    suffix: str = "",
    slot_rows: int = SLOT_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Random sample of ``middle JOIN branch JOIN branch ...`` without computing the join.

    Every row of the join is in the sample a Poisson number of times with mean
    ``fraction``, each independently of all others.  Counts go up: a row of the
    middle table stands for as many rows of the join as the product of its
    branches' key counts, and draws that many times ``fraction`` copies in the
    mean.  Draws go down: each copy picks one of the rows with its key in each
    branch, all alike.

    The result is a function of the rows, the fraction and the seed.  Columns are
    those of the middle table, then each branch's without its keys; names that
    occur twice get the suffix of their table.  NULL keys match nothing.  A
    branch without a partner, or an empty table, gives an empty result.

    Key counts of each branch and the rows drawn from the middle table are
    stored, as they are needed twice.  Where there are many copies they are not
    shuffled: the rows they may pick come to them, as lists (see ``_ways``).
    """
    fraction = check_fraction(fraction)
    if not branches:
        raise ValueError("no branches: there is nothing to join")
    check_columns(middle, "middle")
    names = _output_names(middle, branches, suffix)
    rows, ids = identify_rows(middle, middle_id)
    rows = with_row_bits(rows, ids, "middle", seed)
    sides = []
    for number, branch in enumerate(branches):
        check_columns(branch.rows, f"branch {number}")
        # The middle's keys keep their names and types here; the branch's take them.
        key_names = _pairs(branch.on)
        keyed = rows.select(*[F.col(quoted(k)).alias(f"_k{i}") for i, (k, _) in enumerate(key_names)])
        other = branch.rows.select(
            *[F.col(quoted(k)).alias(f"_k{i}") for i, (_, k) in enumerate(key_names)],
            *[F.col(quoted(c)).alias(f"_v{i}") for i, c in enumerate(branch.rows.columns)],
        )
        branch_ids = None
        if branch.id is not None:
            wanted = [branch.id] if isinstance(branch.id, str) else list(branch.id)
            missing = [c for c in wanted if c not in branch.rows.columns]
            if missing:
                raise ValueError(f"no such id columns: {missing}")
            branch_ids = [f"_v{branch.rows.columns.index(c)}" for c in wanted]
        keyed, other, branch_ids, keys = align_keys(
            keyed, other, [f"_k{i}" for i in range(len(key_names))], branch_ids
        )
        counts = shared_key_counts(keyed, other, keys)
        sides.append((key_names, keys, other, branch_ids, stored(counts, f"counts-{number}")))

    weighted = rows
    for number, (key_names, keys, _, _, counts) in enumerate(sides):
        with_keys = weighted.withColumns(
            {f"_k{i}": F.col(quoted(k)) for i, (k, _) in enumerate(key_names)}
        )
        weighted = attach_weights(
            with_keys, counts, keys, "left", ids=ids, part_rows=part_rows
        ).drop(*keys, "own_count").withColumnRenamed("weight", f"_w{number}")
    product = " * ".join(f"cast(_w{n} as double)" for n in range(len(sides)))
    drawn = poisson_draws(
        weighted.withColumn("weight", F.expr(product)), fraction, ids=ids, side="middle", seed=seed
    )
    drawn = stored(drawn.drop("weight"), "middle")
    ways, spread = _ways(drawn, sides)

    tables = []
    for number, (_, keys, other, branch_ids, counts) in enumerate(sides):
        how = Settings(keys, fraction, seed, False, slot_rows, part_rows)
        other, other_ids = identify_rows(other, branch_ids)
        numbered = number_rows(other, counts, how, other_ids, purpose=f"index-{number}")
        values = [place for place, _ in names if place.startswith(f"_b{number}_")]
        tables.append(
            numbered.select(
                *keys, F.col("slot").alias("_slot"),
                *[F.col(place.removeprefix(f"_b{number}")).alias(place) for place in values],
            )
        )
    places = {c: f"_m{i}" for i, c in enumerate(middle.columns)}
    own = [
        {f"_k{i}": F.col(places[k]).cast(table.schema[f"_k{i}"].dataType) for i, (k, _) in enumerate(key_names)}
        for (key_names, *_), table in zip(sides, tables)
    ]
    sample = drawn.select(
        *[F.col(quoted(c)).alias(place) for c, place in places.items()],
        *[f"_w{n}" for n in range(len(sides))],
        "_bits",
        "copies",
    )
    blocks = copy_blocks(sample)
    # Lists by the same columns of the middle table one after the other: one shuffle for all.
    for number in sorted(ways["list"], key=lambda n: [places[k] for k, _ in sides[n][0]]):
        blocks = _with_lists(blocks, own[number], _lists(tables[number], number))
    for number in ways["cell"]:
        cells = _cells(sample, own[number], number)
        blocks = _with_cells(blocks, own[number], _lists(tables[number], number), cells)
    spread = spread and not ways["cell"]
    copies = expand_copies(blocks, spread_by=["_bits"] if spread else None)

    picked = copies.withColumn("_copy", F.expr("coalesce(_bits ^ copy, 0L)")).drop("_bits", "copies", "copy")
    for number in [*ways["list"], *ways["cell"]]:
        picked = _taken(picked, tables[number], number, seed)
    for number in ways["copy"]:
        # One pick in each stage: the JVM does not compile a method that holds several.
        # Never NULL; saying so keeps the optimizer from checking all picks in the first.
        slot = F.expr(f"coalesce(floor({_pick(number, seed)}) + 1L, 0L)")
        meeting = picked.withColumns(own[number]).withColumn("_slot", slot).drop(f"_w{number}")
        keys = list(own[number])
        picked = join_keys(meeting, tables[number], [*keys, "_slot"], unrolled=True).drop(*keys, "_slot")
    return picked.select(
        *[F.col(place).alias(name) for place, name in names],
    )


def join_sample_chain(
    left: DataFrame,
    middle: DataFrame,
    right: DataFrame,
    on_left: JoinKeys,
    on_right: JoinKeys,
    fraction: float,
    *,
    seed: int = 0,
    left_id: Ids = None,
    middle_id: Ids = None,
    right_id: Ids = None,
    suffixes: tuple[str, str, str] = ("_1", "_2", "_3"),
    slot_rows: int = SLOT_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Sample of ``left JOIN middle ON on_left JOIN right ON on_right``.

    ``on_left`` and ``on_right`` name a column, or list names and ``(middle,
    other)`` pairs.  See ``join_sample_star``.
    """
    return join_sample_star(
        middle,
        [Branch(left, on_left, left_id, suffixes[0]), Branch(right, on_right, right_id, suffixes[2])],
        fraction,
        seed=seed,
        middle_id=middle_id,
        suffix=suffixes[1],
        slot_rows=slot_rows,
        part_rows=part_rows,
    )


def _ways(drawn: DataFrame, sides: Sequence[tuple]) -> tuple[dict[str, list[int]], bool]:
    """Branches by the way their rows meet the copies, and whether copies are to be spread.

    Copies grow with the product of the tables, and none of them is shuffled but in the
    last way:

    * ``list``: each drawn row takes along the rows of its key, which it draws from.
    * ``cell``, at most one branch: so many drawn rows share a key that these lists
      would outgrow the tables.  Drawn rows are dealt to cells of a key, and each
      cell gets the list of the key once.
    * ``copy``: each copy is shuffled to the row it picked, where there are few
      copies in all, keys of more than LIST_ROWS rows, values without an order, or a second
      branch of too long lists.
    """
    blocks = f"((copies - 1) div {COPY_BLOCK} + 1)"
    listed = [F.sum(F.expr(f"cast(_w{n} as double) * {blocks}")) for n in range(len(sides))]
    longest = [F.max(f"_w{n}") for n in range(len(sides))]
    facts = drawn.agg(*copy_facts(), F.sum(F.expr(blocks)), *listed, *longest).first()
    most, total, rows = facts[:3]
    ways = {"list": [], "cell": [], "copy": []}
    for number, (_, _, other, _, counts) in enumerate(sides):
        size, longest = facts[3 + number], facts[3 + len(sides) + number]
        if (total or 0) <= FEW_COPIES or longest > LIST_ROWS or not _ordered(other.schema):
            ways["copy"].append(number)
        elif size <= LIST_SHARE * (rows + counts.agg(F.sum("n_right")).first()[0]):
            ways["list"].append(number)
        else:
            ways["cell"].append(number)
    ways["cell"].sort(key=lambda n: -facts[3 + n])
    ways["copy"] += ways["cell"][1:]
    return ways | {"cell": ways["cell"][:1]}, many_copies(most, total)


def _ordered(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_ordered(field.dataType) for field in kind.fields)
    if isinstance(kind, ArrayType):
        return _ordered(kind.elementType)
    return not isinstance(kind, (MapType, VariantType, CalendarIntervalType))


def _lists(table: DataFrame, number: int) -> DataFrame:
    """One row per key, with the values of its rows, one array each, in the order of slots."""
    values = [c for c in table.columns if c.startswith(f"_b{number}_")]
    keys = [c for c in table.columns if c.startswith("_k")]
    rows = F.sort_array(F.collect_list(F.struct("_slot", *values)))
    lists = table.groupBy(*keys).agg(rows.alias("_rows"))
    return lists.select(*keys, *[F.col("_rows")[c].alias(c) for c in values])


def _with_lists(blocks: DataFrame, own: dict[str, Column], lists: DataFrame) -> DataFrame:
    theirs = lists.withColumnsRenamed({k: f"_their{k}" for k in own}).hint("merge")
    same = [c == F.col(f"_their{k}") for k, c in own.items()]
    return blocks.join(theirs, same).drop(*[f"_their{k}" for k in own])


def _cells(sample: DataFrame, own: dict[str, Column], number: int) -> DataFrame:
    """Keys with more than one cell.  A cell has many more copies than the list has rows."""
    copies = f"sum(cast(copies as double)) / greatest({CELL_COPIES}L, {CELL_SHARE}L * max(_w{number}))"
    cells = sample.withColumns(own).groupBy(*own).agg(F.expr(f"ceil({copies})").alias("_cells"))
    return stored(cells.filter("_cells > 1"), "cells")


def _with_cells(
    blocks: DataFrame, own: dict[str, Column], lists: DataFrame, cells: DataFrame
) -> DataFrame:
    """Deal the blocks to the cells of their key.

    The number of partitions is fixed, as it is where ``expand_copies`` spreads.
    """
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, many = list(own), F.broadcast(cells)  # one row for each CELL_COPIES copies at most
    cell = F.expr("coalesce(pmod(xxhash64(_bits, _block), _cells), 0L)")
    dealt = blocks.withColumns(own).join(many, keys, "left").withColumn("_cell", cell)
    dealt = dealt.drop("_cells").repartition(partitions, *keys, "_cell")
    each = F.expr("explode(sequence(0L, coalesce(_cells, 1L) - 1L))")
    lists = lists.join(many, keys, "left").withColumn("_cell", each).drop("_cells")
    return join_keys(dealt, lists, [*keys, "_cell"], unrolled=True).drop(*keys, "_cell")


def _pick(number: int, seed: int) -> str:
    return f"{uniform(mix52('_copy', f'pick-{number}', seed))} * _w{number}"


def _taken(picked: DataFrame, table: DataFrame, number: int, seed: int) -> DataFrame:
    """Each copy with the values at its place in the lists of a branch."""
    place = F.expr(f"cast(coalesce(floor({_pick(number, seed)}), 0L) as int)")
    values = [c for c in table.columns if c.startswith(f"_b{number}_")]
    placed = picked.withColumn("_place", place).drop(f"_w{number}")
    return placed.withColumns({c: F.get(c, "_place") for c in values}).drop("_place")


def _pairs(on: JoinKeys) -> list[tuple[str, str]]:
    entries = [on] if isinstance(on, str) else list(on)
    return [(e, e) if isinstance(e, str) else tuple(e) for e in entries]


def _output_names(
    middle: DataFrame, branches: Sequence[Branch], suffix: str
) -> list[tuple[str, str]]:
    """Where each output column stands in the picked rows, and its name."""
    columns = [(f"_m{i}", c, suffix) for i, c in enumerate(middle.columns)]
    for number, branch in enumerate(branches):
        pairs = _pairs(branch.on)
        if not pairs:
            raise ValueError("`on` names no key column")
        for own, other in pairs:
            if own not in middle.columns:
                raise ValueError(f"middle has no key column {own!r}")
            if other not in branch.rows.columns:
                raise ValueError(f"branch {number} has no key column {other!r}")
        theirs = {other for _, other in pairs}
        columns += [
            (f"_b{number}_v{i}", c, branch.suffix)
            for i, c in enumerate(branch.rows.columns)
            if c not in theirs
        ]
    seen = [c for _, c, _ in columns]
    names = [(place, c + end if seen.count(c) > 1 else c) for place, c, end in columns]
    out = [name for _, name in names]
    if len(set(out)) < len(out):
        raise ValueError(f"output columns are not distinct: {out}")
    return names
