"""Conversation structure repair: the cheapest edits by integer weights."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, SPACES, bound_batches, column, table

#: Letters of the audit in ASCII order; their places from 1 on are octal digits.
LETTERS = "DIKR"

#: Costs of the edits, and of a truncated row that stays, as the contract has them.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

#: Rows whose letters stand in one weight; after that many, ranks take the letters' place.
BLOCK_ROWS = 256

#: Where a repaired conversation can stand: nothing yet, or the initial of its last role.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
INITIALS = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}
#: The states that may follow each, by ``(s?(ua)+)?``.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
LEGAL = {b"su", b"ua", b"au"}

#: What a row is to the repair: to go, free to stay, or to stay at a price.
GO, FREE, CUT = range(3)

#: Characters of audit that are handed back at a time.
OUT_CHARS = 1 << 20

KEYS = ["no_conv", "conv", "has_turn", "turn", "role"]
FIELDS = (
    "no_conv boolean, conv string, rows long, gaps long, blank long, duplicate long, "
    "truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _edges(initial: bytes, kind: int) -> list[tuple[int, int, int, int, int | None, int | None]]:
    """``(from, to, cost, slot, role inserted, role of the row)`` over one row.

    A slot is two octal digits: the row's letter, or an insert and the row's
    letter; the end is padded with zero.  So slots compare as their letters do:
    no slot's letters are the beginning of another's.  More than one insert
    before a row is never cheapest: the two roles inserted would be a pair that
    could be left out, or follow a system row that is cheaper to delete.

    The role of a row is None where it goes, its state's name where it is set
    anew, and START where it stays as it is.
    """
    out = []
    for state in FOLLOWS:
        inserts = [(state, 0, None)] + [(t, INSERT, t) for t in FOLLOWS[state] if t in NAMES]
        for mid, price, inserted in inserts:

            def edge(to, cost, letter, role):
                digit = LETTERS.index(letter) + 1
                slot = digit << 3 if inserted is None else LETTERS.index("I") + 1 << 3 | digit
                out.append((state, to, price + cost, slot, inserted, role))

            edge(mid, DELETE, "D", None)
            if kind == GO:
                continue
            stays = TRUNCATED if kind == CUT else 0
            for to in FOLLOWS[mid]:
                if INITIALS.get(initial) == to:
                    edge(to, stays, "K", START)
                if to in NAMES:
                    edge(to, stays + REROLE, "R", to)
    return out


EDGES = {(i, kind): _edges(i, kind) for i in (*INITIALS, b"") for kind in (GO, FREE, CUT)}


class Repair:
    """The cheapest repair of a conversation whose rows come one by one.

    The weight of a path is one integer: its cost, then three bits of rank, then
    a slot of two octal digits for each row of the block, so the least integer is
    the cheapest path and of these the one whose letters are ASCII-least.  After
    ``BLOCK_ROWS`` rows the letters so far are put by and their rank among the
    four states takes their place: weights stay short, however long a
    conversation is.  Each path carries the hash of what it repairs, so that no
    text is kept.
    """

    def __init__(self, block_rows: int = BLOCK_ROWS) -> None:
        self.width = 6 * block_rows
        self.shift = self.width
        self.weights: list[int | None] = [0, None, None, None]
        self.hashes = [sha256(), None, None, None]
        self.blocks: list[dict[int, tuple[int, int]]] = []

    def row(self, role: bytes, text: bytes, kind: int) -> None:
        if not self.shift:
            self._close_block()
        self.shift -= 6
        initial = role[:1]
        weights, high = self.weights, self.width + 3
        best: list[int | None] = [None] * 4
        taken: list = [None] * 4
        for edge in EDGES[initial if initial in INITIALS else b"", kind]:
            weight = weights[edge[0]]
            if weight is None:
                continue
            weight += (edge[2] << high) + (edge[3] << self.shift)
            if best[edge[1]] is None or weight < best[edge[1]]:
                best[edge[1]], taken[edge[1]] = weight, edge
        hashes = [edge and self._hashed(edge, role, text) for edge in taken]
        self.weights, self.hashes = best, hashes

    def _hashed(self, edge: tuple, role: bytes, text: bytes):
        state, _, _, _, inserted, own = edge
        found = self.hashes[state]
        if inserted is None and own is None:
            return found
        found = found.copy()  # other paths go on from the same place
        if inserted is not None:
            found.update((b"" if state == START else b"\n") + NAMES[inserted] + b":")
            state = inserted
        if own is not None:
            name = role if own == START else NAMES[own]
            found.update((b"" if state == START else b"\n") + name + b":" + text)
        return found

    def _close_block(self) -> None:
        low = (1 << self.width + 3) - 1
        letters = sorted({w & low for w in self.weights if w is not None})
        rank = {own: k for k, own in enumerate(letters)}
        mask = (1 << self.width) - 1
        self.blocks.append({k: (own & mask, own >> self.width) for own, k in rank.items()})
        self.weights = [
            w if w is None else (w >> self.width + 3 << 3 | rank[w & low]) << self.width
            for w in self.weights
        ]
        self.shift = self.width

    def result(self) -> tuple[int, str, str]:
        """Cost, audit, and hash of the repaired conversation."""
        if not self.shift:
            self._close_block()
        self.shift -= 6
        ends = [(self.weights[s], self.hashes[s]) for s in (START, ASSISTANT)]
        if self.weights[USER] is not None:  # an answer inserted at the end
            last = (INSERT << self.width + 3) + (LETTERS.index("I") + 1 << self.shift + 3)
            found = self.hashes[USER].copy()
            found.update(b"\n" + NAMES[ASSISTANT] + b":")
            ends.append((self.weights[USER] + last, found))
        weight, found = min((e for e in ends if e[0] is not None), key=lambda e: e[0])
        cost = weight >> self.width + 3
        parts, rank = [weight & (1 << self.width) - 1], weight >> self.width & 7
        for block in reversed(self.blocks):
            digits, rank = block[rank]
            parts.append(digits)
        octal = "".join(f"{digits:0{self.width // 3}o}" for digits in reversed(parts))
        audit = octal.translate({48: None} | {49 + k: c for k, c in enumerate(LETTERS)})
        return cost, audit, found.hexdigest()


class Conversation:
    """Faults and repair of one conversation whose rows come in order."""

    def __init__(self, key: tuple) -> None:
        self.key = key
        self.repair = Repair()
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.last = None
        self.turns = 0
        self.initial: bytes | None = None

    def add(self, turn: int | None, role: bytes, text: bytes, copies: int, first: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last:
            self.turns += 1
            self.last = turn
            self.least = turn if self.least is None else self.least
        initial = role[: _sign(role)]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # equal roles side by side
        self.initial = initial
        self.rows += copies
        signs = text.strip(SPACES)
        for copy in range(copies):
            kind = GO
            if not signs:
                self.blank += 1
            elif copy or not first:
                self.duplicate += 1
            elif signs[-1:] not in (b".", b"!", b"?"):
                self.truncated += 1
                kind = CUT
            else:
                kind = FREE
            self.repair.row(role, text, kind)

    def result(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        faults = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (*self.key, self.rows, gaps, *faults, *self.repair.result())


def _sign(text: bytes) -> int:
    """Bytes of the first sign."""
    lead = text[:1]
    return 1 if lead < b"\xc0" else 2 if lead < b"\xe0" else 3 if lead < b"\xf0" else 4


def _rows(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _repairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from rows in order; holds one conversation's letters at most."""
    types = [pa.bool_(), pa.string(), *[pa.int64()] * 7, pa.string(), pa.string()]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))
    now, out, size = None, [], 0

    def flush():
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for *key, has, turn, role, text, copies, first in _rows(batches, [*KEYS, "text", "copies", "first"]):
        if now is None or now.key != key:
            if now:
                out.append(now.result())
                size += 200 + len(out[-1][-2])
            now = Conversation(key)
            if size > OUT_CHARS:
                yield flush()
                out, size = [], 0
        now.add(turn if has else None, role, text, copies, first)
    if now:
        out.append(now.result())
    if out:
        yield flush()


def _marked(
    rows: DataFrame,
    conv_col: str,
    turn_col: str,
    role_col: str,
    text_col: str,
    copies_col: str | None,
) -> DataFrame:
    """Distinct rows, each with ``copies`` and ``first``.

    Copies of a row are folded into one before the shuffle.  ``first`` says that
    no earlier turn has the row's role and text; that is found on digests, and
    each conversation's first ones meet the rows on all that the rows are dealt
    by, so a text that a conversation repeats without end is spread by its turns.
    """
    bound_batches()
    text = F.coalesce(column(text_col).cast("binary"), F.lit(b" "))
    copies = F.lit(1) if copies_col is None else column(copies_col)
    rows = rows.select(
        column(conv_col).isNull().alias("no_conv"),
        F.coalesce(column(conv_col).cast("string"), F.lit("")).alias("conv"),
        column(turn_col).isNotNull().alias("has_turn"),
        F.coalesce(column(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(column(role_col).cast("binary"), F.lit(b" ")).alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.coalesce(copies.cast("long"), F.lit(0)).alias("copies"),
    )
    by = [*KEYS, "digest"]
    firsts = rows.filter("copies > 0").groupBy("no_conv", "conv", "role", "digest").agg(
        F.expr("bool_and(has_turn)").alias("has_turn"),
        F.expr("if(bool_and(has_turn), min(turn), 0L)").alias("turn"),
    )
    folded = rows.groupBy(*by).agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    met = folded.join(firsts.select(*by, F.lit(True).alias("first")), by, "left")
    return met.select(*KEYS, "text", "copies", F.coalesce("first", F.lit(False)).alias("first"))


def _in_order(rows: DataFrame, *order) -> DataFrame:
    """Rows of a conversation side by side, in order."""
    spark = rows.sparkSession
    # A fixed number, as adaptive execution would make one task of small rows.
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return rows.repartition(tasks, "no_conv", "conv").sortWithinPartitions(
        "no_conv", "conv", *order
    )


def repair_conversations(
    rows: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies_col: str | None = None,
) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that mend its structure.

    ``conv``, ``rows``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit`` (the edits' letters), ``repaired_sha256``.

    Rows go by turn, nulls first; of one turn, by role and text.  ``copies_col``
    says how often a row counts (0: only its conversation is listed, with zeros,
    an empty audit and the hash of nothing).  A null role or text counts as one
    space; null conversations are one conversation.  A text without signs is
    blank and goes; repeated rows are duplicates and go.  Other columns are not
    read.  An empty table gives an empty result.

    A conversation's hash is one chain over its texts, so one task reads its rows
    in order, as a stream; what it holds is the conversation's letters, 1 byte or
    so a row, and not its texts.
    """
    marked = _marked(rows, conv_col, turn_col, role_col, text_col, copies_col)
    found = _in_order(marked, *KEYS[2:], "text").mapInArrow(_repairs, FIELDS)
    kind = rows.schema[conv_col].dataType
    conv = F.when(~F.col("no_conv"), F.col("conv").cast(kind)).alias("conv")
    return found.select(conv, *[c for c in found.columns if c not in ("no_conv", "conv")])


def _mended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of repaired conversations, from rows in order that follow their audits."""
    out, size, key, letters, place, last = [], 0, None, iter(""), 0, START
    names = ["no_conv", "conv", "place", "role", "text"]
    types = [pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def flush():
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def put(state, role, text):
        nonlocal place, last, size
        out.append((*key, place, role.decode("utf-8", "replace"), text.decode("utf-8", "replace")))
        place, last, size = place + 1, state, size + len(text) + 100

    def next_role():
        return ASSISTANT if last == USER else USER

    def inserts():
        """Put what is inserted here; the row's own letter, or None at the end."""
        for letter in letters:
            if letter != "I":
                return letter
            state = next_role()
            put(state, NAMES[state], b"")
        return None

    fields = ["no_conv", "conv", "audit", "role", "text", "copies"]
    for no_conv, conv, audit, role, text, copies in _rows(batches, fields):
        if audit is not None:
            inserts()  # of the conversation before
            key, letters, place, last = (no_conv, conv), iter(audit), 0, START
            continue
        for _ in range(copies):
            letter = inserts()
            if letter == "K":
                put(INITIALS[role[:1]], role, text)
            elif letter == "R":
                state = next_role()
                put(state, NAMES[state], text)
        if size > OUT_CHARS:
            yield flush()
            out, size = [], 0
    inserts()
    if out:
        yield flush()


def repaired_rows(rows: DataFrame, repairs: DataFrame, **columns: str) -> DataFrame:
    """The repaired conversations themselves: ``conv``, ``place``, ``role``, ``text``.

    ``repairs`` is what ``repair_conversations`` says of the same rows and
    columns.  Each audit goes to its conversation's rows, before the first, and
    is carried out as they stream by.  Conversations that lose all rows are not
    listed; an empty table gives an empty result.
    """
    names = {"conv_col": "conv_id", "turn_col": "turn", "role_col": "role", "text_col": "text",
             "copies_col": None} | columns
    marked = _marked(rows, **names).withColumn("audit", F.lit(None).cast("string"))
    audits = repairs.select(
        F.col("conv").isNull().alias("no_conv"),
        F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"),
        F.lit(False).alias("has_turn"),
        F.lit(0).cast("long").alias("turn"),
        F.lit(b"").alias("role"),
        F.lit(b"").alias("text"),
        F.lit(0).cast("long").alias("copies"),
        F.lit(False).alias("first"),
        "audit",
    )
    both = marked.unionByName(audits)
    dealt = _in_order(both, F.col("audit").isNull(), *KEYS[2:], "text")
    schema = "no_conv boolean, conv string, place long, role string, text string"
    mended = dealt.mapInArrow(_mended, schema)
    conv = F.when(~F.col("no_conv"), F.col("conv").cast(repairs.schema["conv"].dataType))
    return mended.select(conv.alias("conv"), "place", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with one row in four damaged by the crc32 of its place."""
    place = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    )
    harm = F.crc32(place.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    text = F.when(harm.isin(0, 1), "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(harm == 0, "").when(harm == 4, "user").otherwise(role)
    copies = F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_conversations(
        damaged(table(spark, sf_dir, "conversations")), copies_col="copies"
    )
    return found.withColumnRenamed("conv", "conv_id").drop("rows")


#: The same by other means: letters as text, and a recursion over the rows.
OP11_SQL = f"""
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS spot
    FROM conversations
), harmed AS (
    SELECT *, {CRC32_SQL.format("spot")} % 20 AS harm FROM source
), rows AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
           CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                     ELSE text END AS text
    FROM harmed, range(CASE harm WHEN 3 THEN 2 ELSE 1 END) WHERE harm <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
           left(role, 1) AS sign
    FROM rows
), judged AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
           lag(sign) OVER (PARTITION BY conv_id ORDER BY k) || sign NOT IN ('su', 'ua', 'au') AS off,
           regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
    FROM placed
), faults AS (
    SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate'
                   WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
    FROM judged
), convs AS (
    SELECT DISTINCT conv_id FROM conversations
), follows(was, name, state) AS (
    VALUES ('', 's', 's'), ('', 'user', 'u'), ('s', 'user', 'u'), ('u', 'assistant', 'a'),
           ('a', 'user', 'u')
), inserts AS (
    SELECT was, state, 'I' AS letter, 5 AS cost, [name || ':'] AS lines FROM follows WHERE name <> 's'
    UNION ALL SELECT DISTINCT was, was, '', 0, CAST([] AS VARCHAR[]) FROM follows
), paths(conv_id, k, state, best) AS (
    SELECT conv_id, CAST(0 AS BIGINT), '', {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} FROM convs
    UNION ALL
    SELECT p.conv_id, r.k, e.state,
           min({{'cost': p.best.cost + i.cost + e.cost,
                 'audit': p.best.audit || i.letter || e.letter,
                 'lines': p.best.lines || i.lines || e.lines}})
    FROM paths p JOIN inserts i ON i.was = p.state
    JOIN faults r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1,
    LATERAL (
        SELECT i.state AS state, 'D' AS letter, 2 AS cost, CAST([] AS VARCHAR[]) AS lines
        UNION ALL
        SELECT f.state, CASE WHEN h.kept THEN 'K' ELSE 'R' END,
               CASE WHEN h.kept THEN 0 ELSE 1 END
               + CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END,
               [CASE WHEN h.kept THEN r.role ELSE f.name END || ':' || r.text]
        FROM follows f, (VALUES (true), (false)) h(kept)
        WHERE f.was = i.state AND coalesce(r.fault, 'truncated') = 'truncated'
          AND CASE WHEN h.kept THEN r.sign = f.state ELSE f.name <> 's' END
    ) e
    GROUP BY p.conv_id, r.k, e.state
), ends AS (
    SELECT p.conv_id, min(CASE WHEN state = 'u'
               THEN {{'cost': best.cost + 5, 'audit': best.audit || 'I', 'lines': best.lines || ['assistant:']}}
               ELSE best END) AS best
    FROM paths p
    JOIN (SELECT c.conv_id, count(k) AS n FROM convs c LEFT JOIN faults f
          ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id) t
      ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND p.k = t.n
    WHERE state <> 's' GROUP BY p.conv_id
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (off) AS illegal
    FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
       sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
