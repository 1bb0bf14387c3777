"""Conversation repair against all edits there are, against SQL, and against its own rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from weftsample.llm.conversations import (
    CUT, FREE, GO, OP11_SQL, Repair, damaged, op11_conversation_repair, repair_conversations,
    repaired_rows,
)

DATA = "/root/testdata/sf0.001"
ROLES = [b"user", b"assistant", b"system", b"tool", b"sage", b""]


def all_edits(rows):
    """Least cost, audit and rows of all edits with up to two inserts at a place."""
    names = {b"u": b"user", b"a": b"assistant"}
    gaps = [[], *[[x] for x in names], *[list(p) for p in itertools.permutations(names, 2)]]
    choices = []
    for role, text, kind in rows:
        edits = [(2, "D", None)]
        if kind != GO:
            more = 5 if kind == CUT else 0
            edits.append((more, "K", (role, text)))
            edits += [(more + 1, "R", (name, text)) for name in names.values()]
        choices.append(edits)
    best = None
    for picked in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k, inserted in enumerate(put):
                cost += 5 * len(inserted)
                audit += "I" * len(inserted)
                out += [(names[x], b"") for x in inserted]
                if k < len(rows):
                    cost, audit = cost + picked[k][0], audit + picked[k][1]
                    out += [picked[k][2]] if picked[k][2] else []
            if re.fullmatch(b"(s?(ua)+)?", b"".join(r[:1] or b" " for r, _ in out)):
                found = (cost, audit, b"\n".join(r + b":" + t for r, t in out))
                best = found if best is None else min(best, found)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_against_all_edits(seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice(ROLES), b"t%d" % k, rng.choice([GO, FREE, FREE, CUT]))
        for k in range(rng.choice([0, 1, 2, 3, 3]))
    ]
    repair = Repair(block_rows=2)
    for row in rows:
        repair.row(*row)
    cost, audit, text = all_edits(rows)
    assert repair.result() == (cost, audit, hashlib.sha256(text).hexdigest())


@pytest.mark.parametrize("seed", range(20))
def test_the_size_of_blocks_does_not_matter(seed):
    rng = random.Random(seed)
    found = set()
    rows = [
        (rng.choice(ROLES[:3]), b"t%d" % k, rng.choice([GO, FREE, FREE, CUT])) for k in range(97)
    ]
    for block in (1, 2, 48, 97, 300):
        repair = Repair(block_rows=block)
        for row in rows:
            repair.row(*row)
        found.add(repair.result())
    assert len(found) == 1


def test_weights_of_a_long_conversation_stay_short():
    repair = Repair(block_rows=64)
    for k in range(20_000):
        repair.row(ROLES[k % 3], b"x", FREE)
        assert max(w.bit_length() for w in repair.weights if w is not None) < 64 * 6 + 3 + 20
    assert len(repair.result()[1]) >= 20_000


def test_query_against_sql(spark):
    got = sorted(tuple(r) for r in op11_conversation_repair(spark, DATA).collect())
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    assert got == sorted(connection.sql(OP11_SQL).fetchall())


ODD = [
    (1, 0, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
    (1, None, "system", "Be."), (1, 5, "user", "Hi."), (1, 6, "user", "cut"),
    (2, 3, None, None), (2, None, "user", " \t\n"), (None, 0, "user", "No id."),
    (None, None, None, "a."), (3, 7, "assistant", "é" * 40_000 + "."), (4, 1, "user", ""),
    (5, 1, "tool", "one."), (5, 1, "aide", "one."), (5, 9, "user", "two.\n"),
]


def odd(spark, rows=ODD):
    rows = [(*r, "x", 1, "y") for r in rows]
    schema = "conv_id long, turn long, role string, text string, conv string, first int, digest string"
    return spark.createDataFrame(rows, schema).repartition(4)


def test_odd_rows(spark):
    got = {r.conv: r for r in repair_conversations(odd(spark)).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5}
    one = got[1]
    # Turns none, 0, 2, 2, 5, 6: system, user, assistant, again, again, cut off.
    assert (one.rows, one.gaps, one.blank, one.duplicate, one.truncated) == (6, 3, 0, 2, 1)
    assert (one.cost, one.audit, one.illegal) == (6, "KKKDDD", 2)
    assert (got[2].blank, got[2].gaps, got[2].audit, got[2].cost) == (2, 0, "DD", 4)
    assert (got[4].blank, got[4].audit) == (1, "D")
    assert got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    # Of one turn, by role: aide, tool; then user.
    assert (got[5].rows, got[5].gaps, got[5].illegal, got[5].audit) == (3, 7, 2, "DRR")


def test_repaired_rows_have_the_hash(spark):
    for rows, names in (
        (odd(spark), {}),
        (damaged(spark.read.parquet(f"{DATA}/conversations.parquet")), {"copies_col": "copies"}),
    ):
        repairs = repair_conversations(rows, **names)
        want = {r.conv: r.repaired_sha256 for r in repairs.collect()}
        texts = {conv: [] for conv in want}
        for r in sorted(repaired_rows(rows, repairs, **names).collect(), key=lambda r: r.place):
            assert r.place == len(texts[r.conv])
            texts[r.conv].append(f"{r.role}:{r.text}")
        assert want == {
            conv: hashlib.sha256("\n".join(lines).encode()).hexdigest()
            for conv, lines in texts.items()
        }


def test_rows_in_any_order_and_repeated(spark):
    whole = odd(spark, ODD + ODD[:1] * 50)
    ones = {tuple(r) for r in repair_conversations(whole).collect()}
    assert ones == {tuple(r) for r in repair_conversations(whole.orderBy("text")).collect()}
    assert {r[0]: r[4] for r in ones}[1] == 2 + 50


def test_no_rows(spark):
    empty = odd(spark).limit(0)
    repairs = repair_conversations(empty)
    assert repairs.collect() == [] and repaired_rows(empty, repairs).collect() == []
