"""Window filling against its contract, and the encoder beside the library it stands for."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftsample.llm.tokens import Encoder, vocabulary_path
from weftsample.llm.window_filling import (
    Plan, combinations, fill_sequences, fill_windows, op13_window_filling, repeat_counts,
)

DATA = "/root/testdata/sf0.001"


def plain(texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = tokenizer.encode_batch(list(texts), add_special_tokens=False)
    return [[*e.ids, end] for e in encoded]


def holds(rows, ids_of, capacity=1024):
    """Every id in one piece, every sequence gapless; the padding by the contract's rule."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids_of)
    for i, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(sequences)


def test_contract(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids = plain([r.text or "" for r in docs], 0)
    ids_of = {r.doc_id: own for r, own in zip(docs, ids, strict=True)}
    rows = [r.asDict() for r in op13_window_filling(spark, DATA).collect()]
    padding, sequences = holds(rows, ids_of)
    assert padding == 0
    total = sum(map(len, ids))
    assert sequences <= total // 1024 + (total % 1024).bit_count()


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 5000),
       (5, "no spaces" * 40), (6, "é\U0001f600<|endoftext|>x"), (7, "tail")]


def test_odd_rows(spark):
    rows = [(*r, 0, "x", 0) for r in ODD]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part int, rest string, rank int")
    got = fill_sequences(frame.repartition(3), vocabulary_path(), capacity=64).collect()
    own = [list(r.ids) for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(map(len, own)) == sum(map(len, plain([t or "" for _, t in ODD], 0)))
    texts = collections.Counter(r.id for r in got if r.start == 0)
    assert texts == collections.Counter(i for i, _ in ODD)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.crc
    by_doc = {}
    for r in sorted(got, key=lambda r: r.start):
        if r.id in (4, 5, 6):
            by_doc.setdefault(r.id, []).extend(r.ids)
    want = plain([t for i, t in ODD if i in (4, 5, 6)], 0)
    assert [by_doc[i] for i in (4, 5, 6)] == want
    assert fill_sequences(frame.limit(0), vocabulary_path()).collect() == []


def test_combinations_are_all_there_are():
    lengths = [1, 2, 5, 6, 9, 10, 14, 20]
    want = {
        tuple(sorted(c))
        for c in ((a, b, 20 - a - b) for a in [0, *lengths] for b in lengths)
        if all(n == 0 or n in lengths for n in c) and max(c) < 20
    }
    got = [tuple(sorted(c)) for c in combinations(lengths, 20).tolist()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(combinations(list(range(1, 1024)), 1024)) <= 87_893


def test_repeat_counts_are_the_least_squares():
    """Conditions of the optimum: no gradient where x > 0, none below zero elsewhere."""
    rng = np.random.default_rng(3)
    histogram = np.zeros(65)
    histogram[1:64] = rng.integers(0, 500, 63)
    combos = combinations(np.flatnonzero(histogram).tolist(), 64)
    x = repeat_counts(combos, histogram, steps=5_000)
    used = np.bincount(combos.ravel(), np.repeat(x, 3), 65)
    used[0] = 0
    gradient = (used - histogram)[combos].sum(axis=1) + 0.0
    gradient -= (combos == 0).sum(axis=1) * (used - histogram)[0]
    assert (x >= 0).all()
    assert gradient.min() > -0.5 and np.abs(gradient[x > 1]).max() < 0.5


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_row_once(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 1024])
    lengths = rng.sample(range(1, window), rng.randint(1, min(40, window - 1)))
    counts = {n: rng.choice([1, 2, 3, 50]) for n in lengths}
    for combination, times in fill_windows(counts, window):
        assert times > 0 and sum(n * k for n, k in combination.items()) == window
    plan, taken = Plan(counts, window), collections.defaultdict(list)
    for n, count in counts.items():
        for rank in range(count):
            at = 0
            for start, length, sequence, offset in plan.pieces(n, rank):
                assert start == at
                at += length
                taken[sequence].append((offset, length))
            assert at == n
    assert set(taken) == set(range(plan.sequences))
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_few_documents_are_cut_where_lengths_fit():
    """With all lengths about, at most one in ten is cut: one for each window of the stream."""
    rng = np.random.default_rng(1)
    counts = {n: int(c) for n, c in enumerate(rng.integers(100, 200, 700), 1)}
    plan = Plan(counts, 1024)
    cut = sum(
        len(list(plan.pieces(n, rank))) > 1
        for n, count in counts.items()
        for rank in range(plan.combined.get(n, 0), count)
    )
    assert cut <= plan.full + len(plan.ends)
    assert cut < 0.1 * sum(counts.values()) < sum(plan.combined.values())


def test_encoder_is_the_library():
    own, rng = Encoder(vocabulary_path()), random.Random(5)
    signs = ["a", "B", "é", "ß", "1", "٣", " ", "  ", "\n", "\t", " ", "　", "​", "'s",
             "'LL", "!", "\U0001f600", "<|endoftext|>", "<|", "中", "\x00", "́", "\r\n", "I'm"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3_000)]
    texts += ["a" * 5_000, " " * 5_000, "", "<|endoftext|>" * 3]
    assert [[*own.encode(t).tolist(), 7] for t in texts] == plain(texts, 7)


def test_encoder_refuses_other_files():
    with pytest.raises(ValueError):
        Encoder(public_tokenizers.path("word_bpe_49k.json"))
