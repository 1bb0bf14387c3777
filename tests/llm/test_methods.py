"""The methods by themselves, against plainer versions of the same."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weftsample.llm import packing, pii, quality_rules, toxicity
from weftsample.llm.bpe import (
    Memory, PerfectHash, TwoTierEncoder, merge_bytes, merge_pairs, read_ranks,
)
from weftsample.llm.html_text import render
from weftsample.llm.simhash import ProductCode


@pytest.mark.parametrize("seed", range(5))
def test_bins_are_those_of_one_bin_at_a_time(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([1, 3, 7, 10, 12, 20, 33, 40]) for _ in range(200))
    left, single = Counter(counts), []
    while left := +left:
        longest = max(left)
        left[longest] -= 1
        own = Counter(packing.fullest(dict(+left), 40 - longest))
        left -= own
        own[longest] += 1
        single.append(dict(own))
    at_once = packing.plan_bins(dict(counts), 40)
    key = lambda c: tuple(sorted(c.items()))
    assert Counter(map(key, single)) == sum(
        (Counter({key(c): times}) for c, times in at_once), Counter()
    )


def test_fullest_is_the_best_of_all_subsets():
    rng = random.Random(3)
    for _ in range(100):
        items = [rng.randint(1, 30) for _ in range(9)]
        room = rng.randint(0, 80)
        best = max(
            s for m in range(512) if (s := sum(x for k, x in enumerate(items) if m >> k & 1)) <= room
        )
        chosen = packing.fullest(Counter(items), room)
        assert sum(n * k for n, k in chosen.items()) == best
        assert all(k <= items.count(n) for n, k in chosen.items())


def test_every_anchor_in_reach_is_found():
    code, rng = ProductCode(), np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 20).astype(np.uint64)
    for value, anchors in zip(prints, code.anchors(prints, 2), strict=True):
        for _ in range(200):
            flips = rng.choice(64, 2, replace=False)
            near = value ^ np.uint64(1 << int(flips[0])) ^ np.uint64(1 << int(flips[1]))
            assert code.home(np.array([near]))[0] in anchors


def test_personal_data_is_masked():
    text = "to a.b@c.org, ip 10.0.0.1, +44 20 7946 0958; card 4111 1111 1111 1111"
    found = pii.find_spans(text)
    assert [k for k, *_ in found] == ["email", "ip", "card", "phone"]
    assert pii.masked(text, found) == "to <EMAIL>, ip <IP>, <PHONE>; card <CARD>"
    extra = pii.find_spans("see https://me:pw@host.org/x. IBAN: GB82 WEST 1234 5698 7654 32")
    assert {"url", "account"} <= {k for k, *_ in extra}
    assert pii.find_spans("version 1.2.300.4, https://example.com/a and 4111111111111112") == []


def test_trees_follow_the_directions():
    rng = np.random.default_rng(0)
    rows = rng.random((800, 2))
    labels = ((rows[:, 0] + 0.3 * np.sin(20 * rows[:, 1]) + 0.2 * rng.random(800)) < 0.6) * 1.0
    forest = quality_rules.fit_forest(rows, labels, [-1, 0], quality_rules.Settings())
    grid = np.stack([np.tile(np.linspace(0, 1, 50), 20), np.repeat(rng.random(20), 50)], axis=1)
    assert (np.diff(forest.margin(grid).reshape(20, 50), axis=1) <= 1e-12).all()
    assert ((forest.score(rows) >= 0.5) == (labels == 1)).mean() > 0.9


def test_toxic_sentences_are_located(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ba", "do", "ri", "mo", "te") for b in ("la", "ne", "so", "ku")]

    def sentence(bad=False):
        own = [rng.choice(words) for _ in range(8)] + ["vile"] * bad
        rng.shuffle(own)
        return " ".join(own) + "."

    rows = []
    for i in range(300):
        toxic = i % 4 == 0
        rows.append((i, " ".join([sentence(), sentence(toxic), sentence()]), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.fit_toxicity(docs, docs, without=None)
    found = toxicity.toxic_sentences(docs, weights).collect()
    assert {r.id for r in found} == {i for i, _, toxic in rows if toxic}
    assert all("vile" in r.words and r.sentence == 1 for r in found)


def test_perfect_hash_and_merges():
    items = {f"key{i}".encode(): i for i in range(2000)}
    table = PerfectHash(items)
    assert all(table.get(k) == v for k, v in items.items())
    assert table.get(b"other") is None and PerfectHash({}).get(b"a") is None
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    assert merge_bytes(list(b"abcbc"), merge_pairs(ranks)) == [258, 257]
    assert merge_bytes([], {}) == [] and merge_bytes([7], {}) == [7]


def test_encoder_is_the_library():
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    own = TwoTierEncoder(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    rng = random.Random(5)
    signs = ["a", "B", "é", "ß", "1", "٣", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u200b", "'s",
             "'LL", "!", "\U0001f600", "<|endoftext|>", "中", "\x00", "\u0301", "\r\n", "I'm", "ing",
             "\x1c", "\x85"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(5_000)]
    for text in [*texts, "a" * 3_000, " " * 3_000, ""]:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(packed) == text.encode()


def test_memory_is_bounded_in_bytes():
    memory, made = Memory(lambda t: made.append(t) or t.encode(), 5_000), []
    for k in range(1_000):
        assert memory[f"w{k}"] == memory[f"w{k}"] == f"w{k}".encode()
        assert memory.size <= 5_000
    assert len(made) == 1_000 and 0 < len(memory) < 25
    assert memory["long" * 100] and "long" * 100 not in memory


def test_layout():
    page = (
        "<title>no</title><h1>Head</h1>one<br>two<p>par <b>bold</b>  x<p>next<ul><li>a<li>b<ol>"
        "<li>n<li>m</ol></ul><table><tr><th>Name<th>Qty<tr><td>Fig<td>12</table><p hidden>no</p>"
        "<div style='display: none'>no</div><pre>a  b\n c</pre>&amp;"
    )
    assert render(page).split("\n") == [
        "Head", "", "one", "two", "", "par bold x", "", "next", "", "- a", "- b", "  1. n", "  2. m",
        "", "Name  Qty", "Fig   12", "", "a  b", " c", "", "&",
    ]


@pytest.mark.parametrize(
    "page, text",
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
        (
            "a <svg><title>no</title><desc/><defs><text>no</text></defs>no<rect/><text>One</text>"
            "<text><tspan x=1>Two</tspan><tspan x=1>more</tspan></text></svg> b",
            "a One Two more b",
        ),
        ("<svg><foreignObject><p>in</p></foreignObject></svg><p>out", "in\n\nout"),
        ("a<textarea>\nx  &lt;b>\n y</textarea>b", "a\nx  <b>\n y\nb"),
        ("a <select><option>One<option selected>Two<option>no</select> b", "a Two b"),
        ("a <select>no<option disabled>no<option>Two</option></select> b", "a Two b"),
        ("a<select multiple><optgroup><option>One<optgroup><option>Two</select>b", "a\nOne\nTwo\nb"),
        ("a <object>shown</object> <object data=x.pdf>no</object>b", "a shown b"),
        ("a<dialog>no</dialog><dialog id=x>no</dialog><dialog open>in</dialog>b", "a\nin\nb"),
        ("a<dialog class='open'>no</dialog><dialog class=x OPEN=''>in</dialog>", "a\nin"),
        ("a<audio>no</audio><canvas>no</canvas><datalist><option>no</datalist>b", "ab"),
    ],
    ids=["math", "svg", "foreign", "textarea", "select", "first", "multiple", "object", "dialog",
         "open", "others"],
)
def test_what_browsers_show_is_kept(page, text):
    assert render(page) == text


def test_long_phone_runs_are_counted_to_the_end():
    text = "+1" + " " * 4100 + "23456789"
    assert pii.find_spans(text) == [("phone", 0, 4110)]
    assert pii.find_spans("+1" + " " * 4100 + "2" * 15) == []
    assert pii.find_spans("+1" + " " * 4100 + "2" * 14) == [("phone", 0, 4116)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><th rowspan=2>a<td>b<td>cc<tr><td>d<td>e<tr><td>1<td colspan=2>wide wide</table>",
         "a  b  cc\n   d  e\n1  wide wide"),
        ("<table><tr><td colspan=3>x<td>y<tr><td colspan=3>xx<td>z</table>", "x   y\nxx  z"),
        ("<table><tr><td colspan=2>long title<td>k<tr><td>a<td>b<td>c</table>",
         "long title  k\na  b        c"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>",
         "a  b\n   c\nd  e"),
        ("<table><tr><td colspan=x rowspan=-1>a<td>b</table>", "a  b"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c<hr></div>d", "b\nd"),
        ("<div style='display:none'>a<b style='visibility: visible'>b</b>c</div>d", "d"),
        ("<ol reversed><li>a<li>b<ul><li>x</ul><li value=7>c</ol>",
         "3. a\n2. b\n  - x\n7. c"),
        ("<ol start=3><li>a<li value=10>b<li>c</ol>", "3. a\n10. b\n11. c"),
        ("<input type=submit value='Go on'><input type=hidden value=s><input value='x y'>",
         "Go on x y"),
    ],
)
def test_spans_visibility_numbers_and_buttons(page, text):
    assert render(page) == text


def test_any_order_of_tags_renders():
    import random

    tags = "table tr td th tbody caption ol ul li select option svg text pre div p input hr".split()
    chance = random.Random(5)
    for _ in range(2_000):
        page = "".join(
            f"<{chance.choice(['', '/'])}{chance.choice(tags)}"
            f"{chance.choice(['', ' rowspan=0', ' colspan=2', ' reversed', ' hidden'])}>w"
            for _ in range(30)
        )
        assert isinstance(render(page), str)
