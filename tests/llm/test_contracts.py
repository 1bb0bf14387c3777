"""Each dealt query on a small table against a brute-force version of its contract."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from weftsample.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def run(spark, name, folder=DATA):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def ascii_lower(text):
    return text.encode().lower()


def test_exact_dedup(spark, docs):
    groups = collections.defaultdict(list)
    for i, text in docs.items():
        groups[ascii_lower(text)].append(i)
    want = {
        i: (max(ids), len(ids), i == max(ids), hashlib.sha256(text).hexdigest())
        for text, ids in groups.items()
        for i in ids
    }
    got = {
        r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
        for r in run(spark, "op1_exact_dedup")
    }
    assert got == want
    assert any(len(ids) > 1 for ids in groups.values())


def tokens(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = tokenizer.encode_batch(list(texts), add_special_tokens=False)
    return [[*e.ids, 2] for e in found]


def test_packing(spark, docs):
    rows = run(spark, "op2_best_fit_packing")
    pieces = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    total = 0
    for (i, _), ids in zip(docs.items(), tokens(docs.values()), strict=True):
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        total += at
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    # Within a hundredth of what no packing can beat.
    least = -(-total // 1024)
    assert least <= len(bins) <= least * 1.01 + 1


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    ones = [sum(h >> b & 1 for h in hashes) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))


def test_simhash(spark, docs):
    prints = {i: brute_print(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: (f"{prints[i]:016x}", find(i)) for i in ids}
    got = {
        r["doc_id"]: (r["fingerprint"], r["component_id"])
        for r in run(spark, "op3_simhash_near_dedup")
    }
    assert got == want


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op4_pii")}
    assert set(got) == set(docs)
    for i, text in docs.items():
        want = brute_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert got[i]["spans"].startswith(joined)


def test_quality(spark, docs):
    rows = run(spark, "op10_quality_classifier")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    quality = {r.doc_id: r.quality for r in labels}
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    unseen = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    right = sum(r["predicted"] == quality[r["doc_id"]] for r in unseen)
    assert right >= 0.9 * len(unseen)


def test_toxicity(spark, docs):
    rows = run(spark, "op5_toxicity")
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_bpe(spark, docs):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = {}
    for i, text in docs.items():
        ids = library.encode_ordinary(text)
        packed = np.array(ids, "<u4").tobytes()
        back = hashlib.sha256(text.encode()).hexdigest()
        want[i] = (len(ids), hashlib.sha256(packed).hexdigest(), back)
    got = {
        r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
        for r in run(spark, "op6_bpe")
    }
    assert got == want


def test_quality_rules(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "op7_quality_rules")}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = collections.defaultdict(list)
        for k in range(len(words) - 4):
            at[tuple(words[k : k + 5])].append(k)
        covered = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want = {
            "n_words": len(words),
            "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered),
            "base_failed": failed,
        }
        assert {k: rows[i][k] for k in want} == want
        assert not (failed and rows[i]["kept"])


def brute_removed(docs, window=50):
    """Kept words of each document."""
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for i, t in docs.items()}
    first = {}
    for i, own in words.items():
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            first[key] = min(first.get(key, i), i)
    kept = {}
    for i, own in words.items():
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept[i] = (own, [w for k, w in enumerate(own) if k not in gone])
    return kept


def test_substring_dedup(spark, docs):
    want = {
        i: (len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
        for i, (own, kept) in brute_removed(docs).items()
    }
    got = {
        r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
        for r in run(spark, "op8_substring_dedup")
    }
    assert got == want
    assert any(n for _, n, _ in want.values())


def test_html_extraction(spark):
    """Every word of a plain parser's visible text is there, in order, and nothing else."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.dark, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.dark += tag in ("head", "script", "style")

        def handle_endtag(self, tag):
            self.dark -= tag in ("head", "script", "style")

        def handle_data(self, data):
            if not self.dark:
                self.out.append(data)

    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r["page_id"]: r for r in run(spark, "op9_html_extraction")}
    assert set(got) == {p.page_id for p in pages}
    for page in pages:
        plain = Plain()
        plain.feed(page.html or "")
        plain.close()
        want = re.sub(r"\s+", "", "".join(plain.out))
        have = re.sub(r"(?m)^\s*- |\s+", "", got[page.page_id]["text"])
        assert have == want
        assert got[page.page_id]["n_chars"] == len(got[page.page_id]["text"])


def test_toxicity_finds_held_out_toxic_documents(spark):
    """Recall and precision against the labels of the fold that training never sees.

    Measured: 87 of 97 caught, as in folds among the training rows (0.90).
    """
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect()
    toxic = {r.doc_id: r.toxic for r in labels if r.toxic is not None}
    rows = [r for r in run(spark, "op5_toxicity", folder) if r["held_out"] and r["doc_id"] in toxic]
    caught = sum(r["predicted"] and toxic[r["doc_id"]] for r in rows)
    assert sum(toxic[r["doc_id"]] for r in rows) > 50
    assert caught >= 0.85 * sum(toxic[r["doc_id"]] for r in rows)
    assert caught >= 0.95 * sum(r["predicted"] for r in rows)
