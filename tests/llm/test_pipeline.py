"""The whole pipeline against brute force, on what its classifier keeps."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftsample.llm import pii
from weftsample.llm.quality_model import op10_quality_classifier
from .test_contracts import brute_print

DATA = "/root/testdata/sf0.001"


def near_groups(prints, bits=2):
    """Smallest member of each component over all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, with copies that differ in white space or in one word."""
    path = str(tmp_path_factory.mktemp("copies"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    spaced = docs.filter("doc_id % 3 = 0").selectExpr(
        "doc_id + 10000 AS doc_id", "replace(text, ' ', '  ') AS text", "lang", "source", "n_chars"
    )
    longer = docs.filter("doc_id % 3 = 1").selectExpr(
        "doc_id + 20000 AS doc_id", "text || ' more' AS text", "lang", "source", "n_chars"
    )
    docs.unionByName(spaced).unionByName(longer).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_against_brute_force(spark, folder):
    ran = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in docs}
    good = {r.doc_id for r in op10_quality_classifier(spark, folder).collect() if r.predicted == 1}
    assert 0 < len(good) < len(texts)
    largest = collections.defaultdict(int)
    for i in sorted(good):
        largest[texts[i].encode().lower()] = i
    once = set(largest.values())
    kept = near_groups({i: brute_print(texts[i]) for i in once})
    assert len(kept) < len(once) < len(good)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i in kept:
        text = pii.masked(texts[i], pii.find_spans(texts[i]))
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want[i] = (len(ids), zlib.crc32(np.array(ids[-1024:], "<u4").tobytes()))
    got = {}
    for r in sorted(ran, key=lambda r: (r["doc_id"], r["piece"])):
        before = got.get(r["doc_id"], (0, 0))
        assert r["start"] == before[0]
        got[r["doc_id"]] = (before[0] + r["length"], r["ids_crc32"])
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all(got[i] == want[i] for i in want if want[i][0] <= 1024)


def test_stages_call_the_operators(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "pii_masking",
        "best_fit_packing",
    ]


def test_a_labelled_stage_bears_clashing_names(spark, tmp_path):
    """The classifier rejects documents of a table whose columns are named like its own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name in ("id", "label", "score", "text_", "predicted", "doc"):
        docs = docs.withColumn(name, F.lit("x"))
    stage = dict(corpus_pipeline.STAGES)["quality_classifier"]
    kept = stage(spark, docs, DATA)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in op10_quality_classifier(spark, DATA).collect() if r.predicted == 1}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == good
