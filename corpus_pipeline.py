"""The corpus pipeline: five stages over ``documents``, each stored before the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame.  All but the last return the columns of ``docs``.
Language-model free; no stage looks at ``lang`` or ``source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftsample.llm.common import shared_folder, table
from weftsample.llm.exact_dedup import drop_exact_duplicates
from weftsample.llm.packing import packed_table
from weftsample.llm.pii import mask_personal_data
from weftsample.llm.quality_model import drop_low_quality
from weftsample.llm.simhash import keep_one_per_component


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns as query op10 does.

    Null and empty texts are scored like any other; with no labels nothing is
    rejected; repeated rows are judged each.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z in lower case, the row with the largest doc_id stays.

    A null text equals an empty one; of equal rows one stays.
    """
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints hang together, as in query op3, the smallest doc_id stays.

    Fingerprints are of three-word shingles and link at two or fewer differing
    bits; there is no other check.  Null and blank texts have fingerprint zero.
    """
    return keep_one_per_component(docs, shingle=3, threshold=2)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; ``n_chars`` follows, null for a null text."""
    return mask_personal_data(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences, as in query op2.

    Null and empty texts are the end token alone; an empty table gives an empty
    result, here as in all stages.
    """
    return packed_table(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_masking", pii_masking),
    ("best_fit_packing", best_fit_packing),
]

#: Training, fingerprints and tokens are no SQL; tests/llm/test_pipeline.py holds run() against
#: a brute-force version of all but the classifier's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = shared_folder(spark, f"pipeline-{name}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
