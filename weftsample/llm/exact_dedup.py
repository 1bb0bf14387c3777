"""Exact dedup over keyed streaming state, with a check of full bytes on hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bitsets import bit_set, mark_members, members_of
from .common import LOWER, UPPER, column, shared_folder, stored

#: State on disk; a store is closed once its task has committed, so that open
#: stores, and the space that each reserves, follow the cores and not the state.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def folded(text: str) -> Column:
    """Text with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(column(text), F.lit("")), UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_state(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256_hex,
    files_per_batch: int = 1000,
    checkpoint: str | None = None,
) -> DataFrame:
    """Stream the files of a Parquet table through keyed state; return the state.

    The state has one entry per digest and never expires: the row to keep, as
    stable identifier (``id``, the largest) and content locator (``file``,
    ``row``), and the number of rows ``n``.  It lies in RocksDB on the
    executors' disks, with its changelog under ``checkpoint`` in the shared
    folder; a lost executor's part is rebuilt from there, and a later call with
    the same ``checkpoint`` reads only files that have come since.  Rows are
    folded per task before they are shuffled, so a digest that a third of all
    rows share reaches its state as one row per task.
    """
    checkpoint = checkpoint or shared_folder(spark, "dedup-state")
    schema = spark.read.parquet(path).schema
    # The pattern matches this one path; a plain path may not be a single file.
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(pattern)
        .select(digest(folded(text_col)).alias("digest"), _row(id_col).alias("keep"))
    )
    state = rows.groupBy("digest").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.format("statestore").load(checkpoint).selectExpr(
        "key.digest as digest", "value.max as keep", "value.count as n"
    )


def _row(id_col: str) -> Column:
    """Stable identifier and content locator; orders by id, nulls first."""
    return F.struct(
        column(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def _rows(spark: SparkSession, path: str, id_col: str, text_col: str, digest) -> DataFrame:
    """``digest``, ``content`` (folded text) and ``keep`` (identifier and locator) of each row."""
    content = folded(text_col)
    return spark.read.parquet(path).select(
        digest(content).alias("digest"), content.alias("content"), _row(id_col).alias("keep")
    )


def state_hits(state: DataFrame) -> DataFrame:
    """Entries of the state that came twice or more: ``digest``, ``best``, ``n``; stored."""
    hits = state.filter("n > 1").select("digest", F.col("keep").alias("best"), "n")
    return stored(hits, "dedup-hits")


class HitBits:
    """A broadcast bit set of the digests that were hit, sized by their number.

    Rows that it does not hold have no equal and never leave their scan; it lets
    one in thirty of them through.
    """

    def __init__(self, hits: DataFrame) -> None:
        self.members = hits.count()
        self.pages = bit_set(hits.select(self.hash().alias("hash")), "hash", self.members)

    @staticmethod
    def hash() -> Column:
        return F.xxhash64("digest")

    def pick(self, rows: DataFrame) -> DataFrame:
        return members_of(rows, self.hash(), self.pages, self.members)

    def mark(self, rows: DataFrame, name: str) -> DataFrame:
        return mark_members(rows, self.hash(), self.pages, self.members, name)


def collided(rows: DataFrame, bits: HitBits) -> DataFrame:
    """Digests among the hits whose rows have not all the same bytes; stored.

    Hits are compared by their full bytes: folded per task first, so that a text
    which a third of all rows share is moved once per task.
    """
    texts = bits.pick(rows).select("digest", "content").distinct()
    several = texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1")
    return stored(several.select("digest"), "dedup-collisions")


def _by_bytes(rows: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of collided digests, and the classes that their bytes make."""
    theirs = rows.join(split, "digest", "left_semi")
    classes = theirs.groupBy("digest", "content").agg(
        F.max("keep").alias("best"), F.count("*").alias("n")
    )
    return theirs, classes


def exact_duplicates(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256_hex,
) -> DataFrame:
    """For each row of a Parquet table, which row of its equals stays.

    ``id``, ``file`` and ``row`` (content locator), ``digest``, ``keep_id``,
    ``group_size``, ``kept``.  Texts are equal when identical after lower-casing
    A-Z; null counts as empty.  The largest id stays; of repeated rows with that
    id the one with the last locator; a null id only where no other is there.
    An empty table gives an empty result.  Other columns are not read.
    """
    rows = _rows(spark, path, id_col, text_col, digest)
    state = digest_state(spark, path, id_col=id_col, text_col=text_col, digest=digest)
    hits = state_hits(state)
    split = collided(rows, HitBits(hits))
    narrow = rows.select("digest", "keep")
    if split.isEmpty():
        placed = narrow.join(hits, "digest", "left")
    else:
        # Collided digests tell nothing: their rows meet by their bytes.
        theirs, own = _by_bytes(rows, split)
        met = theirs.join(own, ["digest", "content"]).select("digest", "keep", "best", "n")
        placed = narrow.join(split, "digest", "left_anti").join(hits, "digest", "left")
        placed = placed.unionByName(met)
    best = F.coalesce("best", "keep")
    return placed.select(
        F.col("keep.id").alias("id"),
        F.col("keep.file").alias("file"),
        F.col("keep.row").alias("row"),
        "digest",
        best["id"].alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        best.eqNullSafe(F.col("keep")).alias("kept"),
    )


def drop_exact_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, under the same rules.

    ``docs`` is written to the shared folder first, so that rows have locators.
    Rows that the state has met once stay as they are; of the others those stay
    whose locator the state holds.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "dedup-input")
    docs.write.parquet(path)
    state = digest_state(spark, path, id_col=id_col, text_col=text_col, digest=digest)
    rows = _rows(spark, path, id_col, text_col, digest)
    bits = HitBits(state_hits(state))
    split = collided(rows, bits)
    keepers = bits.pick(state).join(split, "digest", "left_anti").select("keep.file", "keep.row")
    if not split.isEmpty():
        _, classes = _by_bytes(rows, split)
        keepers = keepers.unionByName(classes.select("best.file", "best.row"))
    table = spark.read.schema(docs.schema).parquet(path)
    # One struct holds the columns, so that no name can clash with those added.
    table = table.select(
        F.struct(*[column(c) for c in docs.columns]).alias("doc"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        digest(folded(text_col)).alias("digest"),
    )
    marked = bits.mark(table, "hit")
    # Keepers are unique rows: no key of this join is hot.
    chosen = marked.filter("hit").join(keepers, ["file", "row"], "left_semi")
    return marked.filter("NOT hit").select("doc.*").unionByName(chosen.select("doc.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.col("digest").alias("text_sha256"),
    )


OP1_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS content
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM t WINDOW same AS (PARTITION BY content)
"""
