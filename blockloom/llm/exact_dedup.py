"""Exact dedup over a persistent digest index (operator 3).

The index is a Parquet table, bucketed and sorted by the digest. A new
batch is first reduced to one row for each digest (map-side combine, so that a hot text
sends one row per task), held against the index by a sort-merge anti-join that does
not shuffle the index, and what is new is appended to it. Without a table of its own to go on with, a call
begins an empty one in the shared scratch folder and drops it at its end.

Null text counts as empty. Texts are equal if they are after each ``[\\x20\\x09-\\x0D]+``
became one space. The smallest id of a digest stays; null ids come last. An empty batch gives no rows and appends nothing.
Repeated rows (same id and text) are all reported, all of them count in group_size, and they stay or go together; so do the
rows of a text that has no id at all. ``keep_first`` leaves one row of each text. Texts of any length are hashed whole; other columns
may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import delete, discard, few, id_of, materialize, scratch_root, settings, text_of, unused

BUCKETS = 64


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def sha_of(text_col: str) -> Column:
    return F.sha2(normalized(text_of(text_col)).cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256): native, one pass over the texts."""
    return docs.select(id_of(id_col).alias("doc_id"), sha_of(text_col).alias("text_sha256"))


class DigestIndex:
    """A table (text_sha256, keep_id) that outlives a batch. path: a folder of its own instead of the warehouse."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS, path: str | None = None):
        self.spark, self.table, self.buckets, self.path = spark, table, buckets, path

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def frame(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame) -> None:
        # dealt by the bucket's own hash, each bucket gets one file and not one for each task
        out = rows.repartition(self.buckets, "text_sha256").write.format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append")
        if self.path:
            out = out.option("path", self.path)
        with settings(self.spark):
            out.saveAsTable(self.table)

    def append(self, firsts: DataFrame) -> None:
        """firsts: (text_sha256, keep_id), one row for each digest; those in the index are left out."""
        fresh = firsts.select("text_sha256", "keep_id")
        if not self.exists():
            self._write(fresh.limit(0))
        self._write(fresh.join(self.frame().hint("merge"), "text_sha256", "left_anti"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.path:
            delete(self.spark, self.path)


def _kept_of(own: DataFrame, index: DigestIndex | None) -> DataFrame:
    """own: (doc_id, text_sha256). One row for each digest: the smallest id here, the one that the index has, the size of the group, and whether the digest is new."""
    spark = own.sparkSession
    name = f"blockloom_digests_{uuid.uuid4().hex[:12]}"
    at = index or DigestIndex(spark, name, path=f"{scratch_root(spark)}/{name}")
    groups = materialize(own.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "groups")
    before = at.frame().select("text_sha256", F.lit(False).alias("new")).hint("merge") if index and index.exists() else None
    if before is not None:  # what the index had before this batch
        known = materialize(groups.select("text_sha256").hint("merge").join(before, "text_sha256"), "known")
    at.append(groups.select("text_sha256", F.col("first_id").alias("keep_id")))
    out = groups.hint("merge").join(at.frame().select("text_sha256", "keep_id").hint("merge"), "text_sha256")
    out = out.withColumn("new", F.lit(True)) if before is None else out.join(known, "text_sha256", "left").withColumn("new", F.coalesce("new", F.lit(True)))
    out = materialize(out, "kept_of")
    discard(groups)
    if index is None:
        at.drop()
    return out


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index of earlier batches, a document is kept only if its digest is new or the index has this very id for it (the same batch
    once more); keep_id is then the id that the index has. The index is extended by this batch. group_size counts the rows of this batch.
    """
    own = materialize(digests(docs, id_col, text_col), "digests")
    of = _kept_of(own, index)
    # both sides are plain shuffles of written tables: AQE can split the rows of a hot digest
    out = own.hint("merge").join(of, "text_sha256")
    same = F.when(F.col("keep_id").isNull(), F.col("new")).otherwise(F.col("keep_id") == F.col("first_id"))
    out = out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & same).alias("kept"), "text_sha256")
    return materialize(out, "exact-dedup")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each text, that with the smallest id. Rows get numbers, and only numbers of rows that go are joined to them."""
    row, sha = unused(docs, "row"), unused(docs, "text_sha256")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(sha, sha_of(text_col)), "digests")
    own = rows.select(id_of(id_col).alias("doc_id"), F.col(row).alias("row"), F.col(sha).alias("text_sha256"))
    of = _kept_of(own, None).where("group_size > 1").select("text_sha256", "keep_id")
    tied = own.hint("merge").join(of, "text_sha256")
    first = tied.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256").agg(F.min("row").alias("stays"))
    gone = materialize(tied.join(first, "text_sha256").where("row != stays").select(F.col("row").alias(row)), "gone")
    out = materialize(rows.join(few(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]), "distinct")
    discard(rows, gone)
    return out
