"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a parquet table bucketed and sorted by digest, one row for each text seen. A batch is
reduced to one row a digest before it moves, digests that the index holds are removed by a
sort-merge anti-join (the index side is neither shuffled nor sorted again), and the rest is
appended. Running a batch again appends nothing, so a job that died can be repeated.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.session import drop_scratch, materialise, scratch_path

# fixed values: the characters of [\x20\x09-\x0D]
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class DigestIndex:
    """A digest table at ``path``; the same path and number of buckets open the same index again."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        """The index for joins on its buckets."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def scan(self) -> DataFrame:
        """The index as plain files, for joins whose hot keys Spark may split."""
        return self.spark.read.schema("digest binary, keep_id long").parquet(self.path)

    def append(self, found: DataFrame) -> None:
        """Add the digests of ``found`` (digest, keep_id; one row each) that the index lacks."""
        new = found.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        (new.select("digest", "keep_id").repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def dedup_append(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; new texts enter the index.

    Texts are equal when they are after deleting white space ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and empty texts equal each other. Of the rows of a text that the index lacks, that with
    an id, the most code points and then the smallest id stays; a text the index holds keeps its earlier
    id and none of the batch stays. group_size counts rows of the batch. A repeated id with an equal
    text is one document and shares the decision; null ids come last, however
    long their texts, are never kept and don't enter the index. Other columns are ignored whatever their names; an empty table gives an empty result.
    """
    rows, rows_path = materialise(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("points"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")), "digests")
    groups, groups_path = materialise(rows.groupBy("digest").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "points", F.bitwise_not("doc_id").alias("x"))).alias("top"), F.count("*").alias("group_size"))
        .select("digest", F.bitwise_not("top.x").alias("keep_id"), "group_size"), "digest-groups")
    index.append(groups.where("keep_id is not null").select("digest", "keep_id"))
    decided = groups.select("digest", "group_size").join(index.scan(), "digest", "left")
    result, _ = materialise(rows.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256")), "digest-result")
    for p in (rows_path, groups_path):
        drop_scratch(docs.sparkSession, p)
    return result


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
