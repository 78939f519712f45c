"""Exact deduplication through an extendible-hash index on shared files, all in DataFrame functions.

The directory is a table of 2^MAX_DEPTH places over the leading bits of a text's 64-bit hash; each names the bucket that
owns it. A bucket with more hashes than its capacity is split by its next bit, and the directory doubles where the
bucket was as deep as the directory. The directory routes every row to its bucket. Owner tasks each take a range of
buckets: rows of one bucket meet in one task, which chains texts whose hashes collide, tells them apart by comparing
their bytes, and writes one entry per distinct text to the bucket's own folder. Lookups are routed by the same directory
and take keep_id and group_size from the entries of their own bucket.

Copies of one text may be very many. Hashes that many rows have are known from the counts that build the directory;
their rows are summed up where they are read before they go to the owner, so it gets one row a task for each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.common import discard, materialise, shared_folder

#: The directory has 2^MAX_DEPTH places: a broadcast of under 2 MB at any corpus size.
MAX_DEPTH = 16
#: Hashes that a bucket holds before it is split, and entries in one of its files. At MAX_DEPTH it gets more files instead.
CAPACITY = 1024
#: At most this many hashes can have so large a share of all rows that their rows are summed up first.
MOST_HOT = 1 << 16
#: Rows of one hash that an owner takes as they are, whatever the number of rows.
COLD_ROWS = 64


def place_of(hash_column: str, depth: int = MAX_DEPTH) -> Column:
    """The leading `depth` bits of the hash."""
    return F.shiftrightunsigned(hash_column, 64 - depth).cast("int")


def directory_of(counts: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """place, bucket (the first place that it owns), depth of every place with hashes, for counts of place, n.

    A bucket of `depth` leading bits stays when it holds at most `capacity` hashes, else its two halves take over: so
    the bucket of a place is the shallowest that is not overfull. Equal hashes can't be told apart by more bits, and at
    max_depth a bucket stays overfull. The table has at most 2^max_depth rows, so one
    task works it out.
    """
    own_bits = max_depth - F.col("depth")
    levels = counts.coalesce(1).withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    levels = levels.withColumn("bucket", F.call_function("shiftleft", F.call_function("shiftright", F.col("place"), own_bits), own_bits))
    levels = levels.withColumn("held", F.sum("n").over(Window.partitionBy("depth", "bucket")))
    fits = levels.where((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    return fits.groupBy("place").agg(F.min(F.struct("depth", "bucket")).alias("own")).select("place", "own.bucket", "own.depth")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty), hash64."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("hash64", F.xxhash64("text"))


@dataclass(frozen=True)
class ExactIndex:
    """An index under `path`: directory (place, bucket, depth) and buckets, a folder of entries for each bucket."""

    path: str
    max_depth: int = MAX_DEPTH

    def directory(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("place int, bucket int, depth int").parquet(f"{self.path}/directory")

    def entries(self, spark: SparkSession) -> DataFrame:
        """bucket, hash64, chain, digest, keep_id, group_size of each distinct text; bucket is the folder that it lies in."""
        return spark.read.schema("hash64 long, chain int, digest binary, keep_id long, group_size long, bucket int").parquet(f"{self.path}/buckets")

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows with the bucket that owns their hash64; null where no bucket does, as the index has no such hash."""
        places = F.broadcast(self.directory(rows.sparkSession).select(F.col("place").alias("_place"), "bucket"))
        return rows.join(places, place_of("hash64", self.max_depth) == F.col("_place"), "left").drop("_place")

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size, digest of each row; keep_id and group_size are null where the index has no such text.

        Rows meet the entries of their own bucket only. An entry of a chain is told by the digest of its text. Rows of
        one text that are very many can be dealt over several tasks, as the entry they meet is a single row.
        """
        rows = self.routed(keyed(docs, id_col, text_col).select("doc_id", "hash64", F.unhex(F.sha2("text", 256)).alias("digest")))
        entries = self.entries(docs.sparkSession).select("bucket", "hash64", "digest", "keep_id", "group_size")
        return rows.join(entries, ["bucket", "hash64", "digest"], "left").select("doc_id", "keep_id", "group_size", "digest")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, cold_rows: int = COLD_ROWS) -> ExactIndex:
    """Write the index of all distinct texts of docs.

    A null text counts as empty; an entry keeps the largest doc_id (null if no row of the text has one) and the number
    of rows. chain numbers the texts of one hash, in the order of their bytes.
    """
    spark = docs.sparkSession
    index = ExactIndex(f"{shared_folder(spark)}/exact-index-{uuid.uuid4().hex}", max_depth)
    rows = keyed(docs, id_col, text_col)
    hashes = materialise(rows.groupBy("hash64").agg(F.count(F.lit(1)).alias("n")), "exact-hashes")
    counts = hashes.groupBy(place_of("hash64", max_depth).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    directory_of(counts, capacity, max_depth).write.parquet(f"{index.path}/directory")

    total = hashes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(hashes.where(F.col("n") > max(cold_rows, total // MOST_HOT)).select("hash64"))  # at most MOST_HOT rows
    cold = rows.join(hot, "hash64", "left_anti").select("hash64", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    warm = rows.join(hot, "hash64", "left_semi").groupBy("hash64", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    owned = index.routed(cold.unionByName(warm)).repartition("bucket")
    same = owned.groupBy("bucket", "hash64", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))  # no shuffle: a bucket is in one task
    chained = same.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "hash64").orderBy("text")) - 1)
    entries = chained.select("bucket", "hash64", "chain", F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id", "group_size")
    entries.write.option("maxRecordsPerFile", capacity).partitionBy("bucket").parquet(f"{index.path}/buckets")
    discard(hashes)
    return index


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they have the same bytes (null: empty); of equal texts the row with the largest doc_id is
    kept. A row without doc_id is kept only where no row of its text has one (keep_id is null then); repeated rows with
    the doc_id that stays are all kept. An empty table gives no rows. Other columns of docs are not read.
    """
    rows = build_index(docs, id_col, text_col, capacity, max_depth).lookup(docs, id_col, text_col)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
