"""Taking in observations as a stream: each micro-batch goes through the same converging commit as a batch job.

A date's rows may come in any number of batches. Each is merged with what is stored: what comes last counts for its
variable and pixel, so a re-released value replaces the old one. A batch that is run again, after a failure, finds its
own rows or merges the same values anew: the tables end up the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firnline.sources.ingest import commit, provenance_tag
from firnline.sources.snapshots import Snapshot


#: The column that arrived() adds.
ARRIVED = "arrived"


def arrived(files: DataFrame) -> DataFrame:
    """A stream of Parquet files with the order in which rows arrive: by the file's time, its path, and the row in it."""
    return files.withColumn(ARRIVED, F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")))


def batch_plan(batch: DataFrame, manifest: DataFrame | None, order: str | None = None) -> DataFrame:
    """date, variable, source_hash, action for each date and variable of a batch (date, variable, tile_id, pixel_id, value).

    The digest adds up row hashes, so it does not depend on the order of rows and needs no group in one task. A date is
    skipped when the manifest has all its variables of the batch with these digests.
    """
    row = F.xxhash64("variable", "pixel_id", F.col("value").cast("double"), *([order] if order else [])).cast("decimal(38,0)")
    days = batch.groupBy("date", "variable").agg(F.sum(row).alias("_s"), F.count(F.lit(1)).alias("_n"))
    days = days.select("date", "variable", provenance_tag([F.col("_s"), F.col("_n")]).alias("source_hash"))
    if manifest is None:
        return days.withColumn("action", F.lit("write"))
    known = manifest.select("date", "variable", F.col("source_hash").alias("_known"))
    seen = days.join(known, ["date", "variable"], "left").withColumn("_same", F.coalesce(F.col("_known") == F.col("source_hash"), F.lit(False)))
    whole = seen.groupBy("date").agg(F.min("_same").alias("_all"))  # a row per day
    return seen.join(whole, "date").select("date", "variable", "source_hash", F.when(F.col("_all"), "skip").otherwise("write").alias("action"))


def start_ingest(observations: DataFrame, variables: Sequence[str], path: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Commit a stream's dates to a dataset.

    order: a column of the stream that tells which of a pixel's values in one batch is the last, as `arrived` adds it;
    across batches, which Spark runs in order, the later batch's counts. Rows of variables that the dataset lacks are
    passed over.
    """

    def take(batch: DataFrame, _: int) -> None:
        held = batch.where(F.col("variable").isin(*variables)).persist()  # the digest and the commit read it
        try:
            base = Snapshot.current(batch.sparkSession, path)
            commit(held, batch_plan(held, base.manifest(), order), variables, path, merge=True, order=order, base=base)
        finally:
            held.unpersist()

    return observations.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
