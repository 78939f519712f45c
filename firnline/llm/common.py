"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.sources.tables import delete
from firnline.sources.tables import work_folder as shared_folder

#: A word: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (written := _written.get()) is not None:
        written.append(path)
    return out


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def settled(spark: SparkSession, name: str, work: Callable[[], DataFrame]) -> DataFrame:
    """The rows of work(), written; all else that was written on the way to them is deleted."""
    token = _written.set([])
    try:
        out = materialise(work(), name)
        rest = [path for path in _written.get() if path != out._stored_at]
    finally:
        _written.reset(token)
    for path in rest:
        delete(spark, path)
    if (written := _written.get()) is not None:
        written.append(out._stored_at)
    return out


def discard(*stored: DataFrame) -> None:
    """Delete what `materialise` wrote for these, once nothing that is still to be worked out reads it."""
    for df in stored:
        delete(df.sparkSession, df._stored_at)


def dealt_anew(df: DataFrame) -> DataFrame:
    """df without its partitioning, for a join with the many rows that it summed up by the join's key.

    Else Spark joins where it has summed up, all rows of a key in one task; so it deals both sides out for the join
    itself, and splits the rows of a very frequent key over several tasks.
    """
    return df.hint("rebalance")


#: Bytes of input for each task that gathers rows by a key, and the most such tasks.
TASK_BYTES, MOST_TASKS = 32 << 20, 100_000


def tasks_for(*inputs: DataFrame) -> int:
    """How many tasks to gather rows by a key in: what the session has set, or more if the inputs' files ask for it.

    Spark knows the size of files; of other inputs it has no idea and says so by a number beyond any size.
    """
    size = sum(int(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for x in inputs)
    return max(int(inputs[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // TASK_BYTES), MOST_TASKS) if size < 1 << 55 else 0)


#: Rows and bytes of an Arrow batch that Python workers get, the same for all operators.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get by rows and by bytes, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of the tables by which rows that can't be wanted are passed over before they are moved.
FILTER_BITS = 1 << 24


def bit_table(wanted: DataFrame, column: str) -> np.ndarray:
    """A table of FILTER_BITS bits, of this size at any scale, in which the low bits of each wanted number are set."""
    place = F.col(column).bitwiseAND(FILTER_BITS - 1) + 1  # bitmaps count from 1
    rows = wanted.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:  # at most FILTER_BITS / 32768, of 4 KB each
        table[(row["at"] - 1) * 4096 : row["at"] * 4096] |= np.frombuffer(row["bits"], np.uint8)
    return table


def may_be_wanted(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers have their bit set: all wanted ones, and few others while the table is mostly empty."""
    place = numbers.astype(np.int64) & (FILTER_BITS - 1)
    return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
