"""Helpers shared by the training-data operators: shared scratch tables, label sampling, sizing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import discard, new_folder
from ..store import settled as materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> Iterator[None]:
    """Within it, Python workers get batches of at most so many rows and about so many bytes: what is run must be run within it too."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in names]
    try:
        for k, v in zip(names, (str(rows), size), strict=True):
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in zip(names, before, strict=True):
            spark.conf.set(k, v)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan_parts(df: DataFrame) -> int:
    """Partitions of df's scan, and no fewer than the session's shuffle partitions."""
    return max(shuffle_parts(df.sparkSession), df.rdd.getNumPartitions())


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def bounded_sample(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """Up to about `limit` rows, chosen by a hash of `key`: all rows if they are fewer. The limit is a parameter of the model that is fitted."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(17), key), F.lit(1_000_000)) < int(1_000_000 * limit / n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of labelled documents, of about `limit` labels: a parameter of the model that is fitted.

    The labels are thinned first, by a hash, so the side that is broadcast has at most twice `limit` rows and texts aren't
    shuffled. Only doc_id and text are taken of docs, and doc_id and the label of labels, whatever other columns they have.
    """
    known = labels.select(F.col("doc_id").alias("i"), F.col(label).cast("int").alias(label)).filter(F.col("i").isNotNull() & F.col(label).isin(0, 1)).distinct()
    few = materialize(bounded_sample(known, F.col("i"), limit).limit(2 * limit), "labels")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(few), texts["doc_id"] == few["i"]).select("doc_id", "text", label)


def task_ids() -> tuple[int, int]:
    """Partition and attempt of the running task."""
    at = TaskContext.get()
    return at.partitionId(), at.taskAttemptId()


__all__ = ["bounded_sample", "crc_mod", "discard", "labelled_sample", "materialize", "new_folder", "scan_parts", "shuffle_parts", "small_batches", "table", "task_ids"]
