"""Tables between layers: written as Parquet in a folder that driver and executors share, and read back.

That cuts lineage, so plans stay small and survive lost executors. The folder is that of spark.checkpoint.dir, or of
SparkContext.setCheckpointDir. Where neither is set, a session whose executor is the driver's own process gets a folder of its
own; on a cluster that is an error, since executors would each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written in this process, removed when it ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one. It goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/tallyframe-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back. The folder goes when the driver's process ends, or with discard()."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the folders of tables made by settled(). Whatever was read from them must have been written since."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Whatever new_folder() and settled() make within it goes at its end, also when it fails: what was read from that must have been written by then."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        for spark, path in _WRITTEN[first:]:
            _remove(spark, path)
        del _WRITTEN[first:]


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
