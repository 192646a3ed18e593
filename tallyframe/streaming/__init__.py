"""Files as they arrive: each batch runs through the same transformations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import analysis, statement
from ..store import scratch, settled


def reports(files: DataFrame, proposals: DataFrame | None = None, narrative: DataFrame | None = None) -> DataFrame:
    """Files to reports, one row for each file: those that can't be read have their error.

    proposals (analysis.merge_assisted) and narrative (assist.narrate) are what outside help gave, if any.
    """
    tokens = settled(sources.tokens_of_files(files), "tokens")  # files are parsed once
    known = settled(sources.documents(files.select("path", "length"), tokens), "documents")
    fine = known.filter("error is null").select("doc_id")
    read = statement.statements(tokens.drop("code").join(fine, "doc_id", "left_semi"))
    figures = settled(read.figures if proposals is None else analysis.merge_assisted(read.figures, read.unmapped, proposals), "figures")
    return analysis.report(figures, read.periods, read.companies, read.warnings, read.unmapped, known, narrative)


def watch(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Starts a stream over a folder; each micro-batch of new files is read, analysed and given to the sink with its number.

    Files are told apart by their content's SHA-256, which is state of the stream: what was there before, under any name and in any
    batch, is passed over (of equal files in one batch any is taken). The sink must write within its call: the tables that a batch
    needs go when it is done. A batch that failed comes again with the same number and files, so a sink that writes by the number,
    as into() does, has each file's report once.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(path)
    fresh = stream.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"])

    def run(batch: DataFrame, n: int) -> None:
        with scratch():
            files = settled(batch.drop("digest"), "files")  # read several times, and state is asked once
            if not files.isEmpty():
                sink(reports(files), n)

    return fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def into(target: str) -> Callable[[DataFrame, int], None]:
    """A sink of JSON: a folder for each batch, which a batch that comes again replaces."""

    def sink(out: DataFrame, n: int) -> None:
        out.write.mode("overwrite").json(f"{target.rstrip('/')}/batch={n}")

    return sink
