"""The corpus pipeline: language ID, near duplicates, secrets, source weights, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import jaccard, langid, mixing, packing, secrets
from tallyframe.llm.common import crc_mod, materialize
from tallyframe.llm.queries import vocabulary


#: Settings of the session while the pipeline runs: whole texts pass through Python workers, in batches that are small beside an executor's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def _small(spark: SparkSession) -> None:
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the model knows, and sets lang to it. Texts that are null or have no letter go.

    Learns from the labelled rows that op9 learns from, at most langid.PER_LANGUAGE for each language. Without labels no
    language is known; then all texts with a letter stay, with the lang they have. Called by itself, it leaves the session with
    the batches of BATCHES, which its caller's write needs; run() sets them back.
    """
    _small(spark)
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    if not model.families:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    clear = "_".join(["predicted", *docs.columns])  # longer than any column of docs, hence none of them
    marked = langid.predict(docs, model, (clear, f"{clear}_score"))
    return marked.filter(F.col(clear) != langid.UNDETERMINED).withColumn("lang", F.col(clear)).select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key, and its name: the id, or a number in the order of ids where some have none; those come last, one for each text.

    The key is null where there is neither an id nor a word.
    """
    key = "_".join(["key", *docs.columns])  # longer than any column of docs, hence none of them
    if docs.filter("doc_id is null").isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    tag = F.when(F.col("doc_id").isNull() & F.col("text").rlike(r"\S"), F.sha2(F.col("text").cast("binary"), 256))
    tagged = docs.withColumn(f"{key}_tag", tag)
    units = tagged.select(F.col("doc_id").alias("i"), F.col(f"{key}_tag").alias("t")).filter("i is not null or t is not null").distinct()
    units = materialize(units.sort(F.asc_nulls_last("i"), "t").withColumn(key, F.monotonically_increasing_id()), "units")
    same = tagged["doc_id"].eqNullSafe(units["i"]) & tagged[f"{key}_tag"].eqNullSafe(units["t"])
    return materialize(tagged.join(units, same, "left").select(*docs.columns, key), "keyed"), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id, once.

    Rows with the same id and text are copies, and one of them stays; otherwise rows that repeat an id stand or fall together.
    Texts without an id take part too, after all that have one. A row with neither an id nor a word stays.
    """
    rows, key = _keyed(docs)
    groups = materialize(jaccard.jaccard_groups(rows.select(F.col(key).alias("doc_id"), "text"), k=5, num=80, den=100, enumerated=False), "groups")  # a third fewer signatures: disk is scarcer here than pairs
    gone = materialize(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    many = materialize(groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).filter("n > 1").select(key), "many")
    left = rows.join(gone, key, "left_anti")
    if not many.isEmpty():
        left = left.join(many, key, "left_anti").unionByName(left.join(many, key, "left_semi").dropDuplicates([key, "text"]))
    return left.select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; the secrets in its text are replaced by a mark.

    Null texts stay null. Repeated rows and rows without an id are treated each; an empty table stays empty; all columns are kept.
    """
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document once, and those of small sources up to twice, as temperature mixing with that limit has it.

    A null source is a source; null and empty texts count no tokens and are taken once. Repeated rows stand or fall together; an
    empty table stays empty; all columns are kept, a clash with the operator's own included.
    """
    return mixing.mix(docs, repeats=2.0).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens; a document that mixing repeats is packed as often.

    Null and empty texts are the end id alone; an empty table gives no rows; columns but doc_id and text are ignored.
    Workers let go of their encoders, since other stages may run on the executors next.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), keep_encoder=False)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID, near duplicates and packing can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again. The session's settings are as before when it returns: what it returns holds no texts."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        _small(spark)
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
