"""The queries op1 to op13: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, jaccard, langid, licences, mixing, neargraph, packing, quality, secrets, token_files, topk, toxicity, turntrie
from .common import crc_mod, labelled_sample, table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, root = token_files.encode_to_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read_documents(spark, manifest, root)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op4_near_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neargraph.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"))
    rules = quality.fit(labelled_sample(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"), "quality", quality.FIT_ROWS))
    return quality.score(docs, rules, "doc_id", "held_out").withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repeats=4.0).select("doc_id", "source", "tokens", "pass", "block_draw", "draw")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    labelled = labelled_sample(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"), "toxic", toxicity.FIT_ROWS)
    scored = toxicity.score(docs, toxicity.fit(labelled))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op12_ball_k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_token_files": op2_token_files,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_graph": op4_near_graph,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mixing": op8_source_mixing,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_license_scan": op11_license_scan,
    "op12_ball_k_means": op12_ball_k_means,
    "op13_conversation_trie": op13_conversation_trie,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_exact_top_k": topk.ORACLE_SQL, "op3_secret_scan": secrets.oracle_sql(), "op8_source_mixing": mixing.oracle_sql(4.0), "op12_ball_k_means": balls.oracle_sql(), "op13_conversation_trie": turntrie.ORACLE_SQL}
