"""Optional outside help, as tables: when it's wanted, its narrative, and the text that it would be given. No network code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds and severities that a narrative may use, and its limits.
KINDS, SEVERITIES = ("strength", "concern", "observation", "trend"), ("high", "medium", "low")
LEAST, MOST, INSIGHTS = 40, 1200, 8


def wanted(confidence: Column, n_unmapped: Column, available: Column, opted_out: Column, least: float = 0.6) -> Column:
    """Whether a document should get help: it's there, not declined, and mapping is unsure or incomplete."""
    return available & ~opted_out & ((confidence < least) | (n_unmapped > 0))


def _valid(narrative: DataFrame) -> DataFrame:
    """The narratives that are taken: of fitting length, with some insight, and no more than INSIGHTS. Insights of unknown kinds or severities are left out."""
    fine = F.filter("insights", lambda x: x["kind"].isin(*KINDS) & x["severity"].isin(*SEVERITIES))
    valid = F.length("summary").between(LEAST, MOST) & (F.size("insights") <= INSIGHTS)
    return narrative.filter(valid).withColumn("insights", fine).filter(F.size("insights") > 0)


def narrate(insights: DataFrame, narrative: DataFrame) -> DataFrame:
    """Replaces a document's insights by those of a valid narrative (doc_id, summary, insights array<struct<kind,severity,title,detail>>) that has any; these have no evidence."""
    told = _valid(narrative).select("doc_id", F.posexplode("insights").alias("i", "x"))
    anew = told.select("doc_id", F.concat(F.lit("told-"), F.col("i") + 1).alias("insight"), "x.kind", "x.severity", "x.title", "x.detail", F.array().cast("array<string>").alias("evidence"), (F.col("i") + 1).alias("position"))
    return insights.join(told.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(anew.select(*insights.columns))


def retold(summaries: DataFrame, narrative: DataFrame) -> DataFrame:
    """doc_id, summary (of a valid narrative, where there is one), told (whether it is)."""
    anew = _valid(narrative).select("doc_id", F.col("summary").alias("anew"))
    return summaries.join(anew, "doc_id", "left").select("doc_id", F.coalesce("anew", "summary").alias("summary"), F.col("anew").isNotNull().alias("told"))


def data_block(figures: DataFrame, metrics: DataFrame, insights: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, block: figures, metrics and the first findings as lines of text, in this order."""
    line = lambda df, part, text, key: df.groupBy("doc_id").agg(F.lit(part).alias("part"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, text.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    n = lambda c: F.coalesce(F.format_number(F.col(c), 2), F.lit("unknown"))
    parts = [
        line(figures, 0, F.concat_ws(" ", "concept", "period_id", n("value")), ["concept", "period_id"]),
        line(metrics, 1, F.concat_ws(" ", "metric", "period_id", n("value"), "verdict"), ["seq", "period_id"]),
        line(insights.filter(F.col("position") <= most), 2, F.concat_ws(" ", "severity", "kind", "title"), ["position"]),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]), "\n\n").alias("block"))
