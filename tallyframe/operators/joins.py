"""Joins whose keys may be missing or very frequent."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if more than one in so many rows has it; there are fewer frequent keys than that.
SHARE = 1000
#: A table of up to so many rows is broadcast whole.
FEW = 20_000


def frequent(counts: DataFrame, keys: list[str], n: str = "count", share: int = SHARE) -> DataFrame:
    """The frequent keys of `counts`, which has a row for each key with its number of rows: fewer than `share`."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counts.filter(F.col(n) * share > total).select(*keys)


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], often: DataFrame) -> DataFrame:
    """rows with the other columns of `table`, which has one row for each key; null where it has none, and where a key is null.

    often: the frequent keys of rows, as frequent() tells them, or none. Their part of the table is broadcast: fewer than SHARE
    rows. The rest is joined by a shuffle, in which rows that have met theirs already, and rows without a key, are spread by a hash
    of the whole row over all partitions. So no partition is large because a key is frequent or missing.
    """
    values = [c for c in table.columns if c not in keys]
    few = F.broadcast(table.join(F.broadcast(often), keys, "left_semi"))
    few = few.select(*keys, *(F.col(c).alias(f"_few_{c}") for c in values), F.lit(True).alias("_few"))
    met = rows.join(few, keys, "left")
    done = reduce(or_, (F.col(k).isNull() for k in keys), F.col("_few").isNotNull())
    # The key's hash joins along: a number of its own where there is nothing to meet.
    place = F.when(done, F.xxhash64(*(F.col(c) for c in rows.columns))).otherwise(F.xxhash64(*keys))
    out = met.withColumn("_place", place).join(table.withColumn("_place", F.xxhash64(*keys)), [*keys, "_place"], "left")
    return out.select(*rows.columns, *(F.when(F.col("_few"), F.col(f"_few_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def told(rows: DataFrame, table: DataFrame, keys: list[str], often: DataFrame) -> DataFrame:
    """look_up(); a table of up to FEW rows is broadcast whole, so that no row is shuffled."""
    if table.limit(FEW + 1).count() > FEW:
        return look_up(rows, table, keys, often)
    return rows.join(F.broadcast(table), keys, "left").select(*rows.columns, *(c for c in table.columns if c not in keys))
