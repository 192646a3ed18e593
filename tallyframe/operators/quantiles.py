"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, settled

#: Values that a group gathers in one place, and cuts of a histogram.
SMALL, CUTS = 10_000, 32


def medians(rows: DataFrame, by: list[str], value: str, small: int = SMALL) -> DataFrame:
    """by and median: the mean of the two middle values of each group (the middle one, twice, of an odd number). Nulls don't count; a group of nothing else has a null median.

    A group is narrowed by histograms until the values between two bounds are at most `small`: cuts come from a mergeable sketch of
    the values that are left, the values between cuts and those equal to one are counted, and the bounds become those of the count
    that holds the wanted place. Each round reads the rows once and sends some counts of a group from each task. Only the last few
    values are gathered. Bounds are broadcast: a row or two for each group of more than `small` values.
    """
    given = rows.select(*by, F.col(value).cast("double").alias("v"))
    sizes = settled(given.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("place")
    # at: the wanted place among the values between the bounds; place: among all.
    state = settled(sizes.filter("n > 0").select(*by, middle, "n", "low", "high").withColumn("at", F.col("place")), "bounds")
    done = []
    same = lambda df: [df[k].eqNullSafe(F.col(f"_{k}")) for k in by]
    key = [F.col(k).alias(f"_{k}") for k in by]
    while True:
        done.append(state.filter(f"n <= {small} OR low = high"))
        wide = state.filter(f"n > {small} AND low < high")
        if wide.isEmpty():
            break
        bounds = F.broadcast(wide.select(*key, "place", "low", "high", "at"))
        inside = lambda: given.join(bounds, same(given)).filter("v BETWEEN low AND high").select(*by, "place", "at", "v")
        shares = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
        cuts = settled(inside().groupBy(*by, "place").agg(F.array_distinct(F.percentile_approx("v", shares, F.lit(50 * CUTS))).alias("cuts")), "cuts")
        values = inside()
        met = values.join(F.broadcast(cuts.select(*key, F.col("place").alias("_p"), "cuts")), [*same(values), F.col("place") == F.col("_p")])
        below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        part = 2 * below + F.array_contains("cuts", F.col("v")).cast("int")
        counted = met.groupBy(*by, "place", "at", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrowed = counted.withColumn("before", before).filter("at >= before AND at < before + n")
        state = settled(narrowed.select(*by, "place", "n", "low", "high", (F.col("at") - F.col("before")).alias("at")), "bounds")
        discard(cuts)
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    last = settled(last, "last")
    few = F.broadcast(last.filter("low < high").select(*key, "place", "low", "high", "at"))
    left = given.join(few, same(given)).filter("v BETWEEN low AND high").groupBy(*by, "place", "at").agg(F.array_sort(F.collect_list("v")).alias("values"))
    picked = left.select(*by, "place", F.get("values", F.col("at").cast("int")).alias("v")).unionByName(last.filter("low = high").select(*by, "place", F.col("low").alias("v")))
    found = picked.groupBy(*by).agg(F.avg("v").alias("median"))
    return sizes.select(*by).join(found, [sizes[k].eqNullSafe(found[k]) for k in by], "left").select(*(sizes[k] for k in by), "median")
