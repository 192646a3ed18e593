"""Mixing sources by temperature, in DataFrame functions alone.

Source shares p of all tokens are raised to an exponent a in (0, 1] and normalised. Bisection finds the smallest a for which
no source is passed over more than `repeats` times while the least repeated one is passed over once; or, with `entropy`, the
largest a at which the weights' entropy, in nats, is at least that (1 where the shares have it already). It runs as a fold over
the array of shares: one row for each source (a catalogue, not data that grows with the documents), in one aggregate.

The budget is `budget` tokens, or by default just so many that every source is passed over at least once: no document is lost.
A source's part of it is realised as permutations: the source's documents are dealt into blocks by a hash; each pass takes
blocks in an order drawn anew, and documents within a block likewise. All passes but the last are whole; the last ends where
the part is spent: a document is taken if those before it fill less than what is left. So a source has one cut, a place in its
last pass's order. The cut is found from sums over blocks, then within one block, so a source with a third of all rows is no
single task's work; texts are then read once more and compared with the cuts, and aren't shuffled.

Cases: null sources are a source of their own; a null text, and any without a word, counts 0 tokens; a source without tokens
gets one pass; repeated rows count each, and stand or fall together, as all rows do that draw alike; texts of any length count
whole; an empty table gives no rows. Other columns are kept;
tokens, pass, block_draw and draw clash: a column of such a name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Steps of bisection: the exponent is then known to 2 ** -40.
STEPS = 40


def with_tokens(docs: DataFrame) -> DataFrame:
    """docs with `tokens`: the runs of anything but ASCII white space."""
    return docs.withColumn("tokens", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def weights(counted: DataFrame, repeats: float | None = 4.0, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """Per source: source, held (tokens), weight, part (budgeted tokens). counted: source, tokens."""
    if (repeats is None) == (entropy is None):
        raise ValueError("give either repeats or entropy")
    sums = counted.groupBy("source").agg(F.sum("tokens").alias("held"))
    every = sums.agg(F.sort_array(F.collect_list(F.when(F.col("held") > 0, F.col("held").cast("double")))).alias("all"), F.sum("held").cast("double").alias("total"))
    shares = F.transform("all", lambda n: n / F.col("total"))
    low, high = F.array_min("all"), F.array_max("all")

    def fits(a: Column) -> Column:
        if repeats is not None:
            return F.pow(high / low, 1 - a) <= F.lit(float(repeats))
        z = F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a))
        spread = F.aggregate(shares, F.lit(0.0), lambda s, p: s - (F.pow(p, a) / z) * F.ln(F.pow(p, a) / z))
        return spread < F.lit(float(entropy))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(fits(middle), s["lo"]).otherwise(middle).alias("lo"), F.when(fits(middle), middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    end = "hi" if repeats is not None else "lo"
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda s: s[end])
    if repeats is not None:
        a = F.when(fits(F.lit(0.0)), 0.0).otherwise(found)
    else:
        a = F.when(~fits(F.lit(1.0)), 1.0).otherwise(found)
    one = every.select("all", "total", a.alias("a")).withColumn("z", F.expr("aggregate(all, 0D, (s, n) -> s + pow(n / total, a))"))
    raised = F.when(F.col("held") > 0, F.pow(F.col("held") / F.col("total"), F.col("a")) / F.col("z")).otherwise(0.0)
    # One row, with an array of one number for each source.
    per = sums.withColumn("j", F.lit(1)).join(F.broadcast(one.withColumn("j", F.lit(1))), "j").withColumn("weight", F.coalesce(raised, F.lit(0.0)))
    if budget is not None:
        part = F.floor(F.col("weight") * budget + 0.5)
    else:
        most = F.array_max("all")
        part = F.when(F.col("held") > 0, F.greatest(F.col("held"), F.floor(F.col("weight") * most / (F.pow(most / F.col("total"), F.col("a")) / F.col("z")) + 0.5))).otherwise(0)
    return per.select("source", "held", "weight", F.coalesce(part, F.lit(0)).cast("long").alias("part"))


def _draw(seed: int, *parts: Column | str) -> Column:
    """A draw that other engines can repeat: the MD5 of the parts, as text."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *text).cast("binary"))


#: With more sources than that, the plan is joined without being broadcast.
BROADCAST_SOURCES = 50_000


def mix(docs: DataFrame, repeats: float | None = 4.0, entropy: float | None = None, budget: int | None = None, seed: int = 1, blocks: int = 4096) -> DataFrame:
    """docs, each row as often as it's taken, with tokens, pass (from 0), block_draw and draw (a pass's order within its source).

    docs: doc_id, text, source. `blocks` bounds the sums over a source's blocks.
    """
    kept = [c for c in docs.columns if c not in ("tokens", "pass", "block_draw", "draw")]
    source = {"sn": F.col("source").isNull(), "sk": F.coalesce(F.col("source").cast("string"), F.lit(""))}
    row = F.struct(*kept).alias("row")  # so that no column of docs clashes with those used here
    rows = with_tokens(docs.select(row, "doc_id", "text", "source")).withColumns(source)
    narrow = materialize(rows.select("sn", "sk", "source", "doc_id", "tokens"), "tokens")
    given = weights(narrow.select("source", "tokens"), repeats, entropy, budget).withColumns(source)
    whole = F.when(F.col("held") > 0, F.floor(F.col("part") / F.col("held"))).otherwise(F.lit(1)).cast("int")
    plan = materialize(given.select("sn", "sk", whole.alias("whole"), (F.col("part") - whole * F.col("held")).alias("rest")), "plan")
    near = F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda x: x)

    block = F.conv(F.substring(_draw(seed, "doc_id"), 1, 8), 16, 10).cast("long") % blocks
    block_draw, draw = _draw(seed, "sk", "pass", block), _draw(seed, "sk", "pass", "doc_id")
    last = narrow.join(near(plan.filter("rest > 0")), ["sn", "sk"]).withColumn("pass", F.col("whole")).withColumn("block_draw", block_draw)
    sums = last.groupBy("sn", "sk", "rest", "block_draw").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("sn", "sk").orderBy("block_draw").rowsBetween(Window.unboundedPreceding, -1)
    cut_block = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("base < rest and base + n >= rest")
    cut_block = materialize(cut_block.select("sn", "sk", "block_draw", "base"), "cut_block")
    inside = last.join(near(cut_block), ["sn", "sk", "block_draw"]).groupBy("sn", "sk", "rest", "block_draw", "base", draw.alias("draw")).agg(F.sum("tokens").alias("n"))
    first = Window.partitionBy("sn", "sk").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("at", F.col("base") + F.coalesce(F.sum("n").over(first), F.lit(0))).filter("at < rest")
    cuts = taken.groupBy("sn", "sk").agg(F.max("block_draw").alias("cut_block"), F.max("draw").alias("cut"))
    full = materialize(plan.join(cuts, ["sn", "sk"], "left"), "cuts")

    passes = F.explode(F.sequence(F.lit(0), F.col("whole") - F.when(F.col("cut").isNull(), 1).otherwise(0)))
    each = rows.join(near(full), ["sn", "sk"]).filter("whole > 0 or cut is not null").withColumn("pass", passes)
    each = each.withColumns({"block_draw": block_draw, "draw": draw})
    return each.filter("pass < whole or block_draw < cut_block or (block_draw = cut_block and draw <= cut)").select(*[F.col("row")[c].alias(c) for c in kept], "tokens", "pass", "block_draw", "draw")


def oracle_sql(repeats: float = 4.0, seed: int = 1, blocks: int = 4096) -> str:
    """DuckDB SQL of the rows of mix() with a limit of repeats: doc_id, source, tokens, pass, block_draw, draw. The exponent is the limit that bisection nears."""
    draw = f"md5(concat_ws(':', '{seed}', coalesce(source, ''), pass, "
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
h AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS held FROM d GROUP BY source),
t AS (SELECT max(held) AS hi, min(held) FILTER (held > 0) AS lo, CAST(sum(held) AS DOUBLE) AS total FROM h),
e AS (SELECT *, CASE WHEN hi <= lo * {repeats} THEN 0 ELSE 1 - ln({repeats}) / ln(hi / lo) END AS a FROM t),
p AS (SELECT source, held, CASE WHEN held > 0 THEN greatest(held, CAST(floor(pow(held / total, a) * hi / pow(hi / total, a) + 0.5) AS BIGINT)) ELSE 0 END AS part FROM h, e),
q AS (SELECT *, CASE WHEN held > 0 THEN part // held ELSE 1 END AS whole FROM p),
w AS (SELECT source, whole, part - whole * held AS rest FROM q),
x AS (SELECT d.*, whole, rest, unnest(range(whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS pass FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
y AS (SELECT *, {draw}('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {blocks})) AS block_draw, {draw}coalesce(CAST(doc_id AS VARCHAR), ''))) AS draw FROM x),
z AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY block_draw, draw RANGE UNBOUNDED PRECEDING) - sum(tokens) OVER (PARTITION BY source, pass, block_draw, draw), 0) AS ahead FROM y)
SELECT doc_id, source, tokens, CAST(pass AS INTEGER) AS pass, block_draw, draw FROM z WHERE pass < whole OR ahead < rest"""
