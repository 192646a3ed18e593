"""A prefix trie of conversations, held as chains.

A node is a distinct sequence of first turns; its owner is its smallest member. What a conversation owns at one depth it owns at
every greater one, so the nodes that it owns are one chain, from its first owned depth to its end, and the chains are the tree:

1. Prefix digests. A turn is hashed with its place, and a prefix is the XOR of its turns' hashes (two words of 64 bits, and its
   depth). XOR is associative, so prefixes are running totals over a range-partitioned table, and a conversation of any length is
   spread over tasks.
2. Minima. Digests are grouped (partial sums first) to their smallest conversation, the number of members and the bytes of the
   last text: those groups are the nodes.
3. Search. Every conversation bisects for its first owned depth, all of them at a time: a round looks up one prefix of each
   conversation and the owner of its digest. The last owner that wasn't itself is where its chain hangs.
4. Totals. The sums of chains go up the tree of chains with doubling strides (a chain gives what it has to the one 1, 2, 4, ...
   above it), so a tree of chains of any height takes the logarithm of its height in rounds. Within a chain, sums from the end
   are running totals again.

Hot keys: lookups send keys with more than a SHARE-th of the rows to a broadcast table (fewer than SHARE keys, by counting) and
join only the rest. Groups are pre-aggregated. The ids that end at a node are joined in order, in strings of at most CHUNK ids,
and hashed as a stream; such a node's task holds one string at a time. Each step is written in the shared folder.

Cases: a null turn comes first; turns that tie come in the order of role, then of the text's SHA-256; repeated rows are turns
each. Null roles and texts become empty. Rows without a conv_id take no part. c%5 keeps the sign of c, as in SQL. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, scan_parts

#: A key with more than one in so many rows is looked up by broadcast: there are fewer than SHARE of them.
SHARE = 1000
#: Ids of one string that is hashed.
CHUNK = 2000
#: A conversation takes the first turns of the one whose id is a multiple of FAMILY, fewer than MOST of them.
FAMILY, MOST = 5, 9


def placed(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """df in ranges of (key, order), written, with the range's number as `part`. Equal rows may be parted too."""
    tie = F.monotonically_increasing_id()
    ranged = df.withColumn("tie", tie).repartitionByRange(scan_parts(df), F.col(key), *order, F.col("tie"))
    return materialize(ranged.withColumn("part", F.spark_partition_id()), name)


def running(df: DataFrame, key: str, order: list[Column], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """placed() rows with running totals of each key in `order`: name -> (sum, bit_xor or count, column).

    Each range is totalled by itself. A key that began in an earlier range starts from the totals of its earlier ranges: one row
    for each range at most, which is broadcast.
    """
    own = Window.partitionBy(key, "part").orderBy(*order, F.col("tie"))
    how = {"sum": F.sum, "bit_xor": F.bit_xor, "count": F.count}
    first = df.groupBy("part").agg(F.min(key).alias(key)).select(key).distinct()  # a key in several ranges is the first of one
    told = df.join(F.broadcast(first), key, "left_semi").groupBy(key, "part").agg(*(how[f](c).alias(f"{n}_0") for n, (f, c) in totals.items()))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    add = {"sum": F.sum, "bit_xor": F.bit_xor, "count": F.sum}
    told = told.select(key, "part", *(add[f](f"{n}_0").over(before).alias(f"{n}_0") for n, (f, _) in totals.items()), F.row_number().over(Window.partitionBy(key).orderBy("part")).alias("nth"))
    told = told.filter("nth > 1").drop("nth")
    out = df.select("*", *(how[f](c).over(own).alias(n) for n, (f, c) in totals.items())).join(F.broadcast(told), [key, "part"], "left")
    zero = lambda n: F.coalesce(F.col(f"{n}_0"), F.lit(0))
    return out.withColumns({n: F.col(n).bitwiseXOR(zero(n)) if f == "bit_xor" else F.col(n) + zero(n) for n, (f, _) in totals.items()}).drop(*(f"{n}_0" for n in totals))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with `table`, which has one row for each key; rows without one go. Frequent keys are broadcast, the rest shuffled."""
    n = rows.count()
    heavy = materialize(rows.groupBy(*keys).count().filter(F.col("count") * SHARE > n).select(*keys), "heavy")
    if heavy.isEmpty():
        return rows.join(table, keys)
    few = F.broadcast(table.join(F.broadcast(heavy), keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(heavy), keys, "left_anti").join(table, keys))


def _depths(conv: Column) -> Column:
    """How many turns come from the family's first conversation."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, placed: conv_id, depth (from 1), words h1 and h2, bytes; and every conv_id, a row each."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).alias("bytes"))
    at = [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    own = placed(turns, "conv_id", at, "turns")
    ranked = running(own, "conv_id", at, {"nth": ("count", "bytes")}).select("conv_id", "nth", "role", "digest", "bytes")
    turns = materialize(ranked, "ranked")
    convs = materialize(turns.select("conv_id").distinct(), "convs")
    discard(own)
    family = F.explode(F.sequence(F.lit(0), F.lit(FAMILY - 1)))
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("nth") < MOST)).select("*", family.alias("i"))
    # Ids below zero keep their remainder's sign, so their family lies below its first.
    heads = heads.withColumn("to", F.when(F.col("conv_id") < 0, F.col("conv_id") - F.col("i")).otherwise(F.col("conv_id") + F.col("i")))
    zero = turns.filter((F.col("conv_id") == 0) & (F.col("nth") < MOST)).select("*", F.explode(F.sequence(F.lit(1), F.lit(FAMILY - 1))).alias("i"))
    heads = heads.unionByName(zero.withColumn("to", -F.col("i").cast("long"))).filter(F.col("nth") <= _depths(F.col("to")))
    columns = ("nth", "role", "digest", "bytes")
    heads = heads.select(F.col("to").alias("conv_id"), F.lit(0).alias("side"), *columns).join(convs, "conv_id", "left_semi")
    rest = turns.filter(F.col("nth") > _depths(F.col("conv_id"))).select("conv_id", F.lit(1).alias("side"), *columns)
    return placed(heads.unionByName(rest), "conv_id", [F.col("side"), F.col("nth")], "rebuilt"), convs


def trie(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text. Per node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(conversations)
    order = [F.col("side"), F.col("nth")]
    deep = running(rows, "conv_id", order, {"depth": ("count", "bytes")})
    word = lambda seed: F.xxhash64(F.lit(seed), "depth", F.length("role"), "role", "digest")
    hashed = materialize(deep.withColumns({"h1": word(1), "h2": word(2)}).drop("role", "digest"), "hashed")
    discard(rows)
    prefixes = materialize(running(hashed, "conv_id", order, {"p1": ("bit_xor", "h1"), "p2": ("bit_xor", "h2")}).select("conv_id", "depth", "p1", "p2", "bytes"), "prefixes")
    discard(hashed)
    nodes = materialize(prefixes.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), "nodes")
    found = first_owned(prefixes, nodes, convs)
    discard(prefixes)
    top = found.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"))  # the root: one row, none for an empty table
    every = nodes.select("owner", "depth", "n_convs", "bytes").unionByName(top.filter("owner is not null").select("owner", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).alias("bytes")))
    every = every.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    # Chains: first depth, the chain above, and the depth there. That of the smallest conversation holds the root.
    chains = found.filter("first <= length or up is null").select(F.col("conv_id").alias("owner"), F.when(F.col("up").isNotNull(), F.col("first")).otherwise(0).alias("depth"), "up")
    ends = found.select(F.when((F.col("first") <= F.col("length")) | F.col("up").isNull(), F.col("conv_id")).otherwise(F.col("up")).alias("owner"), F.col("length").alias("depth"), "conv_id")
    ended = materialize(_digests(ends), "ends")
    kids = chains.filter("up is not null").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    local = every.join(chains, ["owner", "depth"], "left").join(kids, ["owner", "depth"], "left").join(ended, ["owner", "depth"], "left")
    local = local.withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.when(F.coalesce("chain_ends", F.lit(False)), 0).otherwise(1))
    local = materialize(local.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "local")
    discard(nodes, ended)
    sums = local.groupBy("owner").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), F.max("up").alias("up"), F.min("depth").alias("first"))
    given = chain_totals(sums).filter("up is not null").groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.sum("saved").alias("saved_in"), F.sum("leaves").alias("leaves_in"))
    filled = local.join(given, ["owner", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("saved_in", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("leaves_in", F.lit(0))})
    order = [F.desc("depth")]
    laid = placed(filled.select("owner", "depth", "up", "n_convs", "n_children", "ends_sha256", "saved", "leaf"), "owner", order, "laid")
    discard(local)
    out = running(laid, "owner", order, {"saved_tokens": ("sum", "saved"), "n_leaves": ("sum", "leaf")})
    parent = F.when(F.col("up").isNotNull(), F.col("up")).when(F.col("depth") > 0, F.col("owner"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def first_owned(prefixes: DataFrame, nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """Per conversation: conv_id, length, first (its first owned depth, length + 1 if it owns none), up (the owner just above; null for the smallest conversation)."""
    lengths = prefixes.groupBy("conv_id").agg(F.max("depth").alias("length"))
    least = convs.agg(F.min("conv_id")).first()[0]
    rows = convs.join(lengths, "conv_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    rows = rows.select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high"), F.when(F.col("conv_id") != F.lit(least).cast("long"), F.lit(least).cast("long")).alias("up"))
    state, done = materialize(rows, "search"), []
    while True:
        done.append(state.filter("low >= high").select("conv_id", "length", F.col("low").alias("first"), "up"))
        now = state.filter("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2).cast("long"))
        if now.isEmpty():
            break
        probes = now.join(prefixes.select("conv_id", "depth", "p1", "p2"), ["conv_id", "depth"])
        hit = lookup(materialize(probes, "probes"), nodes.select("depth", "p1", "p2", "owner"), ["depth", "p1", "p2"])
        own = F.col("owner") == F.col("conv_id")
        low, high = F.when(own, F.col("low")).otherwise(F.col("depth") + 1), F.when(own, F.col("depth")).otherwise(F.col("high"))
        state = materialize(hit.select("conv_id", "length", low.alias("low"), high.alias("high"), F.when(own, F.col("up")).otherwise(F.col("owner")).alias("up")), "search")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialize(out, "found")


def chain_totals(sums: DataFrame) -> DataFrame:
    """owner, up, first, and saved and leaves with those of all chains below: totals go 1, 2, 4, ... chains up."""
    state = materialize(sums.withColumn("above", F.col("up")), "totals")
    while not state.filter("above is not null").isEmpty():
        given = state.filter("above is not null").groupBy(F.col("above").alias("owner")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        far = lookup(state.select("owner", "above").filter("above is not null"), state.select(F.col("owner").alias("above"), F.col("above").alias("far")), ["above"])
        new = state.drop("above").join(given, "owner", "left").join(far.select("owner", "far"), "owner", "left")
        before, state = state, materialize(new.select("owner", "up", "first", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), F.col("far").alias("above")), "totals")
        discard(before)
    return state


def _digests(ends: DataFrame) -> DataFrame:
    """Per node at which conversations end: SHA-256 of their ids in order, and whether its owner is one of them."""
    ranged = ends.repartitionByRange(scan_parts(ends), "owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    strings = ranged.mapInArrow(_strings, "owner long, depth long, first long, ids binary, own boolean")
    # A node's strings meet in one task, one after the other: the hash is a stream over all of them.
    met = strings.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first")
    return met.mapInArrow(_hashed, "owner long, depth long, ends_sha256 string, chain_ends boolean")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of nodes as strings, of at most CHUNK ids each."""
    for batch in batches:
        out, held, at = [], [], None
        for o, d, c in zip(*(batch.column(x).to_pylist() for x in ("owner", "depth", "conv_id")), strict=True):
            if held and ((o, d) != at or len(held) == CHUNK):
                out.append((*at, held[0], ",".join(map(str, held)).encode(), at[0] in held))
                held = []
            at = (o, d)
            held.append(c)
        if held:
            out.append((*at, held[0], ",".join(map(str, held)).encode(), at[0] in held))
        columns = [list(x) for x in zip(*out, strict=True)] or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["owner", "depth", "first", "ids", "own"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each node, of strings that come in order."""
    kinds, names = (pa.int64(), pa.int64(), pa.string(), pa.bool_()), ["owner", "depth", "ends_sha256", "chain_ends"]
    at = state = None
    own = False
    for batch in batches:
        out = []
        for o, d, ids, mine in zip(*(batch.column(x).to_pylist() for x in ("owner", "depth", "ids", "own")), strict=True):
            if (o, d) != at:
                if state is not None:
                    out.append((*at, state.hexdigest(), own))
                at, state, own = (o, d), hashlib.sha256(ids), mine
            else:
                state.update(b"," + ids)
                own = own or mine
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*at, state.hexdigest(), own), kinds, strict=True)], names)


#: DuckDB SQL of the same nodes: prefixes as joined digests, and each node met with all below it.
ORACLE_SQL = """
WITH c AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda acc, b: list_reduce(list_transform(range(8), lambda i: CAST(i AS BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k FROM conversations),
b AS (SELECT c.conv_id, 0 AS side, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE k <= h
  UNION ALL SELECT t.conv_id, 1, k, role, text FROM t JOIN c ON t.conv_id = c.conv_id WHERE k > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, k) AS d, sha256(length(role) || ':' || role || text) AS x, strlen(text) AS bytes FROM b),
p AS (SELECT conv_id, d, bytes, string_agg(x, ',') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT d, path, min(conv_id) AS owner, count(*) AS n, max(bytes) AS bytes, CASE d WHEN 0 THEN NULL WHEN 1 THEN '' ELSE regexp_replace(path, ',[^,]*$', '') END AS above FROM p GROUP BY d, path),
k AS (SELECT above AS path, count(*) AS kids FROM m WHERE d > 0 GROUP BY above),
s AS (SELECT m.*, coalesce(kids, 0) AS kids FROM m LEFT JOIN k ON m.path = k.path),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS top FROM p) WHERE d = top GROUP BY path),
u AS (SELECT a.path, count(*) FILTER (b.kids = 0) AS leaves, sum((b.n - 1) * b.bytes) AS saved FROM s a JOIN s b ON a.d = 0 OR b.path = a.path OR starts_with(b.path, a.path || ',') GROUP BY a.path)
SELECT s.owner AS conv_id, s.d AS depth, up.owner AS parent_conv_id, s.n AS n_convs, s.kids AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM s JOIN u ON s.path = u.path LEFT JOIN e ON s.path = e.path LEFT JOIN m up ON s.above = up.path"""
