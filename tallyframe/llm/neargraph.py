"""Near duplicates of embeddings by a robust-pruned flat graph.

1. Equal vectors are one node (its smallest vec_id stands for them), so copies cost nothing further.
2. Nodes are dealt to their nearest `overlap` of the centroids that k-means finds in a bounded sample (SAMPLE): overlapping
   shards. There are at most MOST_CENTROIDS of them; a shard that is then larger than WIDE cells is divided once more, by
   centroids of a sample of its own, so their number grows with the vectors. What is still beyond twice TARGET nodes (a dense
   group) is dealt further into parts by a hash; its queries then visit all of its parts.
3. In each cell, a node's neighbours are chosen from its nearest nodes and some spread ones by robust pruning: the nearest is
   taken, and those nearer to it than to the node, by a factor, are dropped. Nodes that the medoid doesn't reach are tied in.
4. A node's adjacency lists of all cells are united.
5. Each node is a query in the cells of its shards: greedy search from the medoid with a beam, which goes on to the neighbours
   of every node found within range until no new one is in range.
6. The search goes on over the united lists, beyond the query's own shards: from each node in range to those of its neighbours
   that share no cell with the query, as joins, until no new one is in range.
7. Pairs found are verified in double precision. Recall is audited: a bounded set of queries is compared with all nodes. Among
   them are made-up nodes that were put into the graph beside a sample of the real ones, at distances spread over those of a
   link, so links are measured where real ones are rare; what was found with them is taken out again. Without any measured link,
   or below AUDIT_LEAST the graph is built anew with one more overlapping shard, up to MOST_OVERLAP. It is the mean over queries
   that counts, so that a dense group doesn't hide what small ones lose, and the share of all links.
8. If the last audit fails too, all pairs of nodes are compared in blocks: exact, at a cost that grows with the square of the
   nodes. `near_duplicates` tells the recall of each audit if it's given a list for them.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing, each its own component; so do rows
without an id (component null). Rows that repeat an id and a vector count once; an id with several vectors has the most links and
the smallest component of theirs. Links at exactly the least similarity count. An empty table gives no rows. Vectors of another
length than the most common can't be near these: each length is a graph of its own. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize
from .components import components

#: Rows that k-means learns from; nodes that a cell should hold; the most centroids; queries of the audit.
SAMPLE, TARGET, MOST_CENTROIDS, AUDIT = 16_000, 800, 2048, 256
#: Cells' worth of nodes beyond which a shard is divided by centroids of its own, and rows of it that a task holds for that.
WIDE, HOLD = 8, 50_000
AUDIT_LEAST, MOST_OVERLAP = 0.97, 4
#: Nodes of a block where all pairs are compared; a task holds two blocks.
BLOCK = 4000
#: Neighbours of a node in a cell, candidates that they are chosen from, the pruning factor, and the beam of a search.
DEGREE, CANDIDATES, ALPHA, BEAM = 20, 48, 1.2, 24


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centroids of unit vectors, of unit length."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1)
        c[length > 0] = sums[length > 0] / length[length > 0, None]
    return c


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Adjacency (-1: none) and medoid of a cell of unit vectors, by robust pruning."""
    n = len(x)
    sims = x @ x.T
    medoid = int((x @ x.mean(0)).argmax())
    rng = np.random.default_rng(n)
    near = np.argpartition(-sims, min(CANDIDATES, n - 1), axis=1)[:, : min(CANDIDATES + 1, n)]
    cand = np.hstack([near, rng.integers(0, n, (n, 16)), np.full((n, 1), medoid)])
    far = 1 - np.take_along_axis(sims, cand, 1)
    order = np.argsort(far, axis=1)
    cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
    rows = np.arange(n)
    alive = cand != rows[:, None]
    out = np.full((n, DEGREE), -1)
    for r in range(DEGREE):
        some = alive.any(1)
        pick = alive.argmax(1)  # the nearest that is left
        p = cand[rows, pick]
        out[some, r] = p[some]
        drop = (ALPHA * (1 - sims[p[:, None], cand]) <= far) | (cand == p[:, None])
        alive &= ~drop
    return out, medoid


def tied(x: np.ndarray, lists: list[set[int]], medoid: int) -> None:
    """Adds an edge to each node that can't be reached from the medoid, from the nearest that can."""
    n = len(x)
    seen = np.zeros(n, bool)
    todo = [medoid]
    seen[medoid] = True
    while True:
        while todo:
            for j in lists[todo.pop()]:
                if not seen[j]:
                    seen[j] = True
                    todo.append(j)
        if seen.all():
            return
        lost, found = np.flatnonzero(~seen), np.flatnonzero(seen)
        at = x[lost] @ x[found].T
        i, j = np.unravel_index(int(at.argmax()), at.shape)
        lists[found[j]].add(int(lost[i]))
        todo = [int(lost[i])]
        seen[lost[i]] = True


def search(x: np.ndarray, adjacency: np.ndarray, medoid: int, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and node of all pairs found at least so similar, by greedy search from the medoid that expands in range."""
    n, m = len(q), len(x)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, m + 1), bool)
    seen[:, m] = True
    pool = np.full((n, BEAM), m)
    score = np.full((n, BEAM), -2.0, np.float32)
    open_ = np.zeros((n, BEAM), bool)
    pool[:, 0], score[:, 0], open_[:, 0] = medoid, q @ x[medoid], True
    seen[:, medoid] = True
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    adjacency = np.where(adjacency < 0, m, adjacency)
    each = 4
    while open_.any():
        live = np.flatnonzero(open_.any(1))
        first = np.argsort(np.where(open_[live], -score[live], 9), axis=1, kind="stable")[:, :each]
        chosen = np.where(np.take_along_axis(open_[live], first, 1), np.take_along_axis(pool[live], first, 1), m)
        closed = open_[live]
        np.put_along_axis(closed, first, False, 1)
        open_[live] = closed
        near = np.vstack([adjacency, np.full((1, adjacency.shape[1]), m)])[chosen].reshape(len(live), -1)
        near.sort(axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        near = np.where(fresh, near, m)
        seen[live[:, None], near] = True
        sims = np.einsum("qd,qrd->qr", q[live], padded[near])
        sims[near == m] = -2
        a, s = np.hstack([pool[live], near]), np.hstack([score[live], sims])
        o = np.hstack([open_[live], near != m])
        keep = max(BEAM, int((s >= least).sum(1).max()))
        best = np.argpartition(-s, min(keep, s.shape[1] - 1), axis=1)[:, :keep]
        if keep > pool.shape[1]:
            more = ((0, 0), (0, keep - pool.shape[1]))
            pool, score, open_ = np.pad(pool, more, constant_values=m), np.pad(score, more, constant_values=-2), np.pad(open_, more)
        elif keep < pool.shape[1]:
            best = np.argpartition(-s, min(pool.shape[1], s.shape[1] - 1), axis=1)[:, : pool.shape[1]]
        a, s, o = (np.take_along_axis(z, best, 1) for z in (a, s, o))
        # Beyond the beam, only nodes in range go on being expanded.
        rank = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1, kind="stable")
        pool[live], score[live], open_[live] = a, s, o & ((rank < BEAM) | (s >= least))
    hit = (score >= least) & (pool < m)
    return np.broadcast_to(rows, pool.shape)[hit], pool[hit]


def _vectors(raw: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(b, np.float64) for b in raw.to_pylist()])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _nearest(v: pa.ChunkedArray | pa.Array, c: np.ndarray, take: int) -> np.ndarray:
    """For each vector the numbers of its nearest centroids."""
    return np.argpartition(-(_unit(_vectors(v)) @ c.T), take - 1, axis=1)[:, :take]


def _divided(dealt: DataFrame, overlap: int) -> DataFrame:
    """dealt: cell, rep, v. Cells of more than WIDE times TARGET nodes are divided by centroids that are found in a sample of each."""
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("m"))
    wide = materialize(sizes.filter(F.col("m") > WIDE * TARGET).withColumn("k", F.ceil(F.col("m") * 2 / (TARGET * overlap))), "wide")
    if wide.isEmpty():
        return dealt
    rows = dealt.join(F.broadcast(wide), "cell")  # of wide there is at most a row for each centroid of the first level
    share = F.least(F.lit(1.0), SAMPLE / F.col("m"))
    few = rows.filter(F.pmod(F.xxhash64(F.lit(23), "rep"), F.lit(1_000_000)) < share * 1_000_000)

    def fit(key: tuple, own: pa.Table) -> pa.Table:
        c = k_means(_unit(_vectors(own.column("v"))), own.column("k")[0].as_py())
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([c.tobytes()], pa.binary()), "d": pa.array([c.shape[1]], pa.int32()), "m": own.column("m").slice(0, 1)})

    fitted = materialize(few.groupBy("cell").applyInArrow(fit, "cell long, c binary, d int, m long"), "sub")
    salts = F.ceil(F.col("m") / HOLD).cast("int")
    left = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(29), "rep"), salts).cast("int"))
    right = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def deal(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        c = np.frombuffer(found.column("c")[0].as_py(), np.float32).reshape(-1, found.column("d")[0].as_py())
        take = min(overlap, len(c))
        at = _nearest(own.column("v"), c, take)
        pick = pa.array(np.repeat(np.arange(own.num_rows), take))
        return pa.table({"cell": pa.array(((key[0].as_py() << 20) + 1 + at).ravel(), pa.int64()), "rep": own.column("rep").take(pick), "v": own.column("v").take(pick)})

    finer = left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(deal, "cell long, rep long, v binary")
    return dealt.join(F.broadcast(wide), "cell", "left_anti").select("cell", "rep", "v").unionByName(finer)


def _shards(nodes: DataFrame, n: int, overlap: int) -> DataFrame:
    """cell, rep, v of each node in its nearest cells, with parts (of the cell) and own (the part that the node is built in)."""
    k = max(1, min(MOST_CENTROIDS, -(-n * 2 // (TARGET * overlap)))) if n > TARGET else 1
    spark = nodes.sparkSession
    sample = bounded_sample(nodes, F.col("rep"), SAMPLE).select("v").toPandas()
    centroids = spark.sparkContext.broadcast(k_means(_unit(np.array([np.frombuffer(b, np.float64) for b in sample["v"]])), k))
    take = min(overlap, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            if batch.num_rows:
                at = _nearest(batch.column("v"), c, take)
                pick = pa.array(np.repeat(np.arange(batch.num_rows), take))
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel(), pa.int64()), batch.column("rep").take(pick), batch.column("v").take(pick)], ["cell", "rep", "v"])

    dealt = materialize(nodes.select("rep", "v").mapInArrow(run, "cell long, rep long, v binary"), "shards")
    dealt = materialize(_divided(dealt, overlap), "cells")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / (2 * TARGET)).cast("int").alias("parts"))
    return dealt.join(parts, "cell").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))


def _build_cell(key: tuple, own: pa.Table) -> pa.Table:
    ids = own.column("rep").to_numpy()
    adjacency, _ = build(_unit(_vectors(own.column("v"))))
    lists = [ids[a[a >= 0]] for a in adjacency]
    return pa.table({"rep": pa.array(ids, pa.int64()), "to": pa.array(lists, pa.list_(pa.int64()))})


def _search_cell(least: float):
    def run(key: tuple, own: pa.Table) -> pa.Table:
        rep, v = own.column("rep").to_numpy(), _vectors(own.column("v"))
        inside = np.flatnonzero(own.column("inside").to_numpy(zero_copy_only=False))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(inside):
            place = {int(r): i for i, r in enumerate(rep[inside])}
            x = _unit(v[inside])
            to = own.column("to").to_pylist()
            lists = [{place[j] for j in to[i] or () if j in place} for i in inside]
            medoid = int((x @ x.mean(0)).argmax())
            tied(x, lists, medoid)
            adjacency = np.full((len(x), max(1, max(map(len, lists)))), -1)
            for i, js in enumerate(lists):
                adjacency[i, : len(js)] = list(js)
            length = np.linalg.norm(v, axis=1)
            for at in range(0, len(v), 512):
                q, node = search(x, adjacency, medoid, _unit(v[at : at + 512]), least - 1e-4)
                a, b = q + at, inside[node]
                cos = np.einsum("ij,ij->i", v[a], v[b]) / (length[a] * length[b])
                ok = (cos >= least) & (rep[a] != rep[b])
                found.append((np.maximum(rep[a], rep[b])[ok], np.minimum(rep[a], rep[b])[ok]))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(nodes: DataFrame, n: int, least: float, overlap: int) -> DataFrame:
    """nodes: rep, v. The pairs a, b found and verified."""
    dealt = materialize(_shards(nodes, n, overlap), "dealt")
    edges = dealt.select("cell", "own", "rep", "v").groupBy("cell", "own").applyInArrow(_build_cell, "rep long, to array<long>")
    united = materialize(edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")), "adjacency")
    visits = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = F.col("part") == F.col("own")
    rows = visits.join(united, "rep").select("cell", "part", "rep", "v", inside.alias("inside"), F.when(inside, F.col("to")).alias("to"))
    found = materialize(rows.groupBy("cell", "part").applyInArrow(_search_cell(least), "a long, b long").distinct(), "near")
    places = materialize(dealt.groupBy("rep").agg(F.collect_set("cell").alias("cells")), "places")
    return _beyond(found, united, places, nodes, least)


def _beyond(found: DataFrame, united: DataFrame, places: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """found, and what the search finds over the united lists in cells that a query isn't in."""
    at = lambda name, cells: places.select(F.col("rep").alias(name), F.col("cells").alias(cells))
    edges = materialize(united.select(F.col("rep").alias("u"), F.explode("to").alias("x")).join(at("x", "xs"), "x"), "edges")
    vector = lambda name, v: nodes.select(F.col("rep").alias(name), F.col("v").alias(v))
    fresh = found
    while True:
        both = fresh.select(F.col("a").alias("q"), F.col("b").alias("u")).unionByName(fresh.select(F.col("b").alias("q"), F.col("a").alias("u")))
        # A neighbour shares a cell with u; if all of u's cells are q's, then q has met it.
        outward = both.join(at("q", "qs"), "q").join(at("u", "us"), "u").filter(F.size(F.array_except("us", "qs")) > 0)
        met = outward.join(edges, "u").filter(~F.arrays_overlap("qs", "xs") & (F.col("q") != F.col("x")))
        pairs = met.select(F.greatest("q", "x").alias("a"), F.least("q", "x").alias("b")).distinct().join(found, ["a", "b"], "left_anti")
        fresh = materialize(pairs.join(vector("a", "va"), "a").join(vector("b", "vb"), "b").mapInArrow(_near_enough(least), "a long, b long"), "beyond")
        if fresh.isEmpty():
            return found
        found = materialize(found.unionByName(fresh), "near")


def _near_enough(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _vectors(batch.column("va")), _vectors(batch.column("vb"))
                cos = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield batch.select(["a", "b"]).filter(pa.array(cos >= least))

    return run


def all_links(nodes: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs a, b at least so similar, by comparing all nodes in blocks."""
    blocks = max(1, -(-n // BLOCK))
    dealt = nodes.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("c"))
    # A row for each pair of blocks that the node's block is in.
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("rep", "v", "c", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))

    def run(key: tuple, own: pa.Table) -> pa.Table:
        rep, c, v = own.column("rep").to_numpy(), own.column("c").to_numpy(), _vectors(own.column("v"))
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        lo, hi = (np.flatnonzero(c == k.as_py()) for k in key)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(lo), 512):
            i, j = np.nonzero(unit[lo[at : at + 512]] @ unit[hi].T >= least)
            x, y = rep[lo[at + i]], rep[hi[j]]
            ok = x > y if key[0] == key[1] else x != y
            found.append((np.maximum(x, y)[ok], np.minimum(x, y)[ok]))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialize(cells.groupBy("lo", "hi").applyInArrow(run, "a long, b long"), "near")


def _vector_of(unit: np.ndarray, cos: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors at these cosines from the given ones, in directions drawn at random."""
    away = rng.standard_normal(unit.shape)
    away -= (away * unit).sum(1, keepdims=True) * unit
    length = np.linalg.norm(away, axis=1, keepdims=True)
    away = np.divide(away, length, out=np.zeros_like(away), where=length > 0)
    return cos[:, None] * unit + np.sqrt(1 - cos[:, None] ** 2) * away


def planted(nodes: DataFrame, least: float, queries: int = AUDIT) -> DataFrame | None:
    """Made-up nodes, rep and v, each as near to a node of a bounded sample as a link is, at cosines spread from `least` to 1: links that an audit can measure, however few the real ones are. Their ids are beyond all others; None where there is no room for them, or no node."""
    low, high = nodes.agg(F.min("rep"), F.max("rep")).first()
    if low is None or (high >= 2**63 - 1 - 2 * queries and low < -(2**63) + 2 * queries):
        return None
    picked = bounded_sample(nodes, F.col("rep"), queries).orderBy(F.xxhash64("rep")).limit(2 * queries).toPandas()
    if picked.empty:
        return None
    v = np.array([np.frombuffer(b, np.float64) for b in picked["v"]])
    made = _vector_of(_unit(v), np.linspace(least, 1, len(v) + 2)[1:-1], np.random.default_rng(len(v)))
    first = high + 1 if high < 2**63 - 1 - 2 * queries else low - len(v)
    rows = [(first + i, bytearray(x.tobytes())) for i, x in enumerate(made.astype(np.float64))]
    return nodes.sparkSession.createDataFrame(rows, "rep long, v binary")


def recall(nodes: DataFrame, found: DataFrame, least: float, queries: int = AUDIT, made: DataFrame | None = None) -> float | None:
    """The recall of a bounded set of queries and of the nodes `made`, by comparing them with every node: the mean over queries with links, or the share of links found if that is less. None if none of them has a link."""
    picked = bounded_sample(nodes, F.col("rep"), queries).orderBy(F.xxhash64("rep")).limit(2 * queries)
    picked = (picked if made is None else picked.unionByName(made)).toPandas()
    if picked.empty:
        return None
    ids, q = picked["rep"].to_numpy(np.int64), np.array([np.frombuffer(b, np.float64) for b in picked["v"]])
    held = nodes.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit = held.value
        for batch in batches:
            if batch.num_rows:
                v, rep = _vectors(batch.column("v")), batch.column("rep").to_numpy()
                i, j = np.nonzero((v / np.linalg.norm(v, axis=1, keepdims=True)) @ unit.T >= least)
                ok = rep[i] != own[j]
                a, b = rep[i][ok], own[j][ok]
                yield pa.RecordBatch.from_pydict({"q": b, "a": np.maximum(a, b), "b": np.minimum(a, b)})

    every = nodes if made is None else nodes.unionByName(made)
    real = every.select("rep", "v").mapInArrow(run, "q long, a long, b long")
    have = real.join(found.withColumn("yes", F.lit(1)), ["a", "b"], "left").groupBy("q").agg(F.count("yes").alias("got"), F.count("*").alias("all"))
    each, share = have.agg(F.avg(F.col("got") / F.col("all")), F.sum("got") / F.sum("all")).first()
    return None if each is None else min(each, share)


def near_duplicates(vectors: DataFrame, least: float = 0.95, audits: list[float | None] | None = None) -> DataFrame:
    """vectors: vec_id, embedding. Per row: vec_id, n_links (other vectors linked), component_id (the smallest vec_id reachable), kept.

    audits gets the recall of each audit, None where no link was measured; after a comparison of all pairs, 1.
    """
    audits = [] if audits is None else audits
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("e").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("e", lambda x: x != 0)
    rows = materialize(rows.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    classes = materialize(rows.filter("fine").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")), "classes")
    raw = materialize(classes.select("rep", F.size("e").alias("dims"), "e").mapInArrow(_as_bytes, "rep long, dims int, v binary"), "nodes")
    found = None
    for dims in sorted(r["dims"] for r in raw.select("dims").distinct().collect()):
        nodes = raw.filter(F.col("dims") == dims).select("rep", "v")
        n = nodes.count()
        made = planted(nodes, least)
        every = nodes if made is None else materialize(nodes.unionByName(made), "audited")
        for overlap in range(2, MOST_OVERLAP + 1):
            own = links(every, n, least, overlap)
            audits.append(recall(nodes, own, least, made=made))
            if audits[-1] is not None and audits[-1] >= AUDIT_LEAST:
                break
        else:
            own = all_links(every, n, least)
            audits.append(1.0)
        if made is not None:
            ids = F.broadcast(made.select("rep"))
            own = own.join(ids.withColumnRenamed("rep", "a"), "a", "left_anti").join(ids.withColumnRenamed("rep", "b"), "b", "left_anti").select("a", "b")
        found = own if found is None else found.unionByName(own)
    members = rows.filter("fine").join(classes, "e").select("vec_id", "rep", "copies").distinct()
    if found is None:
        found = rows.sparkSession.createDataFrame([], "a long, b long")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(classes.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("linked"))
    groups = components(found).withColumnRenamed("node", "rep")
    placed = members.join(counted, "rep", "left").join(groups, "rep", "left")
    placed = placed.select("vec_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    placed = placed.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(placed, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.array(v, np.float64).tobytes() for v in batch.column("e").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("dims"), pa.array(raw, pa.binary())], ["rep", "dims", "v"])
