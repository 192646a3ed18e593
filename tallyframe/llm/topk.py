"""Exact top-k search by columnar branch and bound.

Vectors are packed into blocks in vertical layout: one row of a block's matrix holds one dimension of all its vectors. For a
group of queries and a block of candidates, inner products are accumulated over blocks of dimensions, those in which the
queries have most mass first. After each, a pair's score is at most what it has so far plus the product of both vectors'
remaining lengths (Cauchy-Schwarz); pairs that this bound puts below the query's k-th score so far are dropped, and the
surviving candidates are compacted before the next dimensions are read. Components are integers, so scores are exact.

Bounds start high: each query first meets a sample of at most SEEDS candidates (a broadcast of that many vectors), whose k-th
score it takes along; the sample only sets bounds, results come from the candidates themselves. Blocks come in falling order of
their longest vector, and a block that is too short for a query is skipped whole. A block that is too short for all queries of a
group isn't sent to that group: the driver gets a number for each group of QUERIES queries for that.

Work is dealt over a grid of query groups and candidate groups, of about CELLS cells at most unless the queries are many. A task
streams its candidate blocks past one query group, so it holds one block of each and k results for each query, whatever the
size of the table; every query meets every row, in blocks. That is quadratic work, which bounds only lessen.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. Rows that repeat
an id are candidates each, but none for a query of that id; queries that repeat an id give one list, the best of theirs. Equal
scores rank by the smaller vec_id. A query with fewer than k candidates gets all; vectors shorter than others count as filled with zeros;
an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts, task_ids

#: Vectors in a candidate block and in a query group; candidates that set the first bounds; cells of the grid for each shuffle partition.
BLOCK, QUERIES, SEEDS, CELLS = 1024, 2048, 4096, 4
#: Dimensions that are accumulated between two rounds of dropping.
STEP = 16
#: Sums of products below this are exact as doubles.
EXACT = 2.0**53


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x, as double first; null where the vector is null or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _vertical(vectors: list) -> np.ndarray:
    out = np.zeros((max(1, *map(len, vectors)), len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def _blocks(needs: np.ndarray):
    """Candidate blocks of a task's rows: ids and the matrix, as bytes, the longest vector's length, and the query groups that the block can give anything: those whose need (see _need) isn't above that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = task_ids()[0], 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                own = batch.slice(i, BLOCK)
                m = _vertical(own.column("v").to_pylist())
                top = float(np.sqrt((m.astype(np.float64) ** 2).sum(0).max()))
                groups = np.flatnonzero(needs <= top * (1 + 1e-9))
                if len(groups):
                    yield pa.RecordBatch.from_pydict({"groups": pa.array([groups.tolist()], pa.list_(pa.int64())), "block": [part * (1 << 32) + seq], "ids": pa.array([own.column("id").to_numpy().tobytes()], pa.binary()), "m": pa.array([_packed(m)], pa.binary()), "dims": [m.shape[0]], "top": [top]})
                seq += 1

    return run


def _need(m: np.ndarray, floors: np.ndarray) -> float:
    """The length that a candidate must have to reach some query's floor, rounded down: shorter ones can't be among the k of any query of the group."""
    length = np.sqrt((m.astype(np.float64) ** 2).sum(0))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = (floors - 1e-6) / (length * (1 + 2e-9))
    return float(np.where(length > 0, need, np.where(floors <= 1e-6, -np.inf, np.inf)).min())


def _packed(m: np.ndarray) -> bytes:
    """A matrix in the narrowest of 2, 4 and 8 bytes, the width first."""
    top = int(np.abs(m).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return bytes([int(kind[2])]) + m.astype(kind).tobytes()


def _unpacked(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(dims, -1)


class Search:
    """The k best candidates so far of each query of a group. `floor` is a score that a query's k-th is not below."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.order = np.argsort(-(m.astype(np.float64) ** 2).sum(1), kind="stable")
        self.m = m[self.order]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.read = 0  # products that were computed

    def block(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Meets a candidate block: drops by bounds, then keeps the best of the survivors."""
        dims = max(len(self.m), len(m))
        q = np.vstack([self.m, np.zeros((dims - len(self.m), self.m.shape[1]), np.int64)]) if len(self.m) < dims else self.m
        order = np.concatenate([self.order, np.arange(len(self.m), dims)])
        if len(m) < dims:
            m = np.vstack([m, np.zeros((dims - len(m), m.shape[1]), m.dtype)])
        m = m[order]
        top = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * dims
        kind = np.float64 if top < EXACT else object
        rest_q, rest_m = (np.vstack([np.cumsum((x.astype(np.float64) ** 2)[::-1], 0)[::-1], np.zeros(x.shape[1])]) ** 0.5 for x in (q, m))
        # What is left is rounded up, so that no bound is below the score that it bounds.
        rest_q, rest_m = rest_q * (1 + 1e-9), rest_m * (1 + 1e-9)
        near = np.flatnonzero(rest_q[0] * rest_m[0].max(initial=0) + 1e-6 >= self.floor)
        if not len(near):
            return
        q, m, rest_q = q[:, near].astype(kind), m.astype(kind), rest_q[:, near]
        floor, own = self.floor[near], self.ids[near]
        at = min(STEP, dims)
        got = q[:at].T @ m[:at]
        self.read += got.size * at
        alive = _most(got, np.outer(rest_q[at], rest_m[at])) >= floor[:, None]
        alive &= own[:, None] != ids[None, :]
        qi, xi = np.nonzero(alive)
        got = got[qi, xi]
        while at < dims and len(qi):
            to = min(at + STEP, dims)
            if len(qi) > 0.25 * alive.size:  # too many to gather: whole products cost less
                got = got + (q[at:to].T @ m[at:to])[qi, xi]
            else:
                got = got + (q[at:to, qi] * m[at:to, xi]).sum(0)
            self.read += len(qi) * (to - at)
            at = to
            keep = _most(got, rest_q[at, qi] * rest_m[at, xi]) >= floor[qi]
            qi, xi, got = qi[keep], xi[keep], got[keep]
        if not len(qi):
            return
        starts = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1])))
        for a, b in zip(starts, [*starts[1:], len(qi)], strict=True):
            i = near[qi[a]]
            scores = np.concatenate([self.best[i][0], got[a:b].astype(np.int64)])
            found = np.concatenate([self.best[i][1], ids[xi[a:b]]])
            o = np.lexsort((found, -scores))[: self.k]
            self.best[i] = (scores[o], found[o])
            if len(o) == self.k:
                self.floor[i] = max(self.floor[i], scores[o[-1]])


def _most(got: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The highest score that a pair can have, rounded up whatever its sign."""
    got = got.astype(np.float64)
    return got + rest + 1e-12 * np.abs(got) + 1e-6


def _floors(ids: np.ndarray, m: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """For each query the k-th score among the sample, its own id left out; none if the sample is smaller."""
    own = Search(ids, m, k)
    for i in range(0, len(seeds[0]), BLOCK):
        own.block(seeds[0][i : i + BLOCK], seeds[1][:, i : i + BLOCK])
    return np.array([x[-1] if len(x) == k else -np.inf for x, _ in own.best], np.float64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """vectors: vec_id, embedding. Per query and rank: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("long").alias("id"), integers(F.col("embedding"), scale).alias("v"), is_query.alias("q"))
    rows = materialize(whole.filter("id is not null and v is not null"), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    across = -(-n_queries // QUERIES) or 1
    down = max(1, min(-(-n // BLOCK), -(-CELLS * shuffle_parts(spark) // across)))
    share = F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SEEDS / max(n, 1)))
    sample = rows.filter(share).select("id", "v").limit(SEEDS).toPandas()
    seeds = spark.sparkContext.broadcast((sample["id"].to_numpy(np.int64), _vertical(sample["v"].tolist())) if len(sample) else (np.empty(0, np.int64), np.zeros((1, 0), np.int64)))

    def group(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id", kind="stable")
        m, ids = _vertical(own["v"].tolist()), own["id"].to_numpy(np.int64)
        floors = _floors(ids, m, seeds.value, k)
        return pd.DataFrame({"g": [key[0]], "ids": [ids.tobytes()], "m": [_packed(m)], "dims": [m.shape[0]], "floors": [floors.tobytes()], "need": [_need(m, floors)]})

    # The salt keeps a repeated id from filling one group.
    dealt = rows.filter("q").withColumn("g", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(across)))
    queries = materialize(dealt.groupBy("g").applyInPandas(group, "g long, ids binary, m binary, dims long, floors binary, need double"), "queries")
    needs = np.full(across, np.inf)  # a number for each query group
    for r in queries.select("g", "need").collect():
        needs[r["g"]] = r["need"]
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")))
    queries = queries.select("g", cells.alias("s"), F.lit(-1).cast("long").alias("block"), F.lit(float("inf")).alias("top"), "ids", "m", "dims", "floors")
    packed = rows.select("id", "v").mapInArrow(_blocks(needs), "groups array<long>, block long, ids binary, m binary, dims long, top double")
    packed = packed.select(F.explode("groups").alias("g"), F.pmod(F.xxhash64("block"), F.lit(down)).alias("s"), "block", "top", "ids", "m", "dims", F.lit(None).cast("binary").alias("floors"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("g", "s", "block", "ids", "m", "dims", "floors")}
                ids, m = np.frombuffer(row["ids"], np.int64), _unpacked(row["m"], row["dims"])
                if row["block"] < 0:
                    if state is not None:
                        yield from _results(state)
                    cell, state = (row["g"], row["s"]), Search(ids, m.astype(np.int64), k, np.frombuffer(row["floors"], np.float64))
                elif state is not None and cell == (row["g"], row["s"]):
                    state.block(ids, m)
        if state is not None:
            yield from _results(state)

    met = queries.unionByName(packed).repartition(max(across * down, 1), "g", "s").sortWithinPartitions("g", "s", F.desc("top"), "block")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _results(state: Search) -> Iterator[pa.RecordBatch]:
    counts = [len(x) for x, _ in state.best]
    if sum(counts):
        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(state.ids, counts), "vec_id": np.concatenate([x for _, x in state.best]), "score": np.concatenate([x for x, _ in state.best])})


#: DuckDB SQL of op1.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""
