"""Centroid clustering by ball k-means.

A cluster is a ball: its centroid and the distance of its farthest member. Two balls are neighbours where the gap between their
centroids is at most twice the radius. A member nearer to its centroid than half the gap to the nearest neighbour lies in the
stable core and is compared with nothing; the others lie in annuli, one for each neighbour further out, and a member is compared
exactly with the neighbours within twice its own distance, and no others. That leaves out centroids that cannot win (triangle
inequality), so the assignment is that of comparing all. Before the first round all vectors are one ball, that of centroid 0.

A round is three passes: the radii of the balls, the assignment (written in the shared folder, the table before it let go), and
the sums of the members. Nothing is dealt by cluster: batches send one row for each ball, so one ball may hold all rows. The
driver gets k rows of `dims` numbers, parameters of the model. Components are integers and all distances exact.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part and are not returned; nor do
those with an integer beyond LARGEST, whose squared distances a long does not hold. Equal distances go to the smaller number;
centroids that coincide too, so the later one of them is empty and stays. Rows that repeat an id are members each; equal hashes
start in the order of the vectors, a null id last. Fewer vectors than k start as many centroids; an empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .topk import integers

#: Integers up to this size leave room for four times a squared distance of 64 of them in a long.
LARGEST = 1 << 26


class Balls:
    """Centroids, and for each the neighbours (nearest first) with the squared gaps to them."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray):
        self.centroids = centroids
        gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        self.neighbours, self.gaps = [], []
        for i, own in enumerate(gaps):
            near = [j for j in np.lexsort((np.arange(len(own)), own)) if j != i and own[j] <= 4 * radii[i]]
            self.neighbours.append(np.array(near, np.int64))
            self.gaps.append(own[near])

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row of x, and the number of distances that were computed."""
        out, least, read = cluster.copy(), _apart(x, self.centroids[cluster]), len(x)
        for i in np.unique(cluster):
            own = np.flatnonzero(cluster == i)
            # The annulus: how many neighbours lie within twice the member's distance. None: the stable core.
            annulus = np.searchsorted(self.gaps[i], 4 * least[own], side="right")
            for n, j in enumerate(self.neighbours[i]):
                own, annulus = own[annulus > n], annulus[annulus > n]
                if not len(own):
                    break
                d = _apart(x[own], self.centroids[j])
                won = (d < least[own]) | ((d == least[own]) & (j < out[own]))
                # The annulus is that of the distance from the ball's own centroid, so what has been won leaves it alone.
                least[own[won]], out[own[won]] = d[won], j
                read += len(own)
        return out, least, read


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vectors: vec_id, embedding. Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k vectors whose ids have the smallest hashes (sha256 of `seed:vec_id`), in that order.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v")).filter(F.size("v") == dims)
    small = F.forall("v", lambda x: x.between(-LARGEST, LARGEST))
    rows = materialize(whole.filter(small).select("vec_id", F.col("v").cast("array<int>").alias("v"), F.lit(0).alias("cluster")), "members")
    first = rows.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).sort(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not first:
        return rows.select("vec_id", "cluster", *(F.lit(None).cast(t).alias(c) for c, t in (("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    centroids = np.array([r["v"] for r in first], np.int64)
    for n in range(rounds + 1):
        told = spark.sparkContext.broadcast(Balls(centroids, _radii(rows, centroids, dims)))

        def assign(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, distance, _ = told.value.assign(_matrix(batch, dims), batch.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

        before, rows = rows, materialize(rows.select("vec_id", "v", "cluster").mapInArrow(assign, "vec_id long, v array<int>, cluster int, distance long"), "members")
        discard(before)
        if n < rounds:
            centroids = _means(rows, centroids, dims)
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    inertia = sum(r["cluster_inertia"] for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, digests[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _radii(rows: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The squared distance of each ball's farthest member, 0 where it has none."""
    told = rows.sparkSession.sparkContext.broadcast(centroids)

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.full(len(told.value), -1, np.int64)
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            np.maximum.at(out, own, _apart(_matrix(batch, dims), told.value[own]))
        own = np.flatnonzero(out >= 0)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own.astype(np.int32)), "r": pa.array(out[own])})

    out = np.zeros(len(centroids), np.int64)
    for r in rows.select("cluster", "v").mapInArrow(farthest, "cluster int, r long").groupBy("cluster").agg(F.max("r").alias("r")).collect():
        out[r["cluster"]] = r["r"]
    return out


def _means(rows: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The floor of each ball's mean, component by component; a ball without members stays."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column("cluster").to_numpy(), _matrix(batch, dims)
            held = np.unique(own)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(held), "n": pa.array([int((own == i).sum()) for i in held], pa.int64()), "s": pa.array([x[own == i].sum(0).tolist() for i in held], pa.list_(pa.int64()))})

    # One row for each component of each ball; a decimal holds the sum of any number of rows.
    parts = rows.select("cluster", "v").mapInArrow(partial, "cluster int, n long, s array<long>").select("cluster", "n", F.posexplode("s").alias("at", "s"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def oracle_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL of the same rows: every vector compared with every centroid."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    parts = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        apart = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        parts.append(f"d{n} AS MATERIALIZED (SELECT v.vec_id, v.v, c.cluster, {apart} AS distance FROM v, c{n} c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)")
        if n < rounds:
            parts.append(f"e{n} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{n}) GROUP BY cluster, pos)")
            parts.append(f"m{n} AS (SELECT cluster, list({floor} ORDER BY pos) AS c FROM e{n} GROUP BY cluster)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m USING (cluster))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (cluster)"""
