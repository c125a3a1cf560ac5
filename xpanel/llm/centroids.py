"""Exact k-means on integer vectors by the Shallot search.

Every vector remembers its centroid and the second-nearest one, an upper bound of the distance to the first and a lower bound of the
distance to all others. When the centroids have moved, the bounds are moved by as much; a vector whose upper bound is still
below the lower one, or below half the distance from its centroid to the next, keeps its centroid and is not looked at. For the rest
the scan begins at the closer of the two remembered centroids and goes through that centroid's neighbours by distance, as long as one
may lie in the ball of the first distance plus the second-best so far; each better find shrinks the ball. What is
left is compared in integers: bounds are doubles set apart by a margin, so they only ever save work.

A round is one pass over the vectors, written as a table with its bounds (lost executors lose a task, not the rounds), and
one aggregation to k rows of sums. Only centroids (k times the dimension) reach the driver and the tasks.

Vectors of another length, null, or with null or non-finite components take no part; a component is floor(scale * x), and beyond 64
bits the nearest 64-bit number. Distances are exact; those beyond 64 bits, and their sums, are given as the largest 64-bit number.
Rows that repeat an id or a vector are vectors of their own; a null id is hashed as an empty text. Fewer vectors than k give as
many centroids, an empty table no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xpanel.llm.common import delete, intermediates, materialise
from xpanel.llm.topk_search import quantise, usable

STATE = "vec_id long, v array<long>, cluster int, second int, upper double, lower double"
#: Margin of the bounds, and rows that a task compares at a time.
MARGIN, SLICE = 1e-9, 8_192
MAX_LONG = 2**63 - 1


def integers(rows: list[list[int]], dim: int) -> np.ndarray:
    """A matrix of 64-bit integers where squared distances cannot leave 64 bits, else of Python's."""
    m = np.array(rows, np.int64).reshape(len(rows), dim)
    least, most = (int(m.min()), int(m.max())) if m.size else (0, 0)
    return m if dim * (max(-least, most) * 2) ** 2 <= MAX_LONG else m.astype(object)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = v - c
    return (d * d).sum(1) if len(d) else np.zeros(0, d.dtype)


class Centroids:
    """The centroids of a round: their distances, each one's neighbours in order, and how far they have moved."""

    def __init__(self, points: list[list[int]], before: list[list[int]] | None, dim: int):
        self.points = integers(points, dim)
        self.k = len(points)
        as_float = lambda m: m.astype(np.float64)
        gaps = np.array([[float(x) for x in squared(self.points, p)] for p in self.points]).reshape(self.k, self.k)
        self.between = np.sqrt(gaps) * (1 - MARGIN)  # not too large
        self.order = np.argsort(self.between + np.where(np.eye(self.k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
        others = np.where(np.eye(self.k, dtype=bool), np.inf, self.between)
        self.half = others.min(1) / 2 if self.k else np.zeros(0)
        moved = np.zeros(self.k) if before is None else np.sqrt(as_float(squared(self.points, integers(before, dim)))) * (1 + MARGIN)
        self.moved = moved
        apart = np.where(np.eye(self.k, dtype=bool), -np.inf, moved[None, :])
        self.most_moved = np.maximum(apart.max(1), 0) if self.k else moved  # of all but oneself


def assign(v: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> int:
    """Moves the bounds and brings cluster, second, upper and lower up to date, in place; returns how many distances were computed."""
    upper += c.moved[cluster]
    lower -= c.most_moved[cluster]
    open_ = np.flatnonzero(upper >= np.maximum(lower, c.half[cluster]))
    if not len(open_) or c.k < 2:
        return 0
    asked = len(open_)
    own = squared(v[open_], c.points[cluster[open_]])
    upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + MARGIN)
    still = upper[open_] >= np.maximum(lower[open_], c.half[cluster[open_]])
    open_, own = open_[still], own[still]
    other = squared(v[open_], c.points[second[open_]])
    asked += len(open_)
    first, then = cluster[open_].copy(), second[open_].copy()
    swap = (other < own) | ((other == own) & (then < first))
    best, next_ = np.where(swap, other, own), np.where(swap, own, other)
    first, then = np.where(swap, then, first), np.where(swap, first, then)
    start, known = first.copy(), np.stack([first, then])
    near = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)  # of the start, which the ball is around
    for p in np.unique(start):
        rows = np.flatnonzero(start == p)
        for j in c.order[p][1:]:
            ball = near[rows] + np.sqrt(next_[rows].astype(np.float64)) * (1 + MARGIN)
            rows = rows[c.between[p, j] <= ball]  # farther neighbours lie outside as well, and the ball only shrinks
            if not len(rows):
                break
            new = rows[known[1, rows] != j]
            asked += len(new)
            d = squared(v[open_[new]], c.points[j])
            wins = (d < best[new]) | ((d == best[new]) & (j < first[new]))
            places = ~wins & ((d < next_[new]) | ((d == next_[new]) & (j < then[new])))
            w, s = new[wins], new[places]
            next_[w], then[w] = best[w], first[w]
            best[w], first[w] = d[wins], j
            next_[s], then[s] = d[places], j
    cluster[open_], second[open_] = first, then
    upper[open_] = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
    lower[open_] = np.sqrt(next_.astype(np.float64)) * (1 - MARGIN)
    return asked


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The list column as it is, without a Python number for each component unless one is large."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    most = max(-int(flat.min()), int(flat.max())) if flat.size else 0
    return flat if dim * (2 * most) ** 2 <= MAX_LONG else flat.astype(object)


def _round(now: list[list[int]], before: list[list[int]] | None, dim: int, last: bool):
    """A pass over the state; before is None in the first, which has no bounds yet. The last gives the distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(now, before, dim)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v = _matrix(part.column("v"), dim)
                if v.dtype == object or c.points.dtype == object:
                    v, c.points = v.astype(object), c.points.astype(object)
                state = [part.column(x).to_numpy(zero_copy_only=False).copy() for x in ("cluster", "second", "upper", "lower")]
                assign(v, *state, c)
                columns = [part.column("vec_id"), part.column("v"), pa.array(state[0], pa.int32())]
                if last:
                    d = [min(int(x), MAX_LONG) for x in squared(v, c.points[state[0]])]
                    yield pa.RecordBatch.from_arrays([columns[0], columns[2], pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(state[1], pa.int32()), *map(pa.array, state[2:])], ["vec_id", "v", "cluster", "second", "upper", "lower"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of seed:vec_id; ties go to the smaller vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable vector, and the final centroids."""
    spark = embeddings.sparkSession
    v = embeddings.filter(usable(F.col("embedding")) & (F.size("embedding") == dim)).select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding"), scale).alias("v"))
    with intermediates() as made:
        state = materialise(v)
        now, before = first_centroids(state, k, seed), None
        nothing = [F.lit(0).alias("cluster"), F.lit(min(1, len(now) - 1)).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")]
        state = state.select("vec_id", "v", *nothing)
        for _ in range(rounds if now else 0):
            state = materialise(state.mapInArrow(_round(now, before, dim, False), STATE))
            delete(spark, made[:-1])
            del made[:-1]
            now, before = _means(state, now, dim), now
    return state.mapInArrow(_round(now, before, dim, True), "vec_id long, cluster int, distance long"), now


def _means(state: DataFrame, now: list[list[int]], dim: int) -> list[list[int]]:
    """floor(sum / count) of each cluster's components; one without vectors stays. Sums beyond 64 bits are kept as decimals."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.element_at("v", i + 1).cast("decimal(19,0)")) for i in range(dim)]).alias("sums"))
    means = {r["cluster"]: [int(s) // r["n"] for s in r["sums"]] for r in sums.collect()}  # k rows at most
    return [means.get(j, c) for j, c in enumerate(now)]


def cluster_report(embeddings: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, the cluster's and the whole inertia, and a digest of the cluster's centroid."""
    spark = embeddings.sparkSession
    found, centroids = cluster(embeddings, **options)
    found = materialise(found)
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    inertias = {r["cluster"]: int(r["s"]) for r in inertia.collect()}  # k rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    whole = min(sum(inertias.values()), MAX_LONG)
    rows = [(j, min(inertias.get(j, 0), MAX_LONG), whole, digest(c)) for j, c in enumerate(centroids)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1") -> str:
    """cluster_report in SQL: every vector against every centroid, in every round."""
    square = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""v AS (
      SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS j, v AS c FROM v QUALIFY j < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT i, j, CAST({square} AS BIGINT) AS d FROM v, c{r}) GROUP BY i)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT j, pos, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range({dim})) AS pos FROM a{r} JOIN v USING (i)) GROUP BY j, pos)")
            parts.append(f"m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS m FROM s{r} GROUP BY j)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (j))")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN v USING (i) JOIN c{rounds} USING (j)"""
