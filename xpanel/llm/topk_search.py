"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt into shards by space: a shallow KD-tree over a bounded sample (SAMPLE vectors, the smallest hashes of the
id) gives the planes, and every vector goes to the cell that it lies in. A shard's bounding box is exact, from all its
vectors. Within a shard a KD-tree splits at the median of the widest component and keeps tight boxes. The largest inner product
that a box allows bounds the search: nodes are visited best first for a block of queries at a time, and a query leaves a node whose
bound is below its k-th score.

A query is first searched in its own shard. Its k-th score there goes with it, and it is sent only to the shards whose box
allows as much. A group of the second search is a shard and a block of at most about BLOCK_QUERIES queries.

Vectors that are null or hold null or non-finite components take no part. Only vectors of the same length meet. Ties go
to the smaller vec_id. A query is never its own neighbour (rows that repeat its id count as itself); fewer than k other
vectors give as many rows as there are. Every other row is a candidate, one that repeats a vec_id or a vector too; equal queries
are asked once. Components beyond 64 bits and scores beyond 64 bits are given as the nearest 64-bit number; scores are compared
exactly. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xpanel.llm.common import materialise

HITS = "query_id long, vec_id long, score decimal(38,0)"
SHARD_ROWS, BLOCK_QUERIES, LEAF, SAMPLE = 16_384, 8_192, 256, 20_000


def quantise(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


class KdTree:
    """Median splits of the widest component; nodes in a list, each with its box and its children or rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.lows, self.highs, self.children, self.rows = points, [], [], [], []
        self._grow(np.arange(len(points)), leaf)
        self.lows, self.highs = np.array(self.lows), np.array(self.highs)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        at, p = len(self.children), self.points[rows]
        low, high = p.min(0), p.max(0)
        self.lows.append(low)
        self.highs.append(high)
        self.children.append(None)
        self.rows.append(None)
        wide = int(np.argmax(high - low)) if p.shape[1] else 0
        if len(rows) <= leaf or not p.shape[1] or high[wide] == low[wide]:
            self.rows[at] = rows
            return at
        half = len(rows) // 2
        order = np.argpartition(p[:, wide], half)
        self.children[at] = (self._grow(rows[order[:half]], leaf), self._grow(rows[order[half:]], leaf))
        return at


def box_bounds(queries: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """[query, box]: the largest inner product of a query with a vector in a box."""
    return np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T


def search(tree: KdTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, at_least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best of the tree for each query, but for those under at_least; the query's own id left out."""
    bounds, least = box_bounds(queries, tree.lows, tree.highs), at_least.copy()
    best_q, best_id, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, queries.dtype)
    todo = [(-bounds[:, 0].max(initial=-np.inf), 0)]
    while todo:
        _, node = heapq.heappop(todo)
        live = np.flatnonzero(bounds[:, node] >= least)
        if not len(live):
            continue
        if tree.children[node]:
            for c in tree.children[node]:
                heapq.heappush(todo, (-bounds[live, c].max(), c))
            continue
        rows = tree.rows[node]
        scores = queries[live] @ tree.points[rows].T
        q, r = np.nonzero((scores >= least[live][:, None]) & (own[live][:, None] != ids[rows][None, :]))
        if not len(q):
            continue
        best_q, best_id, best_s = np.concatenate([best_q, live[q]]), np.concatenate([best_id, ids[rows[r]]]), np.concatenate([best_s, scores[q, r]])
        order = np.lexsort((best_id, -best_s, best_q))
        best_q, best_id, best_s = best_q[order], best_id[order], best_s[order]
        first = np.searchsorted(best_q, best_q)
        place = np.arange(len(best_q)) - first
        kth = place == k - 1
        least[best_q[kth]] = np.maximum(least[best_q[kth]], best_s[kth])
        best_q, best_id, best_s = best_q[place < k], best_id[place < k], best_s[place < k]
    return best_q, best_id, best_s


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.int64).reshape(len(vectors), -1)


def _exact(*matrices: np.ndarray) -> type:
    """float64 where it holds every inner product of the two, else Python's integers."""
    a, b = (max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in matrices)
    return np.float64 if a * b * max(matrices[0].shape[1], 1) < 2**53 else object


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="object")})
        if len(candidates) and len(queries):
            points, asked = _matrix(candidates["v"]), _matrix(queries["v"])
            kind = _exact(points, asked)
            least = np.array([-np.inf if x is None or pd.isna(x) else (float(x) if kind is np.float64 else int(x)) for x in queries["at_least"]], kind)
            own = queries["vec_id"].to_numpy()
            q, ids, scores = search(KdTree(points.astype(kind)), candidates["vec_id"].to_numpy(), asked.astype(kind), own, k, least)
            out = pd.DataFrame({"query_id": own[q], "vec_id": ids, "score": [int(s) for s in scores]})
        return out.assign(score=[Decimal(int(s)) for s in out["score"]])

    return run


def planes(vectors: DataFrame, shards: int) -> Column:
    """The shard of a vector v of length dim: a cell of KD-trees, one per length, over the sample; 0 where there is one shard."""
    if shards <= 1:
        return F.lit(0)
    sample = vectors.select("dim", "v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).toPandas()  # SAMPLE vectors
    cell = F.lit(0)
    for dim, rows in sample.groupby("dim"):
        tree = KdTree(_matrix(rows["v"]).astype(np.float64), max(1, -(-len(sample) // shards)))

        def place(node: int, tree=tree) -> Column:
            if not tree.children[node]:
                return F.lit(node)
            left, right = tree.children[node]
            wide = int(np.argmax(tree.highs[node] - tree.lows[node]))
            return F.when(F.element_at("v", wide + 1) < F.lit(int(tree.lows[right][wide])), place(left)).otherwise(place(right))

        cell = F.when(F.col("dim") == int(dim), place(0)).otherwise(cell) if dim else cell
    return cell


def _route(boxes, k: int):
    """The queries, once for each shard but their own whose box allows the k-th score."""

    def route(parts):
        low, high = boxes.value
        for rows in parts:
            out = []
            for (dim,), part in rows.groupby(["dim"]):
                shards = [s for d, s in low if d == dim]
                if len(shards) < 2:  # all in their own shard
                    continue
                asked = _matrix(part["v"])
                lows, highs = (np.array([x[dim, s] for s in shards], np.int64).reshape(len(shards), -1) for x in (low, high))
                kind = _exact(np.concatenate([lows, highs]), asked)
                bounds = box_bounds(asked.astype(kind), lows.astype(kind), highs.astype(kind))
                least = [None if x is None or pd.isna(x) else int(x) for x in part["at_least"]]
                for j, s in enumerate(shards):
                    go = [i for i in range(len(part)) if part["own"].iat[i] != s and (least[i] is None or bounds[i, j] >= least[i])]
                    if go:
                        out.append(part.iloc[go].assign(shard=s))
            if out:
                yield pd.concat(out)[["vec_id", "v", "dim", "at_least", "shard", "block"]]

    return route


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    v = embeddings.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), quantise(F.col("embedding")).alias("v"))
    v = materialise(v.withColumn("dim", F.size("v")))
    sizes = v.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    v = materialise(v.withColumn("shard", planes(v, -(-sizes["n"] // SHARD_ROWS)).cast("int")))
    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  columns of their own, for joining a table with itself
    queries = anew(v.filter(F.col("vec_id") % every == 0).distinct())
    none = F.lit(None).cast("decimal(38,0)").alias("at_least")
    near = materialise(v.groupBy("dim", "shard").cogroup(queries.select("*", none).groupBy("dim", "shard")).applyInPandas(_search(k), HITS))
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("at_least"))
    blocks = max(1, -(-(sizes["q"] or 0) // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "dim", "at_least", F.col("shard").alias("own"), block.alias("block"))
    # a box is two vectors, and there is one per SHARD_ROWS vectors
    ends = v.select("dim", "shard", F.posexplode("v")).groupBy("dim", "shard", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high"))
    ends = ends.groupBy("dim", "shard").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("ends")).collect()
    low, high = ({(r["dim"], r["shard"]): [e[c] for e in r["ends"]] for r in ends} for c in ("low", "high"))
    if len(ends) < 2:
        hits = near
    else:
        routed = asked.mapInPandas(_route(spark.sparkContext.broadcast((low, high)), k), "vec_id long, v array<bigint>, dim int, at_least decimal(38,0), shard int, block int")
        shelves = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        far = shelves.groupBy("dim", "shard", "block").cogroup(anew(routed).groupBy("dim", "shard", "block")).applyInPandas(_search(k), HITS)
        hits = near.unionByName(far)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    limit = 2**63
    score = F.least(F.greatest("score", F.lit(-limit).cast("decimal(38,0)")), F.lit(limit - 1).cast("decimal(38,0)")).cast("long")
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", score.alias("score"))
