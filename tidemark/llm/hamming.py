"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned on a bounded sample (principal axes, then iterative quantisation) turns
every vector into a binary code of 64 bits, cut into four substrings of 16. Each
substring has an index of its own. Two codes within Hamming radius r agree in one
substring up to r // 4 bits (pigeonhole), so probing all values that near retrieves
every code within the radius; what is retrieved is checked on the full code and ranked by
exact distances of the original vectors. The radius is the smallest that reaches
``target`` recall on the sample.

The queries are a stated set and all rows are indexed: vectors come in blocks of
bounded size, queries in blocks too, and each pair of blocks is one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship

BITS, PARTS = 64, 4
SAMPLE = 4096
TARGET = 0.98
BLOCK = 4096
QUERY_BLOCK = 512


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """(id, vec) of the vectors that take part: not null, not zero, only finite components, of the right length."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    return rows.where(F.size(v) == dim) if dim else rows


def learn(sample: np.ndarray, target: float = TARGET, k: int = 10, rounds: int = 30) -> dict:
    """Centre, rotation and radius from a sample (rows sorted for a defined result)."""
    x = sample[np.lexsort(sample.T[::-1])]
    mean = x.mean(axis=0)
    y = x - mean
    _, axes = np.linalg.eigh(y.T @ y)
    bits = min(BITS, x.shape[1])
    axes = axes[:, ::-1][:, :bits]
    y = y @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        code = np.where(y @ turn > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(code.T @ y)
        turn = (u @ vt).T
    model = {"mean": mean, "turn": axes @ turn, "bits": bits, "radius": bits}
    asked = x[:: max(1, len(x) // 256)]
    code, own = codes(x, model), codes(asked, model)
    dist = np.bitwise_count(own[:, None] ^ code[None, :])
    near = _distances(asked, x)
    near[near == 0] = np.inf
    kk = min(k, len(x) - 1)
    if kk > 0:
        best = np.argpartition(near, kk - 1, axis=1)[:, :kk]
        reach = np.sort(np.take_along_axis(dist, best, 1).ravel())
        model["radius"] = int(reach[min(len(reach) - 1, int(np.ceil(target * len(reach))) - 1)])
    return model


def codes(x: np.ndarray, model: dict) -> np.ndarray:
    """Codes of the vectors as 64-bit numbers."""
    bits = (x - model["mean"]) @ model["turn"] > 0
    out = np.zeros(len(x), np.uint64)
    for k in range(model["bits"]):
        out |= bits[:, k].astype(np.uint64) << np.uint64(k)
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.maximum(d, 0)


def _masks(width: int, most: int) -> np.ndarray:
    """All substring differences of at most ``most`` bits."""
    all_ = np.arange(1 << width, dtype=np.uint32)
    return all_[np.bitwise_count(all_) <= most]


class Index:
    """The four inverted lists of a block's codes."""

    def __init__(self, code: np.ndarray, bits: int):
        self.code, self.parts = code, PARTS
        self.width = [bits // PARTS + (k < bits % PARTS) for k in range(PARTS)]
        self.lists, at = [], 0
        for w in self.width:
            sub = ((code >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64)
            order = np.argsort(sub, kind="stable")
            edges = np.searchsorted(sub[order], np.arange((1 << w) + 1))
            self.lists.append((at, w, order, edges))
            at += w

    def within(self, code: int, radius: int) -> np.ndarray:
        """The places of all codes at most ``radius`` away, by pigeonhole probing."""
        found = np.zeros(len(self.code), bool)
        for at, w, order, edges in self.lists:
            sub = (int(code) >> at) & ((1 << w) - 1)
            probes = _probes(w, min(w, radius // self.parts)) ^ sub
            lo, hi = edges[probes], edges[probes + 1]
            some = hi > lo
            lo, n = lo[some], (hi - lo)[some]
            if len(lo):
                first = np.cumsum(n) - n
                found[order[np.repeat(lo - first, n) + np.arange(n.sum())]] = True
        at = np.flatnonzero(found)
        return at[np.bitwise_count(self.code[at] ^ np.uint64(code)) <= radius]


_PROBES: dict = {}


def _probes(width: int, most: int) -> np.ndarray:
    if (width, most) not in _PROBES:
        _PROBES[width, most] = _masks(width, most).astype(np.int64)
    return _PROBES[width, most]


def _search(model: dict, k: int):
    """The k nearest of a block's vectors for each query of a block of queries."""

    def run(key, vectors, queries):
        import pyarrow as pa

        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not vectors.num_rows or not queries.num_rows:
            return empty
        matrix = lambda t: np.array(t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1)
        x, q = matrix(vectors), matrix(queries)
        ids, asked = vectors.column("id").to_numpy(), queries.column("id").to_numpy()
        code, own = codes(x, model), codes(q, model)
        index = Index(code, model["bits"])
        names, who = np.unique(ids, return_inverse=True)
        repeats = len(names) < len(ids)
        out = []
        for j in range(len(q)):
            radius = model["radius"]
            while True:
                at = index.within(own[j], radius)
                at = at[ids[at] != asked[j]]
                some = len(np.unique(who[at])) if repeats else len(at)  # candidates, not rows
                if some >= k or radius >= model["bits"]:
                    break
                radius = min(model["bits"], radius + PARTS)  # too few: a wider radius, up to all
            d = np.sqrt(((x[at] - q[j]) ** 2).sum(axis=1))
            if repeats:  # the nearest row of each candidate
                order = np.lexsort((d, who[at]))
                first = np.ones(len(at), bool)
                first[1:] = who[at[order[1:]]] != who[at[order[:-1]]]
                at, d = at[order[first]], d[order[first]]
            if len(at) > k:
                least = np.partition(d, k - 1)[k - 1]
                keep = d <= least
                at, d = at[keep], d[keep]
            best = np.lexsort((ids[at], d))[:k]
            out.append((np.full(len(best), asked[j]), ids[at[best]], d[best]))
        cat = lambda i: np.concatenate([o[i] for o in out])
        return pa.table({"query_id": pa.array(cat(0), pa.int64()), "vec_id": pa.array(cat(1), pa.int64()), "score": pa.array(cat(2), pa.float64())})

    return run


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 100,
    k: int = 10,
    sample: int = SAMPLE,
    target: float = TARGET,
) -> DataFrame:
    """The ``k`` nearest vectors found for each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Queries are the rows whose identifier is divisible by ``every``; candidates are all
    rows with another identifier. Vectors that are null, zero, of another length than most of
    the sample, or that hold null or non-finite components take no part; neither do rows
    without an identifier. Equal distances go to the smaller identifier. Rows that repeat an
    identifier are one candidate, the nearest of them, and one query, the first by
    components. If fewer than ``k`` codes of a block lie within the radius, the radius grows
    until there are or all are taken, so a query has ``k`` rows if there are as many
    candidates. The rotation and the radius come from ``sample`` rows of smallest hash; every
    row is indexed. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    schema = "query_id long, vec_id long, score double"
    rows = usable(df, id_col, vec_col)
    sampled = [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()]
    if not sampled:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    lengths = [len(v) for v in sampled]
    dim = max(sorted(set(lengths)), key=lengths.count)
    model = learn(np.array([v for v in sampled if len(v) == dim], float), target, k)
    rows = usable(df, id_col, vec_col, dim)
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    vector_blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    block = lambda salt, blocks: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    queries = queries.withColumn("qb", block(1, query_blocks)).withColumn("vb", every_block(vector_blocks))
    vectors = rows.withColumn("vb", block(2, vector_blocks)).withColumn("qb", every_block(query_blocks))
    found = vectors.groupBy("vb", "qb").cogroup(queries.groupBy("vb", "qb")).applyInArrow(_search(model, k), schema)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
