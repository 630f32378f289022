"""Approximate nearest neighbours: balanced posting lists below an in-memory graph of centroids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ship, tidy, written

#: Rows that centroids and the pruning ratio are fitted on, at most; every row is indexed.
SAMPLE = 20_000
#: Centroids at most: with them the driver and each task hold that many vectors.
MOST_LISTS = 8192
#: Vectors of a posting list that one task compares, and queries that it compares them with.
LIST_ROWS, QUERY_ROWS = 512, 4096
#: Lists that a boundary vector is copied to, at most, and how much further than the nearest they may be.
COPIES, BOUNDARY = 3, 0.05
#: Share of true neighbours in the sample whose list the ratio must reach.
REACH = 0.97
#: Numbers of a matrix that is in memory at a time, on the driver as in tasks.
CELLS = 1 << 21
#: Lists that are searched first, for a bound on the last neighbour's score.
FIRST = 4


class CentroidGraph:
    """A neighbour graph over centroids, searched best first for many vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.c = centroids
        k = len(centroids)
        near = np.vstack([np.argsort(_distances(centroids[a:z], centroids), axis=1, kind="stable")[:, : min(k, degree + 1)] for a, z in _chunks(k, k)])
        links: list[set[int]] = [set(map(int, r)) - {i} for i, r in enumerate(near)]
        for i in range(k):  # both ways, and a ring, so that each centroid can be reached
            for j in list(links[i]):
                links[j].add(i)
            if k > 1:
                links[i].add((i + 1) % k)
                links[(i + 1) % k].add(i)
        width = max(map(len, links), default=0)
        self.links = np.full((k, width), -1, dtype=np.int32)
        for i, s in enumerate(links):
            self.links[i, : len(s)] = sorted(s)
        self.start = int(np.argmin(_distances(centroids.mean(axis=0, keepdims=True), centroids)[0]))

    def search(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest centroids found for each row, nearest first, and their squared distances."""
        found = [self._search(x[a:z], most) for a, z in _chunks(len(x), max(self.links.shape[1] * self.c.shape[1], len(self.c)))]
        if not found:
            return np.zeros((0, min(most, len(self.c))), np.int64), np.zeros((0, min(most, len(self.c))))
        return np.vstack([f[0] for f in found]), np.vstack([f[1] for f in found])

    def _search(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(self.c)
        most = min(most, k)
        beam = min(k, max(most + most // 4, 32))
        dist = np.full((n, k), np.inf)
        opened = np.zeros((n, k), bool)
        rows = np.arange(n)
        dist[:, self.start] = _distances(x, self.c[self.start : self.start + 1])[:, 0]
        live = rows
        for _ in range(k):
            if not len(live):
                break
            closed = np.where(opened[live], np.inf, dist[live])
            cur = closed.argmin(axis=1)
            best = closed[np.arange(len(live)), cur]
            bound = np.partition(dist[live], beam - 1, axis=1)[:, beam - 1]
            go = np.isfinite(best) & (best <= bound)
            live, cur = live[go], cur[go]
            if not len(live):
                break
            opened[live, cur] = True
            nb = self.links[cur]
            ok = nb >= 0
            ok &= ~np.isfinite(dist[live[:, None], np.where(ok, nb, 0)])
            r, j = np.nonzero(ok)
            at, to = live[r], nb[r, j]
            diff = x[at] - self.c[to]
            dist[at, to] = np.einsum("ij,ij->i", diff, diff)
        order = np.argsort(dist, axis=1, kind="stable")[:, :most]
        return order, np.take_along_axis(dist, order, axis=1)


def _chunks(rows: int, width: int) -> list[tuple[int, int]]:
    """Ranges of rows whose matrix with so many columns has at most CELLS numbers."""
    step = max(1, CELLS // max(1, width))
    return [(a, min(rows, a + step)) for a in range(0, rows, step)]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def lifted(x: np.ndarray, norm2: float, query: bool = False) -> np.ndarray:
    """One more component, with which the largest inner product is the least distance; a query's is 0."""
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))
    return np.hstack((x, more[:, None]))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Balanced k-means: a list's size so far is a penalty on its distance, and empty lists take rows of the largest."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        some = x[:: max(1, len(x) * k // CELLS)]
        usual = _distances(some, c).min(axis=1).mean()
        more = usual * 0.3 * (size * k / len(x) - 1)[None, :]
        at = np.concatenate([(_distances(x[a:z], c) + more).argmin(axis=1) for a, z in _chunks(len(x), k)])
        size = np.bincount(at, minlength=k).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        for e in np.flatnonzero(size == 0):
            c[e] = x[rng.choice(np.flatnonzero(at == size.argmax()))]
    return c


def copies(graph: CentroidGraph, x: np.ndarray) -> np.ndarray:
    """rows x COPIES lists of each vector, -1 for none: the nearest, and for one at a boundary those about as near.

    A further list is left out where a list already chosen is nearer to its centroid than the vector is.
    """
    ids, d = graph.search(x, min(len(graph.c), 4 * COPIES))
    out = np.full((len(x), COPIES), -1, dtype=np.int32)
    out[:, 0] = ids[:, 0]
    used = np.ones(len(x), np.int64)
    for j in range(1, ids.shape[1]):
        ok = (d[:, j] <= d[:, 0] * (1 + BOUNDARY) ** 2) & (used < COPIES)
        for m in range(COPIES - 1):
            has = out[:, m] >= 0
            gap = graph.c[ids[:, j]] - graph.c[out[:, m]]
            ok &= ~has | ((gap * gap).sum(1) > d[:, j])
        r = np.flatnonzero(ok)
        out[r, used[r]] = ids[r, j]
        used[r] += 1
    return out


def fit_ratio(graph: CentroidGraph, x: np.ndarray, raw: np.ndarray, k: int) -> float:
    """The distance ratio to the nearest centroid within which REACH of the sample's true neighbours have a list."""
    lists = copies(graph, x)
    q = np.arange(0, len(x), max(1, len(x) // 400))
    ratios = []
    for a, z in _chunks(len(q), len(raw)):
        own = q[a:z]
        score = raw[own] @ raw.T
        score[np.arange(len(own)), own] = -np.inf
        near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
        d = np.sqrt(_distances(lifted(raw[own], 0.0, query=True), graph.c))
        least = np.where(lists[near] >= 0, d[np.arange(len(own))[:, None, None], np.maximum(lists[near], 0)], np.inf).min(axis=2)
        ratios.append(least / np.maximum(d.min(axis=1), 1e-12)[:, None])
    ratio = np.vstack(ratios)
    return float(np.quantile(ratio, REACH))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id whose vector is not null or zero, has finite components only, and the most usual length."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda e: e != 0) & ~bad)
    x = written(x.withColumn("d", F.size("v")), "vectors")
    usual = x.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return x.where(F.col("d") == (usual.d if usual else 0)).drop("d")


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def nearest(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", reach: float | None = None) -> DataFrame:
    """The ``k`` rows of largest inner product found for each query: query_id, rank, id, score.

    ``queries``: a condition on ``id_col``.  Candidates: every usable row with another id.  Ties go to the smaller id.
    Lists are cut into parts of LIST_ROWS rows and their queries into blocks, so no task holds a whole list.  A query
    takes its nearest lists first; of the other lists within the ratio only what reaches its k-th score comes back.
    Equal vectors share their lists.  Rows that repeat an id count once.  Fewer candidates than ``k``: all found.
    Rows without an id take no part, nor do vectors that are null, zero, not finite throughout, or of another length
    than most.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = usable(vectors, id_col, vector_col)
    n = x.count()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if not n:
        return empty
    part = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30))
    # about 0.9 SAMPLE rows by a hash of the id, so over SAMPLE only where ids repeat; those are cut off
    some = x.where(part < int(min(1.0, 0.9 * SAMPLE / n) * (1 << 30))).limit(SAMPLE).toArrow()
    if not some.num_rows:
        some = x.limit(1).toArrow()
    some = some.sort_by("id")
    raw = _matrix(some.column("v")).astype(float)
    del some
    norm2 = x.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).first()[0]
    up = lifted(raw, norm2)
    graph = CentroidGraph(fit_centroids(up, max(1, min(MOST_LISTS, len(up), math.isqrt(n) // 2))))
    ratio = fit_ratio(graph, up, raw, k) if reach is None else reach
    shared = spark.sparkContext.broadcast(graph)  # at most MOST_LISTS vectors

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            lists = copies(shared.value, lifted(_matrix(v), norm2))
            r, j = np.nonzero(lists >= 0)
            yield pa.record_batch({"list": pa.array(lists[r, j], pa.int32()), "id": b.column("id").take(pa.array(r)), "v": v.take(pa.array(r))})

    def probe(batches):
        g = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            # room for a quarter of the lists at once; whoever needs more gets them all
            q, most = lifted(_matrix(v), norm2, query=True), max(min(len(g.c), 64), len(g.c) // 4)
            ids, d = g.search(q, most)
            inside = d <= d[:, :1] * ratio**2
            if inside[:, -1].any() and most < len(g.c):
                ids, d = g.search(q, len(g.c))
                inside = d <= d[:, :1] * ratio**2
            inside[:, :FIRST] = True
            r, j = np.nonzero(inside)
            yield pa.record_batch({"list": pa.array(ids[r, j], pa.int32()), "id": b.column("id").take(pa.array(r)), "v": v.take(pa.array(r)), "first": pa.array(j < FIRST)})

    postings = written(x.mapInArrow(tidy(assign), "list int, id long, v array<double>"), "postings")
    asked = x.where(queries.isNotNull() & queries) if hasattr(queries, "isNotNull") else x.where(queries)
    probes = written(asked.mapInArrow(tidy(probe), "list int, id long, v array<double>, first boolean"), "probes")
    # a row for each list: how many parts it has, and how many blocks its queries make
    parts = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts"))
    blocks = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
    shape = F.broadcast(written(parts.join(blocks, "list"), "lists"))  # at most MOST_LISTS rows
    rows = postings.join(shape, "list").select(
        "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v"
    )
    bound = spark.createDataFrame([], "q long, least double")
    found = None
    for first in (True, False):
        ask = probes.where(F.col("first") == first).join(shape, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v"
        )
        ask = ask.join(bound, ask["id"] == bound["q"], "left").drop("q")
        got = rows.groupBy("list", "part", "block").cogroup(ask.groupBy("list", "part", "block")).applyInPandas(_compare(k), "q long, id long, score double")
        both = got if found is None else got.union(found)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = both.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        best = written(best, "found")
        found = best.drop("rank")
        bound = best.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    return best.select(F.col("q").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias(id_col), "score")


def _compare(k: int):
    def compare(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows) and len(ask):
            rows = rows.sort_values("id", kind="stable")
            v, ids = np.stack(rows["v"].to_numpy()).astype(float), rows["id"].to_numpy()
            q, names, least = np.stack(ask["v"].to_numpy()).astype(float), ask["id"].to_numpy(), ask["least"].to_numpy(dtype=float)
            score = q @ v.T
            slack = 1e-12 * (1 + np.abs(score).max())
            score[names[:, None] == ids[None, :]] = -np.inf
            last = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
            floor = np.maximum(last, np.where(np.isnan(least), -np.inf, least))
            r, c = np.nonzero((score >= floor[:, None] - slack) & np.isfinite(score))
            exact = (q[r] * v[c]).sum(axis=1)  # the same for equal vectors, wherever they stand
            order = np.lexsort((ids[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            keep = place < k
            out.append(pd.DataFrame({"q": names[r[keep]], "id": ids[c[keep]], "score": exact[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return compare
