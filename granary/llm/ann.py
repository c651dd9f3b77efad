"""Approximate nearest neighbours by an inverted multi-index (operator 1).

A vector's two halves are quantised separately with `codes` centroids each; a cell is a pair of them. A query walks the
cells by the sum of its two squared distances to the centroids, with a heap over the pairs, until the cells it has met
hold the share `probe` of all entries and also of all distinct vectors, so that copies in a walked cell take no place of
others; the entries are reranked by their exact distances.

Centroids are fitted on at most SAMPLE vectors, those first by a hash of the id; every vector is indexed. The share
is measured on the same sample: of PROBES of its vectors the nearest in it are found by brute force, and the walk is as
long as it takes to meet the share `target` of them. In the whole table the nearest are nearer, in cells met sooner. On
clustered vectors that is a small share; on vectors without any structure nearly half of all.

Cells are dealt to groups of at most GROUP entries, or GROUP_BYTES, in the order of cells; a cell with more (many equal
vectors) is split by hash. A query goes once to each group that holds a cell it walks, and gets that group's nearest back.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no
part; shorter vectors count as filled up with zeros; of rows that repeat an id the smallest vector stays; ties go to
the smaller id; without other vectors a query has no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import map_rows, sound_vectors, stored, vectors_of

K = 10
CODES = 64
#: Share of a sample's nearest neighbours that the walk must meet, and the vectors of the sample that ask for theirs.
TARGET, PROBES = 0.96, 512
SAMPLE = 8192
#: Entries of a group and the bytes of their vectors, whichever is less.
GROUP, GROUP_BYTES = 8192, 1 << 24
#: Queries that are compared to a group at once.
QUERIES = 1024


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)


def centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = squares(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """The two codebooks; `held` counts the entries of each cell, `distinct` its different vectors."""

    def __init__(self, sample: np.ndarray, codes: int = CODES):
        self.width, self.half = sample.shape[1], (sample.shape[1] + 1) // 2
        self.first = centroids(sample[:, : self.half], codes)
        rest = sample[:, self.half :]
        self.second = centroids(rest, codes) if rest.shape[1] else np.zeros((1, 0))
        self.held: dict[int, int] = {}
        self.distinct: dict[int, int] = {}

    def cells(self, x: np.ndarray) -> np.ndarray:
        return squares(x[:, : self.half], self.first).argmin(1) * len(self.second) + squares(x[:, self.half :], self.second).argmin(1)

    def walk(self, q: np.ndarray, least: int, least_distinct: int = 0) -> list[int]:
        """Cells that have entries, nearest first, until they hold at least so many, and so many different vectors."""
        one, two = squares(q[None, : self.half], self.first)[0], squares(q[None, self.half :], self.second)[0]
        a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        one, two, wide = one[a], two[b], len(b)
        heap, out, met, met_distinct = [(one[0] + two[0], 0, 0)], [], 0, 0
        while heap and (met < least or met_distinct < least_distinct):
            _, i, j = heapq.heappop(heap)
            if j + 1 < wide:
                heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
            cell = int(a[i]) * wide + int(b[j])
            if n := self.held.get(cell, 0):
                out.append(cell)
                met += n
                met_distinct += self.distinct.get(cell, 0)
        return out


def probe_share(index: Index, sample: np.ndarray, k: int, target: float, probes: int = PROBES) -> float:
    """The share of entries, or of distinct vectors, whichever the walk has met less of, before it comes to the cells that
    hold the share `target` of the nearest of some sampled vectors."""
    cells, wide = index.cells(sample), len(index.second)
    n, distinct = (np.array([of.get(c, 0) for c in range(len(index.first) * wide)], float) for of in (index.held, index.distinct))
    needs = []
    for i in range(min(probes, len(sample))):
        q = sample[i]
        d = squares(q[None], sample)[0]
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        score = (squares(q[None, : index.half], index.first)[0][:, None] + squares(q[None, index.half :], index.second)[0]).ravel()
        order = np.argsort(score, kind="stable")
        before = np.empty_like(score)
        before[order] = np.minimum(*((np.cumsum(v[order]) - v[order]) / v.sum() for v in (n, distinct)))
        needs.append(before[cells[near]])
    needs = np.concatenate(needs) if needs else np.zeros(0)
    return float(np.quantile(needs, target, method="higher")) if len(needs) else 0.0


def grouped(held: dict[int, int], most: int) -> dict[int, list[int]]:
    """Groups of each cell: neighbouring cells share one until it is full, larger cells have several of their own."""
    out, group, room = {}, -1, 0
    for cell, n in sorted(held.items()):
        if n > most:
            parts = -(-n // most)
            out[cell] = list(range(group + 1, group + 1 + parts))
            group, room = group + parts, 0
            continue
        if n > room:
            group, room = group + 1, most
        out[cell] = [group]
        room -= n
    return out


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None):
    """(query row, id, distance) of the k nearest of x, exactly, ties to the smaller id."""
    d = np.maximum(squares(q, x), 0)
    d[q_ids[:, None] == ids[None, :]] = np.inf
    if allowed is not None:
        d[~allowed] = np.inf
    kk = min(k, len(ids))
    bound = np.partition(d, kk - 1, axis=1)[:, kk - 1]
    scale = (q**2).sum(1) + (x**2).sum(1).max()
    for i in range(len(q)):
        some = np.flatnonzero(d[i] <= bound[i] + 1e-12 * scale[i]) if np.isfinite(bound[i]) else np.flatnonzero(np.isfinite(d[i]))
        exact = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
        for j in np.lexsort((ids[some], exact))[:k]:
            yield i, int(ids[some[j]]), float(exact[j])


def search(vectors: DataFrame, queries: Column, k: int = K, codes: int = CODES, probe: float | None = None, target: float = TARGET, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found of each row of `queries` (a condition on `id`). Without a given
    share `probe` of the entries to be met it is measured for the recall `target`."""
    spark = vectors.sparkSession
    good = stored(sound_vectors(vectors, id_col, vec_col, zero_too=False))
    width = good.agg(F.max(F.size("vec"))).first()[0]
    fields = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], fields)
    rows = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    taken = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        taken[i, : len(r.vec)] = r.vec
    index = Index(taken, codes)

    def make_cells():
        return lambda b: {"id": b.column("id").to_pylist(), "vec": list(v := vectors_of(b.column("vec"), width)), "cell": index.cells(v).tolist()}

    cells = stored(map_rows(good, "id long, vec array<double>, cell int", make_cells))
    each = cells.groupBy("cell", F.xxhash64("vec").alias("h")).agg(F.count("*").alias("n"))
    counts = each.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()  # codes ** 2 rows at most
    index.held, index.distinct = {r.cell: r.n for r in counts}, {r.cell: r.distinct for r in counts}
    if probe is None:
        probe = probe_share(index, taken, k, target)
    groups = grouped(index.held, max(1, min(GROUP, GROUP_BYTES // (8 * width))))
    where = spark.createDataFrame([(c, g[0], len(g)) for c, g in groups.items()], "cell int, g int, parts int")
    entries = cells.join(F.broadcast(where), "cell").select((F.col("g") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("g"), "id", "vec", "cell")
    least, least_distinct = (int(probe * sum(n.values())) + 1 for n in (index.held, index.distinct))

    def make_walks():
        def of(b):
            out = {x: [] for x in ("g", "id", "vec", "cells")}
            for i, q in zip(b.column("id").to_pylist(), vectors_of(b.column("vec"), width), strict=True):
                by: dict[int, list[int]] = {}
                for cell in index.walk(q, least, least_distinct):
                    for g in groups[cell]:
                        by.setdefault(g, []).append(cell)
                for g, own in by.items():
                    for name, v in zip(out, (g, i, q, own), strict=True):
                        out[name].append(v)
            return out

        return of

    asked = cells.where(queries)
    parts = F.lit(max(1, -(-asked.count() // QUERIES)))
    walks = map_rows(asked.select("id", "vec"), "g int, id long, vec array<double>, cells array<int>", make_walks)
    base = entries.groupBy("g").agg(F.collect_list(F.struct("id", "vec", "cell")).alias("entries"))
    sets = walks.groupBy("g", F.pmod(F.xxhash64("id"), parts).alias("part")).agg(F.collect_list(F.struct("id", "vec", "cells")).alias("queries"))

    def make_rank():
        def of(b):
            out = {"query_id": [], "vec_id": [], "score": []}
            for xs, qs in zip(b.column("entries"), b.column("queries"), strict=True):
                xs, qs = xs.values, qs.values
                ids, q_ids = xs.field("id").to_numpy(zero_copy_only=False), qs.field("id").to_numpy(zero_copy_only=False)
                x, q = vectors_of(xs.field("vec"), width), vectors_of(qs.field("vec"), width)
                names, at = np.unique(xs.field("cell").to_numpy(zero_copy_only=False), return_inverse=True)
                open_cells = np.stack([np.isin(names, c) for c in qs.field("cells").to_pylist()])
                for i, vec_id, d in nearest(q, q_ids, x, ids, k, open_cells[:, at]):
                    for name, v in zip(out, (int(q_ids[i]), vec_id, d), strict=True):
                        out[name].append(v)
            return out

        return of

    found = map_rows(base.join(sets, "g").select("entries", "queries"), "query_id long, vec_id long, score double", make_rank)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
