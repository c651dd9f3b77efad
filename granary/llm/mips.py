"""Exact top-k inner products over norm-sorted, SVD-rotated vectors (operator 6).

Components are quantised to floor(64 * x). Vectors are sorted by descending length and cut to slabs. A query's bound is
its k-th best score in the first slab. A slab is skipped for all queries whose length times the slab's largest length
cannot reach their bounds (Cauchy-Schwarz). Inside a slab, vectors and queries are turned to the axes of the singular value
decomposition, which puts most of the product into the first coordinates; after each part of them, a vector stays only
if its partial sum plus the product of both remainders' lengths can still reach the bound. Scores of what stays are
computed from the whole numbers themselves.

Scores are exact as long as they fit 64 bits; beyond, they stop at the largest or smallest long.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part; empty
vectors count as zero, shorter ones as filled up with zeros; of rows that repeat an id the smallest vector stays;
ties go to the smaller id; without other vectors a query has no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import map_rows, sound_vectors, stored, vectors_of

K = 20
SCALE = 64
#: Vectors of a slab and their bytes, whichever is less; the first slab goes to every task.
SLAB, SLAB_BYTES = 8192, 1 << 24
#: Queries that are compared to a slab at once.
QUERIES = 1024
#: Slabs that share a key of the join with the queries.
SHARD = 4
#: Slabs at most that make up the first one, where they are short.
FIRSTS = 1024
#: Shares of the coordinates after which partial sums are tested.
STEPS = (0.25, 0.5, 0.75)


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, as int64."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bound)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def kth(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among x, the least long where there are fewer."""
    s = products(q, x)
    s[q_ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    return np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)


def scan(q: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, x: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, piece: int = 2048):
    """(query row, id, score) of the best k of x that reach each query's bound; x is sorted by descending length."""
    with np.errstate(over="ignore", invalid="ignore"):
        q_len, x_len = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))
        qt, xt = q @ turn, x @ turn
    cuts = sorted({max(1, int(s * x.shape[1])) for s in STEPS})
    rests = lambda m: [np.sqrt(np.maximum((m[:, c:] ** 2).sum(1), 0)) for c in cuts]
    q_rest, x_rest = rests(qt), rests(xt)
    low, least, found = bounds.astype(np.float64), bounds.astype(np.int64), [([], []) for _ in q]
    for a in range(0, len(x), piece):
        b = min(len(x), a + piece)
        slack = 1e-9 * q_len * x_len[a] + 1e-6
        rows = np.flatnonzero(~(q_len * x_len[a] + slack < low))
        if not len(rows):
            break  # later vectors are shorter still
        part, stays, done = np.zeros((len(rows), b - a)), np.ones((len(rows), b - a), bool), 0
        for c, qr, xr in zip(cuts, q_rest, x_rest, strict=True):
            part += qt[rows, done:c] @ xt[a:b, done:c].T
            done = c
            stays &= ~(part + qr[rows, None] * xr[None, a:b] + slack[rows, None] < low[rows, None])
            share = stays.mean()
            if share < 0.02 or share > 0.5:
                break  # little is left, or so much that whole products cost less than further tests
        cols = np.flatnonzero(stays.any(0))
        if not len(cols):
            continue
        exact = products(q[rows], x[a:b][cols])
        hits = stays[:, cols] & (exact >= least[rows, None]) & (ids[a:b][cols] != q_ids[rows, None])
        for n in np.flatnonzero(hits.any(1)):
            i, own = rows[n], np.flatnonzero(hits[n])
            found[i][0].append(exact[n, own])
            found[i][1].append(ids[a:b][cols[own]])
            s, own_ids = np.concatenate(found[i][0]), np.concatenate(found[i][1])
            top = best(s, own_ids, k)
            found[i] = ([s[top]], [own_ids[top]])
            if len(top) == k:
                least[i] = max(least[i], s[top[-1]])
                low[i] = float(least[i])
    for i, (s, own_ids) in enumerate(found):
        if s:
            yield from ((i, int(v), int(w)) for v, w in zip(own_ids[0], s[0], strict=True))


def search(vectors: DataFrame, queries: Column, k: int = K, slab: int = SLAB, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each row of `queries` (a condition on `id`)."""
    spark = vectors.sparkSession
    good = stored(sound_vectors(vectors, id_col, vec_col, zero_too=True))
    size = good.agg(F.max(F.size("vec")), F.count("*")).first()
    if not size[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, size[0])
    slab = max(k + 1, min(slab, SLAB_BYTES // (8 * width)))

    def make_gram():
        def of(b):
            with np.errstate(over="ignore", invalid="ignore"):
                x = quantised(vectors_of(b.column("vec"), width))
                return {"gram": [np.nan_to_num(x.T @ x).ravel()]}

        return of

    parts = map_rows(good.select("vec"), "gram array<double>", make_gram).select(F.posexplode("gram").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    gram = np.zeros(width * width)
    for at, v in parts.toLocalIterator():  # width ** 2 sums
        gram[at] = v
    turn = np.linalg.svd(np.nan_to_num(gram).reshape(width, width) / max(1.0, np.abs(gram).max()))[0]

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.floor(SCALE * x) * F.floor(SCALE * x)))
    length = F.when(F.exists("vec", lambda x: F.abs(x) > 1e15), F.lit(float("inf"))).otherwise(length)
    sized = good.withColumn("len", length).repartitionByRange(max(1, -(-size[1] // (SHARD * slab))), F.desc("len"), "id").sortWithinPartitions(F.desc("len"), "id")

    def cut(batches):
        ids, mats, n = [], [], 0

        def row():
            x = np.concatenate(mats)
            with np.errstate(over="ignore"):
                return pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x**2).sum(1)).max())]), pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["len", "ids", "raw"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(slab - n, b.num_rows - at)
                part = b.slice(at, take)
                ids.append(part.column("id").to_numpy(zero_copy_only=False))
                mats.append(quantised(vectors_of(part.column("vec"), width)))
                n, at = n + take, at + take
                if n == slab:
                    yield row()
                    ids, mats, n = [], [], 0
        if n:
            yield row()

    slabs = stored(sized.mapInArrow(cut, "len double, ids array<long>, raw binary").withColumn("shard", F.monotonically_increasing_id()))
    # the longest vectors come to the driver as the first slabs, one slab's worth at most: an ordered limit of the vectors would bring that many from each partition
    last, firsts, held = slabs.agg(F.max("shard")).first()[0], [], 0
    for shard, n in slabs.select("shard", F.size("ids")).orderBy("shard").limit(FIRSTS).collect():
        if firsts and held + n > slab:
            break
        firsts, held = [*firsts, shard], held + n
    head = slabs.where(F.col("shard") <= firsts[-1]).select("ids", "raw").collect()
    head_ids, head_x = np.concatenate([np.array(r["ids"], dtype=np.int64) for r in head]), np.concatenate([np.frombuffer(r["raw"]).reshape(-1, width) for r in head])
    asked = good.where(queries)
    many = F.lit(max(1, -(-asked.count() // QUERIES)))
    sets = asked.groupBy(F.pmod(F.xxhash64("id"), many).alias("part")).agg(F.collect_list(F.struct("id", "vec")).alias("queries"))

    def make_bounds():
        def of(b):
            out = {"ids": [], "raw": [], "bounds": [], "q_len": [], "low": []}
            for qs in b.column("queries"):
                q_ids, q = qs.values.field("id").to_numpy(zero_copy_only=False), quantised(vectors_of(qs.values.field("vec"), width))
                low = kth(q, q_ids, head_x, head_ids, k)
                with np.errstate(over="ignore"):
                    longest = float(np.sqrt((q**2).sum(1)).max())
                for name, v in zip(out, (q_ids, q.tobytes(), low, longest, float(low.min())), strict=True):
                    out[name].append(v)
            return out

        return of

    asking = stored(map_rows(sets.select("queries"), "ids array<long>, raw binary, bounds array<long>, q_len double, low double", make_bounds))
    dealt = asking.select(F.col("ids").alias("q_ids"), F.col("raw").alias("q_raw"), "bounds", "q_len", "low", F.explode(F.sequence(F.lit(0), F.lit(last >> 33))).alias("shard"))
    # compressed files say little of what slabs take in memory, so neither side is offered for a broadcast by the driver
    pairs = dealt.join(slabs.withColumn("shard", F.shiftright("shard", 33).cast("int")).hint("merge"), "shard").where(F.col("q_len") * F.col("len") * (1 + 1e-9) + 1e-6 >= F.col("low"))

    def make_scan():
        def of(b):
            out = {"query_id": [], "vec_id": [], "score": []}
            for q_ids, q_raw, bounds, ids, raw in zip(*(b.column(c) for c in ("q_ids", "q_raw", "bounds", "ids", "raw")), strict=True):
                q_ids, bounds, ids = (c.values.to_numpy(zero_copy_only=False) for c in (q_ids, bounds, ids))
                q, x = np.frombuffer(q_raw.as_py()).reshape(-1, width), np.frombuffer(raw.as_py()).reshape(-1, width)
                for i, vec_id, s in scan(q, q_ids, bounds, x, ids, turn, k):
                    for name, v in zip(out, (int(q_ids[i]), vec_id, s), strict=True):
                        out[name].append(v)
            return out

        return of

    found = map_rows(pairs.select("q_ids", "q_raw", "bounds", "ids", "raw"), "query_id long, vec_id long, score long", make_scan)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
