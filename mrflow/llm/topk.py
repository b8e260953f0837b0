"""Exact top-k inner-product search over an impact-ordered index, a score at a time.

Vectors are cut into blocks. In a block every dimension has its rows in posting segments by quantised value: equal steps
between its least and greatest value. For a query a segment's contribution lies between two bounds. Queries go in batches,
and segments by descending upper bound, the best over the batch; each adds its lower bounds to the rows' accumulators. What
a row may still gain is at most, over the dimensions, the larger of the widest processed segment and the best one not
processed. Rows that this can't lift to the k-th accumulator are proven out; processing stops when scoring all others
exactly takes no more products than postings are left (or none are), and those others are scored exactly. So the result is
exact, and the rule compares two counts of work, whatever the data.

The index is written once. Queries go to it in batches of bounded size, each sent to all tasks; a task goes through its blocks
and holds the best of each query so far, whose last score helps to prove rows of later blocks out. What leaves a task are the
best of its blocks, which are merged by rank. A query's own row is taken out at the end: with it the k + 1 best are found, and
one entry with the query's id and its own product goes. So rows that share an id, or are equal, are candidates like any other.

Products are whole numbers. They are computed in float64 where none can reach 2**53, else in 64-bit integers, else in Python's.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import keep

BLOCK_ROWS = 16_384
#: A batch of queries has about so many rows and components at most; WAVE batches run at once, and few queries are spread over as many.
QUERY_ROWS, QUERY_VALUES, WAVE = 16_384, 1 << 22, 8
#: Queries whose accumulators are filled together.
BATCH = 64
LEVELS = 32
#: Blocks of at most this many times k rows are scored outright.
FEW = 8
#: Shares of the postings after which to look who may still be a member.
LOOKS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, v: array of long); vectors that are null or hold a null or non-finite component are left out. Components beyond a long are held at its ends."""
    x = F.col(vec_col)
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def build(ids: np.ndarray, x: np.ndarray, levels: int = LEVELS) -> tuple:
    """An index of a block: ids, vectors, rows by value for each dimension, the segments' ends there, and their bounds."""
    n, dims = x.shape
    low, high = x.min(0), x.max(0)
    level = np.minimum(((x - low) / (high - low + 1.0) * levels).astype(np.int64), levels - 1)
    size = np.bincount((level + np.arange(dims) * levels).ravel(), minlength=dims * levels).reshape(dims, levels)
    ends = np.concatenate([np.zeros((dims, 1), np.int64), np.cumsum(size, 1)], 1)
    order = np.argsort(x, axis=0, kind="stable").T
    in_order = np.take_along_axis(x.T, order, 1)
    low = np.take_along_axis(in_order, np.minimum(ends[:, :-1], n - 1), 1)
    high = np.take_along_axis(in_order, np.maximum(ends[:, 1:] - 1, 0), 1)
    return ids, x, np.ascontiguousarray(order.astype(np.uint16)), ends, low, high


def _products(x: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """x @ v, exact; no product or sum of them is above ``most``."""
    if most < 1 << 53:
        return (x.astype(float, copy=False) @ v.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return x.astype(np.int64, copy=False) @ v
    return np.array([sum(a * b for a, b in zip(row, v.tolist(), strict=True)) for row in x.astype(np.int64, copy=False).tolist()], object)


def search(index: tuple, q: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (row of q): (vec_ids, scores) of the k best rows of the block; ties to the smaller id. Rows that score below the query's ``least`` may be left out."""
    ids, x, *_ = index
    n, dims = x.shape
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(dims, 1)
    alive = _possible(index, q, k, least) if n > FEW * k and dims and top < 1 << 60 else np.ones((len(q), n), bool)
    dense = x.astype(float) if top < 1 << 53 else x
    out = []
    for mine, v in zip(alive, q, strict=True):
        rows = np.flatnonzero(mine)
        scores = _products(dense[rows], v, top)
        if len(scores) > 4 * k and scores.dtype != object:
            best = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            rows, scores = rows[best], scores[best]
        first = _first(ids[rows], scores, k)
        out.append((ids[rows][first], scores[first]))
    return out


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))[:k]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)


def _possible(index: tuple, q: np.ndarray, k: int, floor: np.ndarray | None) -> np.ndarray:
    """Which rows (columns) may be among the k best of a query (row) and reach its ``floor``."""
    _, x, order, ends, low, high = index
    n, dims = x.shape
    size = np.diff(ends, axis=1)
    real = size > 0
    up = q[:, :, None] > 0
    lower, upper = np.where(up, q[:, :, None] * low, q[:, :, None] * high), np.where(up, q[:, :, None] * high, q[:, :, None] * low)
    least = np.where(real, lower, np.iinfo(np.int64).max).min(2, keepdims=True)
    reach = np.full(len(q), -1) if floor is None else floor - least.sum((1, 2))  # the floor as an accumulator's value
    gain, best, width = (np.where(real, b, 0) for b in (lower - least, upper - least, upper - lower))
    dim, seg = np.unravel_index(np.argsort(-best.max(0), axis=None, kind="stable"), real.shape)
    counted = size[dim, seg] * (gain.max(0)[dim, seg] > 0)  # a segment that adds nothing has no posting to add up
    upto = np.cumsum(counted)
    most = best.max(2).sum(1).max()
    acc = np.zeros((n, len(q)), np.int32 if most < 1 << 31 else np.int64)
    adds = np.ascontiguousarray(gain.transpose(1, 2, 0)).astype(acc.dtype)
    done = np.zeros(real.shape, bool)
    start = 0
    for look in LOOKS:
        stop = len(dim) if look == 1 else int(np.searchsorted(upto, look * upto[-1], "right"))
        for d, s, some in zip(dim[start:stop].tolist(), seg[start:stop].tolist(), counted[start:stop].tolist(), strict=True):
            if some:
                acc[order[d, ends[d, s] : ends[d, s + 1]]] += adds[d, s]
        done[dim[start:stop], seg[start:stop]] = True
        left = int(upto[-1] - (upto[stop - 1] if stop else 0))
        start = stop
        slack = np.maximum(np.where(done, 0, best).max(2), np.where(done, width, 0).max(2)).sum(1)
        if look < 1 and (np.maximum(acc.max(0), reach) - slack <= acc.min(0)).all():
            continue  # nobody is out
        by_query = np.ascontiguousarray(acc.T)
        # k rows have at least the k-th accumulator
        bound = np.maximum(np.partition(by_query, n - k, axis=1)[:, n - k], reach) - slack
        possible = by_query >= bound[:, None]
        if np.count_nonzero(possible) * dims <= left * len(q):
            break
    return possible


def _ordered(scores: np.ndarray) -> list[bytes]:
    """24 bytes of each score that sort as the scores do."""
    if scores.dtype == object:
        return [(int(s) + (1 << 191)).to_bytes(24, "big") for s in scores]
    words = np.empty((len(scores), 3), ">u8")
    words[:, 0] = np.where(scores < 0, (1 << 63) - 1, 1 << 63)
    words[:, 1] = np.where(scores < 0, (1 << 64) - 1, 0).astype(np.uint64)
    words[:, 2] = scores.view(np.uint64)
    return [w.tobytes() for w in words]


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors to blocks of BLOCK_ROWS of one length. A null id stands as the greatest long."""
    held: dict[int, list] = {}

    def emit(rows: list) -> pd.DataFrame:
        ids = np.array([np.iinfo(np.int64).max if pd.isna(i) else int(i) for i, _ in rows], np.int64)
        x = np.array([v for _, v in rows], np.int64).reshape(len(rows), -1)
        small = np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.int64
        _, _, order, ends, low, high = build(ids, x)
        return pd.DataFrame({"index": [pickle.dumps((ids, x.astype(small), order, ends, low, high))]})

    for pdf in batches:
        for i, v in zip(pdf["vec_id"], pdf["v"], strict=True):
            rows = held.setdefault(len(v), [])
            rows.append((i, v))
            if len(rows) == BLOCK_ROWS:
                yield emit(held.pop(len(v)))
    for rows in held.values():
        yield emit(rows)


def _answer(shared, k: int):
    """Blocks to the k best rows of each query over all blocks of the task; shared: (numbers, ids, queries) in groups of BATCH."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        best: list[list | None] = [None] * len(asked)
        for pdf in batches:
            for raw in pdf["index"]:
                ids, x, order, *bounds = pickle.loads(raw)
                block = ids, x, order.astype(np.intp), *bounds
                for g, (*_, q) in enumerate(asked):
                    if q.shape[1] != x.shape[1]:
                        continue
                    before = best[g]
                    full = before is not None and all(len(i) == k and s.dtype != object for i, s in before)
                    found = search(block, q, k, np.array([s[-1] for _, s in before], np.int64) if full else None)
                    if before is not None:
                        both = [(np.concatenate([i, j]), np.concatenate([s, t])) for (i, s), (j, t) in zip(before, found, strict=True)]
                        found = [(i[at], s[at]) for i, s in both for at in (_first(i, s, k),)]
                    best[g] = found
        for (numbers, own, q), found in zip(asked, best, strict=True):
            if found:
                times = [len(i) for i, _ in found]
                scores = [s for _, s in found]
                itself = [(i == one) & (s == sum(a * a for a in v)) for (i, s), one, v in zip(found, own, q.tolist(), strict=True)]
                held = [np.array([max(min(int(x), (1 << 63) - 1), -(1 << 63)) for x in s], np.int64) if s.dtype == object else s for s in scores]
                yield pd.DataFrame({"query": np.repeat(numbers, times), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate(held), "itself": np.concatenate(itself).astype(bool), "exact": [b for s in scores for b in _ordered(s)]})

    return answer


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """vectors, queries (vec_id, v; the queries are rows of vectors) to query_id, rank (from 1), vec_id, score.

    A query meets every row but its own and those of another length. Rows repeated in ``vectors`` count each, also those that
    share the query's id; a query repeated in ``queries`` is answered as often. Rows with a null id are candidates and rank last
    among ties; queries with a null id are left out. Ranks go by the exact product; one beyond a long is given as the nearest long.
    An id of 2**63 - 1 is taken for null. Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    none = np.iinfo(np.int64).max
    distinct = queries.filter("vec_id IS NOT NULL").groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    asked = keep(distinct.withColumn("query", F.monotonically_increasing_id()), "queries")
    facts = asked.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("values")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = max(-(-facts["n"] // QUERY_ROWS), -(-facts["values"] // QUERY_VALUES), min(WAVE, -(-facts["n"] // (4 * BATCH))))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
    blocks = keep(vectors.mapInPandas(_index, "index binary"), "index")
    found = None
    for wave in range(0, parts, WAVE):
        sent, out = [], None
        for _, rows in dealt.filter(F.col("part").between(wave, wave + WAVE - 1)).toPandas().groupby("part"):
            groups = []
            for _, same in rows.groupby(rows["v"].map(len)):
                for i in range(0, len(same), BATCH):
                    some = same.iloc[i : i + BATCH]
                    groups.append((some["query"].to_numpy(np.int64), some["vec_id"].to_numpy(np.int64), np.array(some["v"].tolist(), np.int64).reshape(len(some), -1)))
            sent.append(spark.sparkContext.broadcast(groups))
            got = blocks.mapInPandas(_answer(sent[-1], k + 1), "query long, vec_id long, score long, itself boolean, exact binary")
            out = got if out is None else out.unionByName(got)
        if out is None:
            continue
        kept = keep(out, "found")
        for b in sent:
            b.unpersist()
        found = kept if found is None else found.unionByName(kept)
    met = found.join(asked.select("query", "copies", F.col("vec_id").alias("query_id")), "query")
    by = Window.partitionBy("query").orderBy(F.desc("exact"), "vec_id")
    met = met.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k + 1)
    gone = F.min(F.when(F.col("itself"), F.col("place"))).over(Window.partitionBy("query"))
    met = met.withColumn("gone", F.coalesce(gone, F.lit(k + 1))).filter("place <> gone")
    met = met.withColumn("rank", F.col("place") - (F.col("place") > F.col("gone")).cast("int"))
    every = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.select("query_id", "rank", F.when(F.col("vec_id") != none, F.col("vec_id")).alias("vec_id"), "score")
