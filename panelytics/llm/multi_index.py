"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in two halves; each half has ``centroids`` centroids, fitted on a bounded sample (``sample`` expected rows, chosen by
a hash), and the pair of nearest centroids is a row's cell. Every row is indexed. A query walks the pairs in order of summed
distance with a heap until the cells it has met hold ``probe`` of all rows (and more rows than it needs); what is in those cells is
reranked by the cosine of the original vectors in double precision.

The index is a stored table. Queries are sent to the cells they visit; a cell is split into tiles of at most ``tile`` rows and its
queries into blocks of as many, so a cell with a third of all rows is a number of tasks. Each tile sends on its best rows only.

Vectors here have no strong clusters, so a good recall needs a large ``probe``; the default is measured (README).

Defined results: vectors that are null, zero, of another length than most vectors, or hold null or non-finite components take no part,
neither do rows without an id. Rows that repeat a vec_id are one candidate, at their best score, and one query, with the smallest of their vectors. Ties go to the
smaller id. Fewer than ``k`` candidates in all: all of them. Other columns do not matter.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelytics.llm.common import hash_share
from panelytics.session import stage


@dataclass(frozen=True)
class Settings:
    centroids: int = 16
    sample: int = 20_000
    iterations: int = 12
    probe: float = 0.65
    k: int = 5
    every: int = 50
    tile: int = 1_024
    seed: int = 3


def cluster(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's iterations from distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(iterations):
        own = nearest(x, centroids)
        sums = np.stack([np.bincount(own, weights=x[:, d], minlength=len(centroids)) for d in range(x.shape[1])], axis=1)
        sizes = np.bincount(own, minlength=len(centroids))[:, None]
        centroids = np.where(sizes > 0, sums / np.maximum(sizes, 1), centroids)
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(x, centroids).argmin(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
    """Cells in order of summed distance until they hold ``wanted`` rows; empty cells are passed through."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i] * len(second) + b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (first[a[u]] + second[b[v]], u, v))
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the vectors that take part, and their length."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = most["n"] if most else 0
    return rows.where(F.size("v") == width), width


def search(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest rows of every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows, width = usable(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = rows.count()
    if not n:
        return empty
    half = (width + 1) // 2
    sample = rows.where(hash_share(settings.sample / n, F.col("vec_id"))).orderBy("vec_id").select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(1_000).select("v").toArrow().column(0).combine_chunks()
    fitted = unit(matrix(sample, width))
    books = [cluster(part, settings.centroids, settings.iterations, settings.seed + i) for i, part in enumerate((fitted[:, :half], fitted[:, half:]))]

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(1), width))
                cell = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(cell, pa.int32())], ["vec_id", "v", "cell"])

    index = stage(rows.mapInArrow(code, "vec_id long, v array<double>, cell int"), "multi-index")
    sizes = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for cell, count in index.groupBy("cell").count().collect():  # one row for each cell
        sizes[cell] = count
    wanted = max(settings.probe * n, settings.k + 1)

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(1), width))
                first, second = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
                cells = [walk(f, s, sizes, wanted) for f, s in zip(first, second, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "v", "cells"])

    queries = index.where(F.pmod("vec_id", F.lit(settings.every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = stage(queries.mapInArrow(route, "query_id long, v array<double>, cells array<int>"), "routed")
    visits = routed.select("query_id", "v", F.explode("cells").alias("cell"))
    asked = np.zeros(len(sizes), dtype=np.int64)
    for cell, count in visits.groupBy("cell").count().collect():
        asked[cell] = count
    plan = [(c, int(-(-sizes[c] // settings.tile)), int(-(-asked[c] // settings.tile))) for c in np.flatnonzero(asked).tolist()]
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, tiles int, blocks int"))  # one row for each cell
    tile = F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    every_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    entries = index.join(plan, "cell").select("cell", tile.alias("tile"), every_block.alias("block"), "vec_id", "v")
    askers = visits.join(plan, "cell").select("cell", every_tile.alias("tile"), block.alias("block"), "query_id", "v")
    k = settings.k

    def rerank(entries: pd.DataFrame, askers: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(askers):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x = entries["vec_id"].to_numpy(), np.stack(entries["v"].to_numpy())
        own, q = askers["query_id"].to_numpy(), np.stack(askers["v"].to_numpy())
        parts = [best_rows(own[i : i + 64], q[i : i + 64], ids, x, k) for i in range(0, len(own), 64)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    keys = ["cell", "tile", "block"]
    found = entries.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_rows(own: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best distinct ids for each query but its own, ties to the smaller id.

    A matrix product finds the rows within 1e-9 of the k-th distinct best; their scores are summed row by row, so that equal
    vectors have equal scores wherever they stand.
    """
    distinct, copy = np.unique(ids, return_inverse=True)
    norms, q_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    rough = (q @ x.T) / (q_norms[:, None] * norms)
    rough[own[:, None] == ids[None, :]] = -np.inf
    by_id = rough
    if len(distinct) < len(ids):
        by_id = np.full((len(own), len(distinct)), -np.inf)
        np.maximum.at(by_id, (slice(None), copy), rough)
    least = np.partition(by_id, -min(k, by_id.shape[1]), axis=1)[:, -min(k, by_id.shape[1])] - 1e-9
    row, col = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
    score = (x[col] * q[row]).sum(axis=1) / (norms[col] * q_norms[row])
    order = np.lexsort((ids[col], -score, row))
    row, id_of, score = row[order], ids[col][order], score[order]
    _, first = np.unique(np.stack([row, id_of], axis=1), axis=0, return_index=True)
    first.sort()
    row, id_of, score = row[first], id_of[first], score[first]
    starts = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - starts < k
    return own[row[keep]], id_of[keep], score[keep]
