"""Nearest neighbours with an inverted multi-index (operator 2).

The two halves of every vector are quantised apart from each other; a vector's cell is its pair of
centroids, of which there are more for more vectors. A query has one score per centroid and half. A
heap walks through the pairs in order of their summed scores, the two sorted lists being the axes,
and every entry of the cells that it visits is ranked by its exact inner product.

A walk ends when the cells visited are expected to hold ``RECALL`` of the k best entries, and no
share of the entries is fixed. The scores of a cell's entries lie around its summed score with a
spread that follows from the residuals: their covariance over the fitted sample, times the mean
square of the cell's own. The score that k entries are expected to reach, and how many of them lie
in each cell, follow from the normal tail. Where vectors form groups a walk is short; near random
ones need many cells (the README has recall and ranked shares).

Centroids are fitted on a bounded sample; all vectors are indexed. Entries lie in blocks of about
``BLOCK`` rows in order of cells, a cell with more rows spreading over several. A task reads a block
once and then streams the queries that visit it, so it holds a block and a batch of queries; a block
with more than ``VISITS`` queries is read by several tasks.

Defined cases: vectors that are NULL, zero, of another length than most, or that hold NULL or
non-finite components, neither ask nor answer. Equal vectors are kept in the index with their 21
smallest ids, and at most 20 rows of each of these, which no list of 20 can exceed. Rows with the
query's id are no answers to it; other rows that repeat an id are an answer each; repeated query
rows ask once. NULL ids are no queries and no answers. Equal scores rank by
smaller id. Fewer candidates than asked for give them all. Columns but vec_id and embedding are
never read.
"""

from __future__ import annotations

import heapq
import math
from typing import Iterator, Optional

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe.llm import common, vectors

NEAREST = 20
# Part of the k best that the visited cells are expected to hold, and the fewest entries ranked.
RECALL, LEAST = 0.95, 1000
# Entries per cell that the number of centroids aims at, and the most centroids of a half.
PER_CELL, CENTROIDS = 12, 512
BLOCK, VISITS = 8192, 65_536
# Upper tail of the normal distribution at steps of 1/1024 from -8 to 8.
_TAIL = np.array([0.5 * math.erfc(z / 1024 / math.sqrt(2)) for z in range(-8192, 8193)])


def expected_hits(middle: np.ndarray, spread: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """How many of the ``k`` best entries each cell is expected to hold.

    Scores of a cell's ``counts`` entries are taken as normal around ``middle`` with deviation ``spread``.
    """
    if counts.sum() <= k:
        return counts.astype(np.float64)
    spread = np.maximum(spread, 1e-12)
    low, high = float((middle - 8 * spread).min()), float((middle + 8 * spread).max())
    step, zero = 1024 / spread, 8192 - 1024 * middle / spread
    for _ in range(40):
        score = 0.5 * (low + high)
        hits = counts * _TAIL[np.clip(score * step + zero, 0, 16384).astype(np.int64)]
        total = hits.sum()
        if k <= total <= 1.01 * k:
            break
        low, high = (score, high) if total > k else (low, score)
    return hits


def walk(
    first: np.ndarray,
    second: np.ndarray,
    counts: np.ndarray,
    enough: float,
    hits: Optional[np.ndarray] = None,
    wanted: float = 0.0,
) -> np.ndarray:
    """Cells (first index x second index, as a boolean matrix) in order of summed scores.

    The walk ends with ``enough`` of ``counts`` and, where ``hits`` are given, ``wanted`` of these. Each
    pop offers its two followers; a pair enters the heap once both pairs before it have left.
    """
    rows, cols = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[rows].tolist(), second[cols].tolist()
    order = np.ix_(rows, cols)
    n = counts[order].tolist()
    h = np.zeros_like(n).tolist() if hits is None else hits[order].tolist()
    taken = [0] * len(a)  # how many of each row's pairs have left
    heap = [(-(a[0] + b[0]), 0, 0)]
    found = hit = 0.0
    while heap and (found < enough or hit < wanted):
        _, i, j = heapq.heappop(heap)
        taken[i] = j + 1
        found += n[i][j]
        hit += h[i][j]
        if j + 1 < len(b) and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and taken[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
    # a row's pairs leave from its first on
    seen = np.zeros(counts.shape, dtype=bool)
    seen[order] = np.arange(len(b)) < np.array(taken)[:, None]
    return seen


class Halves:
    """Centroids of both halves and the covariance of what they leave of the sample."""

    def __init__(self, points: np.ndarray, centroids: int):
        self.half = points.shape[1] // 2
        self.books, self.left = [], []
        for side in self.sides(points):
            book = vectors.kmeans(side, centroids, False)
            rest = side - book[self.nearest(side, book)]
            self.books.append(book)
            self.left.append(rest.T @ rest / max(len(rest), 1))

    def sides(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    @staticmethod
    def nearest(side: np.ndarray, book: np.ndarray) -> np.ndarray:
        return (side @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of every row, and the squared length of what the centroids leave, for each half."""
        at = [self.nearest(side, book) for side, book in zip(self.sides(x), self.books)]
        rests = [((s - b[i]) ** 2).sum(axis=1) for s, b, i in zip(self.sides(x), self.books, at)]
        return at[0] * len(self.books[1]) + at[1], rests

    def visits(self, x: np.ndarray, sizes: np.ndarray, rests: np.ndarray, k: int, recall: float) -> Iterator[np.ndarray]:
        """For every query in ``x`` the cells to rank. ``rests``: mean square left per half and cell."""
        shape = len(self.books[0]), len(self.books[1])
        filled = np.flatnonzero(sizes > 0)
        scores = [side @ book.T for side, book in zip(self.sides(x), self.books)]
        # variance along the query for each unit of mean square left
        along = [
            np.einsum("qi,ij,qj->q", side, c, side) / (np.trace(c) or 1.0)
            for side, c in zip(self.sides(x), self.left)
        ]
        for i in range(len(x)):
            middle = np.add.outer(scores[0][i], scores[1][i]).reshape(-1)[filled]
            spread = np.sqrt(np.maximum(along[0][i] * rests[0][filled] + along[1][i] * rests[1][filled], 0))
            hits = np.zeros(len(sizes))
            hits[filled] = expected_hits(middle, spread, sizes[filled], k)
            seen = walk(
                scores[0][i], scores[1][i], sizes.reshape(shape), LEAST, hits.reshape(shape), recall * hits.sum()
            )
            yield seen.reshape(-1)


def nearest(
    entries: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    recall: float = RECALL,
    visits: int = VISITS,
    block_rows: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: for both inputs (vec_id, embedding), the k nearest found."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = entries.sparkSession
    entries, _, dimension = vectors.usable(entries.select("vec_id", "embedding").filter("vec_id IS NOT NULL"))
    if dimension is None:
        return spark.createDataFrame([], schema)
    queries, _, _ = vectors.usable(queries.select("vec_id", "embedding").filter("vec_id IS NOT NULL"))
    # numbers of tasks are fixed: small in bytes, rows that need long walks would share few tasks
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = queries.filter(F.size("embedding") == dimension).repartition(width, "vec_id", "embedding").distinct()
    # no list of k can hold more than the k + 1 smallest ids of one vector (one may be the query's own)
    # and k rows of each; rows that agree in both are alike
    copies = W.partitionBy("embedding").orderBy("vec_id")
    centroids = min(max(math.isqrt(entries.count() // PER_CELL), 1), CENTROIDS)
    entries = entries.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("_rows"))
    entries = entries.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.least("_rows", F.lit(k).cast("long"))))
    entries = entries.select("vec_id", "embedding", again.alias("_row")).drop("_row")

    halves = Halves(vectors.sample(entries, dimension), centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, rests = halves.cells(vectors.matrix(pdf["embedding"], dimension))
                yield pdf.assign(cell=cell, rest0=rests[0], rest1=rests[1])

    indexed = entries.mapInPandas(assign, "vec_id long, embedding array<float>, cell long, rest0 double, rest1 double")
    indexed = common.staged(indexed, "multi-index")
    # at most CENTROIDS x CENTROIDS rows
    n_cells = len(halves.books[0]) * len(halves.books[1])
    sizes, rests = np.zeros(n_cells, dtype=np.int64), np.zeros((2, n_cells))
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("rest0"), F.avg("rest1")).collect():
        sizes[r[0]], rests[0, r[0]], rests[1, r[0]] = r[1:]
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    n_blocks = max(1, -(-int(sizes.sum()) // block_rows))
    filled = np.flatnonzero(sizes)
    places = spark.createDataFrame(
        pd.DataFrame({"cell": filled, "_size": sizes[filled], "_start": starts[filled]}),
        "cell long, _size long, _start long",
    )
    place = F.col("_start") + F.pmod(F.xxhash64("vec_id", "embedding"), F.col("_size"))
    indexed = indexed.join(F.broadcast(places), "cell").withColumn("block", F.floor(place / block_rows).cast("long"))

    def bounds(block: int) -> tuple[int, int]:
        """First cell of a block, and the one after its last."""
        low = int(np.searchsorted(ends, block * block_rows, "right"))
        return low, int(np.searchsorted(starts, (block + 1) * block_rows, "left"))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["vec_id", "embedding", "block", "cells"]
        for pdf in batches:
            out = []
            x = vectors.matrix(pdf["embedding"], dimension)
            for at, seen in enumerate(halves.visits(x, sizes, rests, k, recall)):
                seen = seen & (sizes > 0)
                found = np.flatnonzero(seen)
                hit = np.zeros(n_blocks + 1, dtype=np.int64)
                np.add.at(hit, starts[found] // block_rows, 1)
                np.add.at(hit, (ends[found] - 1) // block_rows + 1, -1)
                for block in np.flatnonzero(np.cumsum(hit)[:n_blocks]).tolist():
                    low, high = bounds(block)
                    bits = np.packbits(seen[low:high]).tobytes()
                    out.append((pdf["vec_id"].iat[at], pdf["embedding"].iat[at], block, bits))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    asked = queries.mapInPandas(plan, "vec_id long, embedding array<float>, block long, cells binary")
    asked = common.staged(asked, "multi-index-visits")
    parts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / visits).cast("long").alias("_parts"))
    asked = asked.join(parts, "block").select(
        "block",
        F.pmod(F.xxhash64("vec_id"), "_parts").alias("part"),
        F.lit(1).alias("kind"),
        "vec_id",
        "embedding",
        # no NULL, which would turn a batch's whole numbers into rounded floating ones
        F.lit(-1).cast("long").alias("cell"),
        F.xxhash64("embedding").alias("asked"),
        "cells",
    )
    given = indexed.join(parts, "block").select(
        "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"),
        F.lit(0).alias("kind"),
        "vec_id",
        "embedding",
        "cell",
        F.lit(0).cast("long").alias("asked"),
        F.lit(None).cast("binary").alias("cells"),
    )

    def ranked(held: list[pd.DataFrame], asking: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = vectors.matrix(pd.concat([h["embedding"] for h in held]), dimension)
        ids = np.concatenate([h["vec_id"].to_numpy() for h in held])
        low, high = bounds(int(asking["block"].iat[0]))
        cells = np.concatenate([h["cell"].to_numpy() for h in held]).astype(np.int64) - low
        for lo in range(0, len(asking), 256):
            some = asking.iloc[lo : lo + 256]
            q = vectors.matrix(some["embedding"], dimension)
            own = some["vec_id"].to_numpy()
            bits = np.frombuffer(b"".join(map(bytes, some["cells"])), dtype=np.uint8).reshape(len(q), -1)
            bits = np.unpackbits(bits, axis=1)[:, : high - low]
            score = q @ x.T
            score[(bits[:, cells] == 0) | (own[:, None] == ids[None, :])] = -np.inf
            n = min(k, score.shape[1])
            kth = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
            slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(kth), kth, 0)))
            at, to = np.nonzero((score >= (kth - slack)[:, None]) & np.isfinite(score))
            # row sums give equal vectors equal scores, wherever they lie
            exact = (q[at] * x[to]).sum(axis=1)
            order = np.lexsort((ids[to], -exact, at))
            at, to, exact = at[order], to[order], exact[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            yield pd.DataFrame(
                {
                    "query_id": own[at[keep]],
                    "asked": some["asked"].to_numpy()[at[keep]],
                    "vec_id": ids[to[keep]],
                    "score": exact[keep],
                }
            )

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            keys = pdf[["block", "part", "kind"]].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(pdf)]):
                if lo == hi:
                    continue
                block, part, kind = keys[lo]
                if (block, part) != now:
                    now, held = (block, part), []
                if kind == 0:
                    held.append(pdf.iloc[lo:hi])
                elif held:
                    yield from ranked(held, pdf.iloc[lo:hi])

    tasks = max(width, n_blocks)
    best = given.unionByName(asked).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind")
    best = best.mapInPandas(rank, "query_id long, asked long, vec_id long, score double")
    order = W.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))


QUERIES = {"op2_multi_index": op2_multi_index}
