"""Near-duplicate vectors by spherical k-means cells (operator 3).

Spherical k-means, fitted on a bounded sample, assigns every vector to the cell of its nearest
centroid. Vectors are compared inside cells, by blocked cosine products. Two vectors at cosine
``SIMILARITY`` or more are at most a chord of sqrt(2 - 2 SIMILARITY) apart; if they lie in different
cells, one of them is within half of that of the plane between the two centroids. Such vectors visit
the other cell too, so no pair is lost; a pair that meets in both cells counts in one of them.

Equal vectors are compared once and carry their number. The members of a cell, and the vectors that
visit it, are split into blocks; every pair of blocks is a task that returns numbers of links and one
edge per linked vector, never its pairs. A group is a component of those edges.

Defined cases: vectors that are NULL, zero, of another length than most, or that hold NULL or
non-finite components link with nothing. Rows that share an id are rows of their own. A component's
id is its smallest vec_id, NULL only if it has no other. An empty table gives no rows. Columns other
than vec_id and embedding are never read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import common, vectors

SIMILARITY = 0.9
# Cells grow with the square root of the number of vectors up to here, which some billion reach.
MOST_CELLS = 8192
# Vectors of the sample per cell, as far as the sample's bytes go.
SAMPLE_PER_CELL, SAMPLE_BYTES = 16, 256 << 20
ROWS_PER_BLOCK = 512
MEMBERS_PER_TASK, VISITORS_PER_TASK = 2048, 8192


def distances(centroids: np.ndarray) -> np.ndarray:
    """Distances of all centroids from each other by their inner products, never too small by rounding."""
    inner = centroids @ centroids.T
    length = np.diagonal(inner)
    return np.sqrt(np.maximum(length[:, None] + length - 2 * inner, 0) + 1e-13)


def visits(unit: np.ndarray, centroids: np.ndarray, apart: np.ndarray, similarity: float) -> tuple[np.ndarray, list]:
    """(home cell, other cells that each vector visits), in blocks of rows; ``apart`` are the distances."""
    homes, others = [np.zeros(0, dtype=np.int64)], []
    for lo in range(0, len(unit), ROWS_PER_BLOCK):
        score = unit[lo : lo + ROWS_PER_BLOCK] @ centroids.T
        home = score.argmax(axis=1)
        row = np.arange(len(score))
        # coinciding centroids have no plane between them
        near = score[row, home][:, None] - score <= apart[home] * (np.sqrt(2 - 2 * similarity) / 2 + 1e-7)
        near[row, home] = False
        homes.append(home)
        others += [np.flatnonzero(r) for r in near]
    return np.concatenate(homes), others


def linked(left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with at least ``similarity``: single precision sifts, double decides."""
    rough = left.astype(np.float32) @ right.astype(np.float32).T
    at, to = np.nonzero(rough >= similarity - 1e-4)
    keep = np.zeros(len(at), dtype=bool)
    for lo in range(0, len(at), 100_000):
        i, j = at[lo : lo + 100_000], to[lo : lo + 100_000]
        keep[lo : lo + 100_000] = (left[i] * right[j]).sum(axis=1) >= similarity
    return at[keep], to[keep]


def _lowest(at: np.ndarray, to: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Component label of every vector of a block pair, left ones first."""
    label = np.arange(n_left + n_right)
    to = to + n_left
    while True:
        before = label.copy()
        np.minimum.at(label, at, label[to])
        np.minimum.at(label, to, label[at])
        label = label[label]
        if (label == before).all():
            return label


def groups(rows: DataFrame, similarity: float = SIMILARITY, most_cells: int = MOST_CELLS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``rows`` (vec_id, embedding)."""
    rows = common.staged(rows.select("vec_id", "embedding").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    taking, others, dimension = vectors.usable(rows)
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if dimension is None:
        return alone.withColumn("kept", F.lit(True))
    nodes = taking.groupBy("embedding").agg(
        F.min("uid").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low")
    )
    nodes = common.staged(nodes, "vector-nodes")
    count = nodes.count()
    wanted = int(np.clip(round(np.sqrt(count) / 4), 1, most_cells))
    size = min(max(vectors.SAMPLE, SAMPLE_PER_CELL * wanted), max(wanted, SAMPLE_BYTES // (8 * dimension)))
    points = vectors.sample(nodes, dimension, size)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids = vectors.kmeans(points, wanted, True)
    apart = distances(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = vectors.matrix(pdf["embedding"], dimension)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                home, other = visits(unit, centroids, apart, similarity)
                yield pd.DataFrame(
                    {
                        "node": pdf["node"],
                        "copies": pdf["copies"],
                        "home": home,
                        "visits": other,
                        "unit": [u.astype("<f8").tobytes() for u in unit],
                    }
                )

    placed = nodes.select("node", "copies", "embedding").mapInPandas(
        assign, "node long, copies long, home long, visits array<long>, unit binary"
    )
    placed = common.staged(placed, "vector-cells")
    # one row per cell: its members and visitors are split by hash into parts of bounded size
    cells = placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("members"))
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("guests"))
    cells = cells.join(guests, "cell", "left").select(
        "cell",
        F.ceil(F.col("members") / MEMBERS_PER_TASK).alias("m"),
        F.ceil((F.col("members") + F.coalesce("guests", F.lit(0))) / VISITORS_PER_TASK).alias("v"),
    )
    cells = F.broadcast(common.staged(cells, "cells"))  # at most MOST_CELLS rows
    spread = F.xxhash64("node")
    members = placed.withColumn("cell", F.col("home")).join(cells, "cell")
    members = members.select(
        "cell",
        F.pmod(spread, "m").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("v") - 1)).alias("j"),
        "node", "copies", "visits", "unit",
    )
    comers = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "visits"))).join(cells, "cell")
    comers = comers.select(
        "cell",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"),
        F.pmod(spread, "v").alias("j"),
        F.col("node").alias("guest"),
        F.col("copies").alias("guest_copies"),
        F.col("home").alias("guest_home"),
        F.col("unit").alias("guest_unit"),
    )

    def compare(own: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(guests):
            return pd.DataFrame({"node": [], "links": [], "lowest": []})
        cell = int(own["cell"].iloc[0])
        left = np.frombuffer(b"".join(map(bytes, own["unit"])), dtype="<f8").reshape(len(own), dimension)
        right = np.frombuffer(b"".join(map(bytes, guests["guest_unit"])), dtype="<f8").reshape(len(guests), dimension)
        a, b = own["node"].to_numpy(), guests["guest"].to_numpy()
        home = guests["guest_home"].to_numpy()
        goes = np.zeros((len(own), len(centroids)), dtype=bool)
        for r, other in enumerate(own["visits"]):
            goes[r, np.asarray(other, dtype=np.int64)] = True
        n_links = np.zeros(len(own) + len(guests), dtype=np.int64)
        at, to = linked(left, right, similarity)
        inside = home[to] == cell
        # members meet each other once, by node; a pair that also meets in the guest's cell counts in the lower cell
        once = np.where(inside, a[at] < b[to], ~goes[at, home[to]] | (cell < home[to]))
        at, to = at[once], to[once]
        np.add.at(n_links, at, guests["guest_copies"].to_numpy()[to])
        np.add.at(n_links, to + len(own), own["copies"].to_numpy()[at])
        label_of = _lowest(at, to, len(own), len(guests))
        names = np.concatenate((a, b))
        some = n_links > 0
        return pd.DataFrame({"node": names[some], "links": n_links[some], "lowest": names[label_of[some]]})

    found = members.groupBy("cell", "i", "j").cogroup(comers.groupBy("cell", "i", "j"))
    found = common.staged(found.applyInPandas(compare, "node long, links long, lowest long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = common.components(found, "node", "lowest")
    named = nodes.join(links, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = taking.join(named, "embedding").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op3_vector_groups": op3_vector_groups}
