"""Shared pieces: reading tables, held-out folds, staging, vectorised word hashes, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe import lineage

# Words are the runs of bytes outside these; it is [^\x20\x09-\x0D]+ on the text.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return lineage.as_table(df, f"llm-{name}")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each prolonged until no column of ``df`` has its name in any letter case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: str, size: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < size:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[which] = np.multiply.accumulate(steps)
    return have


def word_hashes(texts: list, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts``, and the offsets of each text in them.

    Missing texts have no words. A prefix sum of byte times power gives every word's polynomial
    hash at once, so there is no step per word. A-Z count as a-z when ``lower``.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        data = table[data]
    inside = np.ones(256, dtype=bool)
    inside[list(SEPARATORS)] = False
    word = inside[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data))[: len(data)], out=sums[1:])
    hashes = (sums[stop] - sums[start]) * _power("down", len(data))[start]
    hashes = mix(hashes + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    offsets = np.concatenate(([0], np.searchsorted(start, ends))).astype(np.int64)
    return hashes, offsets


def slices(texts: list, limit: int = 4_000_000):
    """(from, to) ranges of ``texts`` of about ``limit`` characters, so that arrays stay bounded."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t is not None else 0
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable by ``edges``, for nodes that have an edge.

    Alternating large-star and small-star rounds over tables in the shared folder. Every round
    replaces edges by edges to smaller nodes, never by all pairs of a group, until all are stars. A
    round's table is removed once the next one is written.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = pairs.filter("u <> v").distinct()
    mark = before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")
        )
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("x"), F.col("m").alias("y")),
                    F.struct(F.col("v").alias("x"), F.col("m").alias("y")),
                )
            ).alias("e")
        )
        small = small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v"))
        small = small.filter("u <> v").distinct()
        path = lineage.scratch_path(spark, "llm-stars")
        pairs = lineage.as_table(small, "llm-stars", path=path)
        if before:
            lineage.remove(spark, before)
        before = path
        seen = pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
