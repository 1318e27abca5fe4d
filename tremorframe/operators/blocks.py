"""Observations in blocks, for event states that are too large to broadcast.

A block holds the observations of some first events. Blocks are the buckets of a table: they are written
once, with the list of blocks that hold each event at either end. In every step each event is sent to
just those blocks, so the observations themselves never move again, and what is sent is at most one row
for each event and block that meet. The number of blocks grows with the events and observations alone.

First events are dealt by hash. Where a block would meet too many second events for a task's hash table,
these are dealt by hash as well, and blocks that still have very many rows, such as that of a hot pair,
are split by row hash. Sums per event are combined within the blocks before they leave them.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe import lineage

# Events of either end whose state one task holds as a hash table (about 100 MB), and rows of a block.
BLOCK_EVENTS, BLOCK_ROWS = 1_000_000, 1_000_000


@dataclass(frozen=True)
class ObservationBlocks:
    """A bucketed table of observations and its layout."""

    table: DataFrame
    # evid, blocks1, blocks2: the blocks that hold an event as first and as second one
    routes: DataFrame
    n_blocks: int
    side: int
    name: str
    path: str

    @property
    def columns(self) -> list[str]:
        return [c for c in self.table.columns if c != "block"]

    @property
    def sparkSession(self) -> SparkSession:
        return self.table.sparkSession

    def attach(self, state: DataFrame) -> DataFrame:
        """Both ends of every observation, as ``forward.attach_sources`` gives them.

        The observations stay in their buckets if the plan is made inside :func:`in_place`.
        """
        out, sent = self.table, state.join(self.routes, "evid")
        for end in "12":
            part = sent.selectExpr(
                f"evid AS evid{end}",
                *[f"{a}0 + d{a} AS {a}{end}" for a in "xyz"],
                f"dt AS s{end}",
                f"explode(blocks{end}) AS block",
            )
            out = out.join(part.hint("shuffle_hash"), ["block", f"evid{end}"])
        return out.drop("block")

    def free(self) -> None:
        self.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        for folder in (self.path, *(f"{self.path}-{part}" for part in ("cells", "layout", "routes"))):
            lineage.remove(self.sparkSession, folder)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Plans made inside take a partitioning by block as good enough for joins by block and event."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _labels(spark: SparkSession, n: int) -> DataFrame:
    """bucket, block: for each of ``n`` buckets the smallest number that is stored in it."""
    tries = math.ceil(n * (math.log(n) + 12))
    while True:
        found = spark.range(tries).select(F.pmod(F.hash("id"), F.lit(n)).alias("bucket"), F.col("id").alias("block"))
        found = found.groupBy("bucket").agg(F.min("block").alias("block"))
        if found.count() == n:
            return found
        tries *= 2


def in_blocks(
    obs: DataFrame,
    n_events: int,
    path: str,
    row_key: str = "arid",
    block_events: int = BLOCK_EVENTS,
    block_rows: int = BLOCK_ROWS,
) -> ObservationBlocks:
    """Write ``obs`` by block to ``path``; ``row_key`` spreads the rows of a block that is split."""
    spark = obs.sparkSession
    side = max(1, math.ceil(n_events / block_events))
    # a quarter more than needed, as hashes deal unevenly
    parts = max(1, math.ceil(1.25 * obs.count() / (side * block_rows)))
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), n)
    at = {"row": dealt(F.lit(side), "evid1"), "part": dealt(F.lit(parts), "evid1", F.lit("part"))}
    # one row per block in all of these: (events / ``block_events``) and (rows / ``block_rows``) of them
    met = obs.select("evid2", *[v.alias(k) for k, v in at.items()]).groupBy("row", "part")
    met = met.agg(F.ceil(F.approx_count_distinct("evid2") / block_events).cast("int").alias("cols"))
    met = lineage.as_table(met, "cells", path=f"{path}-cells")
    placed = obs.withColumns(at).join(F.broadcast(met), ["row", "part"])
    placed = placed.withColumn("col", dealt(F.col("cols"), "evid2", F.lit("col"))).drop("cols")
    sizes = placed.groupBy("row", "part", "col").agg(F.count(F.lit(1)).alias("n"))
    slices = F.sequence(F.lit(0), F.ceil(F.col("n") / block_rows).cast("int") - 1)
    cells = sizes.select("row", "part", "col", F.explode(slices).alias("slice"))
    number = F.row_number().over(W.orderBy("row", "part", "col", "slice")) - 1
    cells = lineage.as_table(cells.withColumn("bucket", number.cast("int")), "layout", path=f"{path}-layout")
    n_blocks = max(cells.count(), 1)
    lists = cells.join(F.broadcast(_labels(spark, n_blocks)), "bucket")
    lists = lists.groupBy("row", "part", "col").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    rows = placed.join(F.broadcast(lists), ["row", "part", "col"])
    pick = F.pmod(F.xxhash64(row_key, F.lit("slice")), F.size("blocks")).cast("int") + 1
    rows = rows.withColumn("block", F.element_at("blocks", pick)).select(*obs.columns, "block")
    name = f"observation_blocks_{uuid.uuid4().hex}"
    rows.repartition(n_blocks, "block").write.bucketBy(n_blocks, "block").format("parquet").option("path", path).saveAsTable(name)
    table = spark.table(name)
    return ObservationBlocks(table, _routes(table, f"{path}-routes"), n_blocks, side, name, path)


def _routes(table: DataFrame, path: str) -> DataFrame:
    # found within the buckets: no more rows than events met by blocks leave them
    ends = table.selectExpr("block", "inline(array(struct(evid1 AS evid, 1 AS end), struct(evid2 AS evid, 2 AS end)))")
    blocks = [F.collect_list(F.when(F.col("end") == end, F.col("block"))).alias(f"blocks{end}") for end in (1, 2)]
    return lineage.as_table(ends.distinct().groupBy("evid").agg(*blocks), "routes", path=path)
