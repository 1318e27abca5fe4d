"""Sharding by fixed virtual slots and a versioned slot-to-shard map (operator 11).

A hash deals records into a fixed number of virtual slots. Bytes are summed per slot, and a map says
which shard holds which slot. Only the map knows the number of shards: it is a small table, stored
version by version, and rebalancing writes a new version in which few slots change hands:

* ``first_map`` deals slots from the heaviest down, each to the lightest shard;
* ``grow`` adds a shard and moves slots only into it;
* ``rebalance`` moves slots from heavy to light shards as long as that brings them closer together.

The law of op11 is ``bytes``: shards of nearly equal size. Records of one id, and equal records, are
hashed with their number among their equals, so a hot id spreads over all slots; they are numbered from
counts, in pieces, never by a window over all of them. A record's place in its shard is its number
within a small bucket of its slot plus the sizes of the buckets before it.

Defined cases: NULL text has no bytes, so its size is 1 and its checksum that of no bytes, 0. A NULL
doc_id is an id of its own. Empty tables give no rows. Slots without records are mapped too, so
records that come later have a shard. Reruns agree: ties break by hash, id, size and number. Columns
other than doc_id and text are never read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe.llm import common

N_SLOTS, N_SHARDS = 4096, 8
# Equal records that one task numbers at once, and records that are ordered in one bucket of a slot.
PIECE, BUCKET = 10_000, 50_000

KEY = ["doc_id", "size", "text_crc32"]


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: the shard of every slot; as many entries as there are slots."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def loads(self, weights: Sequence[int]) -> list[int]:
        out = [0] * self.n_shards
        for shard, weight in zip(self.shards, weights):
            out[shard] += weight
        return out


def first_map(weights: Sequence[int], n_shards: int) -> SlotMap:
    """Slots from the heaviest down, each to the shard that is lightest by then."""
    if n_shards < 1:
        raise ValueError(f"n_shards must be >= 1, got {n_shards}")
    heap = [(0, shard) for shard in range(n_shards)]
    shards = [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
        held, shard = heapq.heappop(heap)
        shards[slot] = shard
        # slots without records weigh as little as possible, so they spread too
        heapq.heappush(heap, (held + max(weights[slot], 1), shard))
    return SlotMap(1, n_shards, tuple(shards))


def grow(old: SlotMap, weights: Sequence[int]) -> SlotMap:
    """One shard more; it takes slots from the shards that are heaviest, nothing else moves."""
    shards, new = list(old.shards), old.n_shards
    loads = old.loads(weights) + [0]
    share = sum(weights) / (new + 1)
    held: list[list[int]] = [[] for _ in range(new)]
    for slot in sorted(range(len(weights)), key=lambda s: (weights[s], s)):
        held[shards[slot]].append(slot)  # the heaviest last
    heap = [(-loads[shard], shard) for shard in range(new)]
    heapq.heapify(heap)
    while heap:
        _, shard = heapq.heappop(heap)
        # the heaviest slot that still fits; the shard keeps its share
        while held[shard]:
            slot = held[shard].pop()
            weight = weights[slot]
            if weight and loads[new] + weight <= share + weight / 2 and loads[shard] - weight >= share - weight / 2:
                shards[slot] = new
                loads[shard] -= weight
                loads[new] += weight
                heapq.heappush(heap, (-loads[shard], shard))
                break
    return SlotMap(old.version + 1, new + 1, tuple(shards))


def rebalance(old: SlotMap, weights: Sequence[int], tolerance: float = 0.01) -> SlotMap:
    """Slots move from the heaviest to the lightest shard until all are within ``tolerance`` of the mean.

    Every move lessens the sum of squared sizes, so the rounds end; they also end where no slot fits.
    """
    shards, loads = list(old.shards), old.loads(weights)
    mean = sum(loads) / old.n_shards
    held: list[list[int]] = [[] for _ in range(old.n_shards)]
    for slot, shard in enumerate(shards):
        held[shard].append(slot)
    while True:
        heavy = max(range(old.n_shards), key=lambda s: (loads[s], -s))
        light = min(range(old.n_shards), key=lambda s: (loads[s], s))
        gap = loads[heavy] - loads[light]
        if max(loads[heavy] - mean, mean - loads[light]) <= tolerance * mean:
            break
        fitting = [s for s in held[heavy] if 0 < weights[s] < gap]
        if not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(gap - 2 * weights[s]), s))
        held[heavy].remove(slot)
        held[light].append(slot)
        shards[slot] = light
        loads[heavy] -= weights[slot]
        loads[light] += weights[slot]
    return SlotMap(old.version + 1, old.n_shards, tuple(shards))


_MAP = "virtual_slot int, shard int, n_shards int"


def map_table(spark: SparkSession, slot_map: SlotMap) -> DataFrame:
    """virtual_slot, shard, n_shards: one row per slot, whatever the number of records."""
    rows = [(slot, shard, slot_map.n_shards) for slot, shard in enumerate(slot_map.shards)]
    return spark.createDataFrame(rows, _MAP)


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Write a version beside the others; a version that exists is never replaced."""
    map_table(spark, slot_map).coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: Optional[int] = None) -> SlotMap:
    """The newest version, or a given one."""
    stored = spark.read.schema(f"{_MAP}, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == F.lit(version)).collect()  # one row per slot
    if not rows:
        raise ValueError(f"no version {version} of a slot map in {path}")
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in sorted(rows, key=lambda r: r["virtual_slot"])))


def record_slot(n_slots: int, *key: str) -> Column:
    """The virtual slot of a record; it depends on ``key`` and the number of slots alone."""
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy, virtual_slot of ``docs`` (doc_id, text), one row per row.

    ``copy`` numbers records that are equal in the first three.
    """
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    counted = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(PIECE).cast("long")))
    pieces = counted.select(*KEY, "rows", first.alias("first"))
    # pieces of a hot record leave the task that counted it
    pieces = pieces.repartition(*KEY, "first")
    last = F.least(F.col("first") + PIECE, F.col("rows")) - 1
    numbered = pieces.select(*KEY, F.explode(F.sequence(F.col("first"), last)).alias("copy"))
    return numbered.withColumn("virtual_slot", record_slot(n_slots, *KEY, "copy"))


def slot_weights(rows: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes of every slot; the driver gets one number per slot, however many records there are."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()
    weights = [0] * n_slots
    for row in sums:
        weights[row["virtual_slot"]] = row["bytes"]
    return weights


def placed(rows: DataFrame, slot_map: SlotMap, total: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the record's place in its shard counted from 0.

    ``total`` is the number of rows; it sets the buckets, so that none has to order many records.
    """
    spark = rows.sparkSession
    buckets = max(1, math.ceil(total / (len(slot_map.shards) * BUCKET)))
    seed = F.xxhash64(*KEY, "copy", F.lit(1))
    rows = rows.join(F.broadcast(map_table(spark, slot_map).drop("n_shards")), "virtual_slot")
    rows = rows.withColumns({"seed": seed, "bucket": F.pmod(seed, F.lit(buckets))})
    sizes = rows.groupBy("shard", "virtual_slot", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket of some ten thousand records
    before = W.partitionBy("shard").orderBy("virtual_slot", "bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("virtual_slot", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("virtual_slot", "bucket").orderBy("seed", *KEY, "copy"))
    rows = rows.withColumn("inside", inside).join(sizes, ["virtual_slot", "bucket"])
    return rows.drop("seed", "bucket").withColumn("slot", (F.col("before") + F.col("inside") - 1).cast("long")).drop("before", "inside")


def assign(
    docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: Optional[str] = None
) -> DataFrame:
    """doc_id, size, text_crc32, copy, virtual_slot, shard, slot of ``docs`` (doc_id, text).

    With ``map_path`` the map is stored there as its first version; without, it lasts for this call.
    """
    rows = common.staged(records(docs, n_slots), "records")
    slot_map = first_map(slot_weights(rows, n_slots), n_shards)
    if map_path:
        save_map(docs.sparkSession, slot_map, map_path)
    return placed(rows, slot_map, rows.count())


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str) -> None:
    """Write whole rows of ``docs`` below ``path``, one folder ``shard=K`` each, by a stored map.

    Rows are dealt by id and content; repeated rows take a slot at random, so that they spread. Texts
    meet no shuffle but the one that gathers a shard's slots.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("documents have a column named shard already")
    n_slots = len(slot_map.shards)
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # packed, so that no name of a helper meets a column of the documents
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64("doc_id", F.octet_length(content), F.crc32(content)).alias("hash"),
    )
    counts = whole.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copy = F.pmod(F.monotonically_increasing_id(), F.coalesce("copies", F.lit(1)))
    rows = whole.join(counts, "hash", "left").withColumn("copy", copy)
    rows = rows.withColumn("virtual_slot", record_slot(n_slots, "hash", "copy"))
    rows = rows.join(F.broadcast(map_table(docs.sparkSession, slot_map).drop("n_shards")), "virtual_slot")
    rows = rows.repartition("shard", "virtual_slot").select("row.*", "shard")
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    return assign(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


QUERIES = {"op11_sharding": op11_sharding}
