"""Mixing sources to target weights by cube-method balanced sampling (operator 5).

Every source has a target number of words. Each of its documents is taken target / source size
times: the whole part surely, the rest as an inclusion probability. The cube method turns the
probabilities into 0 and 1: while more than two documents of a block are open, three of them move
along the null space of their constraints (number of documents, number of words) until one is
decided. Blocks are decided apart from each other, by hash; what stays open of them meets in larger
blocks. A small reserve of each source and the last open documents form its landing problem: it is
decided by draws from the largest document down, each rounding error being spread over those left.

Defined cases: NULL text has size 0; documents of size 0 are taken 0 times. The NULL source is a
source of its own, last in order. Empty tables give no rows. Randomness is a hash of the row's id
and size, ties in order are broken by id, so reruns agree whatever the partitioning; repeated ids
are told apart by their number within the id. Other columns are never read.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
# Documents per block, and the open documents of a source that one task may land.
BLOCK, LANDING = 512, 8192
# Documents of a source that do not fly, so that the landing can even out large documents.
RESERVE = 48
_OPEN = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, size): one row per source.

    Targets follow the weights until a source reaches its limit; the water level that shares the
    excess is found from running sums over the sources in order of limit per weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row per source
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    table = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    )
    table = table.withColumn("cap", F.col("source_size").cast("double") * MOST_REPEATS)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    table = table.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "heavy": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # the level if all sources before this one are full; the first that need not be full sets it
    fits = F.col("left") / F.col("heavy") <= F.col("cap") / F.col("weight")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), (F.col("left") / F.col("heavy")).alias("at"))))
    table = table.withColumn("level", level.over(everything)["at"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return table.select("source", "source_size", target.alias("target"))


def flight(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move ``chances`` towards 0 or 1, keeping their sum and their sum weighted by ``sizes``.

    At most two entries stay open. ``draws`` gives a uniform number per entry; entry k is used for
    the move that k's arrival makes possible.
    """
    p = chances.astype(np.float64).tolist()
    s = sizes.astype(np.float64).tolist()
    u = draws.tolist()
    active: list[int] = []
    for k in range(len(p)):
        if _OPEN < p[k] < 1 - _OPEN:
            active.append(k)
        else:
            p[k] = float(round(p[k]))
        turn = 0
        while len(active) == 3:
            i, j, m = active
            d = (s[j] - s[m], s[m] - s[i], s[i] - s[j])
            if d == (0.0, 0.0, 0.0):
                d = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for x, step in zip(active, d):
                if step > 0:
                    up, down = min(up, (1 - p[x]) / step), min(down, p[x] / step)
                elif step < 0:
                    up, down = min(up, p[x] / -step), min(down, (1 - p[x]) / -step)
            draw = (u[k] + 0.6180339887498949 * turn) % 1.0
            move = up if draw * (up + down) < down else -down
            turn += 1
            for x, step in zip(active, d):
                p[x] = min(max(p[x] + move * step, 0.0), 1.0)
                if p[x] <= _OPEN or p[x] >= 1 - _OPEN:
                    p[x] = round(p[x])
            active = [x for x in active if 0.0 < p[x] < 1.0]
    return np.array(p)


def landing(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Decide all entries, largest first; the words won or lost are spread over the smaller ones."""
    p = chances.astype(np.float64).copy()
    order = [i for i in np.argsort(-sizes, kind="stable") if 0.0 < p[i] < 1.0]
    for at, i in enumerate(order):
        decided = float(draws[i] < p[i])
        owed = sizes[i] * (p[i] - decided)
        p[i] = decided
        rest = np.array(order[at + 1 :], dtype=np.int64)
        while len(rest) and abs(owed) > 1e-9:
            room = (1 - p[rest]) if owed > 0 else p[rest]
            rest, room = rest[room > 0], room[room > 0]
            if not len(rest):
                break
            share = np.minimum(abs(owed) / sizes[rest].sum(), room)
            p[rest] += np.sign(owed) * share
            owed -= np.sign(owed) * float((share * sizes[rest]).sum())
            if (share < room).all():
                break
    return np.clip(np.rint(p), 0.0, 1.0)


def _uniform(seed: pd.Series) -> np.ndarray:
    mixed = common.mix(seed.to_numpy(dtype=np.int64).view(np.uint64))
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)


_STATE = "doc_id long, copy long, source_key long, size long, seed long, chance double"


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "seed", "doc_id", "copy"], ascending=False, na_position="last")
    moved = flight(pdf["size"].to_numpy(), pdf["chance"].to_numpy(), _uniform(pdf["seed"]))
    return pdf.assign(chance=moved)[["doc_id", "copy", "source_key", "size", "seed", "chance"]]


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["seed", "doc_id", "copy"], na_position="last")
    pdf = pd.concat([_fly(pdf.iloc[RESERVE:]), pdf.iloc[:RESERVE][list(pdf.columns)]])
    pdf = pdf.sort_values(["size", "seed", "doc_id", "copy"], ascending=False, na_position="last")
    sizes, draws = pdf["size"].to_numpy(dtype=np.float64), _uniform(pdf["seed"] + 1)
    pdf = pdf.assign(chance=landing(sizes, pdf["chance"].to_numpy(), draws))
    return pdf[["doc_id", "copy", "source_key", "size", "seed", "chance"]]


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """doc_id, copy, source, size, source_size, target, taken of ``docs`` (doc_id, text, source).

    ``copy`` numbers the rows of a repeated doc_id, so (doc_id, copy) names a row.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"))
    sized = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    # equal rows become numbered ones again; rows of one id with other sources or sizes follow them
    before = W.partitionBy("doc_id").orderBy("source", "size").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("rows").over(before), F.lit(0))
    rows = sized.withColumn("first", first).select(
        "doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("k"), "first"
    )
    rows = rows.select("doc_id", (F.col("first") + F.col("k")).cast("long").alias("copy"), "source", "size")
    rows = common.staged(rows, "sizes")
    targets = source_targets(rows.select("source", "size"), weights)
    counts = rows.filter("size > 0").groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    targets = targets.join(counts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    targets = targets.withColumn("source_key", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    targets = common.staged(targets, "targets")

    share = F.col("target") / F.col("source_size")
    key = F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    keyed = rows.withColumn("source_key", key)
    full = keyed.join(targets.drop("source"), "source_key")
    open_rows = full.filter("size > 0").select(
        "doc_id",
        "copy",
        "source_key",
        "size",
        F.xxhash64("doc_id", "copy", "size").alias("seed"),
        (share - F.floor(share)).alias("chance"),
        "n",
    )
    # block 0 is the reserve that joins the landing; the others are decided now
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
    placed = open_rows.withColumn("block", F.pmod(F.xxhash64("seed", F.lit(1)), blocks))
    placed = common.staged(placed.drop("n"), "blocks")
    state = placed.filter("block > 0").groupBy("source_key", "block").applyInPandas(_fly, _STATE)
    reserve = placed.filter("block = 0").drop("block")
    decided, level = [], 1
    while True:
        state = common.staged(state, "flight")
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided.append(state.filter(~is_open))
        state = state.filter(is_open)
        left = state.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
        if not left.filter(F.col("n") > LANDING).head(1):
            break
        # a source with too many open documents flies again in blocks of those
        level += 1
        again = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
        state = state.join(left, "source_key").withColumn(
            "block", F.pmod(F.xxhash64("seed", F.lit(level)), again)
        )
        state = state.drop("n").groupBy("source_key", "block").applyInPandas(_fly, _STATE)
    columns = ["doc_id", "copy", "source_key", "size", "seed", "chance"]
    last = state.select(columns).unionByName(reserve.select(columns))
    decided.append(last.groupBy("source_key").applyInPandas(_land, _STATE))
    taken = decided[0].select(columns)
    for part in decided[1:]:
        taken = taken.unionByName(part.select(columns))
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("copy").alias("_c"), F.rint("chance").cast("long").alias("_x"))
    out = full.join(taken, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("copy") == F.col("_c")), "left")
    count = F.floor(share) + F.coalesce(F.col("_x"), F.lit(0))
    count = F.when(F.col("size") > 0, count).otherwise(F.lit(0))
    return out.select(
        "doc_id",
        "copy",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (count * F.col("size")).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it; its columns stay as they are."""
    at, number, times, each, row = common.free_names(docs, "_mix_id", "_mix_copy", "_mix_times", "_mix_each", "_mix_row")
    mixed = mix_sources(docs, weights).filter("taken > 0")
    mixed = common.staged(
        mixed.select(
            F.col("doc_id").alias(at),
            F.col("copy").alias(number),
            (F.col("taken") / F.col("size")).cast("int").alias(times),
        ),
        "mixed",
    )
    same = F.col("doc_id").eqNullSafe(F.col(at))
    rows = docs
    if mixed.filter(F.col(number) > 0).head(1):
        # rows that share an id are told apart in the order in which mix_sources numbers them
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        place = F.row_number().over(W.partitionBy("doc_id").orderBy("source", size))
        rows = docs.withColumn(row, (place - 1).cast("long"))
        same &= F.col(row) == F.col(number)
    rows = rows.join(mixed, same)
    rows = rows.withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(times))))
    return rows.select(*[F.col(f"`{name}`") for name in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
