"""Building blocks that keep results exact when one key holds a large share of the rows."""

from __future__ import annotations

import math
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe import lineage

# Groups up to this many rows may be gathered by one task.
GATHER_ROWS = 1_000_000
# Tables up to this many rows of a few numbers (about 10 MB) may be broadcast. Each passes through the
# driver, three of them in a step of a relocation.
BROADCAST_ROWS = 200_000
# Rows per task where tasks hold groups as lists, hash tables or Python objects, many times the bytes shuffled.
TASK_ROWS = 100_000
_CELLS = 4096
# Quantile cells are narrowed until the rows of distinct values left in one are no more than this.
FINAL_ROWS = 65_536


def small_side(df: DataFrame, rows: Optional[int]) -> DataFrame:
    """Broadcast ``df`` when its known row count allows it; else leave the join to the planner."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def in_tasks(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Rows of a key in one task, some ``TASK_ROWS`` of the known ``rows`` in each.

    For groups that are small enough to be gathered. The planner does not merge these tasks, as it does
    with others by the bytes that they shuffle. There are no more than 200, above which a task that deals
    rows out sorts them in memory, or than the session's shuffle partitions if these are more.
    """
    most = max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(min(max(1, math.ceil(rows / TASK_ROWS)), most), *keys)


def keep_frequent(
    df: DataFrame, keys: dict[str, Column], min_rows: int, hot_rows: int = GATHER_ROWS
) -> DataFrame:
    """Rows whose key group has at least ``min_rows`` rows.

    Counts are pre-aggregated before their shuffle. Groups above ``hot_rows`` are known to qualify
    once counted, and there are at most (rows / ``hot_rows``) of them, so their keys are broadcast
    and their rows never shuffle. The other groups are each small enough for an ordinary semi join.
    """
    names = list(keys)
    keyed = df.withColumns(keys)
    counts = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    limit = max(hot_rows, min_rows)
    hot = F.broadcast(counts.filter(F.col("_n") > limit).select(*names))
    enough = counts.filter((F.col("_n") >= min_rows) & (F.col("_n") <= limit)).select(*names)
    from_hot = keyed.join(hot, names, "left_semi")
    from_rest = keyed.join(hot, names, "left_anti").join(enough, names, "left_semi")
    return from_hot.unionByName(from_rest).select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The ``row_number = 1`` filter lets the planner keep one row per key and map task before the
    shuffle, so a key with many copies does not travel.
    """
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def number_rows(df: DataFrame, name: str, order: Optional[Sequence[str]] = None) -> DataFrame:
    """Dense ordinals 0 .. n-1, by ``order`` when given, without gathering rows in one task.

    Rows are range-partitioned, fixed in shared storage, and numbered from per-partition counts.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = lineage.cut(df).withColumn("_m", F.monotonically_increasing_id())
    # the generated id holds the partition in its upper bits and the position in the lower 33
    marked = marked.select(
        *df.columns,
        F.shiftright("_m", 33).alias("_part"),
        F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    # one row per partition of the input
    out = marked.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, (F.col("_off") + F.col("_pos")).alias(name))


def running_total(
    df: DataFrame, by: Sequence[str], index: str, value: str, name: str, block: int = 4096
) -> DataFrame:
    """Running sum of ``value`` over the integer ``index``, in two levels.

    Totals per block of indices are accumulated first, then rows inside each block, so the long
    sequence is never held by a single task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(index) / block))
    sums = blocked.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(
        *by, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")
    )
    inside = W.partitionBy(*by, "_block").orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    out = blocked.join(bases, [*by, "_block"])
    return out.select(*df.columns, (F.col("_base") + F.sum(value).over(inside)).alias(name))


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(number of groups, rows of the largest group)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest")).first()
    return row["groups"], row["largest"] or 0


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    lower: bool = False,
    sizes: Optional[tuple[int, int]] = None,
    gather_rows: int = GATHER_ROWS,
) -> DataFrame:
    """Exact quantiles per group: linear interpolation, or the lower element when ``lower``.

    Groups of at most ``gather_rows`` rows use the built-in exact aggregate. Larger groups are
    narrowed by counting: each pass counts rows per value cell, keeps the cell that holds the
    wanted rank, and counts again inside it, so no task ever sees more than cell counts and the few
    distinct values left at the end. Cells divide the range evenly; when that does not help, because
    magnitudes differ widely, the next pass divides it by sign and logarithm. The values are written
    to shared storage once and removed when the quantiles are known; the small table of cells is
    written after each pass. NULL and NaN values are ignored.
    """
    by = list(by)
    data = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *by, F.col(value).cast("double").alias("_x")
    )
    n_groups, largest = sizes if sizes is not None else group_sizes(data, by)
    if largest <= gather_rows:
        if lower:
            aggs = [
                F.expr(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY _x)").alias(name)
                for name, p in probs.items()
            ]
        else:
            aggs = [F.percentile("_x", p).alias(name) for name, p in probs.items()]
        return data.groupBy(*by).agg(*aggs)
    return _narrowed_quantiles(data, by, probs, lower, n_groups)


def _narrowed_quantiles(
    data: DataFrame, by: list[str], probs: dict[str, float], lower: bool, n_groups: int
) -> DataFrame:
    if not by:
        # a constant key turns the ungrouped case into one group; its side is always broadcast
        data = data.withColumn("_all", F.lit(0))
        n_groups = 1
    keys = by or ["_all"]
    spark = data.sparkSession
    path = lineage.scratch_path(spark, "values")
    try:
        data = lineage.as_table(data, "values", path=path)
        return lineage.cut(_narrowed(data, by, keys, probs, lower, n_groups))
    finally:
        lineage.remove(spark, path)


def _magnitude(x: Column) -> Column:
    """Sign and logarithm of a double in one number: it never falls as ``x`` grows, infinities included."""
    # the smallest double has the logarithm -744.4, the largest 709.8; zero has none
    size = F.least(F.log(F.abs(x)) + 745.2, F.lit(1456.0))
    return F.signum(x) * F.coalesce(size, F.lit(0.0))


def _narrowed(
    data: DataFrame, by: list[str], keys: list[str], probs: dict[str, float], lower: bool, n_groups: int
) -> DataFrame:
    totals = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )
    wanted = []
    for i, p in enumerate(probs.values()):
        if lower:
            low = F.greatest(F.ceil(F.lit(float(p)) * F.col("_n")) - 1, F.lit(0))
            share = F.lit(0.0)
            ranks = [(low, share)]
        else:
            at = F.lit(float(p)) * (F.col("_n") - 1)
            low = F.floor(at)
            high = F.least(low + 1, F.col("_n") - 1)
            ranks = [(low, at - low), (high, at - low)]
        for side, (rank, share) in enumerate(ranks):
            wanted.append(
                F.struct(
                    F.lit(i).alias("q"),
                    F.lit(side).alias("side"),
                    rank.cast("long").alias("rank"),
                    share.alias("share"),
                )
            )
    targets = totals.select(*keys, "_lo", "_hi", F.explode(F.array(*wanted)).alias("_w")).select(
        *keys, "_lo", "_hi", "_w.*"
    )
    targets = lineage.cut(targets)

    width = len(wanted)
    largest, even = None, True
    while largest is None or largest > FINAL_ROWS:
        # targets that share a cell are counted once
        cells = targets.select(*keys, "_lo", "_hi").distinct()
        inside = data.join(small_side(cells, n_groups * width), keys).filter(
            F.col("_x").between(F.col("_lo"), F.col("_hi"))
        )
        at, lo, hi = (F.col(c) if even else _magnitude(F.col(c)) for c in ("_x", "_lo", "_hi"))
        slot = F.floor((at - lo) / F.nullif(hi - lo, F.lit(0.0)) * _CELLS)
        counted = (
            inside.withColumn("_cell", F.coalesce(F.least(slot, F.lit(_CELLS - 1)), F.lit(0)))
            .groupBy(*keys, "_lo", "_hi", "_cell")
            .agg(
                F.count(F.lit(1)).alias("_c"),
                F.min("_x").alias("_clo"),
                F.max("_x").alias("_chi"),
            )
        )
        narrowed = _pick(targets, counted, keys, "_cell", ["_clo", "_chi", "_c"])
        targets = lineage.cut(
            narrowed.select(
                *keys,
                F.col("_clo").alias("_lo"),
                F.col("_chi").alias("_hi"),
                "_c",
                "q",
                "side",
                "rank",
                "share",
            )
        )
        # a cell of one value is as narrow as can be
        now = targets.filter("_lo < _hi").agg(F.max("_c")).first()[0] or 0
        targets = targets.drop("_c")
        even = not even or (largest is not None and now * 16 <= largest)
        largest = now

    cells = targets.select(*keys, "_lo", "_hi").distinct()
    left = (
        data.join(small_side(cells, n_groups * width), keys)
        .filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*keys, "_lo", "_hi", "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    found = _pick(targets, left, keys, "_x", ["_x"])
    pick = lambda i, side: F.max(F.when((F.col("q") == i) & (F.col("side") == side), F.col("_x")))
    aggs = []
    for i, name in enumerate(probs):
        if lower:
            aggs.append(pick(i, 0).alias(name))
        else:
            share = F.max(F.when(F.col("q") == i, F.col("share")))
            aggs.append((pick(i, 0) + share * (pick(i, 1) - pick(i, 0))).alias(name))
    return found.groupBy(*keys).agg(*aggs).select(*by, *probs)


def _pick(
    targets: DataFrame, counted: DataFrame, keys: list[str], order: str, keep: list[str]
) -> DataFrame:
    """Join each target to the counted item that holds its rank; the rank becomes relative to it."""
    w = W.partitionBy(*keys, "_lo", "_hi").orderBy(order)
    upto = F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))
    spans = counted.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    spans = spans.select(*keys, "_lo", "_hi", "_from", "_upto", *keep)
    hit = (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_upto"))
    return (
        targets.join(spans, [*keys, "_lo", "_hi"])
        .filter(hit)
        .withColumn("rank", F.col("rank") - F.col("_from"))
    )
