"""Chains of draws: order, burn-in, thinning, centring."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe.functions.portable_random import uniform
from tremorframe.operators.scaling import number_rows, small_side


@dataclass(frozen=True)
class ChainLayout:
    """Where each batch starts in the concatenated chain.

    All events of a batch have the same draws, so one offset per batch places every row and no row
    has to be sorted.
    """

    offsets: DataFrame
    n_batches: int
    n_draws: int


def chain_layout(samples: DataFrame) -> ChainLayout:
    """Read the layout from the draw counts of the batches."""
    widths = samples.groupBy("batch_id").agg((F.max("draw") + 1).alias("_width"))
    earlier = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1)
    # one row per stored batch
    offsets = widths.select(
        "batch_id", F.coalesce(F.sum("_width").over(earlier), F.lit(0)).alias("_start")
    )
    row = widths.agg(F.count(F.lit(1)).alias("n"), F.sum("_width").alias("d")).first()
    return ChainLayout(offsets, row["n"], row["d"] or 0)


def with_draw_ordinal(
    samples: DataFrame, name: str = "pos", layout: Optional[ChainLayout] = None
) -> DataFrame:
    """Add the position in the concatenated chain, counted from 0 in (batch_id, draw) order."""
    layout = layout or chain_layout(samples)
    out = samples.join(small_side(layout.offsets, layout.n_batches), "batch_id")
    return out.select(*samples.columns, (F.col("_start") + F.col("draw")).alias(name))


def check_window(n_draws: int, burn_in: int, thin: int) -> int:
    """Validate burn-in and thinning; the number of draws that remain."""
    if thin < 1:
        raise ValueError(f"thin must be >= 1, got {thin}")
    if burn_in < 0:
        raise ValueError(f"burn_in must be >= 0, got {burn_in}")
    if burn_in >= n_draws:
        raise ValueError(f"burn_in={burn_in} leaves nothing of {n_draws} draws per event")
    return -(-(n_draws - burn_in) // thin)


def after_burn_in(
    samples: DataFrame, burn_in: int = 0, thin: int = 1, layout: Optional[ChainLayout] = None
) -> DataFrame:
    """Draws left after burn-in and thinning.

    ``pos`` is the original position in the chain, ``kept`` tells whether thinning keeps the draw
    and ``rank`` its position among the kept ones. Rows that only thinning drops stay, because some
    summaries ignore thinning.
    """
    layout = layout or chain_layout(samples)
    check_window(layout.n_draws, burn_in, thin)
    placed = with_draw_ordinal(samples, "pos", layout).filter(F.col("pos") >= burn_in)
    since = F.col("pos") - burn_in
    return placed.withColumns(
        {"kept": since % thin == 0, "rank": F.floor(since / thin).cast("long")}
    )


def thinned_chain(
    samples: DataFrame, burn_in: int = 0, thin: int = 1, layout: Optional[ChainLayout] = None
) -> DataFrame:
    """Draws that burn-in and thinning both keep."""
    return after_burn_in(samples, burn_in, thin, layout).filter("kept").drop("kept")


def centred(samples: DataFrame, coords: Sequence[str] = ("X", "Y", "Z")) -> DataFrame:
    """Subtract each event's mean from the named fields.

    Means are aggregated and joined back, so the draws of one event need not meet in one task.
    """
    means = samples.groupBy("evid").agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_mean_{c}") for c in coords]
    )
    out = samples.join(means, "evid").withColumns(
        {c: F.col(c).cast("double") - F.col(f"_mean_{c}") for c in coords}
    )
    return out.select(*samples.columns)


def unit_factor(units: str) -> float:
    """1000 for metres, 1 for kilometres."""
    return 1000.0 if units.lower().startswith("meter") else 1.0


def scale_units(
    samples: DataFrame, units: str, coords: Sequence[str] = ("X", "Y", "Z")
) -> DataFrame:
    factor = unit_factor(units)
    return samples.withColumns({c: F.col(c).cast("double") * factor for c in coords})


def unpivot(
    samples: DataFrame, keep: Sequence[str], coords: Sequence[str] = ("X", "Y", "Z")
) -> DataFrame:
    """Long form: one row per (``keep``, ``coord``, ``value``)."""
    doubles = [F.col(c).cast("double").alias(c) for c in coords]
    return samples.select(*keep, *doubles).unpivot(list(keep), list(coords), "coord", "value")


def chain_trace(
    samples: DataFrame,
    coords: Sequence[str] = ("X", "Y", "Z"),
    burn_in: int = 0,
    thin: int = 1,
    units: str = "meters",
    layout: Optional[ChainLayout] = None,
) -> DataFrame:
    """Scaled, centred draws with their original index: (evid, coord, sample_index, value)."""
    kept = thinned_chain(samples, burn_in, thin, layout)
    moved = centred(scale_units(kept, units, coords), coords)
    return unpivot(moved.withColumnRenamed("pos", "sample_index"), ["evid", "sample_index"], coords)


def first_events(samples: DataFrame, n: int) -> DataFrame:
    """The first ``n`` event ids in id order."""
    return samples.select("evid").distinct().orderBy("evid").limit(n)


def random_events(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct event ids in an order given by a hash of ``seed`` and id."""
    ids = samples.select("evid").distinct()
    return ids.orderBy(uniform(F.lit(seed), F.col("evid")), "evid").limit(n)


def events_at(samples: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Event ids at the given positions in id order."""
    ids = number_rows(samples.select("evid").distinct(), "_i", ["evid"])
    return ids.filter(F.col("_i").isin(list(indices))).select("evid")


def known_events(samples: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """The ids of ``wanted`` that occur; unknown ones are skipped, all unknown is an error."""
    found = samples.filter(F.col("evid").isin(list(wanted))).select("evid").distinct()
    if found.isEmpty():
        raise ValueError("none of the requested event ids occur in the samples")
    return found
