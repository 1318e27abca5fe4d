"""The numbers behind histograms and density curves, counted without gathering draws."""

from __future__ import annotations

import math
from typing import Optional, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe.operators.chains import centred, scale_units, unit_factor, unpivot
from tremorframe.operators.scaling import GATHER_ROWS, exact_quantiles, group_sizes, in_tasks, running_total

# Fixed value: default histogram bin width in km.
BIN_WIDTH = 0.003


def edge_count(lo: float, hi: float, width: float) -> int:
    """Number of edges lo, lo + width, ... below hi + width / 2."""
    return max(0, math.ceil((hi + 0.5 * width - lo) / width))


def bin_index(value: Column, lo: float, width: float, n_edges: int) -> Column:
    """Bin of ``value`` among edges lo + i * width; NULL outside; the last bin is closed."""
    edge = lambda i: F.lit(float(lo)) + i * float(width)
    guess = F.floor((value - float(lo)) / float(width))
    # division may land a value one bin off its true edge
    exact = (
        F.when(value < edge(guess), guess - 1)
        .when(value >= edge(guess + 1), guess + 1)
        .otherwise(guess)
    )
    last = n_edges - 1
    inside = (value >= float(lo)) & (value <= edge(F.lit(last)))
    return F.when(inside, F.least(exact, F.lit(last - 1))).cast("long")


def _scaled(samples: DataFrame, coords: Sequence[str], units: str, center: bool) -> DataFrame:
    out = scale_units(samples.select("evid", *coords), units, coords)
    return centred(out, coords) if center else out


def histogram(
    samples: DataFrame,
    coords: Sequence[str] = ("X", "Y", "Z"),
    xlim: tuple[float, float] = (-0.1, 0.1),
    bin_width: float = BIN_WIDTH,
    units: str = "km",
    density: bool = True,
    center: bool = False,
) -> DataFrame:
    """Per event and coordinate: occupied bins with their left edge, count and density.

    Density is the count over (draws inside the edges x width). Empty bins have no row.
    """
    n_edges = edge_count(*xlim, bin_width)
    long = unpivot(_scaled(samples, coords, units, center), ["evid"], coords)
    index = bin_index(F.col("value"), xlim[0], bin_width, n_edges)
    counts = (
        long.withColumn("bin", index)
        .filter(F.col("bin").isNotNull())
        .groupBy("evid", "coord", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    left = F.lit(float(xlim[0])) + F.col("bin") * float(bin_width)
    out = counts.withColumn("left_edge", left)
    if density:
        inside = F.sum("n").over(W.partitionBy("evid", "coord"))
        out = out.withColumn("density", F.col("n") / (inside * float(bin_width)))
    return out


def cumulative_histogram(
    df: DataFrame,
    columns: Sequence[str],
    scale: float = 1.0,
    bins: Optional[tuple[float, float, float]] = None,
    n_rows: Optional[int] = None,
) -> DataFrame:
    """Running share of values per column: (column, bin, left_edge, n, cumulative).

    ``bins`` is (lo, hi, width); by default the edges are 0, 1, ... up to the row count minus one,
    so larger values drop out. Empty bins have no row; their value is that of the bin before.
    """
    if bins is None:
        n_edges = df.count() if n_rows is None else n_rows
        lo, width = 0.0, 1.0
    else:
        lo, width = float(bins[0]), float(bins[2])
        n_edges = edge_count(*bins)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    counts = (
        long.withColumn("bin", bin_index(F.col("value") * float(scale), lo, width, n_edges))
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = running_total(counts, ["column"], "bin", "n", "_upto")
    totals = counts.groupBy("column").agg(F.sum("n").alias("_total"))
    # one row per requested column
    out = running.join(F.broadcast(totals), "column")
    return out.select(
        "column",
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("left_edge"),
        "n",
        (F.col("_upto") / F.col("_total")).alias("cumulative"),
    )


def histogram2d(
    samples: DataFrame,
    coords: Sequence[str] = ("X", "Y", "Z"),
    xlim: tuple[float, float] = (-0.1, 0.1),
    bin_width: float = BIN_WIDTH,
    units: str = "km",
    center: bool = False,
) -> DataFrame:
    """Occupied cells per event for the three coordinate pairs: (evid, pair, bin_a, bin_b, n)."""
    if len(coords) != 3:
        raise ValueError("coords must name exactly three fields")
    n_edges = edge_count(*xlim, bin_width)
    data = _scaled(samples, coords, units, center)
    indexed = data.select(
        "evid",
        *[bin_index(F.col(c), xlim[0], bin_width, n_edges).alias(f"_b{i}") for i, c in enumerate(coords)],
    )
    pairs = [(0, 1), (0, 2), (1, 2)]
    cells = F.array(
        *[
            F.struct(
                F.lit(f"{coords[a]}{coords[b]}").alias("pair"),
                F.col(f"_b{a}").alias("bin_a"),
                F.col(f"_b{b}").alias("bin_b"),
            )
            for a, b in pairs
        ]
    )
    exploded = indexed.select("evid", F.explode(cells).alias("c")).select("evid", "c.*")
    return (
        exploded.filter(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
        .groupBy("evid", "pair", "bin_a", "bin_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def contour_levels(
    cells: DataFrame,
    xlim: tuple[float, float] = (-0.1, 0.1),
    bin_width: float = BIN_WIDTH,
    n_contours: int = 8,
) -> DataFrame:
    """Contour levels per event and pair: ``n_contours`` even steps above the smallest count.

    Empty cells count as 0, so the smallest count is 0 unless every cell is occupied.
    """
    n_bins = edge_count(*xlim, bin_width) - 1
    ext = cells.groupBy("evid", "pair").agg(
        F.count(F.lit(1)).alias("_occupied"), F.min("n").alias("_min"), F.max("n").alias("_max")
    )
    low = F.when(F.col("_occupied") < n_bins * n_bins, F.lit(0)).otherwise(F.col("_min"))
    step = (F.col("_max") - low) / float(n_contours)
    levels = F.transform(
        F.sequence(F.lit(1), F.lit(n_contours)), lambda i: low.cast("double") + step * i
    )
    return ext.select("evid", "pair", F.posexplode(levels).alias("level_no", "level"))


def finite_only(df: DataFrame, column: str = "value") -> DataFrame:
    """Drop NULL, NaN and infinite values."""
    value = F.col(column)
    return df.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def density_curve(
    samples: DataFrame,
    coords: Sequence[str] = ("X", "Y", "Z"),
    xlim: Optional[tuple[float, float]] = None,
    n_eval: int = 512,
    units: str = "meters",
    gather_rows: int = GATHER_ROWS,
    sizes: Optional[tuple[int, int]] = None,
) -> DataFrame:
    """Gaussian density of mean-removed draws on an even grid: (evid, coord, i, x, density).

    The grid spans ``xlim`` and the data with 5 % margin. Draws are binned linearly to the grid and the
    grid weights are smoothed by :func:`smoothed`, so the work per curve depends on the grid, not on the
    chain. The bandwidth is 0.9 min(s, IQR / 1.34) n^(-1/5), or with s alone when the quartiles coincide.
    A curve whose draws are all equal has no bandwidth; it is the binned density itself. A curve without
    finite draws is zero on -1 .. 1.
    """
    if n_eval < 2:
        raise ValueError(f"n_eval must be >= 2, got {n_eval}")
    if xlim is None:
        xlim = (-300.0, 300.0) if unit_factor(units) == 1000.0 else (-0.3, 0.3)
    every = unpivot(_scaled(samples, coords, units, False), ["evid"], coords)
    keys = ["evid", "coord"]
    sizes = sizes or group_sizes(finite_only(every), keys)
    if sizes[1] <= gather_rows:
        every = in_tasks(every, keys, samples.count() * len(coords))
    long = finite_only(every)
    quartiles = exact_quantiles(
        long, keys, "value", {"q1": 0.25, "q3": 0.75}, sizes=sizes, gather_rows=gather_rows
    )
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    stats = every.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("s"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    spread = F.coalesce(F.col("s"), F.lit(0.0))
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    width = F.when(iqr > 0, F.least(spread, iqr)).otherwise(spread)
    margin = 0.05 * (F.col("hi") - F.col("lo") + 1e-9)
    some = F.col("n") > 0
    low = F.least(F.lit(float(xlim[0])), F.col("lo") - F.col("mean") - margin)
    high = F.greatest(F.lit(float(xlim[1])), F.col("hi") - F.col("mean") + margin)
    stats = stats.join(quartiles, keys, "left").select(
        *keys,
        "n",
        "mean",
        (0.9 * width * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        F.when(some, low).otherwise(-1.0).alias("lo"),
        F.when(some, high).otherwise(1.0).alias("hi"),
    )
    step = (F.col("hi") - F.col("lo")) / float(n_eval - 1)
    stats = stats.withColumn("step", step)

    at = (F.col("value") - F.col("mean") - F.col("lo")) / F.col("step")
    placed = long.join(stats, keys).select(*keys, at.alias("_at"))
    node = F.least(F.greatest(F.floor("_at"), F.lit(0)), F.lit(n_eval - 2)).cast("int")
    share = F.col("_at") - node
    weights = (
        placed.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(node.alias("i"), (1 - share).alias("w")),
                    F.struct((node + 1).alias("i"), share.alias("w")),
                )
            ).alias("g"),
        )
        .groupBy(*keys, "g.i")
        .agg(F.sum("g.w").alias("w"))
    )
    # at most n_eval grid weights per curve
    grids = weights.groupBy(*keys).agg(F.collect_list(F.struct("i", "w")).alias("_g"))
    curves = stats.join(grids, keys, "left").select(
        *keys, "n", "h", "lo", "step", F.col("_g.i").alias("_i"), F.col("_g.w").alias("_w")
    )

    @F.pandas_udf("array<double>")
    def smooth(
        index: pd.Series, weight: pd.Series, n: pd.Series, h: pd.Series, step: pd.Series
    ) -> pd.Series:
        out = []
        for start in range(0, len(n), 256):
            stop = min(start + 256, len(n))
            grid = np.zeros((stop - start, n_eval))
            for row, (i, w) in enumerate(zip(index.iloc[start:stop], weight.iloc[start:stop])):
                if i is not None:
                    grid[row, np.asarray(i)] = w
            count, width, dx = (c.iloc[start:stop].to_numpy(dtype=np.float64) for c in (n, h, step))
            out.extend(smoothed(grid, width / dx) / (np.maximum(count, 1) * dx)[:, None])
        return pd.Series(out)

    dense = curves.withColumn("_d", smooth("_i", "_w", "n", "h", "step"))
    return dense.select(
        *keys, "lo", "step", F.posexplode("_d").alias("i", "density")
    ).select(*keys, "i", (F.col("lo") + F.col("i") * F.col("step")).alias("x"), "density")


def smoothed(grid: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Rows of grid weights convolved with Gaussians of ``width`` nodes; unchanged where it is not above 0.

    The convolution is a product of Fourier transforms, padded so that no end meets the other. With
    rounding unit e and padded length N, each transform is off by at most 4 e log2(N) times its norm, so
    every entry is within 16 e log2(N) |weights| |kernel| of the exact sum, norms being Euclidean.
    """
    n = grid.shape[1]
    padded = 1 << (2 * n - 2).bit_length()
    some = width > 0
    scale = np.where(some, width, 1.0)[:, None]
    offset = np.arange(padded)
    z = np.minimum(offset, padded - offset)[None, :] / scale
    kernel = np.exp(-0.5 * z * z) / (scale * math.sqrt(2 * math.pi))
    kernel = np.where((np.minimum(offset, padded - offset) < n)[None, :], kernel, 0.0)
    out = np.fft.irfft(np.fft.rfft(grid, padded) * np.fft.rfft(kernel), padded)[:, :n]
    # rounding may leave less than nothing where there is nothing
    return np.where(some[:, None], np.maximum(out, 0.0), grid)
