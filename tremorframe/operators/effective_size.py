"""Effective sample size of chains from their clipped autocorrelation."""

from __future__ import annotations

from typing import Optional

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.operators.chains import ChainLayout, chain_layout, check_window, thinned_chain
from tremorframe.operators.scaling import exact_quantiles, in_tasks

AXES = ("x", "y", "z")
# Draws that one task gathers of one chain.
BLOCK_DRAWS = 16_384


def default_max_lag(n_draws: int) -> int:
    """Fixed rule: a quarter of the chain, at most 1000."""
    return min(1000, n_draws // 4)


def lagged_products(head: np.ndarray, full: np.ndarray, max_lag: int) -> np.ndarray:
    """Sums over ``head`` of x[t] * full[t + k] for k = 1 .. max_lag; ``full`` starts with ``head``."""
    size = 1 << int(len(head) + len(full) - 1).bit_length()
    spectrum = np.fft.rfft(full, size) * np.conj(np.fft.rfft(head, size))
    sums = np.zeros(max_lag)
    reach = min(max_lag, len(full) - 1)
    sums[:reach] = np.fft.irfft(spectrum, size)[1 : reach + 1]
    return sums


def effective_sample_size(
    samples: DataFrame,
    burn_in: int = 0,
    thin: int = 1,
    max_lag: Optional[int] = None,
    method: str = "autocorr",
    layout: Optional[ChainLayout] = None,
    block_draws: int = BLOCK_DRAWS,
) -> DataFrame:
    """Effective size per event: ``ess_x``, ``ess_y``, ``ess_z`` and their minimum ``ess``.

    acf(k) = sum x[t] x[t+k] / ((n-k) v) on centred draws with unbiased variance v; negative values
    count as 0; ESS = n / (1 + 2 sum acf) within [1, n]; a constant chain has ESS n.

    Each chain is cut into blocks of ``block_draws``, every block extended by the ``max_lag`` draws
    that follow it. A task sees single blocks only; lagged sums of blocks then add up.
    """
    if method != "autocorr":
        raise ValueError(f"method {method!r} is not supported, only 'autocorr'")
    for name in ("X", "Y", "Z"):
        if name not in samples.columns:
            raise ValueError(f"samples lack {name}, which the effective size needs")
    layout = layout or chain_layout(samples)
    n = check_window(layout.n_draws, burn_in, thin)
    lag = default_max_lag(n) if max_lag is None else int(max_lag)
    if lag < 0:
        raise ValueError(f"max_lag must be >= 0, got {lag}")
    lag = min(lag, n - 1)
    # chains may differ in length: each has its own largest lag, and needs two draws for any
    quarter = F.least(F.lit(1000), F.floor(F.col("n") / 4)) if max_lag is None else F.lit(lag)
    own_lag = F.least(quarter, F.col("n") - 1)
    block = max(int(block_draws), lag, 1)

    draws = thinned_chain(samples, burn_in, thin, layout).select(
        "evid", "rank", *[F.col(a.upper()).cast("double").alias(a) for a in AXES]
    )
    moments = [
        F.count(F.lit(1)).alias("n"),
        *[F.avg(a).alias(f"m_{a}") for a in AXES],
        *[F.var_samp(a).alias(f"v_{a}") for a in AXES],
    ]
    gather = F.sort_array(F.collect_list(F.struct("rank", *AXES))).alias("_d")
    if n <= block:
        # whole chains: one grouping gives the draws and their moments
        gathered = in_tasks(draws, ["evid"], samples.count()).groupBy("evid").agg(gather, *moments).withColumn("_own", F.col("n"))
    else:
        home = F.floor(F.col("rank") / block)
        # the first ``lag`` draws of a block also close the block before it
        shared = (F.col("rank") % block < lag) & (home > 0)
        homes = F.when(shared, F.array(home, home - 1)).otherwise(F.array(home))
        own = F.sum((F.col("rank") < (F.col("_block") + 1) * block).cast("long")).alias("_own")
        gathered = (
            in_tasks(draws.withColumn("_block", F.explode(homes)), ["evid", "_block"], samples.count())
            .groupBy("evid", "_block")
            .agg(gather, own)
            .join(draws.groupBy("evid").agg(*moments), "evid")
        )
    chains = gathered.select(
        "evid",
        "n",
        "_own",
        *[F.col(f"_d.{a}").alias(a) for a in AXES],
        *[f"m_{a}" for a in AXES],
        *[f"v_{a}" for a in AXES],
    )

    @F.pandas_udf("struct<x array<double>, y array<double>, z array<double>>")
    def block_sums(
        own: pd.Series,
        x: pd.Series,
        y: pd.Series,
        z: pd.Series,
        mx: pd.Series,
        my: pd.Series,
        mz: pd.Series,
    ) -> pd.DataFrame:
        out = {}
        for axis, values, means in (("x", x, mx), ("y", y, my), ("z", z, mz)):
            sums = []
            for length, chain, mean in zip(own, values, means):
                full = np.asarray(chain) - mean
                sums.append(lagged_products(full[:length], full, lag))
            out[axis] = sums
        return pd.DataFrame(out)

    summed = chains.withColumn(
        "_s", block_sums("_own", *AXES, *[f"m_{a}" for a in AXES])
    ).select("evid", "n", *[f"v_{a}" for a in AXES], *[F.col(f"_s.{a}").alias(a) for a in AXES])

    if n > block:
        keys = ["evid", "n", *[f"v_{a}" for a in AXES]]
        lags = summed.select(*keys, F.posexplode_outer(F.arrays_zip(*AXES)).alias("_k", "_z"))
        lags = lags.groupBy(*keys, "_k").agg(*[F.sum(f"_z.{a}").alias(a) for a in AXES])
        clipped = lambda a: F.when(
            F.col("_k") < own_lag,
            F.greatest(
                F.col(a) / ((F.col("n") - F.col("_k") - 1) * F.nullif(F.col(f"v_{a}"), F.lit(0.0))),
                F.lit(0.0),
            ),
        )
        totals = lags.groupBy(*keys).agg(*[F.sum(clipped(a)).alias(a) for a in AXES])
    else:

        def total(a: str):
            terms = F.transform(
                F.col(a),
                lambda s, k: F.when(
                    k < own_lag,
                    F.greatest(
                        s / ((F.col("n") - k - 1) * F.nullif(F.col(f"v_{a}"), F.lit(0.0))),
                        F.lit(0.0),
                    ),
                ).otherwise(F.lit(0.0)),
            )
            return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

        totals = summed.select(
            "evid", "n", *[f"v_{a}" for a in AXES], *[total(a).alias(a) for a in AXES]
        )

    length = F.col("n").cast("double")

    def size(a: str):
        raw = length / (1 + 2 * F.coalesce(F.col(a), F.lit(0.0)))
        bounded = F.greatest(F.lit(1.0), F.least(raw, length))
        constant = F.coalesce(F.col(f"v_{a}"), F.lit(0.0)) == 0
        return F.when(constant, length).otherwise(bounded)

    sizes = totals.select("evid", "n", *[size(a).alias(f"ess_{a}") for a in AXES])
    return sizes.withColumn("ess", F.least(*[f"ess_{a}" for a in AXES]))


def ess_summary(sizes: DataFrame, **narrow) -> DataFrame:
    """One row over events: mean, median, min, max, population std, counts."""
    median = exact_quantiles(sizes, [], "ess", {"m": 0.5}, **narrow).scalar()
    out = sizes.agg(
        F.avg("ess").alias("mean_ess"),
        F.min("ess").alias("min_ess"),
        F.max("ess").alias("max_ess"),
        F.stddev_pop("ess").alias("std_ess"),
        F.count(F.lit(1)).alias("n_events"),
        F.max("n").alias("n_samples"),
    )
    return out.select(
        "mean_ess", median.alias("median_ess"), "min_ess", "max_ess", "std_ess", "n_events", "n_samples"
    )
