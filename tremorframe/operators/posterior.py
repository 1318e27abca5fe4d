"""Per-event posterior summaries: means, quantile half-widths, standard deviations, errors."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe import lineage
from tremorframe.operators.chains import (
    ChainLayout,
    after_burn_in,
    centred,
    chain_layout,
    check_window,
    unpivot,
)
from tremorframe.operators.scaling import GATHER_ROWS, exact_quantiles

# The outer quantiles of the half-width.
LOW, HIGH = 0.005, 0.995
SHIFTS = ("X", "Y", "Z")
PLACES = ("latitude", "longitude", "depth")

# Names that ``include`` accepts and the mean each one stands for.
INCLUDE = {"lats": "latitude", "lons": "longitude", "deps": "depth", "X": "X", "Y": "Y", "Z": "Z"}


def _value(name: str, kept_only: bool) -> Column:
    value = F.col(name).cast("double")
    return F.when(F.col("kept"), value) if kept_only else value


def posterior_catalog(
    samples: DataFrame,
    burn_in: int = 0,
    thin: int = 1,
    layout: Optional[ChainLayout] = None,
    gather_rows: int = GATHER_ROWS,
) -> DataFrame:
    """Means and half-widths per event.

    latitude, longitude and depth average all draws after burn-in; X, Y, Z and their half-widths
    0.5 * (q99.5 - q0.5) use the thinned ones.
    """
    layout = layout or chain_layout(samples)
    n_kept = check_window(layout.n_draws, burn_in, thin)
    return _catalog(after_burn_in(samples, burn_in, thin, layout), n_kept, gather_rows)


def _catalog(draws: DataFrame, n_kept: int, gather_rows: int, more: Sequence[Column] = ()) -> DataFrame:
    """The catalog of ``draws`` after burn-in; ``more`` aggregates come along where chains are gathered."""
    means = [F.avg(_value(n, False)).alias(n) for n in PLACES]
    means += [F.avg(_value(n, True)).alias(n) for n in SHIFTS]
    if n_kept <= gather_rows:
        # (batch_id, evid, draw) is the key of the store, so n_kept bounds every group
        # NaN draws take no part in the spans, as on the other path
        finite = lambda n: F.when(~F.isnan(_value(n, True)), _value(n, True))
        spans = [F.percentile(finite(n), [HIGH, LOW]).alias(f"_q{n}") for n in SHIFTS]
        out = draws.groupBy("evid").agg(*means, *spans, *more)
        sigmas = {n: 0.5 * (F.col(f"_q{n}")[0] - F.col(f"_q{n}")[1]) for n in SHIFTS}
    else:
        probs = {"hi": HIGH, "lo": LOW}
        long = unpivot(draws.filter("kept"), ["evid"], SHIFTS)
        spans = exact_quantiles(
            long, ["evid", "coord"], "value", probs, gather_rows=gather_rows
        )
        wide = spans.groupBy("evid").agg(
            *[F.max(F.when(F.col("coord") == n, F.col("hi") - F.col("lo"))).alias(f"_w{n}") for n in SHIFTS]
        )
        out = draws.groupBy("evid").agg(*means).join(wide, "evid", "left")
        sigmas = {n: 0.5 * F.col(f"_w{n}") for n in SHIFTS}
    columns = [*PLACES]
    for n in SHIFTS:
        columns += [n, sigmas[n].alias(f"sigma_{n.lower()}")]
    return out.select(*columns, "evid", *[c for c in out.columns if c == "_chain"])


def catalog_and_chains(
    samples: DataFrame,
    burn_in: int = 0,
    thin: int = 1,
    layout: Optional[ChainLayout] = None,
    gather_rows: int = GATHER_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """:func:`posterior_catalog` and :func:`centred_chains` of one scan of the store.

    Chains up to ``gather_rows`` draws are written with their event's summary, one row per event, which
    both results read. Of longer ones the draws that are left are written as they are.
    """
    layout = layout or chain_layout(samples)
    n_kept = check_window(layout.n_draws, burn_in, thin)
    if n_kept > gather_rows:
        draws = lineage.as_table(after_burn_in(samples, burn_in, thin, layout), "draws-left")
        catalog = _catalog(draws, n_kept, gather_rows)
        return catalog, centred(draws.filter("kept").select("evid", "rank", *SHIFTS), SHIFTS)
    draw = F.struct("rank", *[F.col(n).cast("double").alias(n) for n in SHIFTS])
    chain = F.collect_list(F.when(F.col("kept"), draw)).alias("_chain")
    draws = after_burn_in(samples, burn_in, thin, layout)
    stored = lineage.as_table(_catalog(draws, n_kept, gather_rows, [chain]), "summaries")
    each = stored.select("evid", *[F.col(n).alias(f"_mean_{n}") for n in SHIFTS], F.explode("_chain").alias("_d"))
    moved = [(F.col(f"_d.{n}") - F.col(f"_mean_{n}")).alias(n) for n in SHIFTS]
    return stored.drop("_chain"), each.select("evid", "_d.rank", *moved)


def posterior_means(
    samples: DataFrame,
    include: Sequence[str],
    burn_in: int = 0,
    thin: int = 1,
    layout: Optional[ChainLayout] = None,
) -> DataFrame:
    """Only the named means per event; unread fields are pruned from the scan."""
    unknown = [n for n in include if n not in INCLUDE]
    if unknown:
        raise KeyError(f"unknown fields {unknown}; choose from {sorted(INCLUDE)}")
    draws = after_burn_in(samples, burn_in, thin, layout)
    aggs = [F.avg(_value(INCLUDE[n], n in SHIFTS)).alias(INCLUDE[n]) for n in include]
    return draws.groupBy("evid").agg(*aggs)


def centred_chains(
    samples: DataFrame,
    burn_in: int = 0,
    thin: int = 1,
    coords: Sequence[str] = SHIFTS,
    layout: Optional[ChainLayout] = None,
) -> DataFrame:
    """Long centred draws (evid, rank, coordinates) after burn-in and thinning."""
    draws = after_burn_in(samples, burn_in, thin, layout).filter("kept")
    return centred(draws.select("evid", "rank", *coords), coords)


def pooled_catalog(
    samples: DataFrame, pooled_sigma: bool = True, gather_rows: int = GATHER_ROWS
) -> DataFrame:
    """Means per event with half-widths over the draws of all events together.

    ``pooled_sigma=False`` gives the half-widths per event instead.
    """
    if not pooled_sigma:
        return posterior_catalog(samples, gather_rows=gather_rows)
    names = [*PLACES, *SHIFTS]
    means = samples.groupBy("evid").agg(*[F.avg(_value(n, False)).alias(n) for n in names])
    spans = exact_quantiles(
        unpivot(samples, [], SHIFTS),
        ["coord"],
        "value",
        {"hi": HIGH, "lo": LOW},
        gather_rows=gather_rows,
    )
    width = spans.agg(
        F.struct(
            *[
                (0.5 * F.max(F.when(F.col("coord") == n, F.col("hi") - F.col("lo")))).alias(n)
                for n in SHIFTS
            ]
        )
    ).scalar()
    return means.select(
        "evid", *names, *[width[n].alias(f"sigma_{n.lower()}") for n in SHIFTS]
    )


def std_uncertainty(
    samples: DataFrame, burn_in: int = 0, thin: int = 1, layout: Optional[ChainLayout] = None
) -> DataFrame:
    """Sample standard deviation of position and time per event."""
    draws = after_burn_in(samples, burn_in, thin, layout).filter("kept")
    fields = {"longitude": "longitude", "latitude": "latitude", "depth": "depth", "time": "delta_t"}
    return draws.groupBy("evid").agg(
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"{n}_std") for n, c in fields.items()]
    )


def mean_uncertainty(spreads: DataFrame) -> DataFrame:
    """One row: the average of each standard deviation over events."""
    names = ["longitude_std", "latitude_std", "depth_std", "time_std"]
    return spreads.agg(*[F.avg(n).alias(f"mean_{n}") for n in names])


def compare_to_truth(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """Estimate minus truth per event, matched by ``evid``."""
    pairs = {"longitude": "lon", "latitude": "lat", "depth": "depth"}
    known = truth.select("evid", *[F.col(t).alias(f"_t_{n}") for n, t in pairs.items()])
    return estimate.join(known, "evid").select(
        "evid", *[(F.col(n) - F.col(f"_t_{n}")).alias(f"{n}_error") for n in pairs]
    )


def location_error(errors: DataFrame) -> DataFrame:
    """One row: mean magnitude and root mean square of each coordinate's error."""
    aggs = []
    for n in ("longitude", "latitude", "depth"):
        e = F.col(f"{n}_error")
        aggs += [F.avg(F.abs(e)).alias(f"mean_abs_{n}"), F.sqrt(F.avg(e * e)).alias(f"rms_{n}")]
    return errors.agg(*aggs)


def spatial_extent(catalog: DataFrame) -> DataFrame:
    """One row: range of each coordinate."""
    names = ("longitude", "latitude", "depth")
    return catalog.agg(*[(F.max(n) - F.min(n)).alias(f"{n}_range") for n in names])
