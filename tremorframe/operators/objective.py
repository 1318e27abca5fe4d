"""Robust likelihood, Gaussian priors, their sum, and the gradient per event."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.functions.travel_time import number
from tremorframe.operators.forward import Observations, predict_dt
from tremorframe.operators.scaling import small_side
from tremorframe.schemas import COMPONENTS


@dataclass(frozen=True)
class Priors:
    """Zero-mean diagonal Gaussians on each event's shift and on the mean shift."""

    event_std: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.10)
    centroid_std: tuple[float, float, float, float] = (0.01, 0.01, 0.01, 0.01)


def negative_log_normal(values: Sequence[Column], stds: Sequence[float]) -> Column:
    """Minus log density of a zero-mean diagonal Gaussian."""
    constant = sum(math.log(s) for s in stds) + 0.5 * len(stds) * math.log(2 * math.pi)
    total = F.lit(constant)
    for value, std in zip(values, stds):
        total = total + 0.5 * (value / std) * (value / std)
    return total


def _scaled(predicted: DataFrame, phase_unc: tuple[float, float]) -> DataFrame:
    """Add ``_sigma`` of the phase and the scaled residual ``_u``."""
    p, s = map(number, phase_unc)
    with_sigma = predicted.selectExpr("*", f"CASE WHEN phase < 0.5D THEN {p} ELSE {s} END AS _sigma")
    return with_sigma.selectExpr("*", "dt / _sigma - dt_pred / _sigma AS _u")


_HUBER = "CASE WHEN abs(_u) <= 1 THEN 0.5D * _u * _u ELSE abs(_u) - 0.5D END"


def likelihood(
    obs: Observations,
    state: DataFrame,
    model,
    phase_unc: tuple[float, float],
    n_events: Optional[int] = None,
) -> DataFrame:
    """One row: ``n_obs`` and the mean Huber loss of phase-scaled residuals."""
    scaled = _scaled(predict_dt(obs, state, model, n_events=n_events), phase_unc)
    return scaled.agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg(F.expr(_HUBER)).alias("likelihood_loss")
    )


def prior_terms(state: DataFrame, n_obs: int | Column, priors: Priors) -> DataFrame:
    """One row: event prior, centroid prior times the event count, and their sum over ``n_obs``."""
    moves = [F.col(c) for c in COMPONENTS]
    sums = state.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(negative_log_normal(moves, priors.event_std)).alias("event_prior"),
        *[F.avg(c).alias(c) for c in COMPONENTS],
    )
    centroid = negative_log_normal(moves, priors.centroid_std) * F.col("n_events")
    out = sums.select("n_events", "event_prior", centroid.alias("centroid_prior"))
    n = F.lit(n_obs) if isinstance(n_obs, int) else n_obs
    total = (F.col("event_prior") + F.col("centroid_prior")) / n
    return out.withColumn("prior_loss", total)


def posterior(
    obs: Observations,
    state: DataFrame,
    model,
    phase_unc: tuple[float, float],
    priors: Priors,
    normalize: bool = True,
    n_events: Optional[int] = None,
) -> DataFrame:
    """One row with every term and ``posterior_loss``.

    ``normalize=False`` multiplies the likelihood by the observation count and leaves the prior
    divided by it, as the surveyed objective does; no step uses that form.
    """
    fit = likelihood(obs, state, model, phase_unc, n_events)
    # one row beside one row: both are ungrouped aggregates, joined as scalar subqueries
    terms = fit.select(
        F.struct(F.col("n_obs").alias("n"), F.col("likelihood_loss").alias("loss"))
    ).scalar()
    out = prior_terms(state, terms["n"], priors).select(
        terms["n"].alias("n_obs"),
        "n_events",
        terms["loss"].alias("likelihood_loss"),
        "event_prior",
        "centroid_prior",
        "prior_loss",
    )
    weight = F.lit(1) if normalize else F.col("n_obs")
    return out.withColumn("posterior_loss", weight * F.col("likelihood_loss") + F.col("prior_loss"))


def event_sums(
    obs: Observations,
    state: DataFrame,
    model,
    phase_unc: tuple[float, float],
    n_events: Optional[int] = None,
) -> DataFrame:
    """Likelihood gradient summed per event, not yet divided by the observation count.

    Every observation contributes to its two events. Its Huber loss goes to its second event, so the
    total over events is the total over observations. The sums are pre-aggregated in each map task,
    so an event with very many observations does not concentrate.
    """
    predicted = predict_dt(obs, state, model, gradients=True, n_events=n_events)
    weighed = _scaled(predicted, phase_unc).selectExpr(
        "evid1",
        "evid2",
        "greatest(least(_u, 1D), -1D) / _sigma AS w",
        f"{_HUBER} AS h",
        *[f"g{end}{axis}" for end in "12" for axis in "xyz"],
    )
    first = ", ".join(f"w * g1{a} AS g_d{a}" for a in "xyz")
    second = ", ".join(f"-w * g2{a} AS g_d{a}" for a in "xyz")
    ends = weighed.selectExpr(
        f"inline(array(struct(evid1 AS evid, {first}, w AS g_dt, 0D AS huber_sum),"
        f" struct(evid2 AS evid, {second}, -w AS g_dt, h AS huber_sum)))"
    )
    return ends.groupBy("evid").sum(*[f"g_{c}" for c in COMPONENTS], "huber_sum").toDF(
        "evid", *[f"g_{c}" for c in COMPONENTS], "huber_sum"
    )


def event_gradient(
    obs: Observations,
    state: DataFrame,
    model,
    phase_unc: tuple[float, float],
    priors: Priors,
    n_obs: int,
    n_batch: Optional[int] = None,
    n_events: Optional[int] = None,
) -> DataFrame:
    """State columns with the gradient ``g_dx .. g_dt`` of the normalized posterior loss.

    ``n_batch`` is the row count of ``obs`` when that is a minibatch of the ``n_obs`` rows. Events
    without observations keep the prior's gradient only.
    """
    batch = n_obs if n_batch is None else n_batch
    sums = event_sums(obs, state, model, phase_unc, n_events)
    centre = state.selectExpr(f"struct({', '.join(f'avg({c}) AS {c}' for c in COMPONENTS)})").scalar()
    own = [c for c in state.columns if c != "huber_sum"]
    joined = state.select(*own).join(small_side(sums, n_events), "evid", "left")
    grads = [
        f"coalesce(g_{c}, 0D) / {number(batch)}"
        f" + ({c} / {number(std * std)} + _centre.{c} / {number(cstd * cstd)}) / {number(n_obs)} AS g_{c}"
        for c, std, cstd in zip(COMPONENTS, priors.event_std, priors.centroid_std)
    ]
    return joined.select("*", centre.alias("_centre")).selectExpr(
        *own, *grads, "coalesce(huber_sum, 0D) AS huber_sum"
    )


def loss_from_state(
    before: DataFrame, after: DataFrame, n_batch: int, n_obs: int, priors: Priors
) -> DataFrame:
    """One row: the loss at ``before``, from the Huber sums that the step stored in ``after``."""
    fit = after.agg((F.sum("huber_sum") / F.lit(n_batch))).scalar()
    return prior_terms(before, n_obs, priors).select((fit + F.col("prior_loss")).alias("loss"))


def epoch_mean_loss(losses: DataFrame) -> DataFrame:
    """Mean of a ``loss`` column, 0 without rows."""
    return losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("mean_loss"))


def network_loss(df: DataFrame, predicted: str = "s_pred", true: str = "s_true") -> DataFrame:
    """One row: norm of the slowness error over the norm of the true slowness."""
    error = F.col(predicted) - F.col(true)
    ratio = F.sqrt(F.sum(error * error)) / F.sqrt(F.sum(F.col(true) * F.col(true)))
    return df.agg(ratio.alias("relative_loss"))
