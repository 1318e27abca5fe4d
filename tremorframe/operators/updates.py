"""One optimizer or sampler step as column updates on the event state."""

from __future__ import annotations

import math
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.functions.portable_random import gaussian
from tremorframe.functions.travel_time import number
from tremorframe.schemas import COMPONENTS

# The common Adam defaults.
ADAM_BETA1, ADAM_BETA2, ADAM_EPS = 0.9, 0.999, 1e-8


def adam_update(graded: DataFrame, step: int, lr: float) -> DataFrame:
    """Adam with bias correction; ``graded`` is the state with ``g_*``, ``step`` counts from 1."""
    if step < 1:
        raise ValueError(f"step must be >= 1, got {step}")
    b1, b2 = number(ADAM_BETA1), number(ADAM_BETA2)
    moments = []
    for c in COMPONENTS:
        moments.append(f"{b1} * m_{c} + {number(1 - ADAM_BETA1)} * g_{c} AS m_{c}")
        moments.append(f"{b2} * v_{c} + {number(1 - ADAM_BETA2)} * g_{c} * g_{c} AS v_{c}")
    size = number(lr / (1 - ADAM_BETA1**step))
    spread = number(math.sqrt(1 - ADAM_BETA2**step))
    moves = [
        f"{c} - {size} * (m_{c} / (sqrt(v_{c}) / {spread} + {number(ADAM_EPS)})) AS {c}"
        for c in COMPONENTS
    ]
    return _apply(graded, moments, moves)


def _apply(graded: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Two projections: ``first`` replaces columns by name, ``second`` sees the result.

    The gradient and noise columns go, all others stay in order.
    """
    out = graded
    for step in (first, second):
        new = {text.rsplit(" AS ", 1)[1]: text for text in step}
        out = out.selectExpr(*[new.get(c, c) for c in out.columns])
    return out.select(*[c for c in graded.columns if not c.startswith(("g_", "_noise_"))])


def check_langevin(lr: float, beta: float, eps: float, n_obs: int, preconditioner: str) -> None:
    """Reject settings for which the step is undefined."""
    if not lr >= 0.0:
        raise ValueError(f"lr must be >= 0, got {lr}")
    if not 0.0 <= beta < 1.0:
        raise ValueError(f"beta must be in [0, 1), got {beta}")
    if not eps >= 0.0:
        raise ValueError(f"eps must be >= 0, got {eps}")
    if n_obs <= 0:
        raise ValueError(f"n_obs must be > 0, got {n_obs}")
    if preconditioner not in ("rmsprop", "adam"):
        raise ValueError(f"unknown preconditioner {preconditioner!r}: rmsprop and adam are known")


def langevin_update(
    graded: DataFrame,
    step: int,
    n_obs: int,
    lr: float = 1e-3,
    beta: float = 0.99,
    eps: float = 1e-5,
    preconditioning: bool = True,
    preconditioner: str = "rmsprop",
    noise_scale: float = 0.0,
    seed: int = 0,
    noise_step: Optional[int] = None,
    scale_by_n_obs: bool = True,
    include_gamma: bool = True,
) -> DataFrame:
    """Preconditioned Langevin step on the state with ``g_*``.

    The second moment uses the raw gradient, the drift the gradient times ``n_obs``. Noise has
    standard deviation sqrt(2 lr) sqrt(G) ``noise_scale`` and is keyed by event, component,
    ``noise_step`` and ``seed``, so a retried task draws the same values.
    """
    check_langevin(lr, beta, eps, n_obs, preconditioner)
    if step < 1:
        raise ValueError(f"step must be >= 1, got {step}")
    rate, damping = number(lr), number(eps)
    scale = number(n_obs if scale_by_n_obs else 1)
    memory, moves = [], []
    for c in COMPONENTS:
        move = f"{rate} * g_{c} * {scale}"
        damped = "1D"
        if preconditioning:
            memory.append(f"{number(beta)} * v_{c} + {number(1 - beta)} * g_{c} * g_{c} AS v_{c}")
            used = f"v_{c}" if preconditioner == "rmsprop" else f"(v_{c} / {number(1 - beta**step)})"
            damped = f"({damping} + sqrt({used}))"
            move = f"{rate} / {damped} * g_{c} * {scale}"
            if include_gamma:
                shrink = number(lr * (1 - beta))
                move += f" - {shrink} * g_{c} * sqrt({used}) / ({damped} * {damped})"
        if noise_scale > 0:
            deviation = number(math.sqrt(2 * lr) * noise_scale)
            move += f" + _noise_{c} * {deviation} * sqrt(1D / {damped})"
        moves.append(f"{c} - ({move}) AS {c}")
    if noise_scale > 0:
        at = F.lit(step if noise_step is None else noise_step)
        draws = {
            f"_noise_{c}": gaussian(F.col("evid"), F.lit(c), at, F.lit(seed)) for c in COMPONENTS
        }
        graded = graded.withColumns(draws)
    return _apply(graded, memory, moves)


def carry_second_moment(state: DataFrame) -> DataFrame:
    """Start a sampler from an optimizer's state: keep v (0 where missing), reset m."""
    updates = {f"v_{c}": F.coalesce(F.col(f"v_{c}"), F.lit(0.0)) for c in COMPONENTS}
    updates |= {f"m_{c}": F.lit(0.0) for c in COMPONENTS}
    return state.withColumns(updates)
