"""Travel-time models for joined observations.

A model is anything with ``attach(df, gradients)``: given rows that carry the receiver ``X, Y, Z``,
``phase`` and both source positions ``x1, y1, z1`` and ``x2, y2, z2``, it adds ``t1`` and ``t2``
and, on request, the gradients ``g1x .. g1z`` and ``g2x .. g2z`` with respect to each source. A model
whose ``costly`` is true wants all observations of a receiver and phase in one task.

Expressions of the iterated path are SQL text: one call per projection instead of one per operator.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame

RECEIVER = ("X", "Y", "Z")


def number(value: float) -> str:
    """A double literal."""
    return f"({float(value)!r}D)"


def reach(src: Sequence[str], rec: Sequence[str]) -> str:
    """Distance between two points given as column names."""
    squares = [f"({s} - {r}) * ({s} - {r})" for s, r in zip(src, rec)]
    return f"sqrt({' + '.join(squares)})"


def source(end: str) -> list[str]:
    return [f"{axis}{end}" for axis in "xyz"]


@dataclass(frozen=True)
class StraightRay:
    """The reference time alone: the learned correction is 1 everywhere."""

    vp: float = 6.0
    vs: float = 3.3

    @property
    def velocity(self) -> str:
        return f"CASE WHEN phase >= 0.5D THEN {number(self.vs)} ELSE {number(self.vp)} END"

    def attach(self, df: DataFrame, gradients: bool = False) -> DataFrame:
        reaches = [f"{reach(source(e), RECEIVER)} AS _d{e}" for e in "12"]
        timed = [f"_d{e} / _v AS t{e}" for e in "12"]
        if gradients:
            # a source at its receiver has no direction: gradient 0
            timed += [
                f"CASE WHEN _d{e} = 0 THEN 0D ELSE ({a}{e} - {r}) / (_v * nullif(_d{e}, 0D)) END"
                f" AS g{e}{a}"
                for e in "12"
                for a, r in zip("xyz", RECEIVER)
            ]
        near = df.selectExpr("*", *reaches, f"{self.velocity} AS _v")
        return near.selectExpr(*df.columns, *timed)

    def time(
        self, df: DataFrame, src: Sequence[str], rec: Sequence[str], name: str = "travel_time"
    ) -> DataFrame:
        """Add the travel time from ``src`` to ``rec`` (triples of column names)."""
        return df.selectExpr("*", f"{reach(src, rec)} / ({self.velocity}) AS {name}")

    def receiver_slowness(self, df: DataFrame, name: str = "slowness") -> DataFrame:
        """Gradient norm at the receiver; 1 / v for straight rays."""
        return df.selectExpr("*", f"1D / ({self.velocity}) AS {name}")
