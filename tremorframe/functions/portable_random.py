"""Random numbers that depend on row keys only.

``rand``/``randn`` depend on how rows fall into partitions, so a recomputed partition may draw other
values. These columns hash the row's own key instead: a retried task, another partitioning or
another SQL engine gives the same number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13
_SPAN = float(16**_HEX_DIGITS)


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def _unit(digest: Column, start: int) -> Column:
    digits = F.substring(digest, start, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / _SPAN


def uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from the joint key ``parts``."""
    return _unit(_digest(*parts), 1)


def uniform_pair(*parts: Column) -> tuple[Column, Column]:
    """Two independent uniforms in [0, 1) from one digest."""
    digest = _digest(*parts)
    return _unit(digest, 1), _unit(digest, 1 + _HEX_DIGITS)


def gaussian(*parts: Column) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u, w = uniform_pair(*parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * w)
