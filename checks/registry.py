"""Registration of queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: Optional[str] = None) -> Callable[[Query], Query]:
    """Register the function under its own name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round the named columns (all doubles by default); engines differ in the last bits."""
    names = names or tuple(n for n, t in df.dtypes if t in ("double", "float"))
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})
