"""Skew-proof building blocks against brute force, with thresholds low enough to use them."""

import collections
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorframe import lineage
from tremorframe.operators import observations as ops
from tremorframe.operators import scaling
from tremorframe.operators.scaling import (
    exact_quantiles,
    first_per_key,
    keep_frequent,
    number_rows,
    running_total,
)


def skewed(n, seed=0):
    """Keys of which one holds a third of all rows."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.uniform(size=n) < 1 / 3, 7, rng.integers(0, n // 5, n))
    return [int(k) for k in keys]


@pytest.mark.parametrize("hot_rows", [1, 5, 50, 10**6])
@pytest.mark.parametrize("min_rows", [1, 4, 9])
def test_keep_frequent(spark, hot_rows, min_rows):
    keys = skewed(900)
    df = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    counts = collections.Counter(keys)
    want = sorted(i for i, k in enumerate(keys) if counts[k] >= min_rows)
    got = keep_frequent(df, {"_k": F.col("k")}, min_rows, hot_rows)
    assert got.columns == ["i", "k"]
    assert sorted(r["i"] for r in got.collect()) == want


def test_first_per_key_reduces_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 5, "c")], "k long, o long, v string")
    out = first_per_key(df, ["k"], [F.col("o")])
    assert sorted(r["v"] for r in out.collect()) == ["b", "c"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_number_rows_is_dense_and_ordered(spark):
    keys = skewed(500, 1)
    df = spark.createDataFrame(list(enumerate(keys)), "i long, k long").repartition(6)
    rows = number_rows(df, "n", ["k", "i"]).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["k"], r["i"]))] == list(range(500))
    free = number_rows(df, "n").collect()
    assert sorted(r["n"] for r in free) == list(range(500))


def test_running_total(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(i), int(rng.integers(1, 9))) for g in "ab" for i in rng.choice(1000, 60, False)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r["g"], r["i"]): r["t"] for r in running_total(df, ["g"], "i", "v", "t", block=16).collect()}
    for g, i, _ in rows:
        assert got[g, i] == sum(v for h, j, v in rows if h == g and j <= i)


def _values(kind, n, rng):
    if kind == "normal":
        return rng.normal(size=n)
    if kind == "outlier":
        return np.concatenate([[1e12, -1e15], rng.normal(size=n)])[:n]
    if kind == "ties":
        return rng.integers(-2, 3, n).astype(float)
    if kind == "constant":
        return np.full(n, 3.25)
    return rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-12, 12, n)


@pytest.mark.parametrize("kind", ["normal", "outlier", "ties", "constant", "scales"])
@pytest.mark.parametrize("gather_rows", [0, 10**6])
def test_exact_quantiles_by_group(spark, kind, gather_rows):
    rng = np.random.default_rng(3)
    groups = {g: _values(kind, n, rng) for g, n in (("a", 301), ("b", 64), ("c", 1), ("d", 2))}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows + [("a", None), ("b", float("nan"))], "g string, x double")
    probs = {"lo": 0.005, "mid": 0.5, "hi": 0.995}
    linear = exact_quantiles(df, ["g"], "x", probs, gather_rows=gather_rows)
    for row in linear.collect():
        want = np.quantile(groups[row["g"]], list(probs.values()))
        assert [row[n] for n in probs] == pytest.approx(want, rel=1e-9, abs=1e-12)
    lower = exact_quantiles(df, ["g"], "x", {"m": 0.5}, lower=True, gather_rows=gather_rows)
    for row in lower.collect():
        xs = np.sort(groups[row["g"]])
        assert row["m"] == xs[(len(xs) - 1) // 2]


@pytest.mark.parametrize("gather_rows", [0, 10**6])
def test_exact_quantiles_ungrouped(spark, gather_rows):
    xs = np.random.default_rng(4).exponential(size=1000)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    row = exact_quantiles(df, [], "x", {"q": 0.9}, gather_rows=gather_rows).first()
    assert row["q"] == pytest.approx(np.quantile(xs, 0.9), rel=1e-12)


DT = "network string, station string, dt double, evid1 long, evid2 long, phase string, cc double"


def test_membership_and_unordered_filter_are_idempotent(spark):
    rng = np.random.default_rng(5)
    rows = [
        ("N", f"S{rng.integers(3)}", float(rng.normal()), int(a), int(b), "P", 0.9)
        for a, b in rng.integers(0, 8, (200, 2))
    ]
    rows += [("N", "S1", 0.1, 1, 2, "P", 0.9)] * 90
    df = spark.createDataFrame(rows, DT)
    origins = spark.createDataFrame([(i,) for i in range(6)], "evid long")
    once = ops.with_known_events(df, origins)
    assert sorted(ops.with_known_events(once, origins).collect()) == sorted(once.collect())
    kept = ops.min_rows_per_unordered_pair(df, 7)
    assert sorted(ops.min_rows_per_unordered_pair(kept, 7).collect()) == sorted(kept.collect())
    counts = collections.Counter(frozenset((r[3], r[4])) for r in rows)
    assert kept.count() == sum(n for n in counts.values() if n >= 7)


@pytest.mark.parametrize("infinite", [False, True])
def test_quantiles_of_widely_different_magnitudes(spark, monkeypatch, infinite):
    """Values over all magnitudes, with clusters, are narrowed down to a few rows, and no folder stays."""
    monkeypatch.setattr(scaling, "FINAL_ROWS", 3)
    rng = np.random.default_rng(4)
    spread = rng.choice([-1, 1], 200) * 10.0 ** rng.uniform(-300, 300, 200)
    values = np.concatenate([spread, 1e-200 * (1 + rng.uniform(0, 1e-9, 300)), np.zeros(5)])
    if infinite:
        values = np.concatenate([values, [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = {"a": 0.1, "b": 0.5, "c": 0.55, "d": 0.999}
    row = exact_quantiles(df, [], "x", probs, lower=True, gather_rows=0).first()
    ordered = np.sort(values)
    assert [row[n] for n in probs] == [ordered[max(int(np.ceil(p * len(values))) - 1, 0)] for p in probs.values()]
    folder = lineage.shared_dir(spark).removeprefix("file://")
    assert not glob.glob(f"{folder}/values-*")


def test_in_tasks_bounds_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(scaling, "TASK_ROWS", 50)
    df = spark.range(1000).selectExpr("id % 100 AS k", "id AS v")
    tasks = scaling.in_tasks(df, ["k"], 1000).withColumn("p", F.spark_partition_id())
    assert tasks.agg(F.countDistinct("p")).first()[0] > 10
    assert tasks.groupBy("k").agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0] == 1
    assert scaling.in_tasks(df, ["k"], 10**9).rdd.getNumPartitions() == 200


def test_broadcasts_of_a_run_stay_small():
    # six steps send three tables of up to 64 bytes a row through the driver
    assert 6 * 3 * 64 * scaling.BROADCAST_ROWS < 300e6
