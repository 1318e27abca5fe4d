"""Objective, gradient and single steps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.queries_model import network_model
from tremorframe import lineage
from tremorframe.functions.travel_time import StraightRay
from tremorframe.operators import convergence, forward, objective, updates
from tremorframe.operators import observations as ops
from tremorframe.schemas import COMPONENTS

OBS = "evid1 long, evid2 long, dt double, X double, Y double, Z double, phase int"
PRIORS = objective.Priors()
UNC = (0.5, 0.8)


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(1)
    n = 12
    state = [
        (i, *map(float, rng.uniform(0, 20, 3)), *map(float, rng.normal(0, 0.2, 4)), *[0.0] * 8, 0.0)
        for i in range(n)
    ]
    names = ["evid", "x0", "y0", "z0", *COMPONENTS, *[f"{p}_{c}" for p in "mv" for c in COMPONENTS], "huber_sum"]
    obs = []
    for _ in range(150):
        a, b = rng.choice(n - 1, 2, replace=False)
        obs.append((int(a), int(b), float(rng.normal()), *map(float, rng.uniform(-30, 30, 3)), int(rng.integers(2))))
    return spark.createDataFrame(obs, OBS).cache(), spark.createDataFrame(state, names).cache()


def loss(obs, state, model):
    return objective.posterior(obs, state, model, UNC, PRIORS).first()["posterior_loss"]


@pytest.mark.parametrize("kind", ["ray", "network"])
def test_gradient_against_differences(scene, kind):
    obs, state = scene
    model = StraightRay() if kind == "ray" else network_model(8, 1, np.float64)
    graded = objective.event_gradient(obs, state, model, UNC, PRIORS, obs.count())
    exact = {r["evid"]: r for r in graded.collect()}
    assert len(exact) == 12
    step = 1e-5
    # event 11 has no observations: prior gradient only
    for evid, c in ((0, "dx"), (3, "dy"), (5, "dz"), (7, "dt"), (11, "dx")):
        bump = lambda d: state.withColumn(c, F.when(F.col("evid") == evid, F.col(c) + d).otherwise(F.col(c)))
        numeric = (loss(obs, bump(step), model) - loss(obs, bump(-step), model)) / (2 * step)
        assert exact[evid][f"g_{c}"] == pytest.approx(numeric, abs=1e-7), (evid, c)


def test_broadcast_and_shuffled_state_agree(scene):
    obs, state = scene
    grads = [
        sorted(
            tuple(round(v, 12) for v in r)
            for r in objective.event_gradient(obs, state, StraightRay(), UNC, PRIORS, 150, n_events=n)
            .select("evid", *[f"g_{c}" for c in COMPONENTS])
            .collect()
        )
        for n in (12, 10**12)
    ]
    assert grads[0] == grads[1]


def test_flipped_pairs_leave_the_likelihood(scene):
    obs, state = scene
    flipped = obs.selectExpr("evid2 AS evid1", "evid1 AS evid2", "-dt AS dt", "X", "Y", "Z", "phase")
    a = objective.likelihood(obs, state, StraightRay(), UNC).first()
    b = objective.likelihood(flipped, state, StraightRay(), UNC).first()
    assert a["n_obs"] == b["n_obs"]
    assert a["likelihood_loss"] == pytest.approx(b["likelihood_loss"], rel=1e-12)


def test_loss_from_step_matches_posterior(scene):
    obs, state = scene
    n = obs.count()
    graded = objective.event_gradient(obs, state, StraightRay(), UNC, PRIORS, n)
    after = updates.adam_update(graded, 1, 1e-3)
    got = objective.loss_from_state(state, after, n, n, PRIORS).first()["loss"]
    assert got == pytest.approx(loss(obs, state, StraightRay()), rel=1e-12)
    assert after.columns == [c for c in state.columns]


def test_minibatch_gradient_uses_its_own_mean(scene):
    obs, state = scene
    part = obs.filter("dt > 0").cache()
    k = part.count()
    a = objective.event_gradient(part, state, StraightRay(), UNC, PRIORS, 150, k)
    b = objective.event_gradient(part, state, StraightRay(), UNC, PRIORS, k)
    row = lambda df: df.filter("evid = 11").first()["g_dx"]
    # an event without data sees the prior alone, over the full count
    assert row(a) * 150 == pytest.approx(row(b) * k, rel=1e-12)


def graded_state(spark, n=3000):
    base = spark.range(n).selectExpr("id AS evid", "0D AS x0", "0D AS y0", "0D AS z0")
    zero = {f"{p}{c}": F.lit(0.0) for p in ("", "m_", "v_") for c in COMPONENTS}
    grads = {f"g_{c}": F.lit(0.1 * (i + 1)) for i, c in enumerate(COMPONENTS)}
    return base.withColumns({**zero, "huber_sum": F.lit(0.0), **grads})


def test_noise_has_the_stated_spread(spark):
    lr, n_obs, beta, eps = 1e-3, 7, 0.99, 1e-5
    df = graded_state(spark)
    quiet = updates.langevin_update(df, 1, n_obs, lr=lr).first()
    noisy = updates.langevin_update(df, 1, n_obs, lr=lr, noise_scale=0.5, seed=4).collect()
    for i, c in enumerate(COMPONENTS):
        g = 0.1 * (i + 1)
        metric = 1 / (eps + math.sqrt((1 - beta) * g * g))
        diff = np.array([r[c] for r in noisy]) - quiet[c]
        want = math.sqrt(2 * lr) * math.sqrt(metric) * 0.5
        assert diff.std() == pytest.approx(want, rel=0.05)
        assert diff.mean() == pytest.approx(0, abs=4 * want / math.sqrt(3000))


def test_noise_survives_repartitioning(spark):
    df = graded_state(spark, 200)
    one = updates.langevin_update(df, 2, 7, noise_scale=1.0).orderBy("evid").collect()
    two = updates.langevin_update(df.repartition(9), 2, 7, noise_scale=1.0).orderBy("evid").collect()
    assert one == two


def test_plain_sampler_step(spark):
    row = updates.langevin_update(graded_state(spark, 1), 1, 10, lr=0.5, preconditioning=False).first()
    assert [row[c] for c in COMPONENTS] == pytest.approx([-0.5 * 10 * 0.1 * i for i in (1, 2, 3, 4)])
    row = updates.langevin_update(
        graded_state(spark, 1), 1, 10, lr=0.5, preconditioning=False, scale_by_n_obs=False
    ).first()
    assert row["dx"] == pytest.approx(-0.05)


@pytest.mark.parametrize(
    "bad",
    [{"lr": -1.0}, {"beta": 1.0}, {"beta": -0.1}, {"eps": -1e-9}, {"n_obs": 0}, {"preconditioner": "sgd"}],
)
def test_sampler_rejects(spark, bad):
    args = {"n_obs": 10, **bad}
    with pytest.raises(ValueError):
        updates.langevin_update(graded_state(spark, 1), 1, **args)


def test_transplant(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "evid long, v_dx double, m_dx double")
    df = df.withColumns({f"{p}_{c}": F.lit(1.5) for p in "mv" for c in COMPONENTS[1:]})
    row = updates.carry_second_moment(df).first()
    assert (row["v_dx"], row["m_dx"], row["v_dy"], row["m_dt"]) == (0.0, 0.0, 1.5, 0.0)


def test_gaussian_target_moments(spark):
    """The prior alone, sampled without data, has the prior's spread."""
    n_events = 4000
    df = graded_state(spark, n_events).drop(*[f"g_{c}" for c in COMPONENTS])
    std, lr = 0.5, 0.05
    for step in range(1, 41):
        graded = df.withColumns({f"g_{c}": F.col(c) / (std * std) for c in COMPONENTS})
        df = updates.langevin_update(graded, step, 1, lr=lr, preconditioning=False, noise_scale=1.0)
        if step % 5 == 0:
            df = lineage.cut(df)
    x = np.array([r["dx"] for r in df.select("dx").collect()])
    # stationary variance of the discretised chain x <- (1 - a) x + sqrt(2 lr) z
    a = lr / std**2
    want = math.sqrt(2 * lr / (1 - (1 - a) ** 2))
    assert x.mean() == pytest.approx(0, abs=0.04)
    assert x.std() == pytest.approx(want, rel=0.05)


def test_plateau_rules(spark):
    flat = [("a", i, 1.0 if i % 4 in (1, 2) else 0.0) for i in range(52)]
    slope = [("b", i, 5.0 - 0.1 * i) for i in range(50)]
    short = [("c", i, float(i)) for i in range(10)]
    old = [("d", i, 100.0 - i if i < 30 else 1.0) for i in range(50)]
    df = spark.createDataFrame(flat + slope + short + old, "run_id string, step long, loss double")
    got = {r["run_id"]: r for r in convergence.loss_plateau(df, win=20, rel_slope=8.0).collect()}
    assert {k: r["plateau"] for k, r in got.items()} == {"a": True, "b": False, "c": True, "d": True}
    y = np.array([r[2] for r in slope][-20:])
    assert got["b"]["slope_per_1000"] == pytest.approx(np.polyfit(np.arange(20), y, 1)[0] * 1000)


def test_shift_stats_against_numpy(scene):
    _, state = scene
    d = np.array([[r[c] for c in COMPONENTS[:3]] for r in state.collect()])
    radius = np.sqrt((d**2).sum(axis=1))
    for gather in (0, 10**6):
        row = forward.shift_stats(state, gather_rows=gather).first()
        for i, a in enumerate("XYZ"):
            assert row[f"mean_d{a}"] == pytest.approx(d[:, i].mean())
            assert row[f"median_abs_d{a}"] == np.sort(np.abs(d[:, i]))[5]
        assert row["max_radius"] == pytest.approx(radius.max())
        assert row["quantile_90_radius"] == pytest.approx(np.quantile(radius, 0.9))


def test_observations_matched_with_the_catalog_move_once_more_for_their_sources(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        origins = spark.range(9).selectExpr("id AS evid", "1D AS x0", "1D AS y0", "1D AS z0", "0D AS dx", "0D AS dy", "0D AS dz", "0D AS dt")
        obs = spark.range(40).selectExpr("id % 10 AS evid1", "(id + 1) % 10 AS evid2", "0.1D AS dt", "id AS arid")
        joined = forward.attach_sources(ops.with_known_events(obs, origins), origins)
        text = joined._jdf.queryExecution().executedPlan().toString()
        # four of events, and three of the observations: those of the second source lie in place
        assert text.count("Exchange hashpartitioning(evid1") + text.count("Exchange hashpartitioning(evid2") == 7
        assert joined.count() == 32
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
