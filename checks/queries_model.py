"""Queries of projection, travel time, objective, gradient, steps and whole relocations."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import network_sql as net
from checks import sql as q
from checks.registry import query, rounded
from tremorframe import lineage
from tremorframe.functions.geodesy import EqualArea, distance3
from tremorframe.functions.network import NetworkTravelTime, load_weights
from tremorframe.functions.velocity import profile_nodes, slowness_at
from tremorframe.operators import forward, objective, updates
from tremorframe.operators import observations as ops
from tremorframe.plans import relocate as plan
from tremorframe.plans.training_pairs import Box, training_pairs as make_pairs
from tremorframe.schemas import COMPONENTS, NETWORK_WEIGHTS
from tremorframe.sources import run_store, sample_store, tables

UNC, EV, CE = fx.PHASE_UNC, fx.PRIORS.event_std, fx.PRIORS.centroid_std
SCENE = [*q.BASE, q.STATE]


# --- projection, velocity, travel time -------------------------------------------------------------


@query(
    q.with_(q.ORIGINS, q.ORIGINS_XY)
    + f"SELECT evid, {q.r('x0', 7, 'x')}, {q.r('y0', 7, 'y')} FROM origins_xy"
)
def laea_forward(spark, sf_dir):
    x, y = EqualArea(*fx.CENTRE).forward(F.col("longitude"), F.col("latitude"))
    return rounded(fx.origins(spark, sf_dir).select("evid", x.alias("x"), y.alias("y")), 7)


_LON, _LAT = q.inverse_lonlat("x", "y")
_BACK_X = "100e0 + evid % 997 * 0.125e0"
_BACK_Y = "60e0 + evid % 991 * 0.125e0"


@query(
    q.with_(q.ORIGINS)
    + f"""SELECT evid, {q.r(_LON, 8, 'longitude')}, {q.r(_LAT, 8, 'latitude')}
FROM (SELECT evid, {_BACK_X} AS x, {_BACK_Y} AS y FROM origins)"""
)
def laea_inverse(spark, sf_dir):
    lon, lat = EqualArea(*fx.CENTRE).inverse(F.col("x"), F.col("y"))
    points = fx.origins(spark, sf_dir).selectExpr(
        "evid", f"{_BACK_X.replace('e0', 'D')} AS x", f"{_BACK_Y.replace('e0', 'D')} AS y"
    )
    return rounded(points.select("evid", lon.alias("longitude"), lat.alias("latitude")), 8)


@query(
    q.with_(q.ORIGINS, q.ORIGINS_XY, q.DTIMES, "pairs AS (SELECT DISTINCT evid1, evid2 FROM dtimes)")
    + f"""SELECT evid1, evid2, {q.r('sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)'
    ' + (a.z0 - b.z0) * (a.z0 - b.z0))', 6, 'distance')} FROM pairs JOIN origins_xy a ON evid1 = a.evid
JOIN origins_xy b ON evid2 = b.evid"""
)
def pair_distance(spark, sf_dir):
    base = forward.initial_state(fx.origins(spark, sf_dir), *fx.CENTRE)
    pairs = fx.dtimes(spark, sf_dir).select("evid1", "evid2").distinct()
    both = forward.attach_sources(pairs, base)
    at = lambda e: [F.col(f"{a}{e}") for a in "xyz"]
    return rounded(both.select("evid1", "evid2", distance3(*at(1), *at(2)).alias("distance")), 6)


_BRACKET = """bracket AS (SELECT depth AS z0, lead(depth) OVER w AS z1, vp AS p0, lead(vp) OVER w AS p1,
vs AS s0, lead(vs) OVER w AS s1 FROM velmod WINDOW w AS (ORDER BY depth))"""


@query(
    q.with_(q.ORIGINS, q.VELMOD, _BRACKET)
    + f"""SELECT evid, {q.r('1 / (p0 + (depth - z0) * (p1 - p0) / (z1 - z0))', 8, 'slowness_p')},
{q.r('1 / (s0 + (depth - z0) * (s1 - s0) / (z1 - z0))', 8, 'slowness_s')}
FROM origins JOIN bracket ON depth >= z0 AND (depth < z1 OR (depth = z1 AND z1 = 20e0))"""
)
def velocity_lookup(spark, sf_dir):
    path = lineage.scratch_path(spark, "velmod") + ".csv"
    fx.velocity_model(spark).write.option("header", True).csv(path)
    nodes = profile_nodes(tables.read_velocity_model(spark, path))
    at = lambda phase: slowness_at(nodes, F.col("depth"), F.lit(phase))
    return rounded(
        fx.origins(spark, sf_dir).select("evid", at(0).alias("slowness_p"), at(1).alias("slowness_s")),
        8,
    )


@query(
    q.with_(*SCENE, q.predicted("p", "state"))
    + f"""SELECT network, station, evid1, evid2, dt, phase, cc, {q.r('d1 / v', 7, 't1')},
{q.r('d2 / v', 7, 't2')} FROM p"""
)
def travel_time(spark, sf_dir):
    obs, state = fx.observations_view(spark, sf_dir), fx.state(spark, sf_dir)
    timed = fx.MODEL.attach(forward.attach_sources(obs, state))
    names = ["network", "station", "evid1", "evid2", "dt", "phase", "cc", "t1", "t2"]
    return rounded(timed.select(*names), 7, "t1", "t2").withColumn("phase", F.col("phase").cast("int"))


@query(
    q.with_(*SCENE, q.predicted("p", "state"))
    + f"""SELECT network, station, evid1, evid2, dt, phase, cc, {q.r('dt_pred', 7, 'dt_pred')},
{q.r('dt - dt_pred', 7, 'residual')} FROM p"""
)
def residuals(spark, sf_dir):
    obs, state = fx.observations_view(spark, sf_dir), fx.state(spark, sf_dir)
    out = forward.residuals(obs, state, fx.MODEL)
    names = ["network", "station", "evid1", "evid2", "dt", "phase", "cc", "dt_pred", "residual"]
    shown = rounded(out.select(*names), 7, "dt_pred", "residual")
    return shown.withColumn("phase", F.col("phase").cast("int"))


def _mad(quantile):
    return (
        q.with_(
            *SCENE,
            q.predicted("p", "state"),
            "res AS (SELECT phase, dt - dt_pred AS r FROM p)",
            f"med AS (SELECT phase, {quantile}(r, 0.5) AS m FROM res GROUP BY phase)",
        )
        + f"""SELECT phase, count(*) AS n_obs, {q.r(f'{quantile}(abs(r - m), 0.5)', 8, 'mad')}
FROM res JOIN med USING (phase) GROUP BY phase"""
    )


@query(_mad("quantile_disc"))
def phase_mad(spark, sf_dir):
    obs, state = fx.observations_view(spark, sf_dir), fx.state(spark, sf_dir)
    out = forward.phase_mad(forward.residuals(obs, state, fx.MODEL))
    return rounded(out, 8).withColumn("phase", F.col("phase").cast("int"))


@query(_mad("quantile_cont"))
def phase_mad_averaging(spark, sf_dir):
    """The averaging median, forced through the counting passes that large groups take."""
    obs, state = fx.observations_view(spark, sf_dir), fx.state(spark, sf_dir)
    resid = forward.residuals(obs, state, fx.MODEL)
    out = forward.phase_mad(resid, averaging=True, gather_rows=0)
    return rounded(out, 8).withColumn("phase", F.col("phase").cast("int"))


@query(
    q.with_(*SCENE)
    + f"""SELECT {q.r('avg(dx)', 9, 'mean_dX')}, {q.r('avg(dy)', 9, 'mean_dY')}, {q.r('avg(dz)', 9, 'mean_dZ')},
{q.r('quantile_disc(abs(dx), 0.5)', 9, 'median_abs_dX')}, {q.r('quantile_disc(abs(dy), 0.5)', 9, 'median_abs_dY')},
{q.r('quantile_disc(abs(dz), 0.5)', 9, 'median_abs_dZ')},
{q.r('max(sqrt(dx * dx + dy * dy + dz * dz))', 9, 'max_radius')},
{q.r('quantile_cont(sqrt(dx * dx + dy * dy + dz * dz), 0.9)', 9, 'quantile_90_radius')} FROM state"""
)
def shift_stats(spark, sf_dir):
    return rounded(forward.shift_stats(fx.state(spark, sf_dir)), 9)


# --- objective and gradient ------------------------------------------------------------------------


@query(
    q.with_(*SCENE, q.predicted("p", "state"))
    + f"SELECT count(*) AS n_obs, {q.r('avg(h)', 9, 'likelihood_loss')} FROM {q.scaled('p', UNC)}"
)
def huber_loss(spark, sf_dir):
    obs, state = fx.observations_view(spark, sf_dir), fx.state(spark, sf_dir)
    return rounded(objective.likelihood(obs, state, fx.MODEL, UNC), 9)


_PRIORS = f"""pr AS (SELECT count(*) AS n_events, sum({q.nll(COMPONENTS, EV)}) AS event_prior,
avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz, avg(dt) AS dt FROM state),
pt AS (SELECT n_events, event_prior, {q.nll(COMPONENTS, CE)} * n_events AS centroid_prior FROM pr)"""


@query(
    q.with_(*SCENE, _PRIORS)
    + f"""SELECT n_events, {q.r('event_prior', 5, 'event_prior')}, {q.r('centroid_prior', 5, 'centroid_prior')},
{q.r('(event_prior + centroid_prior) / (SELECT count(*) FROM obs)', 8, 'prior_loss')} FROM pt"""
)
def prior_terms(spark, sf_dir):
    n_obs = fx.observations_view(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    out = objective.prior_terms(fx.state(spark, sf_dir), n_obs, fx.PRIORS)
    return rounded(rounded(out, 5, "event_prior", "centroid_prior"), 8, "prior_loss")


def _posterior_sql(weight):
    return (
        q.with_(
            *SCENE,
            q.predicted("p", "state"),
            _PRIORS,
            f"fit AS (SELECT count(*) AS n_obs, avg(h) AS l FROM {q.scaled('p', UNC)})",
        )
        + f"""SELECT n_obs, {q.r(f'{weight} * l + (event_prior + centroid_prior) / n_obs', 6, 'posterior_loss')}
FROM pt, fit"""
    )


@query(_posterior_sql("1"))
def posterior(spark, sf_dir):
    obs, state = fx.observations_view(spark, sf_dir), fx.state(spark, sf_dir)
    out = objective.posterior(obs, state, fx.MODEL, UNC, fx.PRIORS)
    return rounded(out.select("n_obs", "posterior_loss"), 6)


@query(_posterior_sql("n_obs"))
def posterior_unnormalized(spark, sf_dir):
    obs, state = fx.observations_view(spark, sf_dir), fx.state(spark, sf_dir)
    out = objective.posterior(obs, state, fx.MODEL, UNC, fx.PRIORS, normalize=False)
    return rounded(out.select("n_obs", "posterior_loss"), 6)


def _n_obs(spark, sf_dir):
    return fx.observations_view(spark, sf_dir).count()


def _graded(spark, sf_dir, state=None):
    obs = fx.observations_view(spark, sf_dir)
    n_obs = obs.count()
    state = fx.warm_state(spark, sf_dir) if state is None else state
    return objective.event_gradient(obs, state, fx.MODEL, UNC, fx.PRIORS, n_obs), n_obs


# gradients are about 1e-5; scaled so that rounding keeps digits that matter
_SHOW_GRADIENT = ", ".join(q.r(f"g_{c} * 1e6", 6, f"g_{c}") for c in COMPONENTS)


@query(
    q.with_(*SCENE, q.gradient("g", "state", UNC, EV, CE)) + f"SELECT evid, {_SHOW_GRADIENT} FROM g"
)
def event_gradient(spark, sf_dir):
    graded, _ = _graded(spark, sf_dir, fx.state(spark, sf_dir))
    out = graded.select("evid", *[(F.col(f"g_{c}") * 1e6).alias(f"g_{c}") for c in COMPONENTS])
    return rounded(out, 6)


@query(
    q.with_(*SCENE, q.gradient("g", "state", UNC, EV, CE)) + f"SELECT evid, {_SHOW_GRADIENT} FROM g"
)
def blocked_gradient(spark, sf_dir):
    """The gradient as it is found for states too large to broadcast: the state goes to the observations."""
    obs, origins = fx.observations_view(spark, sf_dir), fx.origins(spark, sf_dir)
    run = plan.start_run(origins, obs, fx.PARAMS, fx.MODEL, broadcast_events=0, block_events=5000, block_rows=100_000)
    state = fx.state(spark, sf_dir)
    with run.planning():
        graded = objective.event_gradient(run.obs, state, fx.MODEL, UNC, fx.PRIORS, run.n_obs, None, run.n_events)
        out = graded.select("evid", *[(F.col(f"g_{c}") * 1e6).alias(f"g_{c}") for c in COMPONENTS])
        out = lineage.as_table(rounded(out, 6), "gradient")
    plan.end_run(run, keep_state=False)
    return out


@query(
    q.with_(*q.BASE)
    + f"""SELECT evid1, evid2, phase, count(*) AS first_epoch, count(*) AS second_epoch, {q.r('sum(dt)', 6, 'sum_dt')}
FROM obs GROUP BY evid1, evid2, phase"""
)
def minibatch_epoch(spark, sf_dir):
    """Rows of two epochs of minibatches: each row comes once in each."""
    obs, origins = fx.observations_view(spark, sf_dir), fx.origins(spark, sf_dir)
    run = plan.start_run(origins, obs, fx.PARAMS, fx.MODEL)
    rows = [part.withColumn("epoch", F.lit(e)) for e in range(2) for part, _ in plan.minibatches(run, run.n_obs // 5, e)]
    every = rows[0]
    for part in rows[1:]:
        every = every.unionByName(part)
    found = every.groupBy("evid1", "evid2", F.col("phase").cast("int").alias("phase")).agg(
        F.count_if(F.col("epoch") == 0).alias("first_epoch"),
        F.count_if(F.col("epoch") == 1).alias("second_epoch"),
        F.sum(F.when(F.col("epoch") == 1, F.col("dt"))).alias("sum_dt"),
    )
    found = lineage.as_table(rounded(found, 6, "sum_dt"), "epochs")
    plan.end_run(run, keep_state=False)
    return found


WARM_SCENE = [*SCENE, q.WARM, q.gradient("g", "warm", UNC, EV, CE)]


def _show(moves=9, first=12, second=16, with_first=True):
    parts = [q.r(c, moves, c) for c in COMPONENTS]
    if with_first:
        parts += [q.r(f"m_{c} * 1e6", first - 6, f"m_{c}") for c in COMPONENTS]
    parts += [q.r(f"v_{c} * 1e11", second - 11, f"v_{c}") for c in COMPONENTS]
    return ", ".join(parts)


def _shown(df, moves=9, first=12, second=16, with_first=True):
    out = df.select("evid", *COMPONENTS, *[f"{p}_{c}" for p in "mv" for c in COMPONENTS])
    out = out.withColumns(
        {f"m_{c}": F.round(F.col(f"m_{c}") * 1e6, first - 6) for c in COMPONENTS}
        | {f"v_{c}": F.round(F.col(f"v_{c}") * 1e11, second - 11) for c in COMPONENTS}
        | {c: F.round(c, moves) for c in COMPONENTS}
    )
    return out if with_first else out.drop(*[f"m_{c}" for c in COMPONENTS])


@query(q.with_(*WARM_SCENE, q.adam("s", "g", 3, 2e-3)) + f"SELECT evid, {_show()} FROM s")
def adam_step(spark, sf_dir):
    graded, _ = _graded(spark, sf_dir)
    return _shown(updates.adam_update(graded, 3, 2e-3))


_N = "(SELECT count(*) FROM obs)"


@query(
    q.with_(*WARM_SCENE, q.langevin("s", "g", _N, 3, 1e-9))
    + f"SELECT evid, {_show(with_first=False)} FROM s"
)
def psgld_step_no_noise(spark, sf_dir):
    graded, n_obs = _graded(spark, sf_dir)
    return _shown(updates.langevin_update(graded, 3, n_obs, lr=1e-9), with_first=False)


@query(
    q.with_(*WARM_SCENE, q.langevin("s", "g", _N, 3, 1e-9, adam_like=True))
    + f"SELECT evid, {_show(with_first=False)} FROM s"
)
def psgld_step_adam_preconditioner(spark, sf_dir):
    graded, n_obs = _graded(spark, sf_dir)
    stepped = updates.langevin_update(graded, 3, n_obs, lr=1e-9, preconditioner="adam")
    return _shown(stepped, with_first=False)


@query(
    q.with_(*WARM_SCENE, q.langevin("s", "g", _N, 3, 1e-9, noise_scale=0.5, seed=7, noise_step=11))
    + f"SELECT evid, {_show(with_first=False)} FROM s"
)
def psgld_step_noise(spark, sf_dir):
    graded, n_obs = _graded(spark, sf_dir)
    stepped = updates.langevin_update(
        graded, 3, n_obs, lr=1e-9, noise_scale=0.5, seed=7, noise_step=11
    )
    return _shown(stepped, with_first=False)


@query(
    q.with_(*SCENE, q.WARM)
    + "SELECT evid, "
    + ", ".join(q.r(f"v_{c} * 1e11", 6, f"v_{c}") for c in COMPONENTS)
    + ", 0e0 AS m_dx FROM warm"
)
def carry_second_moment(spark, sf_dir):
    out = updates.carry_second_moment(fx.warm_state(spark, sf_dir))
    kept = [F.round(F.col(f"v_{c}") * 1e11, 6).alias(f"v_{c}") for c in COMPONENTS]
    return out.select("evid", *kept, "m_dx")


@query(
    q.with_(q.ORIGINS, q.ORIGINS_XY, q.COLD)
    + f"SELECT evid, {q.r('x0', 7, 'x0')}, {q.r('y0', 7, 'y0')}, z0, dx, dy, dz, dt FROM cold"
)
def initial_state(spark, sf_dir):
    out = forward.initial_state(fx.origins(spark, sf_dir), *fx.CENTRE)
    return rounded(out.select("evid", "x0", "y0", "z0", *COMPONENTS), 7, "x0", "y0")


_RLON, _RLAT = q.inverse_lonlat("x", "y")
_CATALOG = (
    f"""SELECT evid, {q.r(_RLON, 8, 'longitude')}, {q.r(_RLAT, 8, 'latitude')}, {q.r('z', 8, 'depth')},
{q.r('x', 7, '"X"')}, {q.r('y', 7, '"Y"')}, {q.r('t', 8, '"T_src"')},
strftime(time, '%Y-%m-%d %H:%M:%S') AS time"""
)


@query(
    q.with_(*SCENE)
    + f"""{_CATALOG}, CAST(NULL AS DOUBLE) AS unc_x,
strftime(time + to_microseconds(CAST(round(t * 1e6) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS time_shifted
FROM (SELECT s.evid, x0 + dx AS x, y0 + dy AS y, z0 + dz AS z, dt AS t, time
FROM state s JOIN origins o ON s.evid = o.evid)"""
)
def relocated_catalog(spark, sf_dir):
    out = forward.relocated_catalog(
        fx.origins(spark, sf_dir), fx.state(spark, sf_dir), *fx.CENTRE, shift_time=True
    )
    return _catalog(out).select(
        *_CATALOG_NAMES,
        "unc_x",
        F.date_format("time_shifted", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_shifted"),
    )


_CATALOG_NAMES = ["evid", "longitude", "latitude", "depth", "X", "Y", "T_src", "time"]


def _catalog(df):
    out = rounded(df, 8, "longitude", "latitude", "depth", "T_src")
    return rounded(out, 7, "X", "Y").withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query(
    q.with_(*SCENE)
    + f"""{_CATALOG} FROM (SELECT s.evid, x0 + dx AS x, y0 + dy AS y, z0 + dz AS z, dt AS t, time
FROM state s JOIN origins o ON s.evid = o.evid)"""
)
def catalog_write(spark, sf_dir):
    """Relocated catalog written as CSV and read back."""
    out = forward.relocated_catalog(
        fx.origins(spark, sf_dir), fx.state(spark, sf_dir), *fx.CENTRE
    )
    path = tables.map_catalog_path(lineage.scratch_path(spark, "catalog"))
    tables.write_catalog(out, path)
    back = tables.read_catalog(spark, path)
    back = back.withColumns({n: F.col(n).cast("double") for n in ("X", "Y", "T_src")})
    return _catalog(back).select(*_CATALOG_NAMES)


# --- whole runs ------------------------------------------------------------------------------------


def _run_params(spark, **changes):
    return replace(
        fx.PARAMS,
        phase_unc=UNC,
        samples_outfile=lineage.scratch_path(spark, "samples"),
        checkpoint_dir=lineage.scratch_path(spark, "checkpoints"),
        metrics_outfile=lineage.scratch_path(spark, "metrics"),
        phase3_epochs=0,
        metrics_every=1000,
        **changes,
    )


_MAP_STEPS = [q.COLD]
for _k in range(3):
    _from = "cold" if _k == 0 else f"s{_k}"
    _MAP_STEPS += [
        q.gradient(f"g{_k + 1}", _from, UNC, EV, CE),
        q.adam(f"s{_k + 1}", f"g{_k + 1}", _k + 1, 2e-3),
    ]


@query(
    q.with_(*q.BASE, *_MAP_STEPS) + f"SELECT evid, {_show(moves=8, first=11, second=15)} FROM s3"
)
def map_relocation(spark, sf_dir):
    """Three epochs of MAP descent."""
    params = _run_params(spark, phase1_epochs=3)
    run = plan.start_run(
        fx.origins(spark, sf_dir), fx.observations_view(spark, sf_dir), params, fx.MODEL
    )
    plan.map_phase(run)
    plan.end_run(run)
    return _shown(run.state, moves=8, first=11, second=15)


_LR = 1e-9
_SGLD_STEPS = [q.COLD]
_PLAN = [("adam", 0.0), ("drift", 0.0), ("ramp", 0.5), ("ramp", 1.0), ("draw", 1.0), ("draw", 1.0)]
for _k, (_kind, _noise) in enumerate(_PLAN):
    _from = "cold" if _k == 0 else f"s{_k}"
    _SGLD_STEPS.append(q.gradient(f"g{_k + 1}", _from, UNC, EV, CE))
    if _kind == "adam":
        _SGLD_STEPS.append(q.adam(f"s{_k + 1}", f"g{_k + 1}", _k + 1, 2e-3))
    else:
        _SGLD_STEPS.append(
            q.langevin(
                f"s{_k + 1}", f"g{_k + 1}", _N, _k, _LR, noise_scale=_noise, seed=3, noise_step=_k
            )
        )
_SLON, _SLAT = q.inverse_lonlat("x0 + dx", "y0 + dy")


@query(
    q.with_(*q.BASE, *_SGLD_STEPS)
    + f"""SELECT evid, draw, CAST(0 AS BIGINT) AS batch_id, {q.r(q.single(_SLON), 3, 'longitude')},
{q.r(q.single(_SLAT), 3, 'latitude')}, {q.r(q.single('z0 + dz'), 3, 'depth')},
{q.r(q.single('dt'), 4, 'delta_t')}, {q.r(q.single('dx'), 4, '"X"')}, {q.r(q.single('dy'), 4, '"Y"')},
{q.r(q.single('dz'), 4, '"Z"')}
FROM (SELECT *, CAST(0 AS BIGINT) AS draw FROM s5 UNION ALL SELECT *, CAST(1 AS BIGINT) FROM s6)"""
)
def langevin_run(spark, sf_dir):
    """All four phases with keyed noise; the stored draws of the last one."""
    params = _run_params(
        spark,
        phase1_epochs=1,
        phase2_epochs=1,
        phase4_epochs=2,
        lr_sgld=_LR,
        save_every_n=1,
        noise_seed=3,
    )
    params = replace(params, phase3_epochs=2)
    plan.relocate(fx.origins(spark, sf_dir), fx.observations_view(spark, sf_dir), params, fx.MODEL)
    stored = sample_store.read_samples(spark, params.samples_outfile)
    out = rounded(stored, 3, "longitude", "latitude", "depth")
    return rounded(out, 4, "delta_t", "X", "Y", "Z")


@query(
    q.with_(*SCENE, q.WARM)
    + f"""SELECT 'phase4' AS phase, CAST(7 AS BIGINT) AS epoch, CAST(1 AS BIGINT) AS seq, evid,
{q.r('dx', 9, 'dx')}, {q.r('v_dt * 1e11', 6, 'v_dt')} FROM warm"""
)
def latest_checkpoint(spark, sf_dir):
    """Two checkpoints written, the newest read back."""
    store = run_store.RunStore(spark, lineage.scratch_path(spark, "checkpoints"))
    first, second = fx.state(spark, sf_dir), fx.warm_state(spark, sf_dir)
    store.save(first, "phase1", 99, 10, "Adam", 100, 100)
    store.save(second, "phase4", 7, 10, "pSGLD", 8, 108, {"max_radius": 1.0})
    row, events = store.load()
    return events.select(
        F.lit(row["phase"]).alias("phase"),
        F.lit(row["epoch"]).cast("long").alias("epoch"),
        F.lit(row["seq"]).cast("long").alias("seq"),
        "evid",
        F.round("dx", 9).alias("dx"),
        F.round(F.col("v_dt") * 1e11, 6).alias("v_dt"),
    )


@query(
    q.with_(*SCENE, q.WARM)
    + f"""SELECT 'phase4' AS phase, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS left_after_clearing, evid,
{q.r('dx', 9, 'dx')} FROM warm"""
)
def checkpoint_clear(spark, sf_dir):
    """Checkpoints that are cleared are gone, and the next one has number 0 again."""
    store = run_store.RunStore(spark, lineage.scratch_path(spark, "checkpoints"))
    store.save(fx.state(spark, sf_dir), "phase1", 99, 10, "Adam", 100, 100)
    store.clear()
    left = 0 if store.load() is None else 1
    store.save(fx.warm_state(spark, sf_dir), "phase4", 7, 10, "pSGLD", 8, 108)
    row, events = store.load()
    return events.select(
        F.lit(row["phase"]).alias("phase"),
        F.lit(row["seq"]).cast("long").alias("seq"),
        F.lit(left).cast("long").alias("left_after_clearing"),
        "evid",
        F.round("dx", 9).alias("dx"),
    )


_RESUMED_STEPS = [*_MAP_STEPS, q.gradient("g4", "s3", UNC, EV, CE), q.adam("s4", "g4", 4, 2e-3)]


@query(
    q.with_(*q.BASE, *_RESUMED_STEPS) + f"SELECT evid, {_show(moves=8, first=11, second=15)} FROM s4"
)
def resumed_relocation(spark, sf_dir):
    """Two epochs of descent, then a second start that runs the stored epoch and one more: four steps in a row."""
    origins, obs = fx.origins(spark, sf_dir), fx.observations_view(spark, sf_dir)
    params = _run_params(spark, phase1_epochs=2)
    first = plan.start_run(origins, obs, params, fx.MODEL)
    plan.map_phase(first)
    plan.end_run(first, keep_state=False)
    run = plan.start_run(origins, obs, replace(params, phase1_epochs=3), fx.MODEL)
    entry = plan.resume_point(run)
    plan.map_phase(run, entry.epoch)
    plan.end_run(run)
    return _shown(run.state, moves=8, first=11, second=15)


_METRICS = [
    q.COLD,
    q.gradient("g1", "cold", UNC, EV, CE),
    q.adam("s1", "g1", 1, 2e-3),
    q.predicted("before", "cold"),
    q.predicted("after", "s1"),
    f"fit AS (SELECT count(*) AS n_obs, avg(h) AS l FROM {q.scaled('before', UNC)})",
    _PRIORS.replace("FROM state", "FROM cold"),
    "res AS (SELECT phase, dt - dt_pred AS r FROM after)",
    "med AS (SELECT phase, quantile_disc(r, 0.5) AS m FROM res GROUP BY phase)",
    "mad AS (SELECT phase, quantile_disc(abs(r - m), 0.5) AS mad FROM res JOIN med USING (phase) GROUP BY phase)",
]


@query(
    q.with_(*q.BASE, *_METRICS)
    + f"""SELECT 'phase1' AS phase, CAST(0 AS BIGINT) AS epoch,
(SELECT {q.r('l + (event_prior + centroid_prior) / n_obs', 6, 'v')} FROM pt, fit) AS loss,
{q.r('avg(dx)', 9, '"mean_dX"')}, {q.r('quantile_disc(abs(dz), 0.5)', 9, '"median_abs_dZ"')},
{q.r('max(sqrt(dx * dx + dy * dy + dz * dz))', 9, 'max_radius')},
{q.r('quantile_cont(sqrt(dx * dx + dy * dy + dz * dz), 0.9)', 9, 'quantile_90_radius')},
(SELECT {q.r('mad', 7, 'v')} FROM mad WHERE phase = 0) AS mad_p, (SELECT {q.r('mad', 7, 'v')} FROM mad WHERE phase = 1) AS mad_s
FROM s1"""
)
def run_metrics(spark, sf_dir):
    """The logged row of one epoch of descent, read back from the metrics table."""
    params = replace(_run_params(spark, phase1_epochs=1), metrics_every=1)
    origins, obs = fx.origins(spark, sf_dir), fx.observations_view(spark, sf_dir)
    run = plan.start_run(origins, obs, params, fx.MODEL)
    plan.map_phase(run)
    plan.end_run(run, keep_state=False)
    logged = run_store.read_metrics(spark, params.metrics_outfile)
    stats = ["mean_dX", "median_abs_dZ", "max_radius", "quantile_90_radius"]
    shown = rounded(logged.select("phase", "epoch", "loss", *stats, "mad_p", "mad_s"), 9, *stats)
    return rounded(rounded(shown, 6, "loss"), 7, "mad_p", "mad_s")


_PROBE_STEPS = [
    q.COLD,
    q.gradient("g1", "cold", UNC, EV, CE),
    q.langevin("s1", "g1", _N, 1, 1e-9),
    q.gradient("g2", "s1", UNC, EV, CE),
    q.langevin("s2", "g2", _N, 2, 0.5e-9),
]


@query(
    q.with_(*q.BASE, *_PROBE_STEPS)
    + f"SELECT evid, {_show(with_first=False)}, 0.25e0 AS share_accepted FROM s2"
)
def step_size_probe(spark, sf_dir):
    """A loss that never counts as flat halves the step twice; the state moves on meanwhile."""
    params = _run_params(spark, lr_sgld=1e-9)
    run = plan.start_run(fx.origins(spark, sf_dir), fx.observations_view(spark, sf_dir), params, fx.MODEL)
    accepted = plan.probe_step_size(run, max_halves=1, win=1, rel_slope=-1.0)
    plan.end_run(run)
    return _shown(run.state, with_first=False).withColumn("share_accepted", F.round(F.lit(accepted / 1e-9), 6))


# --- learned travel time -----------------------------------------------------------------------------


def network_weights(width: int = net.WIDTH, blocks: int = net.BLOCKS):
    """Rows of a weights table of the full architecture, by a fixed rule."""
    sizes = [(width, 4)] + [(width, width)] * (2 * blocks) + [(1, width)]
    rows = []
    for k, (n_out, n_in) in enumerate(sizes):
        i = np.arange(n_out * n_in, dtype=np.float64)
        w = np.sin(1.0 + 0.7 * i + 3.0 * k) / np.sqrt(n_in)
        rows.append((k, n_out, n_in, w.tolist(), (0.1 * np.cos(np.arange(n_out) + k)).tolist()))
    return rows


def network_model(width: int = net.WIDTH, blocks: int = net.BLOCKS, dtype=np.float32) -> NetworkTravelTime:
    layers = [(np.reshape(w, (n_out, n_in)), np.array(b)) for _, n_out, n_in, w, b in network_weights(width, blocks)]
    return NetworkTravelTime(layers, scale=net.SCALE, dtype=dtype)


def stored_network(spark) -> NetworkTravelTime:
    """The network in double precision, its weights written as a table and loaded from it."""
    path = lineage.scratch_path(spark, "weights")
    try:
        spark.createDataFrame(network_weights(), NETWORK_WEIGHTS).write.parquet(path)
        return NetworkTravelTime(load_weights(spark.read.parquet(path)), scale=net.SCALE, dtype=np.float64)
    finally:
        lineage.remove(spark, path)


_FLAT = "sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry))"
_FEATURES = [f"{_FLAT} / {net.SCALE}", f"z / {net.SCALE}", f"rz / {net.SCALE}", "CAST(phase AS DOUBLE)"]
# one row per event, receiver and phase
_TRIPLES = """ends AS MATERIALIZED (
SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT * FROM (
SELECT evid1 AS evid, phase, x1 AS x, y1 AS y, z1 AS z, d1 / v AS t0, "X" AS rx, "Y" AS ry, "Z" AS rz FROM p UNION ALL
SELECT evid2, phase, x2, y2, z2, d2 / v, "X", "Y", "Z" FROM p))),
timed AS MATERIALIZED (SELECT evid, phase, rx, ry, rz, t0 * c AS t FROM ends JOIN o USING (id))"""


def _timed(end):
    at = " AND ".join(f't{end}.r{a.lower()} = p."{a}"' for a in "XYZ")
    return f"JOIN timed t{end} ON t{end}.evid = p.evid{end} AND t{end}.phase = p.phase AND {at}"


@query(
    q.with_(
        *SCENE,
        q.predicted("p", "state"),
        net.weights(),
        _TRIPLES.split(",\ntimed")[0],
        *net.network("o", "ends", "id", _FEATURES),
        "timed" + _TRIPLES.split(",\ntimed")[1],
    )
    + f"""SELECT p.network, p.station, evid1, evid2, p.phase, {q.r('t1.t', 7, 't1')}, {q.r('t2.t', 7, 't2')}
FROM p {_timed(1)} {_timed(2)}"""
)
def network_travel_time(spark, sf_dir):
    obs, state = fx.observations_view(spark, sf_dir), fx.state(spark, sf_dir)
    near = forward.by_receiver(obs, 4 * spark.sparkContext.defaultParallelism)
    timed = stored_network(spark).attach(forward.attach_sources(near, state, state.count()))
    names = ["network", "station", "evid1", "evid2", "phase", "t1", "t2"]
    return rounded(timed.select(*names), 7, "t1", "t2").withColumn("phase", F.col("phase").cast("int"))


_BOX = Box(scale=50.0, z_min=-5.0, z_max=20.0)


def _pairs(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return make_pairs(ids, _BOX, profile_nodes(fx.velocity_model(spark)), seed=5)


# --- training pairs ----------------------------------------------------------------------------------

def _key(tag):
    return f"concat_ws(':', '5', CAST(o_orderkey AS VARCHAR), '{tag}')"


_PAIRS = f"""pairs AS (SELECT id, x_src, y_src, z_src,
  least(greatest(x_src + nx * k, 0e0), 50e0) AS x_rec,
  least(greatest(y_src + ny * k, 0e0), 50e0) AS y_rec,
  least(greatest(z_src + nz * k, -5e0), 20e0) AS z_rec, phase
FROM (SELECT *, radius / (sqrt(nx * nx + ny * ny + nz * nz) + 1e-8) AS k FROM (
SELECT o_orderkey AS id, {q.unit(_key('x'))} * 50e0 AS x_src, {q.unit(_key('y'))} * 50e0 AS y_src,
  -5e0 + {q.unit(_key('z'))} * 25e0 AS z_src, {q.normal(_key('nx'))} AS nx, {q.normal(_key('ny'))} AS ny,
  {q.normal(_key('nz'))} AS nz, 0.1e0 + {q.unit(_key('r'))} * {q.num(50 - 0.1)} AS radius,
  CAST(floor({q.unit(_key('p'))} * 2) AS INT) AS phase FROM orders))),
slow AS (SELECT pairs.*, 1 / (CASE WHEN phase = 1 THEN s0 + (z_rec - z0) * (s1 - s0) / (z1 - z0)
  ELSE p0 + (z_rec - z0) * (p1 - p0) / (z1 - z0) END) AS s_true
FROM pairs JOIN bracket ON z_rec >= z0 AND (z_rec < z1 OR (z_rec = z1 AND z1 = 20e0)))"""

# gradient at the receiver: correction times the ray's direction over the velocity, plus ray time times
# the correction's own slope
_REACH = "sqrt((x_src - x_rec) * (x_src - x_rec) + (y_src - y_rec) * (y_src - y_rec) + (z_src - z_rec) * (z_src - z_rec))"
_FLAT_PAIR = "sqrt((x_src - x_rec) * (x_src - x_rec) + (y_src - y_rec) * (y_src - y_rec))"
_ALONG = {
    a: f"CASE WHEN {_FLAT_PAIR} > 0 THEN -({a}_src - {a}_rec) / {_FLAT_PAIR} * g[1] / {net.SCALE} ELSE 0e0 END" for a in "xy"
} | {"z": f"g[3] / {net.SCALE}"}
_TERMS = [
    f"(CASE WHEN {_REACH} = 0 THEN 0e0 ELSE c * ({a}_rec - {a}_src) / {_REACH} / v END + {_REACH} / v * {_ALONG[a]})"
    for a in "xyz"
]


@query(
    q.with_(
        q.VELMOD,
        _BRACKET,
        _PAIRS,
        net.weights(),
        *net.network(
            "o",
            "slow",
            "id",
            [f"{_FLAT_PAIR} / {net.SCALE}", f"z_src / {net.SCALE}", f"z_rec / {net.SCALE}", "CAST(phase AS DOUBLE)"],
            gradient=True,
        ),
    )
    + f"""SELECT id, phase, {q.r('s_true', 7, 's_true')},
{q.r(f"sqrt({' + '.join(f'{t} * {t}' for t in _TERMS)})", 7, 's_pred')}
FROM (SELECT slow.*, c, g, CASE WHEN phase >= 0.5 THEN 3.3e0 ELSE 6e0 END AS v FROM slow JOIN o USING (id))"""
)
def network_slowness(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    slow = stored_network(spark).receiver_slowness(pairs, "s_pred")
    return rounded(slow.select("id", "phase", "s_true", "s_pred"), 7)


_PAIR_COLUMNS = ["x_src", "y_src", "z_src", "x_rec", "y_rec", "z_rec", "s_true"]


@query(
    q.with_(q.VELMOD, _BRACKET, _PAIRS)
    + f"SELECT id, phase, {', '.join(q.r(c, 7, c) for c in _PAIR_COLUMNS)} FROM slow"
)
def training_pairs(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir), 7)


@query(
    q.with_(q.VELMOD, _BRACKET, _PAIRS)
    + f"""SELECT {q.r('sqrt(sum((p - s_true) * (p - s_true))) / sqrt(sum(s_true * s_true))', 9,
    'relative_loss')} FROM (SELECT s_true, CASE WHEN phase >= 0.5 THEN 1 / 3.3e0 ELSE 1 / 6e0 END AS p FROM slow)"""
)
def network_loss(spark, sf_dir):
    """Relative slowness error of the straight-ray model on the training pairs."""
    pairs = fx.MODEL.receiver_slowness(_pairs(spark, sf_dir), "s_pred")
    return rounded(objective.network_loss(pairs), 9)


@query(
    q.with_(q.ORIGINS, q.DTIMES, q.ENCODED, q.KNOWN)
    + """SELECT phase, count(*) AS n_obs, count(DISTINCT station) AS n_stations FROM known GROUP BY phase"""
)
def phase_split(spark, sf_dir):
    known = ops.with_known_events(
        ops.encode_phase(fx.dtimes(spark, sf_dir)), fx.origins(spark, sf_dir)
    )
    out = known.groupBy(F.col("phase").cast("int").alias("phase")).agg(
        F.count(F.lit(1)).alias("n_obs"), F.countDistinct("station").alias("n_stations")
    )
    return out
