"""SQL text of the fixture views and of the formulas that the oracles share.

Written from the formulas, not from the library: constants are computed here anew.
"""

from __future__ import annotations

import math

LAT0, LON0 = 32.5, -118.5
_A, _F = 6378.137, 1 / 298.257223563
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _authalic(s: float) -> float:
    return (1 - _E2) * (
        s / (1 - _E2 * s * s) - 1 / (2 * _E) * math.log((1 - _E * s) / (1 + _E * s))
    )


_P1 = math.radians(LAT0)
_QP = _authalic(1.0)
_B1 = math.asin(_authalic(math.sin(_P1)) / _QP)
_RQ = _A * math.sqrt(_QP / 2)
_D = _A * math.cos(_P1) / math.sqrt(1 - _E2 * math.sin(_P1) ** 2) / (_RQ * math.cos(_B1))


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def r(expr: str, digits: int, name: str) -> str:
    """Rounded output column without negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0e0 ELSE round({expr}, {digits}) END AS {name}"


def single(expr: str) -> str:
    """The value as stored in single precision."""
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)"


STATIONS = """stations AS (
SELECT concat('N', CAST(s_nationkey % 5 AS VARCHAR)) AS network,
  concat('S', CAST(s_suppkey AS VARCHAR)) AS station,
  -117.5e0 + (s_suppkey * 37 % 100) * 1e-2 AS longitude,
  33.0e0 + (s_suppkey * 61 % 100) * 1e-2 AS latitude,
  -1e-3 * (s_suppkey % 20) AS depth
FROM supplier)"""

STATIONS_TWICE = """stations_twice AS (
SELECT * FROM stations UNION ALL
SELECT network, station, longitude + CAST(depth < -5e-3 AS INT) * 1e-3 AS longitude, latitude, depth
FROM stations)"""

ORIGINS = """origins AS (
SELECT p_partkey AS evid, -116.9e0 + (p_partkey * 7919 % 10007) * 3e-5 AS longitude,
  33.4e0 + (p_partkey * 104729 % 9973) * 3e-5 AS latitude,
  2e0 + p_size * 25e-2 AS depth, o_orderdate AS time
FROM part JOIN orders ON o_orderkey = p_partkey)"""

DTIMES = """dtimes AS (
SELECT concat('N', CAST(s_nationkey % 5 AS VARCHAR)) AS network,
  concat('S', CAST(l_suppkey AS VARCHAR)) AS station,
  (l_discount - 5e-2) * 12e0 AS dt,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_partkey + 1 + l_orderkey % 3 END AS evid1,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + 1 + l_orderkey % 3 ELSE l_partkey END AS evid2,
  CASE l_returnflag WHEN 'R' THEN 's' WHEN 'A' THEN 'P' ELSE 'S' END AS phase,
  1e0 - l_tax * 6e0 AS cc
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

ENCODED = """encoded AS (
SELECT network, station, dt, evid1, evid2,
  CASE WHEN phase IN ('s', 'S') THEN 1 ELSE 0 END AS phase, cc
FROM dtimes)"""

KNOWN = """known AS (
SELECT * FROM encoded WHERE evid1 IN (SELECT evid FROM origins)
  AND evid2 IN (SELECT evid FROM origins))"""

VELMOD = """velmod(depth, vs, vp) AS (VALUES (-5e0, 3.3e0, 6.0e0), (0e0, 3.3e0, 6.0e0),
  (5e0, 3.4e0, 6.1e0), (10e0, 3.5e0, 6.2e0), (15e0, 3.6e0, 6.3e0), (20e0, 3.7e0, 6.4e0))"""

SAMPLES = """samples AS (
SELECT evid, CAST(j % 16 AS BIGINT) AS draw, -116.8e0 + "X" * 1e-2 AS longitude,
  33.5e0 + "Y" * 1e-2 AS latitude, 6e0 + "Z" AS depth, "Y" * 5e-2 AS delta_t, "X", "Y", "Z",
  CAST(j // 16 AS BIGINT) AS batch_id, CAST(j AS BIGINT) AS pos
FROM (SELECT vec_id AS evid, i - 1 AS j, CAST(embedding[i] AS DOUBLE) AS "X",
    CAST(embedding[(i + 20) % 64 + 1] AS DOUBLE) AS "Y",
    CAST(embedding[(i + 41) % 64 + 1] AS DOUBLE) AS "Z"
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)))"""

LONG = """long AS (
SELECT evid, pos, 'X' AS coord, "X" AS value FROM samples UNION ALL
SELECT evid, pos, 'Y', "Y" FROM samples UNION ALL
SELECT evid, pos, 'Z', "Z" FROM samples)"""


def forward_xy(lon: str, lat: str) -> tuple[str, str]:
    """X and Y expressions for degrees."""
    s = f"sin(radians({lat}))"
    q = (
        f"({num(1 - _E2)} * ({s} / (1 - {num(_E2)} * {s} * {s})"
        f" - {num(1 / (2 * _E))} * ln((1 - {num(_E)} * {s}) / (1 + {num(_E)} * {s}))))"
    )
    beta = f"asin({q} / {num(_QP)})"
    dl = f"radians({lon} - ({num(LON0)}))"
    sb, cb = num(math.sin(_B1)), num(math.cos(_B1))
    b = f"({num(_RQ)} * sqrt(2e0 / (1 + {sb} * sin({beta}) + {cb} * cos({beta}) * cos({dl}))))"
    x = f"({b} * {num(_D)} * cos({beta}) * sin({dl}))"
    y = f"({b} / {num(_D)} * ({cb} * sin({beta}) - {sb} * cos({beta}) * cos({dl})))"
    return x, y


def inverse_lonlat(x: str, y: str) -> tuple[str, str]:
    """Longitude and latitude expressions for km away from the centre."""
    d = num(_D)
    rho = f"sqrt(({x}) / {d} * ({x}) / {d} + {d} * ({y}) * {d} * ({y}))"
    ce = f"(2 * asin({rho} / {num(2 * _RQ)}))"
    sb, cb = num(math.sin(_B1)), num(math.cos(_B1))
    beta = f"asin(cos({ce}) * {sb} + {d} * ({y}) * sin({ce}) * {cb} / {rho})"
    lon = (
        f"({num(LON0)} + degrees(atan2(({x}) * sin({ce}), {d} * {rho} * {cb} * cos({ce})"
        f" - {d} * {d} * ({y}) * {sb} * sin({ce}))))"
    )
    e4, e6 = _E2**2, _E2**3
    lat = (
        f"degrees({beta} + {num(_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040)} * sin(2 * {beta})"
        f" + {num(23 * e4 / 360 + 251 * e6 / 3780)} * sin(4 * {beta})"
        f" + {num(761 * e6 / 45360)} * sin(6 * {beta}))"
    )
    return lon, lat


_X, _Y = forward_xy("longitude", "latitude")

STATIONS_XY = f"""stations_xy AS (
SELECT *, {_X} AS "X", {_Y} AS "Y", depth AS "Z" FROM stations)"""

ORIGINS_XY = f"""origins_xy AS MATERIALIZED (
SELECT *, {_X} AS x0, {_Y} AS y0, depth AS z0 FROM origins)"""

# arid-free observations: whole table, no quality filter
OBS = """obs AS MATERIALIZED (
SELECT k.*, s.longitude, s.latitude, s.depth, s."X", s."Y", s."Z"
FROM known k JOIN stations_xy s ON k.network = s.network AND k.station = s.station)"""

STATE = """state AS MATERIALIZED (
SELECT evid, x0, y0, z0, (evid * 31 % 101 - 50) * 2e-3 AS dx, (evid * 17 % 103 - 51) * 2e-3 AS dy,
  (evid * 13 % 107 - 53) * 2e-3 AS dz, (evid * 7 % 109 - 54) * 1e-3 AS dt,
  0e0 AS m_dx, 0e0 AS m_dy, 0e0 AS m_dz, 0e0 AS m_dt, 0e0 AS v_dx, 0e0 AS v_dy, 0e0 AS v_dz, 0e0 AS v_dt
FROM origins_xy)"""

WARM = """warm AS MATERIALIZED (
SELECT evid, x0, y0, z0, dx, dy, dz, dt,
  (evid * 3 % 11 - 5) * 1e-6 AS m_dx, (evid * 4 % 11 - 5) * 1e-6 AS m_dy,
  (evid * 5 % 11 - 5) * 1e-6 AS m_dz, (evid * 6 % 11 - 5) * 1e-6 AS m_dt,
  (evid * 5 % 13 + 1) * 1e-11 AS v_dx, (evid * 6 % 13 + 1) * 1e-11 AS v_dy,
  (evid * 7 % 13 + 1) * 1e-11 AS v_dz, (evid * 8 % 13 + 1) * 1e-11 AS v_dt
FROM state)"""

COLD = """cold AS MATERIALIZED (
SELECT evid, x0, y0, z0, 0e0 AS dx, 0e0 AS dy, 0e0 AS dz, 0e0 AS dt,
  0e0 AS m_dx, 0e0 AS m_dy, 0e0 AS m_dz, 0e0 AS m_dt, 0e0 AS v_dx, 0e0 AS v_dy, 0e0 AS v_dz, 0e0 AS v_dt
FROM origins_xy)"""

BASE = [STATIONS, ORIGINS, DTIMES, ENCODED, KNOWN, STATIONS_XY, ORIGINS_XY, OBS]
COMPONENTS = ("dx", "dy", "dz", "dt")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def predicted(name: str, state: str, vp: float = 6.0, vs: float = 3.3) -> str:
    """Observations with both source positions, distances, velocity and dt_pred."""
    dist = lambda e: (
        f'sqrt((x{e} - "X") * (x{e} - "X") + (y{e} - "Y") * (y{e} - "Y") + (z{e} - "Z") * (z{e} - "Z"))'
    )
    return f"""{name} AS MATERIALIZED (
SELECT *, (d2 / v + s2) - (d1 / v + s1) AS dt_pred FROM (
SELECT *, {dist(1)} AS d1, {dist(2)} AS d2,
  CASE WHEN phase >= 0.5 THEN {num(vs)} ELSE {num(vp)} END AS v
FROM (SELECT o.*, a.x0 + a.dx AS x1, a.y0 + a.dy AS y1, a.z0 + a.dz AS z1, a.dt AS s1,
    b.x0 + b.dx AS x2, b.y0 + b.dy AS y2, b.z0 + b.dz AS z2, b.dt AS s2
  FROM obs o JOIN {state} a ON o.evid1 = a.evid JOIN {state} b ON o.evid2 = b.evid)))"""


def scaled(pred: str, phase_unc: tuple[float, float]) -> str:
    """Subquery with sigma, the scaled residual and its Huber loss."""
    return f"""(SELECT *, CASE WHEN abs(u) <= 1 THEN 0.5e0 * u * u ELSE abs(u) - 0.5e0 END AS h FROM (
SELECT *, dt / sigma - dt_pred / sigma AS u FROM (
SELECT *, CASE WHEN phase < 0.5 THEN {num(phase_unc[0])} ELSE {num(phase_unc[1])} END AS sigma FROM {pred})))"""


def nll(columns: tuple[str, ...], stds: tuple[float, ...]) -> str:
    constant = sum(math.log(s) for s in stds) + 0.5 * len(stds) * math.log(2 * math.pi)
    terms = [f"0.5e0 * ({c} / {num(s)}) * ({c} / {num(s)})" for c, s in zip(columns, stds)]
    return f"({num(constant)} + " + " + ".join(terms) + ")"


def gradient(
    name: str,
    state: str,
    phase_unc: tuple[float, float],
    event_std: tuple[float, ...],
    centroid_std: tuple[float, ...],
) -> str:
    """CTEs that give every state row its gradient of the normalized loss."""
    pred = f"{name}_p"
    ends = []
    for e, sign in ((1, ""), (2, "-")):
        slopes = ", ".join(
            f'CASE WHEN d{e} = 0 THEN 0 ELSE {sign}w * ({a}{e} - "{a.upper()}") / (v * d{e}) END AS g{a}'
            for a in "xyz"
        )
        ends.append(f"SELECT evid{e} AS evid, {slopes}, {sign}w AS gt FROM {name}_w")
    grads = []
    for c, g, s, sc in zip(COMPONENTS, ("gx", "gy", "gz", "gt"), event_std, centroid_std):
        grads.append(
            f"coalesce(q.{g}, 0e0) / n.n + (t.{c} / {num(s * s)} + c.{c} / {num(sc * sc)}) / n.n AS g_{c}"
        )
    return ",\n".join(
        [
            predicted(pred, state),
            f"""{name}_w AS MATERIALIZED (SELECT *, greatest(least(u, 1e0), -1e0) / sigma AS w
FROM {scaled(pred, phase_unc)})""",
            f"{name}_e AS MATERIALIZED (SELECT evid, sum(gx) AS gx, sum(gy) AS gy, sum(gz) AS gz, sum(gt) AS gt "
            f"FROM ({' UNION ALL '.join(ends)}) GROUP BY evid)",
            f"{name}_n AS MATERIALIZED (SELECT count(*) AS n FROM {pred})",
            f"{name}_c AS MATERIALIZED (SELECT avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz, avg(dt) AS dt FROM {state})",
            f"""{name} AS MATERIALIZED (SELECT t.*, {', '.join(grads)}
FROM {state} t LEFT JOIN {name}_e q ON t.evid = q.evid, {name}_n n, {name}_c c)""",
        ]
    )


def adam(name: str, graded: str, step: int, lr: float) -> str:
    """Adam update of a graded state."""
    m = {c: f"(0.9e0 * m_{c} + {num(1 - 0.9)} * g_{c})" for c in COMPONENTS}
    v = {c: f"(0.999e0 * v_{c} + {num(1 - 0.999)} * g_{c} * g_{c})" for c in COMPONENTS}
    moves = [
        f"{c} - {num(lr / (1 - 0.9**step))} * ({m[c]} / (sqrt({v[c]}) / {num(math.sqrt(1 - 0.999**step))} + 1e-8)) AS {c}"
        for c in COMPONENTS
    ]
    memory = [f"{m[c]} AS m_{c}" for c in COMPONENTS] + [f"{v[c]} AS v_{c}" for c in COMPONENTS]
    return (
        f"{name} AS MATERIALIZED (SELECT evid, x0, y0, z0, {', '.join(moves + memory)} FROM {graded})"
    )


def unit(key: str, start: int = 1) -> str:
    """Uniform in [0, 1) from 13 hex digits of an MD5 digest."""
    return f"(CAST(CAST('0x' || substr(md5({key}), {start}, 13) AS BIGINT) AS DOUBLE) / {num(float(16**13))})"


def normal(key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {unit(key)})) * cos({num(2 * math.pi)} * {unit(key, 14)}))"


def langevin(
    name: str,
    graded: str,
    n_obs: str,
    step: int,
    lr: float,
    beta: float = 0.99,
    eps: float = 1e-5,
    adam_like: bool = False,
    noise_scale: float = 0.0,
    seed: int = 0,
    noise_step: int = 0,
) -> str:
    """Preconditioned Langevin update of a graded state."""
    moves, memory = [], []
    for c in COMPONENTS:
        v = f"({num(beta)} * v_{c} + {num(1 - beta)} * g_{c} * g_{c})"
        used = f"({v} / {num(1 - beta**step)})" if adam_like else v
        root = f"sqrt({used})"
        damp = f"({num(eps)} + {root})"
        move = (
            f"{num(lr)} / {damp} * g_{c} * {n_obs}"
            f" - {num(lr * (1 - beta))} * g_{c} * {root} / ({damp} * {damp})"
        )
        if noise_scale > 0:
            key = f"concat_ws(':', CAST(evid AS VARCHAR), '{c}', '{noise_step}', '{seed}')"
            move += f" + {normal(key)} * {num(math.sqrt(2 * lr) * noise_scale)} * sqrt(1 / {damp})"
        moves.append(f"{c} - ({move}) AS {c}")
        memory.append(f"{v} AS v_{c}")
    carried = ", ".join(f"m_{c}" for c in COMPONENTS)
    return (
        f"{name} AS MATERIALIZED (SELECT evid, x0, y0, z0, {', '.join(moves + memory)}, {carried} FROM {graded})"
    )
