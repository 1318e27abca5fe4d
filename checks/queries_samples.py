"""Queries of the sample store, chains, posterior summaries and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import sql as q
from checks.registry import query, rounded
from tremorframe import lineage
from tremorframe.operators import chains, convergence, distributions, objective, posterior
from tremorframe.operators import effective_size as ess_ops
from tremorframe.sources import sample_store, tables

FIELDS = ["longitude", "latitude", "depth", "delta_t", "X", "Y", "Z"]


def stored(spark, sf_dir):
    """The fixture chains written to a sample store batch by batch; gives the path."""
    path = lineage.scratch_path(spark, "samples")
    rows = fx.samples(spark, sf_dir)
    rows = rows.withColumns({n: F.col(n).cast("float") for n in FIELDS})
    rows.write.partitionBy("batch_id").parquet(path)
    return path


# --- store -----------------------------------------------------------------------------------------

_SINGLE = ", ".join(q.r(q.single(f'"{n}"'), 4, f'"{n}"') for n in FIELDS)


@query(q.with_(q.SAMPLES) + f"SELECT evid, batch_id, draw, {_SINGLE} FROM samples")
def sample_read(spark, sf_dir):
    return rounded(sample_store.read_samples(spark, stored(spark, sf_dir)), 4)


@query(
    q.with_(q.SAMPLES)
    + f"SELECT evid, batch_id, CAST(draw // 5 AS BIGINT) AS draw, {_SINGLE} FROM samples WHERE draw % 5 = 0"
)
def sample_thin(spark, sf_dir):
    return rounded(sample_store.read_samples(spark, stored(spark, sf_dir), thin=5), 4)


@query(
    q.with_(q.SAMPLES)
    + f"SELECT evid, batch_id, draw, {_SINGLE} FROM samples WHERE evid IN (SELECT doc_id FROM labels)"
)
def sample_events(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("evid"))
    return rounded(sample_store.read_samples(spark, stored(spark, sf_dir), event_ids=wanted), 4)


_LON, _LAT = q.inverse_lonlat("120e0 + \"X\"", "90e0 + \"Y\"")


@query(
    q.with_(q.SAMPLES)
    + f"""SELECT evid, pos AS draw, CAST(1 AS BIGINT) AS batch_id, {q.r(q.single(_LON), 3, 'longitude')},
{q.r(q.single(_LAT), 3, 'latitude')}, {q.r(q.single('5 + "Z"'), 3, 'depth')},
{q.r(q.single('delta_t'), 4, 'delta_t')}, {q.r(q.single('"X"'), 4, '"X"')},
{q.r(q.single('"Y"'), 4, '"Y"')}, {q.r(q.single('"Z"'), 4, '"Z"')} FROM samples"""
)
def sample_append(spark, sf_dir):
    """Two batches appended, the second one written twice as a retry would; the second is read."""
    path = lineage.scratch_path(spark, "samples")
    draws = fx.samples(spark, sf_dir).selectExpr(
        "evid",
        "batch_id * 16 + draw AS draw",
        "120D AS x0",
        "90D AS y0",
        "5D AS z0",
        "X AS dx",
        "Y AS dy",
        "Z AS dz",
        "delta_t AS dt",
    )
    sample_store.save_samples(draws, path, *fx.CENTRE)
    number = sample_store.save_samples(draws, path, *fx.CENTRE)
    sample_store.save_samples(draws, path, *fx.CENTRE, batch_id=number)
    out = sample_store.read_samples(spark, path).filter(F.col("batch_id") == 1)
    return rounded(rounded(out, 3, "longitude", "latitude", "depth"), 4, "delta_t", "X", "Y", "Z")


@query(
    q.with_(q.SAMPLES)
    + """SELECT batch_id, count(DISTINCT evid) AS n_events, max(draw) + 1 AS sample_count,
count(*) AS n_rows FROM samples GROUP BY batch_id"""
)
def batch_metadata(spark, sf_dir):
    return sample_store.batch_metadata(sample_store.read_samples(spark, stored(spark, sf_dir)))


@query(
    q.with_(q.SAMPLES)
    + """SELECT (SELECT count(DISTINCT evid) FROM samples) AS n_events, count(*) AS n_batches,
sum(w) AS n_draws FROM (SELECT batch_id, max(draw) + 1 AS w FROM samples GROUP BY batch_id)"""
)
def store_metadata(spark, sf_dir):
    return sample_store.store_metadata(sample_store.read_samples(spark, stored(spark, sf_dir)))


@query(q.with_(q.SAMPLES) + "SELECT max(batch_id) + 1 AS next_batch_id FROM samples")
def next_batch_id(spark, sf_dir):
    return sample_store.next_batch(sample_store.read_samples(spark, stored(spark, sf_dir)))


# --- chains ------------------------------------------------------------------------------------------


@query(q.with_(q.SAMPLES) + "SELECT evid, batch_id, draw, pos FROM samples")
def draw_ordinal(spark, sf_dir):
    placed = chains.with_draw_ordinal(fx.samples(spark, sf_dir))
    return placed.select("evid", "batch_id", "draw", "pos")


@query(
    q.with_(q.SAMPLES)
    + f"""SELECT evid, pos, (pos - 10) // 3 AS rank, {q.r('"X"', 7, '"X"')} FROM samples
WHERE pos >= 10 AND (pos - 10) % 3 = 0"""
)
def sample_burnin(spark, sf_dir):
    kept = chains.thinned_chain(fx.samples(spark, sf_dir), burn_in=10, thin=3)
    return rounded(kept.select("evid", "pos", "rank", "X"), 7)


@query(
    q.with_(q.SAMPLES, q.LONG)
    + f"""SELECT evid, coord, sample_index, {q.r('v', 4, 'value')} FROM (
SELECT evid, coord, pos AS sample_index, (value - avg(value) OVER (PARTITION BY evid, coord)) * 1000 AS v
FROM long WHERE pos >= 4 AND (pos - 4) % 2 = 0)"""
)
def chain_trace(spark, sf_dir):
    return rounded(chains.chain_trace(fx.samples(spark, sf_dir), burn_in=4, thin=2), 4)


@query(
    q.with_(q.SAMPLES)
    + f"""SELECT evid, (pos - 8) // 4 AS rank, {q.r('x', 7, '"X"')}, {q.r('y', 7, '"Y"')}, {q.r('z', 7, '"Z"')}
FROM (SELECT evid, pos, "X" - avg("X") OVER w AS x, "Y" - avg("Y") OVER w AS y, "Z" - avg("Z") OVER w AS z
FROM samples WHERE pos >= 8 AND (pos - 8) % 4 = 0 WINDOW w AS (PARTITION BY evid))"""
)
def centred_chains(spark, sf_dir):
    return rounded(posterior.centred_chains(fx.samples(spark, sf_dir), burn_in=8, thin=4), 7)


@query(
    q.with_(q.SAMPLES)
    + """SELECT DISTINCT evid FROM samples ORDER BY evid LIMIT 24"""
)
def first_events(spark, sf_dir):
    """The default selection of an event grid: the first 24."""
    return chains.first_events(fx.samples(spark, sf_dir), 24)


@query(
    f"""SELECT vec_id AS evid FROM embeddings
ORDER BY {q.unit("concat_ws(':', '1', CAST(vec_id AS VARCHAR))")}, vec_id LIMIT 24"""
)
def random_events(spark, sf_dir):
    return chains.random_events(fx.samples(spark, sf_dir), 24, seed=1)


@query(q.with_(q.SAMPLES) + "SELECT DISTINCT evid FROM samples WHERE evid IN (3, 5, 8, 13)")
def events_by_index(spark, sf_dir):
    return chains.events_at(fx.samples(spark, sf_dir), [3, 5, 8, 13])


@query(
    """SELECT event_id, value FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL
ELSE value END AS value FROM events) WHERE value IS NOT NULL"""
    " AND event_id % 5 <> 1 AND event_id % 5 <> 2"
)
def finite_filter(spark, sf_dir):
    """NULL, NaN and infinite values are injected by key, then dropped."""
    raw = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') WHEN 2 THEN double('-Infinity') "
        "ELSE value END AS value",
    )
    return distributions.finite_only(raw)


# --- posterior summaries -----------------------------------------------------------------------------

_CAT = """q AS (SELECT evid, avg(latitude) AS latitude, avg(longitude) AS longitude, avg(depth) AS depth,
{fields} FROM samples WHERE pos >= 10 GROUP BY evid)"""
_KEPT = "FILTER (WHERE (pos - 10) % 3 = 0)"


def _cat_sql():
    fields = ", ".join(
        f"""avg("{n}") {_KEPT} AS m{n}, quantile_cont("{n}", 0.995) {_KEPT} AS h{n},
quantile_cont("{n}", 0.005) {_KEPT} AS l{n}"""
        for n in "XYZ"
    )
    show = ", ".join(
        f"{q.r(f'm{n}', 7, chr(34) + n + chr(34))}, {q.r(f'0.5e0 * (h{n} - l{n})', 7, 'sigma_' + n.lower())}"
        for n in "XYZ"
    )
    return (
        q.with_(q.SAMPLES, _CAT.format(fields=fields))
        + f"""SELECT {q.r('latitude', 7, 'latitude')}, {q.r('longitude', 7, 'longitude')},
{q.r('depth', 7, 'depth')}, {show}, evid FROM q"""
    )


def _thinned(thin: int, width: int) -> str:
    """View ``thin``: every ``thin``-th stored draw of each batch of 16, as one chain of ``width`` a batch."""
    fields = ", ".join(f'{q.single(chr(34) + n + chr(34))} AS "{n}"' for n in FIELDS)
    return (
        f"thin AS (SELECT evid, {fields}, batch_id * {width} + draw // {thin} AS pos FROM samples WHERE draw % {thin} = 0)"
    )


@query(_cat_sql().replace("q AS (", _thinned(2, 8) + ",\nq AS (", 1).replace("FROM samples WHERE pos >= 10", "FROM thin WHERE pos >= 10"))
def thinned_catalog(spark, sf_dir):
    """A thinned read of the store, then burn-in and thinning of what it gave."""
    samples = sample_store.read_samples(spark, stored(spark, sf_dir), thin=2)
    return rounded(posterior.posterior_catalog(samples, burn_in=10, thin=3), 7)


@query(_cat_sql())
def posterior_catalog(spark, sf_dir):
    return rounded(posterior.posterior_catalog(fx.samples(spark, sf_dir), burn_in=10, thin=3), 7)


@query(_cat_sql())
def posterior_catalog_long_chains(spark, sf_dir):
    """The same summary through the counting passes that very long chains take."""
    out = posterior.posterior_catalog(
        fx.samples(spark, sf_dir), burn_in=10, thin=3, gather_rows=0
    )
    return rounded(out, 7)


@query(
    q.with_(q.SAMPLES)
    + f"""SELECT evid, {q.r('avg(latitude)', 7, 'latitude')},
{q.r('avg("X") FILTER (WHERE (pos - 10) % 3 = 0)', 7, '"X"')} FROM samples WHERE pos >= 10 GROUP BY evid"""
)
def posterior_include(spark, sf_dir):
    return rounded(
        posterior.posterior_means(fx.samples(spark, sf_dir), ["lats", "X"], burn_in=10, thin=3), 7
    )


@query(
    q.with_(
        q.SAMPLES,
        "w AS (SELECT "
        + ", ".join(
            f'0.5e0 * (quantile_cont("{n}", 0.995) - quantile_cont("{n}", 0.005)) AS s{n}' for n in "XYZ"
        )
        + " FROM samples)",
    )
    + "SELECT evid, "
    + ", ".join(q.r(f'avg("{n}")', 7, f'"{n}"') for n in FIELDS if n != "delta_t")
    + ", "
    + ", ".join(q.r(f"max(s{n})", 7, f"sigma_{n.lower()}") for n in "XYZ")
    + " FROM samples, w GROUP BY evid"
)
def pooled_catalog(spark, sf_dir):
    return rounded(posterior.pooled_catalog(fx.samples(spark, sf_dir)), 7)


_STD = """u AS (SELECT evid, stddev_samp(longitude) AS longitude_std, stddev_samp(latitude) AS latitude_std,
stddev_samp(depth) AS depth_std, stddev_samp(delta_t) AS time_std FROM samples WHERE pos >= 4 GROUP BY evid)"""
_STD_NAMES = ["longitude_std", "latitude_std", "depth_std", "time_std"]


@query(
    q.with_(q.SAMPLES, _STD) + f"SELECT evid, {', '.join(q.r(n, 8, n) for n in _STD_NAMES)} FROM u"
)
def std_uncertainty(spark, sf_dir):
    return rounded(posterior.std_uncertainty(fx.samples(spark, sf_dir), burn_in=4), 8)


@query(
    q.with_(q.SAMPLES, _STD)
    + f"SELECT {', '.join(q.r(f'avg({n})', 8, 'mean_' + n) for n in _STD_NAMES)} FROM u"
)
def mean_uncertainty(spark, sf_dir):
    spreads = posterior.std_uncertainty(fx.samples(spark, sf_dir), burn_in=4)
    return rounded(posterior.mean_uncertainty(spreads), 8)


@query(
    q.with_(
        q.SAMPLES,
        _STD,
        q.ORIGINS,
        """m AS (SELECT evid, avg(longitude) AS longitude, avg(latitude) AS latitude, avg(depth) AS depth
FROM samples WHERE pos >= 4 GROUP BY evid)""",
    )
    + f"""SELECT m.evid AS event_id, {q.r('m.longitude', 6, 'longitude')}, {q.r('m.latitude', 6, 'latitude')},
{q.r('m.depth', 6, 'depth')}, strftime(o.time, '%Y-%m-%d %H:%M:%S') AS origin_time,
{', '.join(q.r(n, 8, n) for n in _STD_NAMES)}
FROM m JOIN u ON m.evid = u.evid LEFT JOIN origins o ON m.evid = o.evid"""
)
def summary_catalog(spark, sf_dir):
    """The documented summary file, written as CSV and read back."""
    samples = fx.samples(spark, sf_dir)
    means = posterior.posterior_means(samples, ["lats", "lons", "deps"], burn_in=4)
    spreads = posterior.std_uncertainty(samples, burn_in=4)
    table = tables.summary_catalog(means, spreads, fx.origins(spark, sf_dir))
    path = lineage.scratch_path(spark, "summary") + ".csv"
    tables.write_catalog(table, path)
    back = spark.read.option("header", True).schema(table.schema).csv(path)
    back = rounded(rounded(back, 6, "longitude", "latitude", "depth"), 8, *_STD_NAMES)
    return back.withColumn("origin_time", F.date_format("origin_time", "yyyy-MM-dd HH:mm:ss"))


_ERR = """e AS (SELECT avg(s.longitude) - any_value(o.longitude) AS longitude,
avg(s.latitude) - any_value(o.latitude) AS latitude, avg(s.depth) - any_value(o.depth) AS depth
FROM samples s JOIN origins o ON s.evid = o.evid GROUP BY s.evid)"""


@query(
    q.with_(q.SAMPLES, q.ORIGINS, _ERR)
    + "SELECT "
    + ", ".join(
        f"{q.r(f'avg(abs({n}))', 8, f'mean_abs_{n}')}, {q.r(f'sqrt(avg({n} * {n}))', 8, f'rms_{n}')}"
        for n in ("longitude", "latitude", "depth")
    )
    + " FROM e"
)
def location_error(spark, sf_dir):
    means = posterior.posterior_means(fx.samples(spark, sf_dir), ["lats", "lons", "deps"])
    truth = fx.origins(spark, sf_dir).selectExpr("evid", "longitude AS lon", "latitude AS lat", "depth")
    return rounded(posterior.location_error(posterior.compare_to_truth(means, truth)), 8)


@query(
    q.with_(q.ORIGINS)
    + "SELECT "
    + ", ".join(
        q.r(f"max({n}) - min({n})", 8, f"{n}_range") for n in ("longitude", "latitude", "depth")
    )
    + " FROM origins"
)
def spatial_extent(spark, sf_dir):
    return rounded(posterior.spatial_extent(fx.origins(spark, sf_dir)), 8)


# --- effective sample size -----------------------------------------------------------------------------

_ESS = """c AS (SELECT evid, coord, pos, value - avg(value) OVER w AS x, count(*) OVER w AS n,
  var_samp(value) OVER w AS v FROM long WINDOW w AS (PARTITION BY evid, coord)),
a AS (SELECT p.evid, p.coord, p.n, k.k, sum(p.x * s.x) / ((p.n - k.k) * p.v) AS acf
  FROM c p, range(1, 17) k(k), c s
  WHERE s.evid = p.evid AND s.coord = p.coord AND s.pos = p.pos + k.k GROUP BY p.evid, p.coord, p.n, p.v, k.k),
f AS (SELECT evid, coord, n, greatest(1e0, least(n / (1 + 2 * sum(greatest(acf, 0))), n)) AS size
  FROM a GROUP BY evid, coord, n),
s AS (SELECT evid, max(n) AS n, max(size) FILTER (WHERE coord = 'X') AS ess_x,
  max(size) FILTER (WHERE coord = 'Y') AS ess_y, max(size) FILTER (WHERE coord = 'Z') AS ess_z,
  min(size) AS ess FROM f GROUP BY evid)"""
_ESS_SHOW = ", ".join(q.r(n, 6, n) for n in ("ess_x", "ess_y", "ess_z", "ess"))


@query(q.with_(q.SAMPLES, q.LONG, _ESS) + f"SELECT evid, n, {_ESS_SHOW} FROM s")
def ess(spark, sf_dir):
    return rounded(ess_ops.effective_sample_size(fx.samples(spark, sf_dir)), 6)


@query(
    q.with_(q.SAMPLES, _thinned(5, 4), q.LONG.replace("FROM samples", "FROM thin"), _ESS.replace("range(1, 17)", "range(1, 5)"))
    + f"SELECT evid, n, {_ESS_SHOW} FROM s"
)
def thinned_ess(spark, sf_dir):
    samples = sample_store.read_samples(spark, stored(spark, sf_dir), thin=5)
    return rounded(ess_ops.effective_sample_size(samples), 6)


@query(q.with_(q.SAMPLES, q.LONG, _ESS) + f"SELECT evid, n, {_ESS_SHOW} FROM s")
def ess_long_chains(spark, sf_dir):
    """The same sizes with chains cut into overlapping blocks, as very long ones are."""
    out = ess_ops.effective_sample_size(fx.samples(spark, sf_dir), block_draws=20)
    return rounded(out, 6)


@query(
    q.with_(q.SAMPLES, q.LONG, _ESS)
    + f"""SELECT {q.r('avg(ess)', 6, 'mean_ess')}, {q.r('median(ess)', 6, 'median_ess')},
{q.r('min(ess)', 6, 'min_ess')}, {q.r('max(ess)', 6, 'max_ess')}, {q.r('stddev_pop(ess)', 6, 'std_ess')},
count(*) AS n_events, max(n) AS n_samples FROM s"""
)
def ess_summary(spark, sf_dir):
    sizes = ess_ops.effective_sample_size(fx.samples(spark, sf_dir))
    return rounded(ess_ops.ess_summary(sizes), 6)


# --- distributions -----------------------------------------------------------------------------------

_EDGES = "edges AS (SELECT i AS bin, -0.1e0 + i * 0.003e0 AS lo, -0.1e0 + (i + 1) * 0.003e0 AS hi, i = 66 AS closed FROM range(0, 67) t(i))"
_IN_BIN = "{v} >= {e}.lo AND ({v} < {e}.hi OR ({e}.closed AND {v} = {e}.hi))"


@query(
    q.with_(
        q.SAMPLES,
        q.LONG,
        _EDGES,
        f"""h AS (SELECT evid, coord, bin, lo, count(*) AS n FROM long JOIN edges e
ON {_IN_BIN.format(v='value', e='e')} GROUP BY evid, coord, bin, lo)""",
    )
    + f"""SELECT evid, coord, bin, n, {q.r('lo', 7, 'left_edge')},
{q.r('n / (sum(n) OVER (PARTITION BY evid, coord) * 0.003e0)', 6, 'density')} FROM h"""
)
def hist1d(spark, sf_dir):
    return rounded(rounded(distributions.histogram(fx.samples(spark, sf_dir)), 7, "left_edge"), 6, "density")


_MARGINS = """n AS (SELECT count(*) AS n_rows FROM u),
v AS (SELECT 'longitude_std' AS col, longitude_std * 2e4 AS x FROM u UNION ALL
  SELECT 'depth_std', depth_std * 1e3 FROM u),
h AS (SELECT col, least(CAST(floor(x) AS BIGINT), n_rows - 2) AS bin, count(*) AS n FROM v, n
  WHERE x >= 0 AND x <= n_rows - 1 GROUP BY ALL)"""


@query(
    q.with_(
        q.SAMPLES,
        _STD,
        "p AS (SELECT evid, longitude_std * 2e1 AS a, depth_std AS b FROM u)",
        _MARGINS,
    )
    + f"""SELECT CASE col WHEN 'longitude_std' THEN 'a' ELSE 'b' END AS "column", bin,
CAST(bin AS DOUBLE) AS left_edge, n,
{q.r('sum(n) OVER (PARTITION BY col ORDER BY bin) / sum(n) OVER (PARTITION BY col)', 8, 'cumulative')} FROM h"""
)
def hist1d_cumulative(spark, sf_dir):
    spreads = posterior.std_uncertainty(fx.samples(spark, sf_dir), burn_in=4).select(
        (F.col("longitude_std") * 20).alias("a"), F.col("depth_std").alias("b")
    )
    return rounded(distributions.cumulative_histogram(spreads, ["a", "b"], scale=1000.0), 8)


_PAIR_CELLS = "cells AS (" + " UNION ALL ".join(
    f"""SELECT evid, '{a}{b}' AS pair, e.bin AS bin_a, g.bin AS bin_b, count(*) AS n FROM samples
JOIN edges e ON {_IN_BIN.format(v=f'"{a}"', e='e')} JOIN edges g ON {_IN_BIN.format(v=f'"{b}"', e='g')}
GROUP BY evid, e.bin, g.bin"""
    for a, b in ("XY", "XZ", "YZ")
) + ")"


@query(q.with_(q.SAMPLES, _EDGES, _PAIR_CELLS) + "SELECT * FROM cells")
def hist2d(spark, sf_dir):
    return distributions.histogram2d(fx.samples(spark, sf_dir))


@query(
    q.with_(q.SAMPLES, _EDGES, _PAIR_CELLS)
    + f"""SELECT evid, pair, CAST(k AS INT) AS level_no, {q.r('m * (k + 1) / 8e0', 6, 'level')} FROM (
SELECT evid, pair, max(n) AS m FROM cells GROUP BY evid, pair), range(0, 8) t(k)"""
)
def contour_levels(spark, sf_dir):
    cells = distributions.histogram2d(fx.samples(spark, sf_dir))
    return rounded(distributions.contour_levels(cells), 6)


_KDE = """st AS (SELECT evid, coord, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS s, min(v) AS a, max(v) AS b,
  (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34e0 AS iqr FROM m GROUP BY evid, coord),
gr AS (SELECT *, (hi - lo) / 511e0 AS step FROM (SELECT *, 0.9e0 * least(s, iqr) * pow(n, -0.2e0) AS h,
  least(-300e0, a - mean - 0.05e0 * (b - a + 1e-9)) AS lo,
  greatest(300e0, b - mean + 0.05e0 * (b - a + 1e-9)) AS hi FROM st)),
pl AS (SELECT evid, coord, (v - mean - lo) / step AS t FROM m JOIN gr USING (evid, coord)),
w AS (SELECT evid, coord, i, sum(w) AS w FROM (
  SELECT evid, coord, CAST(floor(t) AS INT) AS i, 1 - (t - floor(t)) AS w FROM pl UNION ALL
  SELECT evid, coord, CAST(floor(t) AS INT) + 1, t - floor(t) FROM pl) GROUP BY evid, coord, i)"""


@query(
    q.with_(
        q.SAMPLES,
        q.LONG,
        "m AS (SELECT evid, coord, value * 1000 AS v FROM long)",
        _KDE,
    )
    + f"""SELECT evid, coord, CAST(k AS INT) AS i, {q.r('lo + k * step', 5, 'x')},
{q.r("sum(w * exp(-0.5e0 * ((k - i) * step / h) * ((k - i) * step / h))) / (n * h * 2.5066282746310002e0)", 7, 'density')}
FROM gr JOIN w USING (evid, coord), range(0, 512) g(k) GROUP BY evid, coord, k, lo, step, n, h"""
)
def density_curve(spark, sf_dir):
    curves = distributions.density_curve(fx.samples(spark, sf_dir))
    return rounded(rounded(curves, 5, "x"), 7, "density")


# --- convergence -------------------------------------------------------------------------------------


@query(
    q.with_(q.SAMPLES)
    + f"""SELECT c.pos AS epoch, {q.r('''sqrt(sum((c."X" - p."X") * (c."X" - p."X") + (c."Y" - p."Y") * (c."Y" - p."Y")
+ (c."Z" - p."Z") * (c."Z" - p."Z"))) / (sqrt(sum(p."X" * p."X" + p."Y" * p."Y" + p."Z" * p."Z")) + 1e-12)''',
    8, 'relative_change')}
FROM samples c LEFT JOIN samples p ON c.evid = p.evid AND c.pos = p.pos + 10 GROUP BY c.pos"""
)
def relative_change(spark, sf_dir):
    """Draws taken as snapshots, ten epochs apart."""
    snapshots = chains.with_draw_ordinal(fx.samples(spark, sf_dir), "epoch")
    return rounded(convergence.relative_change(snapshots, 10, ["X", "Y", "Z"]), 8)


_RECENT = """r AS (SELECT conv_id AS run_id, turn AS step, CAST(length(text) AS DOUBLE) AS loss,
max(turn) OVER (PARTITION BY conv_id) AS e FROM conversations),
f AS (SELECT run_id, count(*) AS n, 1000 * coalesce(regr_slope(loss, step), 0) AS slope,
stddev_pop(loss) AS sd FROM r WHERE step > e - 4 GROUP BY run_id)"""


@query(
    q.with_(_RECENT)
    + f"""SELECT run_id, n, {q.r('slope', 4, 'slope_per_1000')}, {q.r('sd', 6, 'loss_std')},
n < 4 OR abs(slope) <= 1000 * (sd + 1e-12) AS plateau FROM f"""
)
def loss_plateau(spark, sf_dir):
    """Conversations as runs, turns as steps, text lengths as losses."""
    metrics = fx.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS run_id", "turn AS step", "cast(length(text) AS double) AS loss"
    )
    out = convergence.loss_plateau(metrics, win=4, rel_slope=1000.0)
    return rounded(rounded(out, 4, "slope_per_1000"), 6, "loss_std")


@query(f"SELECT {q.r('coalesce(avg(value), 0)', 8, 'mean_loss')} FROM events")
def epoch_mean_loss(spark, sf_dir):
    losses = fx.table(spark, sf_dir, "events").select(F.col("value").alias("loss"))
    return rounded(objective.epoch_mean_loss(losses), 8)


# --- catalog and chains together, cleared stores -----------------------------------------------------

_CHAIN = "chain AS (SELECT * FROM samples WHERE pos >= 10 AND (pos - 10) % 3 = 0)"


@query(
    q.with_(q.SAMPLES, _CHAIN)
    + f"""SELECT c.evid, (pos - 10) // 3 AS rank, {q.r('"X" - mx', 7, '"X"')}, {q.r('"Z" - mz', 7, '"Z"')},
{q.r('mx', 7, 'mean_x')}, {q.r('sx', 7, 'sigma_x')}, {q.r('lat', 7, 'latitude')} FROM chain c
JOIN (SELECT evid, avg("X") AS mx, avg("Z") AS mz,
0.5e0 * (quantile_cont("X", 0.995) - quantile_cont("X", 0.005)) AS sx FROM chain GROUP BY evid) s ON s.evid = c.evid
JOIN (SELECT evid, avg(latitude) AS lat FROM samples WHERE pos >= 10 GROUP BY evid) l ON l.evid = c.evid"""
)
def catalog_and_chains(spark, sf_dir):
    """One call gives the catalog and the centred chains; here beside each other."""
    catalog, chains_ = posterior.catalog_and_chains(fx.samples(spark, sf_dir), burn_in=10, thin=3)
    named = catalog.select("evid", F.col("X").alias("mean_x"), "sigma_x", "latitude")
    return rounded(chains_.select("evid", "rank", "X", "Z").join(named, "evid"), 7)


@query(
    q.with_(q.SAMPLES)
    + f"""SELECT evid, CAST(0 AS BIGINT) AS batch_id, draw, CAST(0 AS BIGINT) AS rows_after_clearing, {_SINGLE}
FROM samples WHERE batch_id = 2"""
)
def sample_clear(spark, sf_dir):
    """A store that is cleared is empty, and its next batch has number 0 again."""
    path = stored(spark, sf_dir)
    sample_store.clear_samples(spark, path)
    left = sample_store.read_samples(spark, path).count()
    rows = fx.samples(spark, sf_dir).filter("batch_id = 2").withColumns({n: F.col(n).cast("float") for n in FIELDS})
    sample_store.append_batch(rows.drop("batch_id"), path)
    return rounded(sample_store.read_samples(spark, path), 4).withColumn("rows_after_clearing", F.lit(left).cast("long"))
