"""Queries of statistics, time intervals, composites and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..operators import composites as cp
from ..operators import filters as fl
from ..operators import statistics as st
from ..operators import time_buckets as tb
from ._cube import CUBE_SQL, CUBE_Z_SQL, GRID, GRID_Z, cube, cube_z, rounded, rounded_sql, stages_sql, table

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _r(c, digits: int = 6):
    return F.round(c, digits) + 0.0


BASE = f"WITH {CUBE_SQL}\n"
KEYS = ("j", "i")

# Statistics per cell.
_b = {"minv": 1, "maxv": 1, "mean": 1, "stddev": 1, "tprod": 1}
_add("stat_basic", lambda s, d: rounded(st.basic(cube(s, d), "u"), _b, KEYS), BASE + rounded_sql(_b, "(SELECT j, i, min(u) AS minv, max(u) AS maxv, avg(u) AS mean, stddev_samp(u) AS stddev, sum(u * (t + 1)) AS tprod FROM s0 GROUP BY j, i)", KEYS))


def _confidence(s, d):
    c = cube(s, d)
    trend = c.groupBy("j", "i").agg(F.regr_slope("u", F.col("t") + 1.0).alias("trend"), F.regr_intercept("u", F.col("t") + 1.0).alias("icept"))
    return rounded(st.basic_confidence(c, trend, "u"), {"ressq": 1}, KEYS)


_add("stat_basic_confidence", _confidence, BASE + ", tr AS (SELECT j, i, regr_slope(u, t + 1) AS b, regr_intercept(u, t + 1) AS a FROM s0 GROUP BY j, i)\n" + rounded_sql({"ressq": 1}, "(SELECT j, i, sum(pow(u - a - b * (t + 1), 2)) AS ressq FROM s0 JOIN tr USING (j, i) GROUP BY j, i)", KEYS))
_w = {"minv": 1, "maxv": 1, "mean": 1, "stddev": 1, "wsum": 1}
_add("stat_basic_weighted", lambda s, d: rounded(st.basic_weighted(cube(s, d), "u", "q"), _w, KEYS), BASE + rounded_sql(_w, "(SELECT *, sqrt(greatest(b - mean * mean, 0)) AS stddev FROM (SELECT j, i, min(CASE WHEN q > 0 THEN u END) AS minv, max(CASE WHEN q > 0 THEN u END) AS maxv, sum(q * u) / nullif(sum(q), 0) AS mean, sum(q * u * u) / nullif(sum(q), 0) AS b, sum(q) AS wsum FROM s0 GROUP BY j, i))", KEYS))
BOUNDS = [-3.0, -1.0, 0.0, 1.0, 3.0, -3.0]
_BIN = "CASE WHEN u >= -3 AND u < -1 THEN 0 WHEN u >= -1 AND u < 0 THEN 1 WHEN u >= 0 AND u < 1 THEN 2 WHEN u >= 1 AND u < 3 THEN 3 ELSE 4 END"


def _binned(s, d):
    found = st.binned(cube(s, d), "u", BOUNDS)
    return found.select("j", "i", *[F.col("hist")[k].alias(f"n{k}") for k in range(5)], "mfv", "med")


_add("stat_binned", _binned, BASE + f""", b AS (SELECT j, i, {_BIN} AS b FROM s0), n AS (SELECT j, i, {', '.join(f'count(*) FILTER (b = {k}) AS n{k}' for k in range(5))} FROM b GROUP BY j, i)
    SELECT *, CASE greatest(n0, n1, n2, n3, n4) WHEN n0 THEN -2.0 WHEN n1 THEN -0.5 WHEN n2 THEN 0.5 WHEN n3 THEN 2.0 ELSE 0.0 END::DOUBLE AS mfv,
    CASE WHEN n0 >= (n0 + n1 + n2 + n3 + n4 + 1) // 2 THEN -2.0 WHEN n0 + n1 >= (n0 + n1 + n2 + n3 + n4 + 1) // 2 THEN -0.5 WHEN n0 + n1 + n2 >= (n0 + n1 + n2 + n3 + n4 + 1) // 2 THEN 0.5
         WHEN n0 + n1 + n2 + n3 >= (n0 + n1 + n2 + n3 + n4 + 1) // 2 THEN 2.0 ELSE 0.0 END::DOUBLE AS med FROM n""")
_add("stat_hist2d", lambda s, d: st.hist2d(table(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y")), "x", 5.0, 4.0, 10, "y", 0.005, 0.02, 4), """
    WITH b AS (SELECT CAST(trunc((CAST(l_quantity AS DOUBLE) - 5) / 4) AS INTEGER) AS bx, CAST(trunc((CAST(l_discount AS DOUBLE) - 0.005::DOUBLE) / 0.02::DOUBLE) AS INTEGER) AS by_ FROM lineitem),
    c AS (SELECT CASE WHEN bx BETWEEN 0 AND 9 AND by_ BETWEEN 0 AND 3 THEN bx ELSE -1 END AS bx, CASE WHEN bx BETWEEN 0 AND 9 AND by_ BETWEEN 0 AND 3 THEN by_ ELSE -1 END AS by_ FROM b)
    SELECT bx, by_ AS "by", count(*) AS n FROM c GROUP BY ALL""")  # fmt: skip
_add("stat_windrose", lambda s, d: rounded(st.windrose(cube(s, d), F.degrees(F.atan2(-F.col("u"), -F.col("v"))), F.hypot("u", "v"), 8, [0.0, 1.0, 2.0, 4.0]), {"percent": 1}, ("sector", "bin", "n")), BASE + """
    , b AS (SELECT CAST(floor(((degrees(atan2(-u, -v)) + 360) % 360 + 22.5) / 45) AS INTEGER) % 8 AS sector, CASE WHEN f >= 4 THEN 3 WHEN f >= 2 THEN 2 WHEN f >= 1 THEN 1 ELSE 0 END AS bin FROM (SELECT *, sqrt(u * u + v * v) AS f FROM s0)),
    n AS (SELECT sector, bin, count(*) AS n FROM b GROUP BY ALL) SELECT sector, bin, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS percent FROM n""")


def _patterns(s, d):
    return cube(s, d).filter("t < 2").select((F.col("t") + 1).alias("n"), "j", "i", F.col("v").alias("pat"))


_RS = BASE + ", ts AS (SELECT p.t + 1 AS n, c.t, sum(c.u * p.v) AS ts FROM s0 c JOIN s0 p ON p.j = c.j AND p.i = c.i AND p.t < 2 GROUP BY ALL)\n"
_add("stat_regress_series", lambda s, d: rounded(st.regress(cube(s, d), "u", "u", _patterns(s, d))[0], {"ts": 1e-2}, ("n", "t")), _RS + rounded_sql({"ts": 1e-2}, "ts", ("n", "t")))
_add("stat_regress", lambda s, d: rounded(st.regress(cube(s, d), "u", "u", _patterns(s, d))[1], {"res": 1e-4}, ("n", "j", "i")), _RS + rounded_sql({"res": 1e-4}, "(SELECT n, j, i, sum(ts * u) AS res FROM s0 JOIN ts USING (t) GROUP BY ALL)", ("n", "j", "i")))
_add("stat_kernel_average_2d", lambda s, d: rounded(st.kernel_average(cube(s, d).filter("u > 2").select(F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("v").alias("z")), cube(s, d).select("j", "i", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y")).distinct(), 1.5, 2.0), {"density": 1, "average": 1}, KEYS), BASE + """
    , w AS (SELECT c.j, c.i, exp(-(pow((c.i - p.i) / 1.5::DOUBLE, 2) + pow((c.j - p.j) / 2.0::DOUBLE, 2)) / 2) AS w, p.v AS z FROM s0 c JOIN s0 p ON p.u > 2 AND abs(c.i - p.i) <= 6 AND abs(c.j - p.j) <= 8 WHERE c.t = 0),
    a AS (SELECT j, i, sum(w) AS density, sum(w * z) / sum(w) AS av FROM w GROUP BY j, i), m AS (SELECT max(density) AS top FROM a)
    SELECT j, i, CASE WHEN density >= 0.001::DOUBLE * top THEN round(density, 6) END AS density, CASE WHEN density >= 0.001::DOUBLE * top THEN round(av, 6) + 0.0::DOUBLE END AS average FROM a, m""")
_add("stat_percentile_thresholds", lambda s, d: st.percentile_thresholds(table(s, d, "events").withColumn("value", F.col("value").cast("double")), "value", 0.05, 0.95), "SELECT quantile_disc(value, 0.05) AS lower, quantile_disc(value, 0.95) AS upper FROM events")
_add("stat_mask_insignificant", lambda s, d: rounded(cube(s, d).join(st.basic(cube(s, d), "u"), list(KEYS)).withColumn("r", st.mask_insignificant(F.col("u"), F.col("mean"), F.col("stddev"), 1.5)), {"r": 1}), BASE + ", m AS (SELECT j, i, avg(u) AS a, stddev_samp(u) AS sd FROM s0 GROUP BY j, i)\n" + rounded_sql({"r": 1}, "(SELECT t, j, i, CASE WHEN abs(u - a) >= 1.5 * sd THEN u END AS r FROM s0 JOIN m USING (j, i))"))

# Time intervals.
EV = "WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM events)"


def _events(s, d):
    return table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("double").alias("value"))


def _agg_query(buckets):
    def query(s, d):
        found = tb.aggregate(_events(s, d), "ts", "value", buckets(), 1, ("event_type",), complete=False)
        return found.select("event_type", F.date_format("t_start", "yyyy-MM-dd HH:mm:ss").alias("t_start"), F.date_format("t_end", "yyyy-MM-dd HH:mm:ss").alias("t_end"), _r(F.col("mean")).alias("mean"), "valid", "cnt")

    return query


def _agg_sql(start: str, end: str, source: str = EV) -> str:
    f = "'%Y-%m-%d %H:%M:%S'"
    return f"""{source}, b AS (SELECT *, CAST({start} AS TIMESTAMP) AS t0 FROM e)
    SELECT event_type, strftime(t0, {f}) AS t_start, strftime(CAST({end} AS TIMESTAMP), {f}) AS t_end, round(avg(value), 6) AS mean, count(value) AS valid, count(*) AS cnt FROM b GROUP BY event_type, t0"""


_PENT = "((dayofyear(ts) - 1 - CASE WHEN year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) AND dayofyear(ts) > 59 THEN 1 ELSE 0 END) // 5)"
for _name, _buckets, _start, _end in (
    ("all", lambda: tb.whole("2024-01-01 00:00:00", "2025-01-01 00:00:00"), "TIMESTAMP '2024-01-01'", "TIMESTAMP '2025-01-01'"),
    ("cal_year", lambda: tb.CAL_YEAR, "date_trunc('year', ts)", "t0 + INTERVAL 1 YEAR"),
    ("met_season", lambda: tb.MET_SEASON, "date_trunc('month', ts) - to_months(CAST(month(ts) % 3 AS INTEGER))", "t0 + INTERVAL 3 MONTH"),
    ("cal_month", lambda: tb.CAL_MONTH, "date_trunc('month', ts)", "t0 + INTERVAL 1 MONTH"),
    ("cal_week", lambda: tb.CAL_WEEK, "date_trunc('week', ts)", "t0 + INTERVAL 7 DAY"),
    ("cal_pentad", lambda: tb.CAL_PENTAD, f"date_trunc('year', ts) + to_days(CAST(5 * {_PENT} + CASE WHEN year(ts) % 4 = 0 AND {_PENT} >= 12 THEN 1 ELSE 0 END AS INTEGER))", "t0 + INTERVAL 5 DAY"),
    ("nday", lambda: tb.n_days(4), "make_timestamp(epoch_us(ts) // 345600000000 * 345600000000)", "t0 + INTERVAL 4 DAY"),
    ("nhour", lambda: tb.n_hours(6), "make_timestamp(epoch_us(ts) // 21600000000 * 21600000000)", "t0 + INTERVAL 6 HOUR"),
):
    _add(f"agg_{_name}", _agg_query(_buckets), _agg_sql(_start, _end))


def _orders(buckets):
    def query(s, d):
        rows = table(s, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("event_type"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
        found = tb.aggregate(rows, "ts", "value", buckets(), 86400, ("event_type",), complete=False)
        return found.select("event_type", F.date_format("t_start", "yyyy-MM-dd HH:mm:ss").alias("t_start"), F.date_format("t_end", "yyyy-MM-dd HH:mm:ss").alias("t_end"), _r(F.col("mean"), 4).alias("mean"), "valid", "cnt")

    return query


_OR = "WITH e AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderpriority AS event_type, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders)"
_add("agg_met_season_years", _orders(lambda: tb.MET_SEASON), _agg_sql("date_trunc('month', ts) - to_months(CAST(month(ts) % 3 AS INTEGER))", "t0 + INTERVAL 3 MONTH", _OR).replace("avg(value), 6", "avg(value), 4"))
_add("agg_cal_pentad_years", _orders(lambda: tb.CAL_PENTAD), _agg_sql(f"date_trunc('year', ts) + to_days(CAST(5 * {_PENT} + CASE WHEN year(ts) % 4 = 0 AND {_PENT} >= 12 THEN 1 ELSE 0 END AS INTEGER))", "t0 + to_days(CASE WHEN year(t0) % 4 = 0 AND dayofyear(t0) = 56 THEN 6 ELSE 5 END)", _OR).replace("avg(value), 6", "avg(value), 4"))


def _steps(s, d):
    """Hourly means of the events: a series with steps, some of which are missing."""
    return _events(s, d).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))


_add("agg_complete_days", lambda s, d: tb.aggregate(_steps(s, d), "ts", "value", tb.n_days(1), 3600).select(F.date_format("t_start", "yyyy-MM-dd").alias("day"), _r(F.col("mean")).alias("mean"), "valid", "cnt"), EV + """, h AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS value FROM e GROUP BY 1)
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(avg(value), 6) AS mean, count(value) AS valid, count(*) AS cnt FROM h GROUP BY date_trunc('day', ts) HAVING min(ts) = date_trunc('day', min(ts)) AND max(ts) = date_trunc('day', min(ts)) + INTERVAL 23 HOUR""")
_add("agg_histogram", lambda s, d: tb.aggregate(_events(s, d), "ts", "value", tb.n_days(7), 1, (), [0.0, 5.0, 20.0, 60.0, 500.0], complete=False).select(F.date_format("t_start", "yyyy-MM-dd").alias("day"), *[F.col("hist")[k].alias(f"n{k}") for k in range(4)], "mfv", "cnt"), EV + """, b AS (SELECT make_timestamp(epoch_us(ts) // 604800000000 * 604800000000) AS t0, value FROM e),
    n AS (SELECT t0, count(*) FILTER (value < 5) AS n0, count(*) FILTER (value >= 5 AND value < 20) AS n1, count(*) FILTER (value >= 20 AND value < 60) AS n2, count(*) FILTER (value >= 60) AS n3, count(*) AS cnt FROM b GROUP BY t0)
    SELECT strftime(t0, '%Y-%m-%d') AS day, n0, n1, n2, n3, CASE greatest(n0, n1, n2, n3) WHEN n0 THEN 2.5 WHEN n1 THEN 12.5 WHEN n2 THEN 40.0 ELSE 280.0 END::DOUBLE AS mfv, cnt FROM n""")
_add("agg_resample_nearest", lambda s, d: tb.resample_nearest(_events(s, d), "ts", 6).select(F.date_format("t_nominal", "yyyy-MM-dd HH:mm:ss").alias("t"), "event_id"), """
    WITH e AS (SELECT event_id, ts, epoch_us(ts) // 1000000 AS s FROM events), b AS (SELECT *, (s + 10800) // 21600 * 21600 AS a FROM e)
    SELECT strftime(make_timestamp(CAST(1000000 * a AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS t, event_id FROM b QUALIFY row_number() OVER (PARTITION BY a ORDER BY abs(s - a), ts) = 1""")

# Composites. The cube's t stands for six-hourly steps from the start of 2024.
_T = "TIMESTAMP '2024-01-01' + to_hours(CAST(6 * t AS INTEGER))"


def _timed(s, d):
    return cube(s, d).withColumn("t", F.timestamp_seconds(F.lit(1704067200) + 21600 * F.col("t")))


def _deciders(s, d):
    c = _timed(s, d)
    series = _events(s, d).groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.avg("value").alias("value"))
    day = cp.by_date("even_day", lambda t: F.day(t) % 2 == 0)
    data = cp.by_data("warm", c.filter("j = 20 AND i = 3").select("t", "u"), lambda f: f["u"] > 0)
    index = cp.by_timeseries("busy", series, lambda v: v > 45)
    return c, [day, data, index, day & data, day | index, day ^ data, ~day, *cp.timelag(day, [-24, 6]), *cp.matrix([day], [~data]), *cp.timelag_months(day, [1])]


def _composite(s, d):
    c, deciders = _deciders(s, d)
    found = cp.composite(c, "u", cp.membership(c.select("t").distinct(), deciders))
    return rounded(found, {"mean": 1, "std": 1, "valid_cnt": 1}, ("composite", "j", "i"))


_DEC = f""", tt AS (SELECT DISTINCT t AS n, {_T} AS t FROM s0), ix AS (SELECT date_trunc('day', ts) AS d, avg(value) AS v FROM events GROUP BY 1), ix2 AS (SELECT d, v, lead(d) OVER (ORDER BY d) AS e FROM ix),
    c AS (SELECT n, day(t) % 2 = 0 AS a, EXISTS (SELECT 1 FROM s0 WHERE s0.t = tt.n AND j = 20 AND i = 3 AND u > 0) AS b, EXISTS (SELECT 1 FROM ix2 WHERE tt.t >= d AND tt.t < e AND v > 45) AS x,
        day(t + INTERVAL 24 HOUR) % 2 = 0 AS l1, day(t - INTERVAL 6 HOUR) % 2 = 0 AS l2, day(t - INTERVAL 1 MONTH) % 2 = 0 AS lm FROM tt),
    m AS (SELECT n, unnest([CASE WHEN a THEN 'even_day' END, CASE WHEN b THEN 'warm' END, CASE WHEN x THEN 'busy' END, CASE WHEN a AND b THEN 'even_day&warm' END, CASE WHEN a OR x THEN 'even_day|busy' END,
        CASE WHEN a <> b THEN 'even_day^warm' END, CASE WHEN NOT a THEN '~even_day' END, CASE WHEN l1 THEN 'even_day_lag-024h' END, CASE WHEN l2 THEN 'even_day_lag+006h' END, CASE WHEN a AND NOT b THEN 'even_day&~warm' END, CASE WHEN lm THEN 'even_day_lag+01mon' END]) AS composite FROM c)
    """
_add("comp_composite", _composite, BASE + _DEC + rounded_sql({"mean": 1, "std": 1, "valid_cnt": 1}, "(SELECT composite, j, i, avg(u) AS mean, stddev_samp(u) AS std, count(u) AS valid_cnt FROM s0 JOIN m ON m.n = s0.t WHERE composite IS NOT NULL GROUP BY ALL)", ("composite", "j", "i")))


def _members(s, d):
    c, deciders = _deciders(s, d)
    return cp.membership(c.select("t").distinct(), deciders).select("composite", F.date_format("t", "yyyy-MM-dd HH").alias("t"))


_add("comp_membership", _members, BASE + _DEC + f"SELECT composite, strftime({_T.replace('* t', '* n')}, '%Y-%m-%d %H') AS t FROM m WHERE composite IS NOT NULL")
_add("comp_time_average", lambda s, d: rounded(cube(s, d).filter("t >= 2 AND t < 7").groupBy("j", "i").agg(F.avg("u").alias("mean"), F.count("u").alias("valid")), {"mean": 1, "valid": 1}, KEYS), BASE + rounded_sql({"mean": 1, "valid": 1}, "(SELECT j, i, avg(u) AS mean, count(u) AS valid FROM s0 WHERE t >= 2 AND t < 7 GROUP BY j, i)", KEYS))

# Filters.
_SM = "u + (1::DOUBLE / 6) * (CASE WHEN j > 0 AND j < 49 THEN u[n] - 2 * u + u[s] ELSE 0 END + (u[e] - 2 * u + u[w]))"
_add("filter_smooth_xy", lambda s, d: rounded(fl.smooth_xy(GRID, GRID.slices(cube(s, d)), "u", 2, out="r"), {"r": 1}), stages_sql([{"a": _SM}, {"r": _SM.replace("u[", "a[").replace("* u", "* a").replace("u + (1", "a + (1")}]) + "\n" + rounded_sql({"r": 1}, "s2"))
WTS = [0.1, 0.2, 0.4, 0.2, 0.1]
_D = "::DOUBLE"
_add("filter_filter_xy", lambda s, d: rounded(fl.filter_xy(GRID, GRID.slices(cube(s, d)), "u", WTS, "r"), {"r": 1}), stages_sql([{"a": f"0.1{_D} * u[ss] + 0.2{_D} * u[s] + 0.4{_D} * u + 0.2{_D} * u[n] + 0.1{_D} * u[nn]"}, {"r": f"0.1{_D} * a[ww] + 0.2{_D} * a[w] + 0.4{_D} * a + 0.2{_D} * a[e] + 0.1{_D} * a[ee]"}]) + "\n" + rounded_sql({"r": 1}, "s2"))
_add("filter_filter_t", lambda s, d: rounded(fl.filter_t(GRID, cube(s, d), "u", WTS, "r"), {"r": 1}), BASE + rounded_sql({"r": 1}, f"(SELECT t, j, i, 0.1{_D} * lag(u, 2) OVER w + 0.2{_D} * lag(u) OVER w + 0.4{_D} * u + 0.2{_D} * lead(u) OVER w + 0.1{_D} * lead(u, 2) OVER w AS r FROM s0 WINDOW w AS (PARTITION BY j, i ORDER BY t))"))
_LW = [float(w) for w in fl.lanczos_weights(4, 4, 1)]
_add("filter_lanczos", lambda s, d: rounded(fl.filter_t(GRID, cube(s, d), "u", _LW, "r"), {"r": 1}), BASE + rounded_sql({"r": 1}, "(SELECT t, j, i, " + " + ".join(f"({w!r}::DOUBLE) * {'u' if k == 2 else f'lag(u, {2 - k}) OVER w' if k < 2 else f'lead(u, {k - 2}) OVER w'}" for k, w in enumerate(_LW)) + " AS r FROM s0 WINDOW w AS (PARTITION BY j, i ORDER BY t))"))
_K3 = "CASE WHEN j > 0 AND j < 49 THEN (u * 2 + u[e] + u[w] + u[n] + u[s]) / 6 ELSE u END"
_add("filter_smoothed_field", lambda s, d: rounded(fl.kernel3(GRID, GRID.slices(cube(s, d)), "u", 2, out="r"), {"r": 1}), stages_sql([{"a": _K3}, {"b": _K3.replace("u[", "a[").replace("u * 2", "a * 2").replace("ELSE u", "ELSE a")}, {"r": "CASE WHEN j > 1 AND j < 48 THEN b END"}]) + "\n" + rounded_sql({"r": 1}, "s3"))
_add("filter_momentum_flux", lambda s, d: rounded(fl.momentum_flux(cube(s, d), "u", "v", "r"), {"r": 1}), BASE + rounded_sql({"r": 1}, "(SELECT t, j, i, (u - avg(u) OVER (PARTITION BY t, j)) * (v - avg(v) OVER (PARTITION BY t, j)) AS r FROM s0)"))
_GR = {"a": "m OR coalesce(m[e], false) OR coalesce(m[w], false) OR coalesce(m[n], false) OR coalesce(m[s], false)"}
_add("filter_mask_grow", lambda s, d: fl.mask_grow(GRID, GRID.slices(cube(s, d)).withColumn("m", F.col("u") > 5), "m", 2).select("t", "j", "i", F.col("m").cast("int").alias("m")), stages_sql([{"m": "u > 5"}, _GR, {"b": _GR["a"].replace("m[", "a[").replace("m OR", "a OR", 1)}]) + "\nSELECT t, j, i, CAST(b AS INTEGER) AS m FROM s3")
_add("filter_mirror_y_domain", lambda s, d: rounded(fl.mirror_y(GRID, cube(s, d).select("t", "j", "i", "u")), {"u": 1}), BASE + rounded_sql({"u": 1}, "(SELECT t, j, i, u FROM s0 UNION ALL SELECT t, 98 - j, (i + 32) % 64, u FROM s0 WHERE j > 0 AND j < 49)"))
_add("filter_concat1", lambda s, d: rounded(fl.append_first_column(GRID, cube(s, d).select("t", "j", "i", "u", "lon"), "lon"), {"u": 1, "lon": 1}), BASE + rounded_sql({"u": 1, "lon": 1}, "(SELECT t, j, i, u, lon FROM s0 UNION ALL SELECT t, j, 64, u, lon + 360 FROM s0 WHERE i = 0)"))
_add("filter_unscale", lambda s, d: rounded(fl.pack(cube(s, d), "u"), {"packed": 1, "scale": 1e3, "offset": 1}), BASE + ", l AS (SELECT min(u) AS lo, max(u) AS hi FROM s0)\n" + rounded_sql({"packed": 1, "scale": 1e3, "offset": 1}, "(SELECT t, j, i, greatest(-32767, least(32767, round_even((u - (hi + lo) / 2) / ((hi - lo) / 65534), 0))) AS packed, (hi - lo) / 65534 AS scale, (hi + lo) / 2 AS \"offset\" FROM s0, l)").replace("AS offset", 'AS "offset"').replace("round(offset", 'round("offset"'))
_add("filter_scale", lambda s, d: rounded(cube(s, d).withColumn("p", F.when(F.col("i") == 5, -32768).otherwise(F.rint(F.col("u") * 100).cast("int"))).withColumn("r", fl.unpack(F.col("p"), 0.01, 3.0, -32768)), {"r": 1}), BASE + rounded_sql({"r": 1}, "(SELECT t, j, i, CASE WHEN i <> 5 THEN CAST(round_even(u * 100, 0) AS INTEGER) * 0.01::DOUBLE + 3 END AS r FROM s0)"))

# Interpolation.
_add("interp_vert_by_coord", lambda s, d: rounded(fl.vert_by_coord(GRID_Z, cube_z(s, d), "u", "th", [305.0, 318.5, 330.0]), {"value": 1}, ("t", "level", "j", "i")), f"WITH {CUBE_Z_SQL}, p AS (SELECT t, j, i, th, u, lead(th) OVER w AS c, lead(u) OVER w AS v FROM s0 WINDOW w AS (PARTITION BY t, j, i ORDER BY k)), l AS (SELECT unnest([305.0::DOUBLE, 318.5::DOUBLE, 330.0::DOUBLE]) AS level)\n" + rounded_sql({"value": 1}, "(SELECT t, level, j, i, min(CASE WHEN (th <= level AND level < c) OR (th >= level AND level > c) THEN u + (level - th) * (v - u) / nullif(c - th, 0) END) AS value FROM p, l GROUP BY ALL)", ("t", "level", "j", "i")))


def _places(s, d):
    return cube(s, d).select("t", "j", (F.col("i") + 0.25 * (F.col("j") % 5)).alias("x"))


_add("interp_by_idx_1d", lambda s, d: rounded(fl.at_index(GRID, cube(s, d), "u", _places(s, d)), {"u": 1}, ("t", "j", "x")), BASE + ", p AS (SELECT t, j, i + 0.25::DOUBLE * (j % 5) AS x FROM s0)\n" + rounded_sql({"u": 1}, "(SELECT p.t, p.j, p.x, CASE WHEN x = floor(x) THEN a.u ELSE (1 - (x - floor(x))) * a.u + (x - floor(x)) * b.u END AS u FROM p LEFT JOIN s0 a ON a.t = p.t AND a.j = p.j AND a.i = floor(x) LEFT JOIN s0 b ON b.t = p.t AND b.j = p.j AND b.i = floor(x) + 1)", ("t", "j", "x")))


def _spots(s, d):
    return cube(s, d).select("t", (F.col("j") + 0.5).alias("y"), (F.col("i") + 0.25 * (F.col("j") % 4)).alias("x"))


_add("interp_at_position", lambda s, d: rounded(fl.at_position(cube(s, d), "u", _spots(s, d)), {"u": 1}, ("t", "y", "x")), BASE + ", p AS (SELECT t, j + 0.5::DOUBLE AS y, i + 0.25::DOUBLE * (j % 4) AS x FROM s0)\n" + rounded_sql({"u": 1}, """(SELECT p.t, p.y, p.x, CASE WHEN x = floor(x) THEN 0.5 * a.u + 0.5 * c.u ELSE 0.5 * ((1 - (x - floor(x))) * a.u + (x - floor(x)) * b.u) + 0.5 * ((1 - (x - floor(x))) * c.u + (x - floor(x)) * e.u) END AS u FROM p
    LEFT JOIN s0 a ON a.t = p.t AND a.j = floor(y) AND a.i = floor(x) LEFT JOIN s0 b ON b.t = p.t AND b.j = floor(y) AND b.i = floor(x) + 1 LEFT JOIN s0 c ON c.t = p.t AND c.j = floor(y) + 1 AND c.i = floor(x) LEFT JOIN s0 e ON e.t = p.t AND e.j = floor(y) + 1 AND e.i = floor(x) + 1)""", ("t", "y", "x")))
