"""Time intervals as bucket Columns, and aggregation over complete intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import binned


@dataclass(frozen=True)
class Buckets:
    """Intervals of time: functions from a timestamp Column to the start of its interval and of the next one."""

    name: str
    start: object
    following: object


def _months(n: int, shift: int = 0):
    def start(t: Column) -> Column:
        month = F.date_trunc("month", t)
        return F.add_months(month, -F.pmod(F.month(t) - 1 - shift, F.lit(n))).cast("timestamp")

    return start, lambda s: F.add_months(s, n).cast("timestamp")


CAL_YEAR = Buckets("cal_year", *_months(12))
#: December to February and so on.
MET_SEASON = Buckets("met_season", *_months(3, 2))
CAL_MONTH = Buckets("cal_month", *_months(1))
#: Weeks begin on Monday.
CAL_WEEK = Buckets("cal_week", lambda t: F.date_trunc("week", t), lambda s: (F.to_date(s) + F.expr("INTERVAL 7 DAYS")).cast("timestamp"))


def _leap(t: Column) -> Column:
    y = F.year(t)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _pentad(t: Column) -> Column:
    """Five-day intervals of the year, 0 to 72; the leap day makes number 11 a day longer."""
    day = F.dayofyear(t) - 1
    return F.floor((day - F.when(_leap(t) & (day >= 59), 1).otherwise(0)) / 5)


def _pentad_start(t: Column) -> Column:
    p = _pentad(t)
    days = (5 * p + F.when(_leap(t) & (p >= 12), 1).otherwise(0)).cast("int")
    return F.date_add(F.date_trunc("year", t).cast("date"), days).cast("timestamp")


CAL_PENTAD = Buckets(
    "cal_pentad", _pentad_start, lambda s: F.date_add(F.to_date(s), F.when(_leap(s) & (_pentad(s) == 11), 6).otherwise(5)).cast("timestamp")
)


def n_hours(n: int, epoch: str = "1970-01-01 00:00:00") -> Buckets:
    """Intervals of n hours from an epoch."""
    base, width = F.unix_timestamp(F.lit(epoch).cast("timestamp")), n * 3600
    start = lambda t: F.timestamp_seconds(base + F.floor((F.unix_timestamp(t) - base) / width) * width)
    return Buckets(f"{n}h", start, lambda s: F.timestamp_seconds(F.unix_timestamp(s) + width))


def n_days(n: int, epoch: str = "1970-01-01 00:00:00") -> Buckets:
    """Intervals of n days from an epoch."""
    return n_hours(24 * n, epoch)


def whole(begin: str, end: str) -> Buckets:
    """One interval."""
    return Buckets("all", lambda t: F.lit(begin).cast("timestamp"), lambda s: F.lit(end).cast("timestamp"))


def by_interval(hours: int) -> Buckets:
    """The kind of interval that lasts so many hours."""
    return CAL_WEEK if hours == 168 else n_days(hours // 24) if hours % 24 == 0 else n_hours(hours)


def with_bucket(rows: DataFrame, t: str, buckets: Buckets, out: str = "bucket") -> DataFrame:
    """Adds the start of each row's interval."""
    return rows.withColumn(out, buckets.start(F.col(t)))


def aggregate(rows: DataFrame, t: str, v: str, buckets: Buckets, step_seconds: int, by: tuple[str, ...] = (), bounds: list[float] | None = None, complete: bool = True) -> DataFrame:
    """Mean and number of values (valid) and rows (cnt) for each interval; with ``bounds`` the histogram and mode instead.

    Columns: keys, t_start, t_end (of the next interval), then the statistics.
    Only complete intervals are kept: the first step is the interval's start and
    the last is one step before its end.
    """
    rows = rows.withColumn("t_start", buckets.start(F.col(t)))
    keys = [*by, "t_start"]
    found = rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.count(v).alias("valid"), F.count(F.lit(1)).alias("cnt"), F.min(t).alias("__a"), F.max(t).alias("__b"))
    if bounds:
        found = found.drop("mean").join(binned(rows, v, bounds, tuple(keys)).drop("med"), keys)
    found = found.withColumn("t_end", buckets.following(F.col("t_start")))
    if complete:
        last = F.unix_timestamp("t_end") - step_seconds
        found = found.filter((F.col("__a") == F.col("t_start")) & (F.unix_timestamp("__b") == last))
    return found.drop("__a", "__b")


def resample_nearest(rows: DataFrame, t: str, hours: int, by: tuple[str, ...] = ()) -> DataFrame:
    """For each multiple of so many hours, the row nearest in time (the earlier of two)."""
    width = hours * 3600
    at = F.floor((F.unix_timestamp(t) + width / 2) / width) * width
    away = F.abs(F.unix_timestamp(t) - F.col("__at"))
    w = Window.partitionBy(*by, "__at").orderBy(away, t)
    return rows.withColumn("__at", at).withColumn("__n", F.row_number().over(w)).filter("__n = 1").withColumn("t_nominal", F.timestamp_seconds("__at")).drop("__at", "__n")
