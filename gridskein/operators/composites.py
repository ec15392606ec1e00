"""Composites: means of fields over the times that conditions pick.

A decider turns times into a membership: a frame (composite, t).  Deciders
combine by ``&``, ``|``, ``^`` and ``~``; lags and products of lists make families.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Decider:
    """A named condition on times: ``evaluate`` adds to a frame of times (t) a boolean column of a given name."""

    name: str
    evaluate: Callable[[DataFrame, str], DataFrame]

    def _with(self, other: Decider, sign: str, combine: Callable[[Column, Column], Column]) -> Decider:
        def evaluate(times: DataFrame, out: str) -> DataFrame:
            both = other.evaluate(self.evaluate(times, f"{out}a"), f"{out}b")
            return both.withColumn(out, combine(F.col(f"{out}a"), F.col(f"{out}b"))).drop(f"{out}a", f"{out}b")

        return Decider(f"{self.name}{sign}{other.name}", evaluate)

    def __and__(self, other: Decider) -> Decider:
        return self._with(other, "&", lambda a, b: a & b)

    def __or__(self, other: Decider) -> Decider:
        return self._with(other, "|", lambda a, b: a | b)

    def __xor__(self, other: Decider) -> Decider:
        return self._with(other, "^", lambda a, b: a != b)

    def __invert__(self) -> Decider:
        return Decider(f"~{self.name}", lambda times, out: self.evaluate(times, out).withColumn(out, ~F.col(out)))


def by_date(name: str, criterion: Callable[[Column], Column]) -> Decider:
    """A condition on the time itself."""
    return Decider(name, lambda times, out: times.withColumn(out, F.coalesce(criterion(F.col("t")), F.lit(False))))


def by_data(name: str, field: DataFrame, criterion: Callable[[DataFrame], Column]) -> Decider:
    """A condition on a frame with one row for each t (such as a field at one cell); times without a row don't fulfil it."""

    def evaluate(times: DataFrame, out: str) -> DataFrame:
        found = field.select("t", criterion(field).alias(out))
        return times.join(found, "t", "left").withColumn(out, F.coalesce(out, F.lit(False)))

    return Decider(name, evaluate)


def by_timeseries(name: str, series: DataFrame, criterion: Callable[[Column], Column]) -> Decider:
    """A condition on an index (d, value), each value valid from its time to the next; before the first and from the last on it isn't fulfilled.

    An as-of join: times and index are sorted together, by year so that no task
    holds all of it; each year also gets the last index value before it.
    """

    def evaluate(times: DataFrame, out: str) -> DataFrame:
        year = lambda c: F.year(c)
        ends = series.agg(F.max("d").alias("__end"))
        index = series.select(F.col("d").alias("t"), F.struct("d", "value").alias("__v"), year(F.col("d")).alias("__y"))
        years = times.select(year(F.col("t")).alias("__y")).distinct()
        last = index.groupBy("__y").agg(F.max_by("__v", "t").alias("__last")).withColumnRenamed("__y", "__z")
        carried = years.join(last, F.col("__z") < F.col("__y")).groupBy("__y").agg(F.max("__last").alias("__carried"))  # years, not times
        w = Window.partitionBy("__y").orderBy("t", "__order").rowsBetween(Window.unboundedPreceding, 0)
        both = times.withColumns({"__v": F.lit(None).cast(index.schema["__v"].dataType), "__y": year(F.col("t")), "__order": F.lit(1)})
        both = both.unionByName(index.withColumn("__order", F.lit(0)), allowMissingColumns=True)
        found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__order = 1").join(F.broadcast(carried), "__y", "left").crossJoin(F.broadcast(ends))
        value = F.coalesce(F.col("__v"), F.col("__carried"))["value"]
        return found.withColumn(out, F.coalesce(criterion(value) & (F.col("t") < F.col("__end")), F.lit(False))).select(*times.columns, out)

    return Decider(name, evaluate)


def timelag(decider: Decider, hours: list[int]) -> list[Decider]:
    """The condition at other times: each at the time less so many hours."""

    def one(h: int) -> Decider:
        def evaluate(times: DataFrame, out: str) -> DataFrame:
            moved = times.withColumns({"__t": F.col("t"), "t": F.timestamp_seconds(F.unix_timestamp("t") - 3600 * h)})
            return decider.evaluate(moved, out).withColumn("t", F.col("__t")).drop("__t")

        return replace(decider, name=f"{decider.name}_lag{h:+04d}h", evaluate=evaluate)

    return [one(h) for h in hours]


def timelag_months(decider: Decider, months: list[int]) -> list[Decider]:
    """The condition so many calendar months earlier."""

    def one(m: int) -> Decider:
        def evaluate(times: DataFrame, out: str) -> DataFrame:
            moved = times.withColumns({"__t": F.col("t"), "t": F.col("t") - F.make_interval(months=F.lit(m))})
            return decider.evaluate(moved, out).withColumn("t", F.col("__t")).drop("__t")

        return replace(decider, name=f"{decider.name}_lag{m:+03d}mon", evaluate=evaluate)

    return [one(m) for m in months]


def matrix(rows: list[Decider], columns: list[Decider]) -> list[Decider]:
    """All conjunctions of a decider of each list."""
    return [a & b for a in rows for b in columns]


def membership(times: DataFrame, deciders: list[Decider]) -> DataFrame:
    """(composite, t) of all deciders that hold; times are distinct."""
    for k, d in enumerate(deciders):
        times = d.evaluate(times, f"__c{k}")
    names = F.array(*[F.when(F.col(f"__c{k}"), F.lit(d.name)) for k, d in enumerate(deciders)])
    return times.select("t", F.explode(F.array_compact(names)).alias("composite"))


def composite(cube: DataFrame, v: str, times: DataFrame, by: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """(composite, keys, mean, std, valid_cnt) of a field over a membership."""
    joined = cube.join(times, "t")
    return joined.groupBy("composite", *by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("valid_cnt"))
