"""Recurrences through time, many segments of time at once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise

_SEGMENT = "__segment"


def in_segments(rows: DataFrame, by: str, t: str, length: int, advance: Callable[[object, int, list[dict], list[dict]], list[dict]], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Results of ``advance(key, step, rows, before)`` for all steps of each ``by``, as if they were taken one after the other.

    ``before`` are the results of the step t - 1 (none: it has no rows), so they are
    all that is carried on; results have ``by`` and ``t`` and follow ``schema``.
    Segments of ``length`` steps start without anything before them and run side by
    side.  Then those whose first step follows on other results of the segment
    before than it had are run again with these, until none is left: by induction
    from the first segment the results are those of one run.  What happened before
    a segment is soon without effect, so a second round mostly is the last; at
    worst there are as many rounds as segments.  Only the results of one step a
    segment are compared and handed on.
    """
    keys, names = [by, _SEGMENT], [c.split()[0] for c in schema.split(", ")]
    rows = materialise(rows.withColumn(_SEGMENT, F.floor(F.col(t) / length).cast("long")), "steps")
    spark, full = rows.sparkSession, f"{schema}, {_SEGMENT} long"

    def run(key, mine, starts):
        out, before, last = [], starts[names].to_dict("records"), int(key[1]) * length - 1
        for step, part in mine.sort_values([t, *order]).groupby(t, sort=True):
            before = advance(key[0], int(step), part.to_dict("records"), before if int(step) == last + 1 else [])
            out += before
            last = int(step)
        return pd.DataFrame(out, columns=names).assign(**{_SEGMENT: key[1]})

    apply = lambda part, starts: part.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(run, full)
    # A start matters where a segment has rows in its first step.
    heads = materialise(rows.filter(F.col(t) == F.col(_SEGMENT) * length).select(*keys).distinct(), "heads")
    used = spark.createDataFrame([], full)
    found = materialise(apply(rows, used), "segments")
    while True:
        ends = found.filter(F.col(t) == (F.col(_SEGMENT) + 1) * length - 1).withColumn(_SEGMENT, F.col(_SEGMENT) + 1)
        ends = materialise(ends.select(*used.columns).join(heads, keys, "left_semi").select(*used.columns), "ends")
        redo = ends.exceptAll(used).unionByName(used.exceptAll(ends)).select(*keys).distinct()
        redo = materialise(redo, "redo")
        if redo.isEmpty():
            discard(rows, heads, ends, redo)
            return found.drop(_SEGMENT)
        again = apply(rows.join(redo, keys, "left_semi"), ends.join(redo, keys, "left_semi"))
        later = materialise(found.join(redo, keys, "left_anti").select(*used.columns).unionByName(again), "segments")
        discard(found, redo)
        found, used = later, ends
