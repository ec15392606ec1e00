"""Structured Streaming forms of the time aggregation and of the low tracker.

Event time must be a timestamp (not the type without time zone); rows that come
after the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import TRACK_SCHEMA, TRACKING, TrackConfig, link_lows

#: Setting and value of the state store that typed state needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_NAMES = [c.split()[0] for c in TRACK_SCHEMA.split(", ")]


def windowed_aggregate(stream: DataFrame, t: str, v: str, width: str, delay: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, number of values and of rows for each interval, given out once the watermark has passed its end."""
    rows = stream.withWatermark(t, delay)
    found = rows.groupBy(F.window(t, width).alias("w"), *by).agg(F.avg(v).alias("mean"), F.count(v).alias("valid"), F.count(F.lit(1)).alias("cnt"))
    return found.select(F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), *by, "mean", "valid", "cnt")


def session_aggregate(stream: DataFrame, t: str, v: str, gap: str, delay: str, by: tuple[str, ...]) -> DataFrame:
    """The same for sessions: runs of rows of a key without a gap."""
    rows = stream.withWatermark(t, delay)
    found = rows.groupBy(F.session_window(t, gap).alias("w"), *by).agg(F.avg(v).alias("mean"), F.count(v).alias("valid"), F.count(F.lit(1)).alias("cnt"))
    return found.select(F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), *by, "mean", "valid", "cnt")


def running_statistics(stream: DataFrame, v: str, by: tuple[str, ...]) -> DataFrame:
    """Least, greatest, mean and deviation of all rows so far (complete mode)."""
    return stream.groupBy(*by).agg(F.min(v).alias("minv"), F.max(v).alias("maxv"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"), F.count(v).alias("n"))


_OPEN = TRACK_SCHEMA + ", number long"


class _TrackProcessor(StatefulProcessor):
    """Typed state of a hemisphere: the rows of its last step with the numbers of their tracks, that step, and the next number."""

    def __init__(self, config: TrackConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", _OPEN)
        self.at = handle.getValueState("at", "step long, next long")

    def _keep(self, rows: list[dict], step: int, following: int) -> None:
        plain = lambda v: v.tolist() if hasattr(v, "tolist") else v
        self.open.put([tuple(plain(r[c]) for c in (*_NAMES, "number")) for r in rows]) if rows else self.open.clear()
        self.at.update((step, following))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """Rows of the last step of a batch, and how many tracks it has."""
        if len(initialState):
            rows = initialState.sort_values("place").to_dict("records")
            self._keep([{**r, "number": r["track_id"]} for r in rows], int(rows[0]["t"]), int(rows[0]["tracks"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        step, following = (int(x) for x in self.at.get()) if self.at.exists() else (None, 0)
        before = [{**dict(zip(_NAMES, r, strict=False)), "number": r[-1]} for r in self.open.get()] if self.open.exists() else []
        out = []
        for t, part in pd.concat(list(rows)).sort_values(["t", "j", "i"]).groupby("t"):
            if step is not None and t <= step:
                continue
            numbers = {r["track_id"]: r["number"] for r in before} if step is not None and t == step + 1 else {}
            before = link_lows(key[0], int(t), part.to_dict("records"), before if numbers else [], self.config)
            for r in before:
                if r["track_id"] not in numbers:
                    numbers[r["track_id"]], following = following, following + 1
                r["number"] = numbers[r["track_id"]]
            step = int(t)
            out += [{**r, "track_id": r["number"]} for r in before]
        if step is not None:
            self._keep(before, step, following)
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def track_stream(lows: DataFrame, config: TrackConfig = TRACKING, tracked: DataFrame | None = None) -> DataFrame:
    """Tracks of located lows as they come: the typed state of a hemisphere is its last step's rows and the next number.

    Steps of a batch are taken in order; a step that comes after a later one is
    dropped.  Gives the same tracks as ``track_cyclones`` if steps come in order.
    With ``tracked`` (rows of ``track_cyclones``) the stream goes on where these end.
    The session's state store must be RocksDB's (``ROCKSDB``).
    """
    initial = None
    if tracked is not None:
        last = tracked.groupBy("hemis").agg(F.max("t").alias("t"), (F.max("track_id") + 1).alias("tracks"))
        initial = tracked.join(last, ["hemis", "t"]).select(*_NAMES, "tracks").groupBy("hemis")
    return lows.groupBy("hemis").transformWithStateInPandas(_TrackProcessor(config), TRACK_SCHEMA, "Append", "None", initial)
