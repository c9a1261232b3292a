"""The live loop as a stream: trailing samples of every session, analysed as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "run_id bigint, t array<double>, x array<double>"
OUTPUT = "session_id bigint, run_id bigint, n int, first_t double, last_t double, mean_x double, effective_rate double"


def trailing_state(samples: DataFrame, seconds: float = 12.0, idle_seconds: float = 600.0) -> DataFrame:
    """The trailing window of each session after every batch, from samples session_id, run_id, t, x.

    State holds the session's run and its samples of the last `seconds`, and goes when nothing came
    for `idle_seconds`. Samples of an older run are stale and dropped; a newer run starts afresh.
    Samples may come in any order within the window; what is older than the window is dropped. Null
    times are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run, t, x = state.get if state.exists else (None, [], [])
        new = pd.concat(list(batches), ignore_index=True).dropna(subset=["t", "run_id"])
        if len(new):
            newest = int(new["run_id"].max())
            if run is None or newest > run:
                run, t, x = newest, [], []
            new = new[new["run_id"] == run]
            joined = sorted(zip(list(t) + new["t"].tolist(), list(x) + new["x"].tolist(), strict=True))
            joined = [p for p in joined if p[0] >= joined[-1][0] - seconds] if joined else []
            t, x = [p[0] for p in joined], [p[1] for p in joined]
            state.update((run, t, x))
        if state.exists:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        if t:
            span = t[-1] - t[0]
            yield pd.DataFrame([(key[0], run, len(t), t[0], t[-1], sum(x) / len(x), (len(t) - 1) / span if span > 0 else None)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return samples.groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "update", "ProcessingTimeTimeout")


def fixed_windows(samples: DataFrame, stamp: str, late: str = "10 seconds", length: str = "15 seconds", stride: str | None = None) -> DataFrame:
    """Counts and means of fixed or sliding measurements in event time; late samples are dropped by the watermark."""
    window = F.window(stamp, length, stride) if stride else F.window(stamp, length)
    return samples.withWatermark(stamp, late).groupBy("session_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_x")


def keep_history(runs: DataFrame, path: str, checkpoint: str):
    """Append every finished prediction of a stream to a table; returns the query. A restart adds nothing twice."""
    return runs.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repeatability(history: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key, the runs of a history: number, mean, deviation and range of their predictions."""
    return history.groupBy(*keys).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"))
