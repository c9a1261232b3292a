"""The live analysis as one stream: samples in, gated predictions out, in any order of arrival.

State is a map from a sample's time to its colours, so a batch writes what came and removes
what left the window, not the window anew. A sample that comes again finds its time taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import live
from ..sources import readers

COLOURS = "r array<double>, g array<double>, b array<double>"
WINDOW = f"session_id string, run_id bigint, revision bigint, newest double, n int, fps double, {COLOURS}"
#: The store that keeps state by key; the session has to be set to it before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: For runs that end with their input (availableNow): timers would else ask for one empty batch after another.
ENDS = ("spark.sql.streaming.noDataMicroBatches.enabled", "false")


class TrailingWindow(StatefulProcessor):
    """Keeps each session's samples of the last `seconds` and gives its window after every batch that brought some.

    Samples of an older run are stale and dropped; a newer run starts afresh. A sample whose time
    is held already is a repetition and dropped. State goes when nothing came for `idle_ms`.
    """

    def __init__(self, seconds: float, idle_ms: int) -> None:
        self.seconds, self.idle_ms = seconds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getMapState("samples", "t double", COLOURS)
        self.session = handle.getValueState("session", "run_id bigint, newest double, revision bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, newest, revision = self.session.get() if self.session.exists() else (None, float("-inf"), 0)
        held = {k[0] for k in self.samples.keys()} if self.samples.exists() else set()
        added = False
        for part in rows:
            for own, some in part.dropna(subset=["t_s", "run_id"]).groupby("run_id", sort=True):
                if run is not None and own < run:
                    continue
                if run is None or own > run:
                    run, newest, held = int(own), float("-inf"), set()
                    self.samples.clear()
                newest = max(newest, float(some["t_s"].max()))
                for t, r, g, b in zip(some["t_s"], some["r"], some["g"], some["b"]):
                    if t >= newest - self.seconds and t not in held:
                        self.samples.updateValue((float(t),), (list(map(float, r)), list(map(float, g)), list(map(float, b))))
                        held.add(float(t))
                        added = True
        if run is None:
            return
        for t in [t for t in held if t < newest - self.seconds]:
            self.samples.removeKey((t,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if not added:
            self.session.update((run, newest, revision))
            return
        self.session.update((run, newest, revision + 1))
        window = sorted((k[0], v) for k, v in self.samples.iterator())
        times = [t for t, _ in window]
        steps = sorted(b - a for a, b in zip(times, times[1:]) if b > a)
        middle = (steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2 if len(times) >= 3 and steps else None
        colours = [[v[c][k] for k in range(len(live.REGIONS)) for _, v in window] for c in range(3)]
        yield pd.DataFrame({"session_id": [key[0]], "run_id": [run], "revision": [revision + 1], "newest": [newest], "n": [len(window)], "fps": [1.0 / middle if middle else None], **{c: [v] for c, v in zip("rgb", colours)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.samples.clear()
        self.session.clear()
        return iter(())

    def close(self) -> None:
        pass


def windows(samples: DataFrame, seconds: float = 8.0, idle_seconds: float = 600.0) -> DataFrame:
    """A session's window after every batch: session_id, run_id, revision, newest, n, fps and colours, region after region.

    samples: session_id, run_id, t_s and rois, a map of regions to colours; incomplete ones are
    dropped. revision counts the windows of a session since its state was made, so that each is told apart.
    """
    complete = readers.complete_samples(samples, live.REGIONS).select(F.col("session_id").cast("string"), F.col("run_id").cast("bigint"), F.col("t_s").cast("double"), "r", "g", "b")
    return complete.groupBy("session_id").transformWithStateInPandas(TrailingWindow(seconds, int(idle_seconds * 1000)), WINDOW, "append", "ProcessingTime")


def predictions(samples: DataFrame, seconds: float = 8.0, fps: float = 30.0, scorer: str = "spectral", idle_seconds: float = 600.0) -> DataFrame:
    """The whole live loop as a stream: windows, channels, quality, gate, consensus and the gated prediction of every revision."""
    keys = ["session_id", "run_id", "revision", "newest"]
    return live.predict(live.analysed(windows(samples, seconds, idle_seconds), keys, seconds, fps), scorer)
