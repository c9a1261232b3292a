"""Sweeps over recordings: how a window's channels and rate depend on the buffer that was filtered.

A parameter table says which window is cut out of which buffer. Buffers that are the same for several
parameters, as those that end with the recording, are projected and filtered once a recording,
and all their windows are cut out of the one result. A recording and its parameters stay in its
row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import signals as S
from .live import CHANNELS, REGIONS

Scorer = Callable[[dict[str, Column]], Column]


def median_rate(rate: float, **options) -> Scorer:
    """The median of the channels' dominant rates in bpm, at `rate` samples a second."""

    def score(channels: dict[str, Column]) -> Column:
        found = F.array_sort(F.filter(F.array(*[K.quality(c, rate, **options)["bpm"] for c in channels.values()]), lambda x: x.isNotNull() & ~F.isnan(x)))
        n = F.size(found)
        return F.when(n > 0, (F.get(found, F.floor((n - 1) / 2).cast("int")) + F.get(found, F.floor(n / 2).cast("int"))) / 2)

    return score


def frame_of(seconds: Column, fps: float) -> Column:
    """The frame nearest to a time, half to even."""
    return F.rint(seconds * fps).cast("int")


def target_of(hr: Column, fallback: Column, start: Column, end: Column) -> Column:
    """Struct of a window's labels: mean, median, low, high and target, the mean or else the recording's own, with its source."""
    known = F.filter(F.slice(hr, start + 1, end - start), lambda x: S.finite(x).isNotNull())
    ordered, n = F.array_sort(known), F.size(known)
    mean = F.when(n > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / n)
    middle = F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)
    return F.struct(
        mean.alias("mean"), middle.alias("median"), F.array_min(known).alias("low"), F.array_max(known).alias("high"), F.coalesce(mean, fallback).alias("target"),
        F.when(n > 0, "hr_continuous_window_mean").otherwise("global_hr_mean").alias("source"),
    )


def cut_windows(rows: DataFrame, fps: float, wanted: str, frames: int) -> DataFrame:
    """A row for each entry of `wanted` with `w`, the entry, and `made`, the window's channels resampled to `frames` and scaled.

    rows: r, g, b, arrays of regions, each an array of frames; wanted: an array of structs with
    buffer_start, buffer_end, start and end in frames. Each distinct buffer of a row is filtered
    once. Channels are null where the buffer is too short for the filter. Colours are dropped.
    """
    of = lambda p: F.struct(p["buffer_start"].alias("s"), p["buffer_end"].alias("e"))
    each = rows.withColumn("__b", F.explode(F.array_distinct(F.transform(wanted, of))))
    mine = F.filter(wanted, lambda p: (p["buffer_start"] == F.col("__b.s")) & (p["buffer_end"] == F.col("__b.e")))
    part = lambda c: F.flatten(F.transform(F.col(c), lambda x: F.slice(x, F.col("__b.s") + 1, F.col("__b.e") - F.col("__b.s"))))
    kept = [c for c in rows.columns if c not in ("r", "g", "b", wanted)]
    filtered = each.select(*kept, mine.alias(wanted), "__b", K.pulse_signals(part("r"), part("g"), part("b"), len(REGIONS), K.training_signals, fps).alias("__p"))
    cut = filtered.withColumn("w", F.explode(wanted))
    ready = K.mapped(K.model_ready, frames)
    window = lambda c: ready(F.slice(F.col(f"__p.{c}"), F.col("w.start") - F.col("__b.s") + 1, F.col("w.end") - F.col("w.start")))
    return cut.select(*kept, "w", F.struct(*[window(c).alias(c) for c in CHANNELS]).alias("made"))


def _compared(rows: DataFrame, score: Scorer, frames: int) -> DataFrame:
    """Add stored_hr, stored_error, hr, error and the correlation of each channel with the stored one; rows: w, made, stored, hr, hr_mean."""
    ready = K.mapped(K.model_ready, frames)
    window = lambda c: ready(F.slice(F.col(f"stored.{c}"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")))
    held = rows.withColumns({f"__s_{c}": window(c) for c in CHANNELS} | {"target": target_of(F.col("hr"), F.col("hr_mean"), F.col("w.start"), F.col("w.end"))})
    found = held.withColumns({"stored_hr": score({c: F.col(f"__s_{c}") for c in CHANNELS}), "__hr": score({c: F.col(f"made.{c}") for c in CHANNELS})})
    return found.withColumns(
        {f"{c}_r": S.correlation(F.col(f"__s_{c}"), F.col(f"made.{c}")) for c in CHANNELS}
        | {"stored_error": F.abs(F.col("stored_hr") - F.col("target.target")), "error": F.abs(F.col("__hr") - F.col("target.target")), "hr": F.col("__hr")}
    ).drop("__hr", *[f"__s_{c}" for c in CHANNELS])


RESULTS = ["stored_hr", "stored_error", "hr", "error", *[f"{c}_r" for c in CHANNELS]]


def future_context(rows: DataFrame, keys: list[str], fps: float, end_second: float, seconds: float, pre_seconds: float, futures: list[float], frames: int, score: Scorer) -> DataFrame:
    """How much the frames after a window change it: a row for each length of future context, and one, future_s null, for the whole recording.

    rows: keys, r, g, b, stored (struct of the whole recording's channels), hr (labels by frame) and
    hr_mean. The buffer is the window with pre_seconds before and the future after it, as far as the recording goes;
    actual_pre_s and actual_future_s say how far. Recordings that don't hold the window give
    status `outside` and nulls.
    """
    n, end = F.size(F.get("r", F.lit(0))), frame_of(F.lit(float(end_second)), fps)
    start = end - int(round(seconds * fps))
    first = F.greatest(F.lit(0), start - int(round(pre_seconds * fps)))
    place = lambda future, s, e: F.struct(F.lit(future).cast("double").alias("future_s"), s.alias("buffer_start"), e.alias("buffer_end"), start.alias("start"), end.alias("end"))
    every = [place(None, F.lit(0), n)] + [place(f, first, F.least(n, end + int(round(f * fps)))) for f in futures]
    outside = F.coalesce((start < 0) | (end > n), F.lit(True))
    given = rows.withColumn("wanted", F.array(*every))
    made = _compared(cut_windows(given.where(~outside), fps, "wanted", frames), score, frames)
    whole = F.col("w.future_s").isNull()
    inside = made.select(
        *keys, F.col("w.future_s").alias("future_s"), F.lit("ok").alias("status"), F.when(~whole, (F.col("w.start") - F.col("w.buffer_start")) / fps).alias("actual_pre_s"),
        F.when(~whole, (F.col("w.buffer_end") - F.col("w.end")) / fps).alias("actual_future_s"), "target.target", *RESULTS,
    )
    left = given.where(outside).select(*keys, F.explode("wanted.future_s").alias("future_s"), F.lit("outside").alias("status"))
    return inside.unionByName(left, allowMissingColumns=True)


def end_seconds(rows: DataFrame, keys: list[str], fps: float, ends: list[float], seconds: float, buffer_seconds: float, frames: int, score: Scorer) -> DataFrame:
    """Windows that end at each of some seconds, from the stored channels and from a buffer of their own: a row an end.

    status is `skip` where the recording doesn't hold the window, `short` where the buffer is
    shorter than it (stored rate alone), else ok. rows as for future_context.
    """
    n, window, buffer = F.size(F.get("r", F.lit(0))), int(round(seconds * fps)), int(round(buffer_seconds * fps))
    place = lambda s: F.struct(F.lit(float(s)).alias("end_s"), F.greatest(F.lit(0), frame_of(F.lit(float(s)), fps) - buffer).alias("buffer_start"), frame_of(F.lit(float(s)), fps).alias("buffer_end"), (frame_of(F.lit(float(s)), fps) - window).alias("start"), frame_of(F.lit(float(s)), fps).alias("end"))
    given = rows.withColumn("wanted", F.array(*[place(s) for s in ends]))
    fits = lambda p: (p["start"] >= 0) & (p["end"] <= n)
    held = given.withColumn("wanted", F.filter("wanted", fits))
    made = _compared(cut_windows(held, fps, "wanted", frames), score, frames)
    short = F.col("w.buffer_end") - F.col("w.buffer_start") < window
    own = [F.when(~short, F.col(c)).alias(c) for c in ("hr", "error", *[f"{c}_r" for c in CHANNELS])]
    labels = [F.col(f"target.{c}").alias(f"hr_{c}") for c in ("mean", "median", "low", "high")]
    inside = made.select(*keys, F.col("w.end_s").alias("end_s"), F.when(short, "short").otherwise("ok").alias("status"), F.col("w.start").alias("start_frame"), F.col("w.end").alias("end_frame"), *labels, "stored_hr", "stored_error", *own)
    left = given.select(*keys, F.explode(F.filter("wanted", lambda p: ~F.coalesce(fits(p), F.lit(False)))).alias("w")).select(*keys, F.col("w.end_s").alias("end_s"), F.lit("skip").alias("status"))
    return inside.unionByName(left, allowMissingColumns=True)
