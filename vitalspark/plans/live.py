"""The analyses that callers ask for: a live series, a gated prediction, and offline evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import signals as S
from ..operators import evaluate, rules
from ..operators import windows as W
from ..sources import readers

#: The regions of a face and the channels in the order that models take them.
REGIONS, CHANNELS = ["forehead", "image_left_cheek", "image_right_cheek"], ["pos", "chrom", "green"]


def series(samples: DataFrame, keys: list[str], seconds: float = 8.0) -> DataFrame:
    """One row a session: its latest complete samples as colour arrays, region after region, with n and fps.

    A session's trailing window is bounded by its seconds, so gathering it is too.
    """
    complete = readers.complete_samples(samples, REGIONS)
    newest = complete.groupBy(*keys).agg(F.max("t_s").alias("newest"))
    recent = complete.join(newest, keys).where(F.col("t_s") >= F.col("newest") - seconds)
    packed = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t_s", "r", "g", "b"))).alias("w"))
    t = F.col("w.t_s")
    steps = F.filter(F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: b - a), lambda d: d > 0)
    gaps = F.when(F.size(t) >= 3, rules.middle(steps))
    colour = lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(REGIONS) - 1)), lambda k: F.transform(F.col(f"w.{c}"), lambda x: F.get(x, k))))
    return packed.select(*keys, F.size("w").alias("n"), F.try_divide(F.lit(1.0), gaps).alias("fps"), *[colour(c).alias(c) for c in "rgb"])


def analyse(samples: DataFrame, keys: list[str], seconds: float = 8.0, fps: float = 30.0) -> DataFrame:
    """The classical analysis of every session: channels, rates, quality, gate and consensus.

    Signals are put on an even grid of `fps` before their spectra are taken; sessions of under
    eight samples have no channels and are rejected.
    """
    return analysed(series(samples, keys, seconds), keys, seconds, fps)


def analysed(rows: DataFrame, keys: list[str], seconds: float = 8.0, fps: float = 30.0) -> DataFrame:
    """The same of windows that are put together already: keys, n, fps, and r, g, b as `series` has them; of a table or of a stream."""
    made = rows.withColumn("p", F.when(F.col("n") >= 8, K.pulse_signals(F.col("r"), F.col("g"), F.col("b"), len(REGIONS))))
    length = int(seconds * fps)
    made = made.select(*keys, "n", "fps", *[K.mapped(K.fourier_resample, length)(F.col(f"p.{c}")).alias(c) for c in CHANNELS])
    # The grid has `length` samples over the time that the window's samples took.
    made = made.withColumn("grid", length * F.col("fps") / F.col("n"))
    return gated(made, keys, "grid")


def gated(signals: DataFrame, keys: list[str], rate: str) -> DataFrame:
    """Quality of each channel at each row's own rate, and the gate over them."""
    found = signals.withColumns({f"q_{c}": rated_quality(F.col(c), F.col(rate)) for c in CHANNELS})
    gate = rules.quality_gate({c: F.col(f"q_{c}.bpm") for c in CHANNELS}, {c: F.col(f"q_{c}.sqi") for c in CHANNELS})
    return found.withColumns(gate).withColumns({f"{c}_{m}": F.col(f"q_{c}.{m}") for c in CHANNELS for m in ("bpm", "sqi")}).drop(*[f"q_{c}" for c in CHANNELS])


def rated(signals: pd.Series, rates: pd.Series):
    """Rows of one rate and length at a time: (rate, row numbers, matrix)."""
    known = rates.to_numpy(dtype=float)
    for own in np.unique(known[np.isfinite(known)]):
        for rows, x in K._matrices(signals.where(pd.Series(known == own, index=signals.index), None)):
            yield float(own), rows, x


def rated_quality(signal: Column, rate: Column) -> Column:
    """Spectral quality at a rate of each row's own: rows of one rate and length go together."""

    @F.pandas_udf("bpm double, sqi double")
    def run(signals: pd.Series, rates: pd.Series) -> pd.DataFrame:
        out = np.full((len(signals), 2), np.nan)
        for own, rows, x in rated(signals, rates):
            if own > 2 * K.HIGH:
                bpm, sqi, _ = K.spectral_quality(x, own)
                out[rows, 0], out[rows, 1] = bpm, sqi
        return pd.DataFrame(out, columns=["bpm", "sqi"])

    return run(signal, rate)


def rated_channels(r: Column, g: Column, b: Column, rate: Column) -> Column:
    """Training-style channels of each row at its own rate; nulls where the rate or length allows no band-pass."""

    @F.pandas_udf("green array<double>, pos array<double>, chrom array<double>")
    def run(red: pd.Series, green: pd.Series, blue: pd.Series, rates: pd.Series) -> pd.DataFrame:
        out = {c: [None] * len(red) for c in ("green", "pos", "chrom")}
        for own, rows, x in rated(red, rates):
            cube = np.stack([p.reshape(len(rows), len(REGIONS), -1) for p in (x, *(np.stack(c.iloc[rows].to_numpy()).astype(float) for c in (green, blue)))], axis=-1)
            for name, made in K.training_signals(cube, own).items():
                for k, row in zip(rows, made, strict=True):
                    out[name][k] = None if np.isnan(row).any() else row.tolist()
        return pd.DataFrame(out)

    return run(r, g, b, rate)


def buffered(samples: DataFrame, keys: list[str], seconds: float = 8.0, buffer_seconds: float = 12.0, frames: int = 240) -> DataFrame:
    """Model-ready channels of every session: a longer buffer is filtered, then its last `seconds` are cut out, resampled and scaled.

    status is ok or error, with a message; sessions in error have null channels.
    """
    rows = series(samples, keys, max(seconds, buffer_seconds))
    # Samples keep the order of their times, so the window is the buffer's tail.
    made = rows.withColumns({"p": rated_channels(F.col("r"), F.col("g"), F.col("b"), F.col("fps")), "window_n": F.least(F.col("n"), F.floor(seconds * F.col("fps") + 1e-9).cast("int") + 1)})
    message = F.when(F.col("fps").isNull(), "no sampling rate").when(F.col("p.pos").isNull(), "the buffer can't be filtered").when(F.col("window_n") < 8, "too few samples in the window")
    ready = lambda c: K.mapped(K.model_ready, frames)(F.when(message.isNull(), W.last_part(F.col(f"p.{c}"), F.col("window_n"))))
    return made.select(*keys, "n", "fps", "window_n", F.when(message.isNull(), "ok").otherwise("error").alias("status"), message.alias("message"), *[ready(c).alias(c) for c in CHANNELS])


def candidates(rows: DataFrame, keys: list[str], fps: float, seconds: float, buffer_seconds: float, rates: list[float], frames: int = 240) -> DataFrame:
    """Every way to get a window's channels, one row each: stored, source_buffer, and simulated at each rate; a way that fails says so.

    rows: keys, stored (struct of pos, chrom and green of the window) and r, g, b, arrays of regions,
    each an array of the recording's frames up to the window's end.
    """
    ready = K.mapped(K.model_ready, frames)
    ways = [rows.select(*keys, F.lit("stored").alias("mode"), F.lit(None).cast("double").alias("simulated_fps"), F.size("stored.pos").alias("samples"), *[ready(F.col(f"stored.{c}")).alias(c) for c in CHANNELS])]
    for rate in (None, *rates):
        own = fps if rate is None else rate
        n = F.size(F.get("r", F.lit(0)))
        first = F.greatest(F.lit(0), F.bround(n - buffer_seconds * fps).cast("int"))
        seen = F.sequence(first, n - 1) if rate is None else S.simulated_frames(first, n, F.lit(float(fps)), float(rate))
        cut = rows.withColumn("__f", seen)
        region = lambda c, k: F.transform("__f", lambda i: F.get(F.get(c, F.lit(k)), i))
        colours = [F.concat(*[region(c, k) for k in range(len(REGIONS))]) for c in "rgb"]
        window = int(round(seconds * own))
        made = cut.select(*keys, F.size("__f").alias("samples"), K.pulse_signals(*colours, len(REGIONS), K.buffered_channels, own, window, frames).alias("p"))
        ways.append(made.select(*keys, F.lit("source_buffer" if rate is None else "simulated_buffer").alias("mode"), F.lit(rate).cast("double").alias("simulated_fps"), "samples", *[F.col(f"p.{c}").alias(c) for c in CHANNELS]))
    every = ways[0]
    for w in ways[1:]:
        every = every.unionByName(w)
    return every.withColumn("status", F.when(F.col("pos").isNotNull() & F.col("chrom").isNotNull() & F.col("green").isNotNull(), "ok").otherwise("failed"))


def region_samples(pixels: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean colour and image quality of every region of a frame: pixels x, y, r, g, b inside boxes region, x_min, x_max, y_min, y_max.

    A region without pixels is rejected.
    """
    inside = (F.col("x") >= F.col("x_min")) & (F.col("x") < F.col("x_max")) & (F.col("y") >= F.col("y_min")) & (F.col("y") < F.col("y_max"))
    share = lambda c: F.avg(c.cast("double"))
    any_of = lambda f: f(F.col("r")) | f(F.col("g")) | f(F.col("b"))
    bright, dark = (lambda c: c >= 250), (lambda c: c <= 10)
    found = boxes.join(pixels, keys).where(inside).groupBy(*keys, "region").agg(
        F.count(F.lit(1)).alias("pixels"), *[F.avg(c).alias(c) for c in "rgb"], share(any_of(bright)).alias("saturated"), share(bright(F.col("r"))).alias("red_saturated"), share(bright(F.col("g"))).alias("green_saturated"), share(any_of(dark)).alias("dark")
    )
    every = boxes.select(*keys, "region").join(found, [*keys, "region"], "left")
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    quality = rules.image_quality(F.col("saturated"), F.col("red_saturated"), F.col("green_saturated"), F.col("dark"), F.col("g"), spread)
    empty = F.col("pixels").isNull()
    return every.withColumns({"status": F.when(empty, "reject").otherwise(quality["status"]), "reasons": F.when(empty, "empty").otherwise(quality["reasons"])})


def tone_errors(spark: SparkSession, rates: list[float], lengths: list[float], fps: float) -> DataFrame:
    """Mean and largest error of the dominant rate of synthetic tones by channel, for each window length."""
    every = None
    for seconds in lengths:
        made = readers.tones(spark, rates, seconds, fps)
        rows = made.select("bpm", F.lit(float(seconds)).alias("seconds"), F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), K.quality(F.col(c), fps)["bpm"].alias("found")) for c in CHANNELS])).alias("q"))
        every = rows if every is None else every.unionByName(rows)
    error = F.abs(F.col("q.found") - F.col("bpm"))
    return every.groupBy("seconds", F.col("q.channel").alias("channel")).agg(F.count(F.lit(1)).alias("tones"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def scored(signal: Column, kernel: Callable[[np.ndarray], np.ndarray], rows: int = 128) -> Column:
    """A score of every signal by a kernel over matrices of at most `rows` rows, made ready once a task; null for unusable rows."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), np.nan)
            for own, x in K._matrices(batch):
                for at in range(0, len(own), rows):
                    out[own[at : at + rows]] = kernel(x[at : at + rows])
            yield pd.Series(out, index=batch.index).where(np.isfinite(out), None)

    return run(signal)


#: Scorers by name: a column of a rate in bpm from the three channels, or null where they have none.
SCORERS: dict[str, Callable[[DataFrame], Column]] = {"spectral": lambda df: F.col("median_bpm"), "unavailable": lambda df: F.lit(None).cast("double")}


def predict(analysed: DataFrame, scorer: str = "spectral") -> DataFrame:
    """Predictions behind the gate: rejected windows, and those of too few or too slow samples, have no value; an unknown scorer is unavailable, not an error."""
    known = scorer if scorer in SCORERS else "unavailable"
    ready = F.col("accepted") & (F.col("n") >= 20) & (F.col("fps") >= 8)
    value = F.when(ready, S.clamped(SCORERS[known](analysed), 40.0, 180.0))
    made = analysed.withColumns({"model_name": F.lit(scorer), "value": value})
    return made.withColumn("state", rules.readiness(F.col("n"), F.col("fps"), F.col("accepted"), F.col("value"), F.col("median_bpm")))


def valid_input(signals: Column, channels: int = 3, frames: int = 240) -> Column:
    """Is this a model's window: so many channels of so many finite numbers?"""
    return (F.size(signals) == channels) & F.forall(signals, lambda x: (F.size(x) == frames) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)))


def model_window(df: DataFrame, frames: int = 240) -> Column:
    """Channels resampled, scaled and stacked in the contractual order."""
    return F.array(*[S.zscore(S.resampled(F.col(c), frames), "padded") for c in CHANNELS])


def evaluate_modes(predictions: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The tables of an offline evaluation: errors, bias, calibration and coverage by group."""
    errors = evaluate.with_errors(predictions)
    return {"errors": evaluate.error_summary(errors, keys), "bias": evaluate.bias_summary(errors, keys), "calibration": evaluate.calibration(errors, keys), "coverage": evaluate.coverage(errors, keys)}
