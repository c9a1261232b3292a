"""Windows over recordings and series: trailing, sliding and even windows, fills, crops and beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import signals as S
from . import scans
from .quantiles import joined, quantiles, with_quantiles


def trailing(samples: DataFrame, keys: list[str], time: str, seconds: float) -> DataFrame:
    """Samples no older than the newest of their recording by more than `seconds`, the bound included."""
    newest = samples.groupBy(*keys).agg(F.max(time).alias("newest"))
    return joined(samples, newest, keys).where(F.col(time) >= F.col("newest") - seconds).drop("newest")


def sampling_rate(samples: DataFrame, keys: list[str], time: str, width: float) -> DataFrame:
    """Rate from the median of the positive steps, null under three samples; and (n - 1) / duration. Scanned in buckets of `width`."""
    step = scans.scan(samples, keys, [time], width, {"__before": scans.previous(F.col(time))}).withColumn("step", F.col(time) - F.col("__before"))
    found = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(time) - F.min(time)).alias("duration"))
    found = with_quantiles(found, step, keys, {"middle": (F.when(F.col("step") > 0, F.col("step")), 0.5)})
    return found.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("middle") > 0), 1 / F.col("middle")).alias("rate"), F.when((F.col("n") >= 2) & (F.col("duration") > 0), (F.col("n") - 1) / F.col("duration")).alias("effective_rate"))


def sliding(recordings: DataFrame, frames: Column, size: Column, stride: Column) -> DataFrame:
    """A row a full window: start_frame and end_frame, from 0 by the stride."""
    starts = recordings.withColumns({"__n": frames.cast("int"), "__w": size.cast("int"), "__s": stride.cast("int")}).where("__n >= __w and __s > 0")
    return starts.withColumn("start_frame", F.explode(F.sequence(F.lit(0), F.col("__n") - F.col("__w"), F.col("__s")))).withColumn("end_frame", F.col("start_frame") + F.col("__w")).drop("__n", "__w", "__s")


def even_ends(frames: Column, size: Column, count: int) -> Column:
    """Ends of `count` windows spread evenly inside a recording, its first and last window left out."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.floor(size + (frames - size) * i / (count + 1)).cast("int"))


def evenly(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of every group, spread evenly over its order, first and last included."""
    numbered = rows.withColumns({"__k": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / max(1, most - 1)))
    return numbered.where((F.col("__n") <= most) | F.array_contains(places, F.col("__k").cast("bigint"))).drop("__k", "__n")


def filled(rows: DataFrame, keys: list[str], time: str, value: str, width: float) -> DataFrame:
    """Rows whose unknown values are the last known one, or for the head the first; scanned in buckets of `width`."""
    found = scans.scan(rows, keys, [time], width, {"__past": scans.last(F.col(value)), "__next": scans.following(F.col(value))})
    return found.withColumn(value, F.coalesce("__past", "__next")).drop("__past", "__next")


def interpolated(rows: DataFrame, keys: list[str], time: str, value: str, width: float) -> DataFrame:
    """Rows whose gaps are filled by a line between the neighbours in time; the ends by the nearest value; scanned in buckets of `width`."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    found = scans.scan(rows, keys, [time], width, {"__p": scans.last(known), "__n": scans.following(known)})
    v0, v1, t0, t1 = F.col("__p.v"), F.col("__n.v"), F.col("__p.t"), F.col("__n.t")
    line = F.when(t1 > t0, v0 + (v1 - v0) * (F.col(time) - t0) / (t1 - t0)).otherwise(v0)
    return found.withColumn(value, F.coalesce(F.col(value), line, v0, v1)).drop("__p", "__n")


def heart_rate_variability(beats: DataFrame, keys: list[str], rr: str, order: list[str], width: float) -> DataFrame:
    """Mean, SDNN, RMSSD, pNN50 and rates of the plausible intervals; differences are taken after the others are gone. Scanned in buckets of `width` of order[0]."""
    good = beats.where((F.col(rr) > 300) & (F.col(rr) < 2000))
    before = scans.scan(good, keys, order, width, {"__before": scans.previous(F.col(rr))})
    found = before.withColumn("step", F.abs(F.col(rr) - F.col("__before"))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(rr).alias("mean_rr"), F.stddev_pop(rr).alias("sdnn"), F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("rmssd"), (F.avg((F.col("step") > 50).cast("double")) * 100).alias("pnn50"),
        F.avg(60000 / F.col(rr)).alias("hr_mean"), F.min(60000 / F.col(rr)).alias("hr_min"), F.max(60000 / F.col(rr)).alias("hr_max"),
    )
    return found.withColumns({c: F.when(F.col("n") >= 3, F.col(c)) for c in ("mean_rr", "sdnn", "rmssd", "pnn50", "hr_mean", "hr_min", "hr_max")})


def changes(rows: DataFrame, keys: list[str], time: str, value: str, width: float) -> DataFrame:
    """Rows with step (from the row before), running (sum so far), share (of the recording's sum) and least_so_far; scanned in buckets of `width`."""
    x = F.col(value)
    found = scans.scan(rows, keys, [time], width, {"__before": scans.previous(F.struct(x.alias("v"))), "running": scans.running_sum(x), "least_so_far": scans.running_least(x)})
    whole = rows.groupBy(*keys).agg(F.sum(value).alias("__whole"))
    return joined(found, whole, keys).withColumns({"step": x - F.col("__before.v"), "share": F.try_divide(x, F.col("__whole"))}).drop("__before", "__whole")


def steadiness(value: Column) -> Column:
    """1 less the coefficient of variation, at least 0: the quality index of a reference signal."""
    return 1 - F.least(F.try_divide(F.stddev_pop(value), F.abs(F.avg(value))), F.lit(1.0))


def crop(samples: DataFrame, clock: DataFrame, keys: list[str], time: str, least_seconds: float) -> DataFrame:
    """Samples between the first and last tick of their recording's clock, recordings of under least_seconds left out."""
    # Dealt by time for spans and lengths: else rows that come dealt by recording are read for these in the tasks that join them, three passes in their memory at once.
    span = clock.repartition(*keys, time).groupBy(*keys).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    inside = samples.join(span, keys).where((F.col(time) >= F.col("t0")) & (F.col(time) <= F.col("t1"))).drop("t0", "t1")
    long = inside.repartition(*keys, time).groupBy(*keys).agg((F.max(time) - F.min(time)).alias("__l")).where(F.col("__l") >= least_seconds)
    return inside.join(long, keys, "left_semi")


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], time: str, value: str, width: float) -> DataFrame:
    """Rows with the value of the latest event at or before them: one scan over both in buckets of `width`, no range join."""
    left = rows.withColumns({"__which": F.lit(1), "__v": F.lit(None).cast(events.schema[value].dataType)})
    right = events.select(*keys, time, F.lit(0).alias("__which"), F.col(value).alias("__v"))
    both = left.unionByName(right, allowMissingColumns=True)
    return scans.scan(both, keys, [time, "__which"], width, {value: scans.last(F.col("__v"))}).where("__which = 1").drop("__which", "__v")


def label_stats(labels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, extremes, range and share of missing labels of every window."""
    return labels.groupBy(*keys).agg(
        F.avg(value).alias("target_hr_mean"), F.median(value).alias("target_hr_median"), F.min(value).alias("target_hr_min"), F.max(value).alias("target_hr_max"), (F.max(value) - F.min(value)).alias("target_hr_range"), F.avg(F.col(value).isNull().cast("double")).alias("target_nan_frac")
    )


def tumbled(signal: Column, size: int) -> Column:
    """Whole windows of a signal, one after another; a shorter signal is one window of its own."""
    whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(signal) / size).cast("int") - 1), lambda k: F.slice(signal, k * size + 1, size))
    return F.when(F.size(signal) >= size, whole).otherwise(F.array(signal))


def last_part(signal: Column, size: int | Column) -> Column:
    """The last `size` samples, or all of a shorter signal."""
    n = F.least(F.lit(size) if isinstance(size, int) else size, F.size(signal))
    return F.when(n > 0, F.slice(signal, F.size(signal) - n + 1, n)).otherwise(F.slice(signal, 1, 0))


def end_aligned(frames: Column, length: Column) -> Column:
    """Struct of the frames that a shorter row of labels goes with, by their ends, and of how many leading frames go."""
    return F.struct(last_part(frames, length).alias("frames"), F.greatest(F.size(frames) - length, F.lit(0)).alias("dropped"))


def sampling_counts(rows: DataFrame, keys: list[str], start: Column, end: Column, fps: Column, rate: float) -> DataFrame:
    """keys, frames and total: how many frames sampling at a lower rate would see of each row's part of a recording, and the sum of their numbers.

    keys tell rows apart. The frame of each time, and of the one before, follow from the place
    alone; frames rise with time where the rate isn't above that of the recording, so a frame is new
    when it isn't that of the time before. Nothing is sorted or kept as an array.
    """
    step = 1.0 / rate
    count = F.ceil((end / fps - start / fps) / step).cast("int")
    given = rows.select(*keys, start.alias("__a"), end.alias("__b"), fps.alias("__f"), F.greatest(count, F.lit(1)).alias("__n"), (count < 2).alias("__few"))
    a, b, f, n, k = (F.col(c) for c in ("__a", "__b", "__f", "__n", "__k"))
    held = lambda t: F.greatest(a, F.least(F.rint(t * f).cast("int"), b - 1))
    at = lambda place: held(a / f + place * step)
    tail = F.col("__few") | (a / f + (n - 1) * step < b / f - 0.75 / rate)
    # One place more for the tail: the last frame's own time.
    placed = given.withColumn("__k", F.explode(F.sequence(F.lit(0), n))).where((k < n) | tail)
    frame = F.when(k < n, at(k)).otherwise(held(b / f - 1.0 / f))
    seen = placed.select(*keys, frame.alias("__x"), F.when(k > 0, at(k - 1)).alias("__y"))
    new = F.col("__y").isNull() | (F.col("__x") > F.col("__y"))
    return seen.groupBy(*keys).agg(F.count_if(new).cast("int").alias("frames"), F.sum(F.when(new, F.col("__x")).otherwise(0)).alias("total"))


def hashed_share(key: Column, salt: str) -> Column:
    """A share from 0 to 1 by the hash of a key: the same at any scale and in SQL."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + salt))), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Slowest and fastest speed of a clip.
SLOW, FAST = 0.7, 2.0


def with_clip(rows: DataFrame, frames: Column, length: int, speed: Column | None = None, place: Column | None = None) -> DataFrame:
    """Add source_length and first_frame of a clip of `length` samples: centred and at its own speed, unless shares choose."""
    wanted = F.lit(length) if speed is None else F.bround(length * (SLOW + (FAST - SLOW) * speed)).cast("int")
    rows = rows.withColumn("source_length", F.greatest(F.lit(length), F.least(wanted, frames)))
    free = frames - F.col("source_length")
    first = F.floor(free / 2) if place is None else F.floor(place * (free + 1))
    return rows.withColumn("first_frame", F.greatest(first, F.lit(0)).cast("int"))


def buffered(rows: DataFrame, colours: list[str], regions: int, buffer: int, window: int, fps: float) -> DataFrame:
    """Channels of the last `window` frames, cut out after the last `buffer` frames were projected and filtered.

    colours: arrays of regions, each an array of frames. Buffers too short for the filter give nulls.
    """
    cut = {c: F.flatten(F.transform(F.col(c), lambda x: last_part(x, buffer))) for c in colours}
    made = rows.select("*", K.pulse_signals(*cut.values(), regions, K.training_signals, fps).alias("__p"))
    names = ("green", "pos", "chrom")
    return made.select(*[c for c in rows.columns if c not in colours], *[S.zscore(last_part(F.col(f"__p.{c}"), window)).alias(c) for c in names])


def effective_rate(samples: DataFrame, keys: list[str], time: str) -> DataFrame:
    """n and (n - 1) over the time that the samples take; null for one sample or no time."""
    found = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(time) - F.min(time)).alias("d"))
    return found.select(*keys, "n", F.when((F.col("n") >= 2) & (F.col("d") > 0), (F.col("n") - 1) / F.col("d")).alias("rate"))


#: Fixed value: intervals whose median is above it are in milliseconds, else in seconds.
MS_FROM = 20.0


def tachogram(beats: DataFrame, keys: list[str], rr: str, order: list[str], width: float, rate: float = 4.0, per_second: float | None = None) -> DataFrame:
    """keys, k and `rr`: intervals between beats on an even grid, k over the rate being seconds, in the unit that they came in.

    Intervals that are no positive numbers are left out. Each pair of beats fills the grid between
    them by a line, without a range join. A recording's median, which tells its unit, is of its own
    intervals alone. With `per_second` the unit is known and all intervals are taken as they are: a
    zero one is a beat at the place of the one before, an unknown one has no length and gives unknown
    values after it. Beats are scanned in buckets of `width` of order[0].
    """
    v, exact = F.col(rr), "decimal(38,15)"
    # Decimals, whose sum is the same in whatever order parts of it are added, so that neighbouring pairs meet at the very same number.
    if per_second is None:
        known = beats.where((v > 0) & ~F.isnan(rr) & (v < float("inf")))
        # Whether the median is above the bound needs counts alone, and for a tie the two values next to the bound.
        sides = known.groupBy(*keys).agg(F.count_if(v <= MS_FROM).alias("__low"), F.count_if(v > MS_FROM).alias("__high"), ((F.max(F.when(v <= MS_FROM, v)) + F.min(F.when(v > MS_FROM, v))) / 2).alias("__middle"))
        large = (F.col("__high") > F.col("__low")) | ((F.col("__high") == F.col("__low")) & (F.col("__middle") > MS_FROM))
        timed = joined(known, sides.select(*keys, large.alias("__large")), keys)
        timed = timed.withColumn("__s", (v / F.when(F.col("__large"), 1000.0).otherwise(1.0)).try_cast(exact)).drop("__large")
    else:
        timed = beats.withColumn("__s", (v / per_second).try_cast(exact))
    length = F.col("__s")
    pairs = scans.scan(timed, keys, order, width, {"__at": scans.running_sum(length), "__since": scans.previous(length), "__before": scans.previous(F.struct(v.alias("v")))}).where("__since is not null")
    pairs = pairs.withColumns({"at": F.col("__at").cast("double"), "__a": (F.col("__at") - F.coalesce(length, F.lit(0))).cast("double"), "__r": F.col("__before.v")})
    r0, a0 = F.col("__r"), F.col("__a")
    low, high = F.ceil(a0 * rate), F.ceil(F.col("at") * rate) - 1
    grid = pairs.where(high >= low).withColumn("k", F.explode(F.sequence(low, high)))
    value = r0 + (F.col(rr) - r0) * (F.col("k") / rate - a0) / (F.col("at") - a0)
    return grid.select(*keys, "k", value.alias("rr"))
