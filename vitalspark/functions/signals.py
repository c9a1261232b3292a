"""Column functions over array signals, native to the engine: no Python runs for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def doubles(signal: Column) -> Column:
    return F.transform(signal, lambda x: x.cast("double"))


def scaled(signal: Column, factor: float, offset: float) -> Column:
    return F.transform(signal, lambda x: offset + factor * x)


def let(body, **values: Column) -> Column:
    """`body` of named values, each computed once a row: expressions inside an array lambda would run for every element."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, lambda s: body(*[s[k] for k in values])), 0)


def total(signal: Column) -> Column:
    return F.aggregate(signal, F.lit(0.0), lambda a, x: a + x)


def mean(signal: Column) -> Column:
    """Mean of a signal; null when it is empty."""
    return F.try_divide(total(signal), F.size(signal))


def deviation(signal: Column) -> Column:
    """Population standard deviation."""

    def spread(x: Column, m: Column) -> Column:
        return F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(x)))

    return let(lambda x: let(spread, x=x, m=mean(x)), x=signal)


def zscore(signal: Column, variant: str = "plain") -> Column:
    """Z-score of a signal. Variants differ in the divisor and in what a flat signal becomes.

    plain: by sigma, zeros when flat; padded: by sigma + 1e-8, zeros when flat; open: by
    sigma + 1e-8 without a guard.
    """

    def scale(x: Column, m: Column, d: Column) -> Column:
        if variant == "open":
            return F.transform(x, lambda v: (v - m) / (d + EPSILON))
        divisor = d + EPSILON if variant == "padded" else d
        return F.when(d < EPSILON, F.transform(x, lambda v: F.lit(0.0))).otherwise(F.transform(x, lambda v: (v - m) / divisor))

    return let(lambda x: let(scale, x=x, m=mean(x), d=deviation(x)), x=signal)


def by_mean(signal: Column) -> Column:
    """A colour channel over its own mean."""
    return let(lambda x: let(lambda y, m: F.transform(y, lambda v: v / (m + EPSILON)), y=x, m=mean(x)), x=signal)


def mean_of(signals: list[Column]) -> Column:
    """Element-wise mean of signals of one length."""
    out = signals[0]
    for s in signals[1:]:
        out = F.zip_with(out, s, lambda a, b: a + b)
    return F.transform(out, lambda x: x / len(signals))


def combine(a: Column, b: Column, wa: Column | float, wb: Column | float) -> Column:
    return F.zip_with(a, b, lambda x, y: wa * x + wb * y)


def rgb_parts(kind: str, r: Column, g: Column, b: Column) -> tuple[Column, Column, float]:
    """The two projections of normalised colour of a method, and the sign of the second in their sum."""
    if kind == "pos":
        return combine(g, b, 1.0, -1.0), combine(combine(g, b, 1.0, 1.0), r, 1.0, -2.0), 1.0
    if kind == "chrom":
        return combine(r, g, 3.0, -2.0), combine(combine(r, g, 1.5, 1.0), b, 1.0, -1.5), -1.0
    raise ValueError(kind)


def projected(first: Column, second: Column, sign: float) -> Column:
    """first + sign * alpha * second with alpha the ratio of deviations; first alone when the second is flat."""

    def mix(a: Column, b: Column, s1: Column, s2: Column) -> Column:
        return F.when(s2 < EPSILON, a).otherwise(combine(a, b, 1.0, sign * s1 / s2))

    return let(lambda a, b: let(mix, a=a, b=b, s1=deviation(a), s2=deviation(b)), a=first, b=second)


def resampled(signal: Column, length: int) -> Column:
    """Linear resampling onto `length` points from the first to the last; null for under two points."""

    def stretch(x: Column) -> Column:
        n = F.size(x)

        def at(j: Column) -> Column:
            place = j * (n - 1) / (length - 1)
            low = F.least(F.floor(place), n - 2).cast("int")
            a, b = F.element_at(x, low + 1), F.element_at(x, low + 2)
            return a + (b - a) * (place - low)

        return F.when(n >= 2, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))

    return let(stretch, x=signal)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; null when either is flat."""

    def pearson(x: Column, y: Column, mx: Column, my: Column, sx: Column, sy: Column) -> Column:
        shared = F.try_divide(total(F.zip_with(x, y, lambda u, v: (u - mx) * (v - my))), F.size(x))
        return F.when((sx >= EPSILON) & (sy >= EPSILON), shared / (sx * sy))

    return let(lambda x, y: let(pearson, x=x, y=y, mx=mean(x), my=mean(y), sx=deviation(x), sy=deviation(y)), x=a, y=b)


def pearson_loss(a: Column, b: Column) -> Column:
    """One less the correlation, with a small floor under the spreads."""

    def loss(x: Column, y: Column, mx: Column, my: Column) -> Column:
        pairs = F.zip_with(x, y, lambda u, v: F.struct(((u - mx) * (v - my)).alias("uv"), ((u - mx) * (u - mx)).alias("uu"), ((v - my) * (v - my)).alias("vv")))
        return let(lambda p: 1 - total(F.transform(p, lambda r: r["uv"])) / F.sqrt(total(F.transform(p, lambda r: r["uu"])) * total(F.transform(p, lambda r: r["vv"])) + 1e-8), p=pairs)

    return let(loss, x=a, y=b, mx=mean(a), my=mean(b))


def mean_error(a: Column, b: Column) -> Column:
    return F.try_divide(total(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.size(a))


def root_error(a: Column, b: Column) -> Column:
    return F.sqrt(F.try_divide(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), F.size(a)))


def autocorrelation_quality(signal: Column, bpm: Column, fps: float) -> Column:
    """Autocorrelation at the lag of one beat, in 0 to 1: null without a rate or for too short a signal, 0 when flat."""
    lag, n = F.bround(F.try_divide(F.lit(60.0 * fps), bpm)).cast("int"), F.size(signal)

    def share(c: Column) -> Column:
        zero = total(F.transform(c, lambda x: x * x))
        rest = F.greatest(n - lag, F.lit(0))
        late = total(F.zip_with(F.slice(c, F.lit(1), rest), F.slice(c, lag + 1, rest), lambda x, y: x * y)) / zero
        return F.when(zero < 1e-10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(late, F.lit(1.0))))

    centred = let(lambda x, m: F.transform(x, lambda v: v - m), x=signal, m=mean(signal))
    usable = (bpm > 0) & ~F.isnan(bpm) & (lag < n)
    return F.when(usable, let(share, c=centred))


def rotated(signal: Column, by: int) -> Column:
    n = F.size(signal)
    shift = F.lit(by) % n
    return F.concat(F.slice(signal, shift + 1, n - shift), F.slice(signal, F.lit(1), shift))


def moving_average(signal: Column, half: int) -> Column:
    """Centred moving average over 2 * half + 1 points, shorter at the edges."""
    n = F.size(signal)

    def at(i: Column) -> Column:
        low = F.greatest(i - half, F.lit(0))
        return mean(F.slice(signal, low + 1, F.least(i + half, n - 1) - low + 1))

    return F.when(n >= 2 * half + 1, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(signal)


def ensemble(signals: list[Column], qualities: list[Column], floor: float = 0.01) -> tuple[Column, list[Column]]:
    """Quality-weighted sum of signals, and the weights: at least the floor each, one in all."""
    raw = [F.greatest(q, F.lit(floor)) for q in qualities]
    whole = sum(raw[1:], raw[0])
    weights = [w / whole for w in raw]
    out = F.transform(signals[0], lambda x: x * weights[0])
    for s, w in zip(signals[1:], weights[1:], strict=True):
        out = combine(out, s, 1.0, w)
    return out, weights


def max_jump(signal: Column) -> Column:
    """Largest absolute step over the median one; null when that is zero."""
    n = F.size(signal)
    steps = F.array_sort(F.zip_with(F.slice(signal, F.lit(1), n - 1), F.slice(signal, F.lit(2), n - 1), lambda a, b: F.abs(b - a)))
    k = n - 1
    middle = (F.element_at(steps, F.floor((k - 1) / 2).cast("int") + 1) + F.element_at(steps, F.floor(k / 2).cast("int") + 1)) / 2
    return F.when(middle > 0, F.array_max(steps) / middle)


def finite(value: Column) -> Column:
    """A number, or null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clamped(value: Column, low: float, high: float) -> Column:
    """A number kept inside bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def from_sentinel(value: Column, *sentinels: float) -> Column:
    """Null for the numbers that stand for a missing value."""
    return F.when(~value.isin(list(sentinels)), value)


def validity(signal: Column) -> Column:
    """Why a channel window is unusable: missing, nan or flat; null when it is usable."""
    bad = F.exists(signal, lambda x: x.isNull() | F.isnan(x))
    return F.when(signal.isNull() | (F.size(signal) == 0), "missing").when(bad, "nan").when(deviation(signal) < 1e-6, "flat")


def simulated_frames(start: Column, end: Column, fps: Column, rate: float) -> Column:
    """Frames that sampling at a lower rate would see between two frames, as distinct numbers in order."""
    a, b, step = start / fps, end / fps, 1.0 / rate
    count = F.ceil((b - a) / step).cast("int")
    last = a + (count - 1) * step
    times = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: a + k * step)
    tail = (count < 2) | (last < b - 0.75 / rate)
    every = F.when(tail, F.concat(times, F.array(b - 1.0 / fps))).otherwise(times)
    return F.array_sort(F.array_distinct(F.transform(every, lambda t: F.greatest(start, F.least(F.bround(t * fps).cast("int"), end - 1)))))


def summary(signal: Column, quality: Column) -> Column:
    """Struct of a candidate signal: ok, n, mean, sd, low, high and its spectral rate and quality; under eight samples it is not ok."""
    ok = F.coalesce(F.size(signal) >= 8, F.lit(False))
    held = lambda c: F.when(ok, c)
    sqi = quality["sqi"]
    status = F.when(sqi.isNull() | F.isnan(sqi), "invalid").when(sqi >= 0.50, "good").when(sqi >= 0.30, "moderate").otherwise("poor")
    return F.struct(
        ok.alias("ok"), F.size(signal).alias("n"), held(mean(signal)).alias("mean"), held(deviation(signal)).alias("sd"), held(F.array_min(signal)).alias("low"), held(F.array_max(signal)).alias("high"),
        held(quality["bpm"]).alias("bpm"), held(sqi).alias("sqi"), held(status).alias("status"),
    )


def best_of(values: dict[str, Column]) -> Column:
    """The name of the greatest known value, the first of equals; null where none is known."""
    known = {name: F.when(~F.isnan(v), v) for name, v in values.items()}
    top = F.array_max(F.array(*known.values()))
    return F.coalesce(*[F.when(v == top, F.lit(name)) for name, v in known.items()])


def band_power(signal: Column, first: int, last: int) -> Column:
    """Powers of the bins first to last of a demeaned, Hann-windowed signal, as one array: a DFT within the row."""

    def powers(x: Column, m: Column, n: Column) -> Column:
        tapered = F.transform(x, lambda v, i: (v - m) * (0.5 - 0.5 * F.cos(2 * F.pi() * i / (n - 1))))

        def bins(v: Column, n: Column) -> Column:
            part = lambda k, f: total(F.transform(v, lambda y, i: y * f(2 * F.pi() * k * i / n)))
            return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.pow(part(k, F.cos), F.lit(2.0)) + F.pow(part(k, F.sin), F.lit(2.0)))

        return let(bins, v=tapered, n=n)

    return let(lambda x: let(powers, x=x, m=mean(x), n=F.size(x)), x=signal)


def lag_curve(a: Column, b: Column, most: int) -> Column:
    """Correlations of a with b moved by every lag from -most to most, in that order: nulls where either part is flat."""

    def curve(x: Column, y: Column) -> Column:
        n = F.size(x)
        at = lambda lag: correlation(F.slice(x, F.greatest(F.lit(0), -lag) + 1, n - F.abs(lag)), F.slice(y, F.greatest(F.lit(0), lag) + 1, n - F.abs(lag)))
        return F.transform(F.sequence(F.lit(-most), F.lit(most)), at)

    return let(curve, x=a, y=b)
