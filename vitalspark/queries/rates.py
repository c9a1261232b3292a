"""Rates, spectra and windows over `embeddings` read as signals of 64 samples at 8 Hz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import rates
from ..functions import signals as S
from ..operators import windows
from . import Registry, rounded
from .filters import filtered_sql
from .signals import FPS, LONG, ROI, R, STATUS, channels, long, spectrum_sql
from .signals import windows as signals_of

registry = Registry()


@registry.add(f"""WITH {LONG}, {spectrum_sql('s', 'vec_id', refine=False)} SELECT vec_id, {R('bpm', 4)} AS bpm, {R('sqi')} AS sqi FROM quality""")
def cardiac_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals_of(spark, sf_dir).select("vec_id", rates.measured(rates.cardiac, "bpm double, sqi double", FPS)(F.col("x")).alias("m"))
    return found.select("vec_id", (F.round("m.bpm", 4) + 0.0).alias("bpm"), (F.round("m.sqi", 6) + 0.0).alias("sqi"))


@registry.add(f"""WITH {LONG}, t AS (SELECT vec_id, (i // 16)::int AS part, (i % 16)::int AS k, x FROM s), d AS (SELECT vec_id, part, k, (x - avg(x) OVER (PARTITION BY vec_id, part)) * (0.5::double - 0.5::double * cos(2 * pi() * k / 15)) AS v FROM t),
 w AS (SELECT vec_id, part, b::int AS bin, power(sum(v * cos(2 * pi() * b * k / 16)), 2) + power(sum(v * sin(2 * pi() * b * k / 16)), 2) AS pw FROM d, range(2, 8) u(b) GROUP BY vec_id, part, b),
 q AS (SELECT vec_id, part, arg_max(bin, pw) AS top, sum(pw) AS whole FROM w GROUP BY vec_id, part), m AS (SELECT vec_id, part, top * 30.0::double AS bpm, sum(pw) FILTER (abs(bin - top) <= 1) / any_value(whole) AS sqi FROM w JOIN q USING (vec_id, part) GROUP BY vec_id, part, top)
 SELECT vec_id, {R('median(bpm)', 4)} AS bpm, {R('median(sqi)')} AS sqi FROM m GROUP BY vec_id""")
def windowed_cardiac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over whole windows of two seconds."""
    parts = signals_of(spark, sf_dir).select("vec_id", F.explode(windows.tumbled(F.col("x"), 16)).alias("x"))
    found = parts.select("vec_id", rates.measured(rates.cardiac, "bpm double, sqi double", FPS)(F.col("x")).alias("m"))
    return rounded(found.groupBy("vec_id").agg(F.round(F.median("m.bpm"), 4).alias("bpm"), F.median("m.sqi").alias("sqi")))


@registry.add(f"""WITH {LONG}, {spectrum_sql('s', 'vec_id')}, a AS (SELECT *, lag(pw) OVER o AS l, lead(pw) OVER o AS r FROM w WINDOW o AS (PARTITION BY vec_id ORDER BY bin)),
 p AS (SELECT vec_id, bin, pw, row_number() OVER (PARTITION BY vec_id ORDER BY pw DESC, bin) AS place FROM a WHERE bin BETWEEN 6 AND 28 AND pw >= l AND pw >= r), b AS (SELECT vec_id, sum(pw) AS whole FROM w WHERE bin BETWEEN 6 AND 28 GROUP BY vec_id)
 SELECT vec_id, place::int AS place, {R('bin * 7.5::double', 4)} AS bpm, {R('pw / whole')} AS share FROM p JOIN b USING (vec_id) WHERE place <= 3""")
def strongest_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals_of(spark, sf_dir).select("vec_id", rates.measured(rates.strongest, "bpm array<double>, share array<double>", FPS)(F.col("x")).alias("m"))
    rows = found.select("vec_id", F.posexplode(F.arrays_zip("m.bpm", "m.share")).alias("place", "p"))
    return rows.select("vec_id", (F.col("place") + 1).alias("place"), (F.round("p.bpm", 4) + 0.0).alias("bpm"), (F.round("p.share", 6) + 0.0).alias("share"))


@registry.add(f"""WITH e AS (SELECT vec_id, i::int AS i, avg(110 + 10 * embedding[(i + 7 * j + 21) % 64 + 1]::double) AS x FROM embeddings, range(64) t(i), range(3) u(j) GROUP BY vec_id, i),
 d AS (SELECT vec_id, i, (x - (regr_slope(x, i) OVER w * i + regr_intercept(x, i) OVER w)) * (0.5::double - 0.5::double * cos(2 * pi() * i / 63)) AS v FROM e WINDOW w AS (PARTITION BY vec_id)),
 p AS (SELECT vec_id, b::int AS bin, power(sum(v * cos(2 * pi() * b * i / 64)), 2) + power(sum(v * sin(2 * pi() * b * i / 64)), 2) AS pw FROM d, range(2, 5) u(b) GROUP BY vec_id, b), q AS (SELECT vec_id, arg_max(bin, pw) AS top, sum(pw) AS whole FROM p GROUP BY vec_id)
 SELECT vec_id, {R('top * 7.5::double', 4)} AS breaths, {R('sum(pw) FILTER (abs(bin - top) <= 1) / any_value(whole)')} AS share, 1.0::double AS flat_share, 0.25::double AS lowest_hz FROM p JOIN q USING (vec_id) GROUP BY vec_id, top""")
def intensity_respiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breathing from the raw green of all regions, without any band-pass."""
    green = S.mean_of([S.scaled(S.rotated(F.col("x"), 7 * j + 21), 10.0, 110.0) for j in range(3)])
    ddl = "per_minute double, share double, flat_share double, lowest_hz double"
    found = signals_of(spark, sf_dir).select("vec_id", rates.measured(rates.slow_peak, ddl, FPS, 0.15, 0.50)(green).alias("m"))
    return found.select("vec_id", (F.round("m.per_minute", 4) + 0.0).alias("breaths"), (F.round("m.share", 6) + 0.0).alias("share"), "m.flat_share", "m.lowest_hz")


WELCH = """l AS (SELECT vec_id, i, x - (regr_slope(x, i) OVER w * i + regr_intercept(x, i) OVER w) AS x FROM s WINDOW w AS (PARTITION BY vec_id)),
 g AS (SELECT vec_id, p::int AS p, (i - 16 * p)::int AS k, x FROM l, range(3) t(p) WHERE i - 16 * p BETWEEN 0 AND 31), v AS (SELECT vec_id, p, k, (x - avg(x) OVER (PARTITION BY vec_id, p)) * (0.5::double - 0.5::double * cos(2 * pi() * k / 32)) AS v FROM g),
 f AS (SELECT vec_id, p, b::int AS bin, power(sum(v * cos(2 * pi() * b * k / 32)), 2) + power(sum(v * sin(2 * pi() * b * k / 32)), 2) AS pw FROM v, range(1, 16) u(b) GROUP BY vec_id, p, b),
 y AS (SELECT vec_id, bin, bin * 0.25::double AS hz, 2 * avg(pw) / (8 * 12) AS pw FROM f GROUP BY vec_id, bin)"""


@registry.add(f"""WITH {LONG}, {WELCH}, t AS (SELECT vec_id, arg_max(hz, pw) AS peak, max(pw) / median(pw) AS snr FROM y WHERE hz BETWEEN 0.7 AND 3.5 GROUP BY vec_id),
 h AS (SELECT vec_id, 0.8::double + 0.1::double * (vec_id % 20) AS f0 FROM embeddings), n AS (SELECT vec_id, max(pw) FILTER (abs(hz - f0) <= 0.29::double) AS sig, median(pw) FILTER (hz BETWEEN 0.7 AND 3.5 AND abs(hz - f0) > 0.29::double AND abs(hz - 2 * f0) > 0.29::double) AS noise FROM y JOIN h USING (vec_id) GROUP BY vec_id)
 SELECT vec_id, {R('peak', 4)} AS peak, {R('snr', 4)} AS snr, peak <= 0.71 OR peak >= 3.49 AS at_edge, {R('sig / (noise + 1e-30::double)', 4)} AS snr_at_reference FROM t JOIN n USING (vec_id)""")
def welch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, ratio to the median and rim of the band, and the ratio at a known rate, from half-overlapping segments of four seconds."""
    stats = rates.measured(rates.band_statistics, "peak double, snr double, at_edge boolean", FPS, 32, K.LOW, K.HIGH)(F.col("x"))
    reference = F.lit(0.8) + F.lit(0.1) * (F.col("vec_id") % 20)
    made = signals_of(spark, sf_dir).select("vec_id", stats.alias("m"), rates.referenced_snr(F.col("x"), reference, FPS, 32, 0.29).alias("snr_at_reference"))
    # A reach of 0.29 Hz, as bins are a quarter of a hertz apart.
    return rounded(made.select("vec_id", "m.peak", "m.snr", "m.at_edge", "snr_at_reference"), 4)


@registry.add(f"""WITH c AS (SELECT vec_id, i::int AS i, 120 + 10 * embedding[i + 1]::double AS r, 110 + 10 * embedding[(i + 21) % 64 + 1]::double AS g, 100 + 10 * embedding[(i + 42) % 64 + 1]::double AS b FROM embeddings, range(64) t(i)),
 p AS (SELECT vec_id, s, i, r / avg(r) OVER w AS r, g / avg(g) OVER w AS g, b / avg(b) OVER w AS b FROM (SELECT *, unnest(range(greatest(0, i - 11), least(51, i) + 1)) AS s FROM c) WINDOW w AS (PARTITION BY vec_id, s)),
 a AS (SELECT vec_id, s, i, g - b AS a, g + b - 2 * r AS c FROM p), h AS (SELECT vec_id, s, i, a + stddev_pop(a) OVER w / (stddev_pop(c) OVER w + 1e-12::double) * c AS h FROM a WINDOW w AS (PARTITION BY vec_id, s)),
 k AS (SELECT vec_id, i, h - avg(h) OVER w AS plain, (h - avg(h) OVER w) / (stddev_pop(h) OVER w + 1e-12::double) AS scaled FROM h WINDOW w AS (PARTITION BY vec_id, s))
 SELECT c.vec_id, c.i, {R('coalesce(plain, 0)')} AS plain, {R('coalesce(scaled, 0)')} AS scaled FROM c LEFT JOIN (SELECT vec_id, i, sum(plain) AS plain, sum(scaled) AS scaled FROM k GROUP BY vec_id, i) o ON o.vec_id = c.vec_id AND o.i = c.i""")
def overlapped_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = [S.scaled(S.rotated(F.col("x"), shift), 10.0, base) for shift, base in ((0, 120.0), (21, 110.0), (42, 100.0))]
    made = signals_of(spark, sf_dir).select("vec_id", *[rates.overlapped_pos(*colours, FPS, scaled).alias(name) for name, scaled in (("plain", False), ("scaled", True))])
    return rounded(long(made, ["vec_id"], ["plain", "scaled"]))


#: Each region projected by itself, averaged, and band-passed by the recursion.
TRAINING = f"""e AS (SELECT vec_id, i::int AS i, j::int AS j, 120 + 10 * embedding[(i + 7 * j) % 64 + 1]::double AS r, 110 + 10 * embedding[(i + 7 * j + 21) % 64 + 1]::double AS g, 100 + 10 * embedding[(i + 7 * j + 42) % 64 + 1]::double AS b FROM embeddings, range(64) t(i), range(3) u(j)),
 n AS (SELECT vec_id, i, j, r / (avg(r) OVER w + 1e-8::double) AS r, g / (avg(g) OVER w + 1e-8::double) AS g, b / (avg(b) OVER w + 1e-8::double) AS b FROM e WINDOW w AS (PARTITION BY vec_id, j)),
 p AS (SELECT vec_id, i, j, g, g - b AS p1, g + b - 2 * r AS p2, 3 * r - 2 * g AS c1, 1.5::double * r + g - 1.5::double * b AS c2 FROM n),
 q AS (SELECT vec_id, i, j, g, p1 + stddev_pop(p1) OVER w / (stddev_pop(p2) OVER w + 1e-8::double) * p2 AS pos, c1 - stddev_pop(c1) OVER w / (stddev_pop(c2) OVER w + 1e-8::double) * c2 AS chrom FROM p WINDOW w AS (PARTITION BY vec_id, j)),
 m AS (SELECT vec_id, i, avg(g) AS green, avg(pos) AS pos, avg(chrom) AS chrom FROM q GROUP BY vec_id, i),
 sig AS MATERIALIZED (SELECT vec_id, 64 AS n, i, ch, x FROM (UNPIVOT (SELECT vec_id, i, green, pos, chrom FROM m) ON green, pos, chrom INTO NAME ch VALUE x)), {filtered_sql('sig', 'vec_id, ch')},
 f AS (SELECT vec_id, i, max(x) FILTER (ch = 'green') AS green, max(x) FILTER (ch = 'pos') AS pos, max(x) FILTER (ch = 'chrom') AS chrom FROM filtered GROUP BY vec_id, i)"""


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id with the channels of three regions projected one by one, averaged and band-passed."""
    colours = signals_of(spark, sf_dir).select("vec_id", *[F.concat(*[S.scaled(S.rotated(F.col("x"), 7 * j + shift), 10.0, base) for j in range(3)]).alias(c) for c, shift, base in (("r", 0, 120.0), ("g", 21, 110.0), ("b", 42, 100.0))])
    return colours.select("vec_id", K.pulse_signals(F.col("r"), F.col("g"), F.col("b"), 3, K.training_signals, FPS).alias("p")).select("vec_id", "p.*")


@registry.add(f"""WITH RECURSIVE {TRAINING} SELECT vec_id, i, {', '.join(f'{R(f"({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w", 5)} AS {c}' for c in ('green', 'pos', 'chrom'))} FROM f WINDOW w AS (PARTITION BY vec_id)""")
def training_style_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long(trained(spark, sf_dir), ["vec_id"], ["green", "pos", "chrom"]), 5)


@registry.add(f"""WITH RECURSIVE {TRAINING}, z AS (SELECT vec_id, i, {', '.join(f'({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w AS {c}' for c in ('green', 'pos', 'chrom'))} FROM f WINDOW w AS (PARTITION BY vec_id)), k AS (SELECT * FROM z WHERE i >= 24)
 SELECT vec_id, i - 24 AS i, {', '.join(f'{R(f"({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w", 5)} AS {c}' for c in ('green', 'pos', 'chrom'))} FROM k WINDOW w AS (PARTITION BY vec_id)""")
def buffered_window_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five seconds of an eight-second buffer, cut out after filtering and scaled again."""
    made = trained(spark, sf_dir).select("vec_id", *[S.zscore(windows.last_part(F.col(c), 40)).alias(c) for c in ("green", "pos", "chrom")])
    return rounded(long(made, ["vec_id"], ["green", "pos", "chrom"]), 5)


@registry.add(f"""WITH {LONG}, {spectrum_sql('s', 'vec_id')}, g AS (SELECT vec_id, count(*)::int AS n, avg(x) AS mean, stddev_pop(x) AS sd, min(x) AS low, max(x) AS high FROM s GROUP BY vec_id)
 SELECT vec_id, true AS ok, n, {R('mean')} AS mean, {R('sd')} AS sd, {R('low')} AS low, {R('high')} AS high, {R('bpm', 4)} AS bpm, {R('sqi')} AS sqi, {STATUS} AS status FROM g JOIN quality USING (vec_id)""")
def candidate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signals_of(spark, sf_dir).withColumn("q", K.quality(F.col("x"), FPS))
    summary = S.summary(F.col("x"), F.col("q"))
    found = made.select("vec_id", summary.alias("m")).select("vec_id", "m.*")
    return rounded(found.withColumn("bpm", F.round("bpm", 4)))


@registry.add(f"""WITH {ROI}, c AS (SELECT vec_id, i, channel, CASE channel WHEN 'pos' THEN pos WHEN 'chrom' THEN chrom ELSE green END AS x FROM z, (VALUES ('pos'), ('chrom'), ('green')) t(channel)), {spectrum_sql('c', 'vec_id, channel')},
 o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sqi, 9) DESC, CASE channel WHEN 'green' THEN 0 WHEN 'pos' THEN 1 ELSE 2 END) AS place FROM quality) SELECT vec_id, channel AS name, {R('sqi')} AS sqi, {R('bpm', 4)} AS bpm, {STATUS} AS status FROM o WHERE place = 1""")
def best_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("green", "pos", "chrom")
    made = channels(spark, sf_dir).select("vec_id", *[K.quality(F.col(c), FPS).alias(c) for c in names])
    best = S.best_of({c: F.round(F.col(f"{c}.sqi"), 9) for c in names})
    picked = lambda part: F.coalesce(*[F.when(F.col("name") == c, F.col(f"{c}.{part}")) for c in names])
    found = made.withColumn("name", best)
    return found.select("vec_id", "name", (F.round(picked("sqi"), 6) + 0.0).alias("sqi"), (F.round(picked("bpm"), 4) + 0.0).alias("bpm"), K.status(picked("sqi")).alias("status"))


@registry.add(f"""WITH u AS (SELECT vec_id, embedding AS e, ('0x' || substr(md5(vec_id::varchar || ':speed'), 1, 8))::bigint::double / 4294967296 AS a, ('0x' || substr(md5(vec_id::varchar || ':start'), 1, 8))::bigint::double / 4294967296 AS b FROM embeddings),
 l AS (SELECT vec_id, e, greatest(40, least(64, round_even(40 * (0.7::double + 1.3::double * a), 0)::int)) AS n, b FROM u), c AS (SELECT vec_id, e, n, floor(b * (64 - n + 1))::int AS first FROM l),
 p AS (SELECT vec_id, e, n, first, j::int AS i, j * (n - 1)::double / 39 AS pos FROM c, range(40) t(j)), k AS (SELECT *, least(floor(pos)::int, n - 2) AS low FROM p),
 v AS (SELECT vec_id, i, n, first, e[first + low + 1]::double + (e[first + low + 2]::double - e[first + low + 1]::double) * (pos - low) AS x FROM k)
 SELECT vec_id, i, n AS source_length, first AS first_frame, {R('(x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6::double)')} AS x FROM v WINDOW w AS (PARTITION BY vec_id)""")
def augmented_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of 40 samples from a place and at a speed that hashes of the row choose."""
    u = lambda salt: windows.hashed_share(F.col("vec_id"), salt)
    made = windows.with_clip(signals_of(spark, sf_dir), F.size("x"), 40, speed=u("speed"), place=u("start"))
    clip = S.resampled(F.slice("x", F.col("first_frame") + 1, F.col("source_length")), 40)
    scaled = S.let(lambda c: S.let(lambda y, m, d: F.transform(y, lambda v: (v - m) / (d + 1e-6)), y=c, m=S.mean(c), d=S.deviation(c)), c=clip)
    return rounded(long(made.select("vec_id", "source_length", "first_frame", scaled.alias("x")), ["vec_id", "source_length", "first_frame"], ["x"]))


@registry.add(f"""WITH {LONG}, k AS (SELECT vec_id, i - 12 AS i, x FROM s WHERE i BETWEEN 12 AND 51) SELECT vec_id, count(*)::int AS n, {R('avg(x)')} AS mean, {R('min(x)')} AS low FROM k GROUP BY vec_id""")
def centred_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.with_clip(signals_of(spark, sf_dir), F.size("x"), 40)
    clip = F.slice("x", F.col("first_frame") + 1, F.col("source_length"))
    return rounded(made.select("vec_id", F.size(clip).alias("n"), S.mean(clip).alias("mean"), F.array_min(clip).alias("low")))


@registry.add(f"""WITH {LONG}, a AS (SELECT vec_id, i, x, 64 - (40 + vec_id % 20) AS extra FROM s) SELECT vec_id, (40 + vec_id % 20)::int AS n, any_value(extra)::int AS dropped, {R('avg(x)')} AS mean, {R('arg_min(x, i)')} AS first FROM a WHERE i >= extra GROUP BY vec_id""")
def end_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames brought to a shorter row of labels by their ends."""
    labels = (F.col("vec_id") % 20 + 40).cast("int")
    made = signals_of(spark, sf_dir).select("vec_id", windows.end_aligned(F.col("x"), labels).alias("a"))
    return rounded(made.select("vec_id", F.size("a.frames").alias("n"), "a.dropped", S.mean(F.col("a.frames")).alias("mean"), F.get("a.frames", F.lit(0)).alias("first")))


# Kernels without a statement in SQL: tests hold them against closed forms.
@registry.add()
def peak_counted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by peaks alone: of the cardiac band, of the whole row's prominent peaks, of breathing."""
    made = signals_of(spark, sf_dir).select(
        "vec_id",
        rates.measured(rates.counted, "per_minute double, peaks int", FPS, K.LOW, K.HIGH)(F.col("x")).alias("c"),
        rates.measured(rates.beats, "polarity_bpm double, energy_bpm double", 40.0)(F.col("x")).alias("b"),
        rates.measured(rates.breathing, "spectral_per_minute double, lag_per_minute double, quality double", 2.0)(F.col("x")).alias("r"),
        rates.measured(rates.breathing_share, "per_minute double, share double", FPS)(F.col("x")).alias("s"),
    )
    return rounded(made.select("vec_id", F.col("c.per_minute").alias("counted"), "c.peaks", "b.*", "r.*", F.col("s.share").alias("breath_share")))


@registry.add()
def harmonic_breathing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four estimates of breathing: comb of harmonics, envelope, direct peak, and the knee of the density."""
    envelope = K.mapped(K.analytic_envelope)(K.mapped(K.bandpass, FPS, 0.7, 3.0)(F.col("x")))
    stats = lambda c: rates.measured(rates.band_statistics, "peak double, snr double, at_edge boolean", FPS, 64, 0.10, 0.50)(c)
    made = signals_of(spark, sf_dir).withColumn("e", envelope).select(
        "vec_id", rates.measured(rates.comb, "per_minute double, log_score double", FPS, 64)(F.col("x")).alias("c"), stats(F.col("e")).alias("v"), stats(F.col("x")).alias("d"), rates.measured(rates.knee, "knee double, plateau double", FPS, 64)(F.col("x")).alias("k")
    )
    return rounded(made.select("vec_id", F.col("c.per_minute").alias("comb"), (F.col("v.peak") * 60).alias("envelope"), (F.col("d.peak") * 60).alias("direct"), F.col("k.knee").alias("knee_hz")))


@registry.add()
def motion_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head recoil from two heights' difference, breathing from their mean, with their quality."""
    made = signals_of(spark, sf_dir).withColumn("y", S.rotated(F.col("x"), 5))
    recoil, breath = rates.motion(S.combine(F.col("x"), F.col("y"), 1.0, -1.0), 16.0, rates.MOTION), rates.motion(S.combine(F.col("x"), F.col("y"), 0.5, 0.5), FPS, rates.BREATH)
    made = made.select("vec_id", recoil.alias("recoil"), breath.alias("breath"))
    bpm = lambda c: F.lit(72.0)
    return rounded(made.select("vec_id", S.deviation(F.col("recoil")).alias("recoil_sd"), S.deviation(F.col("breath")).alias("breath_sd"), S.autocorrelation_quality(F.col("recoil"), bpm("recoil"), 16.0).alias("recoil_quality")))


@registry.add()
def buffer_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the last three seconds of each channel agree with the full-length signal, by length of the buffer that was filtered."""
    names = ("green", "pos", "chrom")
    colours = signals_of(spark, sf_dir).select("vec_id", *[F.array(*[S.scaled(S.rotated(F.col("x"), 7 * j + shift), 10.0, base) for j in range(3)]).alias(c) for c, shift, base in (("r", 0, 120.0), ("g", 21, 110.0), ("b", 42, 100.0))])
    full = windows.buffered(colours, ["r", "g", "b"], 3, 64, 24, FPS)
    made = [windows.buffered(colours, ["r", "g", "b"], 3, n, 24, FPS).select("vec_id", F.lit(n).alias("buffer"), *[F.col(c).alias(f"{c}_b") for c in names]) for n in (32, 40, 48, 64)]
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    both = every.join(full, "vec_id")
    return rounded(both.groupBy("buffer").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(S.correlation(F.col(c), F.col(f"{c}_b"))).alias(f"{c}_r") for c in names]), 4)
