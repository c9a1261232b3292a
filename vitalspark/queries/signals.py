"""Signal queries over `embeddings` read as windows of 64 samples at 8 Hz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import signals as S
from ..operators import rules
from . import Registry, rounded, table

registry = Registry()
FPS = 8.0

#: Samples in long form, and helpers that the SQL of several queries starts with.
LONG = "s AS (SELECT vec_id, i::int AS i, embedding[i + 1]::double AS x FROM embeddings, range(64) t(i))"
ROI = """e AS (SELECT vec_id, i::int AS i, j::int AS j, embedding[(i + 7 * j) % 64 + 1]::double AS a, embedding[(i + 7 * j + 21) % 64 + 1]::double AS b, embedding[(i + 7 * j + 42) % 64 + 1]::double AS c FROM embeddings, range(64) t(i), range(3) u(j)),
 m AS (SELECT vec_id, i, avg(120 + 10 * a) AS r, avg(110 + 10 * b) AS g, avg(100 + 10 * c) AS b FROM e GROUP BY vec_id, i),
 n AS (SELECT vec_id, i, r / (avg(r) OVER w + 1e-8::double) AS r, g / (avg(g) OVER w + 1e-8::double) AS g, b / (avg(b) OVER w + 1e-8::double) AS b, g AS raw FROM m WINDOW w AS (PARTITION BY vec_id)),
 p AS (SELECT vec_id, i, raw, g - b AS p1, g + b - 2 * r AS p2, 3 * r - 2 * g AS c1, 1.5::double * r + g - 1.5::double * b AS c2 FROM n),
 q AS (SELECT vec_id, i, raw, p1 + stddev_pop(p1) OVER w / stddev_pop(p2) OVER w * p2 AS pos, c1 - stddev_pop(c1) OVER w / stddev_pop(c2) OVER w * c2 AS chrom FROM p WINDOW w AS (PARTITION BY vec_id)),
 z AS (SELECT vec_id, i, (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w AS green, (pos - avg(pos) OVER w) / stddev_pop(pos) OVER w AS pos, (chrom - avg(chrom) OVER w) / stddev_pop(chrom) OVER w AS chrom FROM q WINDOW w AS (PARTITION BY vec_id))"""
R = lambda x, n=6: f"round({x}, {n}) + 0.0"


def spectrum_sql(source: str, keys: str, window: bool = True, reach: int = 1, refine: bool = True) -> str:
    """CTEs that take `source` (keys, i, x) to `quality` (keys, bpm, sqi, bin)."""
    hann = "(0.5::double - 0.5::double * cos(2 * pi() * i / 63))" if window else "1"
    top = (
        "CASE WHEN k.bin > 6 AND k.bin < 28 AND abs(l - 2 * c + r) >= 1e-12 AND abs(0.5::double * (l - r) / (l - 2 * c + r)) <= 0.5 THEN k.bin + 0.5::double * (l - r) / (l - 2 * c + r) ELSE k.bin END"
        if refine
        else "k.bin"
    )
    return f"""d AS (SELECT {keys}, i, (x - avg(x) OVER (PARTITION BY {keys})) * {hann} AS v FROM {source}),
 w AS (SELECT {keys}, k::int AS bin, power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2) AS pw FROM d, range(5, 30) t(k) GROUP BY {keys}, k),
 k AS (SELECT {keys}, arg_max(bin, pw) AS bin FROM w WHERE bin BETWEEN 6 AND 28 GROUP BY {keys}),
 quality AS (SELECT {keys}, {top} * 7.5::double AS bpm, near / whole AS sqi, k.bin AS bin FROM (
  SELECT {keys}, k.bin AS bin, sum(pw) FILTER (w.bin BETWEEN 6 AND 28) AS whole, sum(pw) FILTER (w.bin BETWEEN greatest(6, k.bin - {reach}) AND least(28, k.bin + {reach})) AS near,
   ln(max(pw) FILTER (w.bin = k.bin - 1) + 1e-20::double) AS l, ln(max(pw) FILTER (w.bin = k.bin) + 1e-20::double) AS c, ln(max(pw) FILTER (w.bin = k.bin + 1) + 1e-20::double) AS r
  FROM w JOIN k USING ({keys}) GROUP BY {keys}, k.bin) k)"""


STATUS = "CASE WHEN sqi >= 0.5 THEN 'good' WHEN sqi >= 0.3 THEN 'moderate' ELSE 'poor' END"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", S.doubles(F.col("embedding")).alias("x"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id with the GREEN, POS and CHROM signals of three regions combined before projection."""
    colours = windows(spark, sf_dir).select("vec_id", *[F.concat(*[S.scaled(S.rotated(F.col("x"), 7 * j + shift), 10.0, base) for j in range(3)]).alias(c) for c, shift, base in (("r", 0, 120.0), ("g", 21, 110.0), ("b", 42, 100.0))])
    return colours.select("vec_id", K.pulse_signals(F.col("r"), F.col("g"), F.col("b"), 3).alias("p")).select("vec_id", "p.*")


def long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Arrays of one length as rows with their place."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("i", "v")).select(*keys, "i", *[F.col(f"v.{c}").alias(c) for c in columns])


@registry.add(f"""WITH {LONG} SELECT vec_id, i, {R('(x - m) / (d + 1e-8::double)')} AS padded, {R('(x - m) / d')} AS plain, {R('(x - m) / (d + 1e-8::double)')} AS open FROM (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS d FROM s WINDOW w AS (PARTITION BY vec_id))""")
def zscore_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows(spark, sf_dir).select("vec_id", *[S.zscore(F.col("x"), k).alias(k) for k in ("padded", "plain", "open")])
    return rounded(long(made, ["vec_id"], ["padded", "plain", "open"]))


@registry.add(f"WITH {ROI} SELECT vec_id, i, {R('green', 5)} AS green, {R('pos', 5)} AS pos, {R('chrom', 5)} AS chrom FROM z")
def roi_pulse_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long(channels(spark, sf_dir), ["vec_id"], ["green", "pos", "chrom"]), 5)


@registry.add(f"WITH {LONG}, {spectrum_sql('s', 'vec_id')} SELECT vec_id, {R('bpm', 4)} AS bpm, {R('sqi')} AS sqi, {STATUS} AS status FROM quality")
def spectral_sqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows(spark, sf_dir).select("vec_id", K.quality(F.col("x"), FPS).alias("q"))
    return made.select("vec_id", (F.round("q.bpm", 4) + 0.0).alias("bpm"), (F.round("q.sqi", 6) + 0.0).alias("sqi"), K.status(F.col("q.sqi")).alias("status"))


@registry.add(f"WITH {LONG}, {spectrum_sql('s', 'vec_id', window=False, reach=3, refine=False)} SELECT vec_id, {R('bpm', 4)} AS bpm, {R('sqi')} AS sqi FROM quality")
def offline_sqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows(spark, sf_dir).select("vec_id", K.quality(F.col("x"), FPS, reach=3, window=False, refine=False, least=1e-10).alias("q"))
    return made.select("vec_id", (F.round("q.bpm", 4) + 0.0).alias("bpm"), (F.round("q.sqi", 6) + 0.0).alias("sqi"))


@registry.add(f"""WITH {ROI}, c AS (SELECT vec_id, i, channel, CASE channel WHEN 'pos' THEN pos WHEN 'chrom' THEN chrom ELSE green END AS x FROM z, (VALUES ('pos'), ('chrom'), ('green')) t(channel)),
 {spectrum_sql('c', 'vec_id, channel')},
 g AS (SELECT vec_id, count(*) FILTER (sqi >= 0.5) AS good, count(*) FILTER (sqi >= 0.3) AS moderate, max(bpm) FILTER (sqi >= 0.3) - min(bpm) FILTER (sqi >= 0.3) AS spread, avg(bpm) AS mean_bpm, median(bpm) AS median_bpm, median(bpm) FILTER (sqi >= 0.3) AS consensus_bpm FROM quality GROUP BY vec_id),
 a AS (SELECT *, moderate >= 2 AND coalesce(spread <= 20, false) AS ok FROM g)
 SELECT vec_id, good::int AS n_good, moderate::int AS n_moderate, {R('spread', 4)} AS spread, ok AS accepted, CASE WHEN NOT ok THEN 'rejected' WHEN good >= 1 THEN 'good' ELSE 'moderate' END AS confidence,
 CASE WHEN moderate < 2 THEN 'few_supported_channels' WHEN NOT ok THEN 'channels_disagree' WHEN good >= 1 THEN 'good_channel' ELSE 'moderate_channels_only' END AS reasons, {R('mean_bpm', 4)} AS mean_bpm, {R('median_bpm', 4)} AS median_bpm, {R('consensus_bpm', 4)} AS consensus_bpm FROM a""")
def window_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("pos", "chrom", "green")
    made = channels(spark, sf_dir).select("vec_id", *[K.quality(F.col(c), FPS).alias(c) for c in names])
    gate = rules.quality_gate({c: F.col(f"{c}.bpm") for c in names}, {c: F.col(f"{c}.sqi") for c in names})
    return rounded(made.select("vec_id", *[c.alias(k) for k, c in gate.items()]), 4)


@registry.add(f"""WITH {LONG}, c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM s), b AS (SELECT vec_id, 50 + vec_id % 100 AS bpm, round_even(480.0::double / (50 + vec_id % 100), 0)::int AS lag FROM embeddings),
 v AS (SELECT a.vec_id, b.bpm, sum(a.c * z.c) AS l, any_value(b.lag) AS lag FROM c a JOIN b USING (vec_id) JOIN c z ON z.vec_id = a.vec_id AND z.i = a.i + b.lag GROUP BY ALL), o AS (SELECT vec_id, sum(c * c) AS o FROM c GROUP BY vec_id)
 SELECT vec_id, bpm::int AS bpm, {R('greatest(0.0::double, least(1.0::double, l / o))')} AS sqi FROM v JOIN o USING (vec_id)""")
def autocorrelation_sqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpm = (F.col("vec_id") % 100 + 50).cast("int")
    return rounded(windows(spark, sf_dir).select("vec_id", bpm.alias("bpm"), S.autocorrelation_quality(F.col("x"), bpm.cast("double"), FPS).alias("sqi")))


@registry.add(f"""WITH {LONG}, o AS (SELECT vec_id, i, embedding[(i + 5) % 64 + 1]::double AS y FROM embeddings, range(64) t(i))
 SELECT vec_id, {R('corr(x, y)')} AS r, {R('avg(abs(x - y))')} AS mae, {R('sqrt(avg((x - y) * (x - y)))')} AS rmse, {R('1 - corr(x, y)')} AS neg_pearson FROM s JOIN o USING (vec_id, i) GROUP BY vec_id""")
def signal_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = windows(spark, sf_dir).withColumn("y", S.rotated(F.col("x"), 5))
    x, y = F.col("x"), F.col("y")
    return rounded(pair.select("vec_id", S.correlation(x, y).alias("r"), S.mean_error(x, y).alias("mae"), S.root_error(x, y).alias("rmse"), (1 - S.correlation(x, y)).alias("neg_pearson")))


@registry.add(f"""WITH g AS (SELECT vec_id, j::int AS i, j * 63.0::double / 239 AS p, embedding AS e FROM embeddings, range(240) t(j)), l AS (SELECT *, least(floor(p)::int, 62) AS k FROM g)
 SELECT vec_id, i, {R('e[k + 1]::double + (e[k + 2]::double - e[k + 1]::double) * (p - k)')} AS x FROM l""")
def linear_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows(spark, sf_dir).select("vec_id", S.resampled(F.col("x"), 240).alias("x"))
    return rounded(long(made, ["vec_id"], ["x"]))


@registry.add(f"""WITH {LONG}, m AS (SELECT j::int AS j, n::int AS n, (1 + 2 * (SELECT sum(cos(2 * pi() * k * (j / 240.0::double - n / 64.0::double))) FROM range(1, 32) t(k)) + cos(2 * pi() * 32 * (j / 240.0::double - n / 64.0::double))) / 64 AS w FROM range(240) a(j), range(64) b(n))
 SELECT vec_id, j AS i, {R('sum(w * x)')} AS x FROM s JOIN m ON m.n = s.i GROUP BY vec_id, j""")
def fourier_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows(spark, sf_dir).select("vec_id", K.mapped(K.fourier_resample, 240)(F.col("x")).alias("x"))
    return rounded(long(made, ["vec_id"], ["x"]))


@registry.add(f"""WITH {LONG}, {spectrum_sql('s', 'vec_id', window=True)}, f AS (SELECT vec_id, (6 + vec_id % 23)::int AS t FROM embeddings)
 SELECT vec_id, {R('sum(pw) FILTER (bin = t) / sum(pw) FILTER (bin BETWEEN 6 AND 28)')} AS share, {R("10 * log10(sum(pw) FILTER (abs(bin - t) <= 1 AND bin BETWEEN 6 AND 28) / sum(pw) FILTER (abs(bin - t) > 1 AND bin BETWEEN 6 AND 28))", 4)} AS snr_db FROM w JOIN f USING (vec_id) GROUP BY vec_id""")
def target_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of band power at a target frequency and its signal-to-noise ratio, by a DFT within the row."""
    made = windows(spark, sf_dir).select("vec_id", S.band_power(F.col("x"), 6, 28).alias("pw"), (F.col("vec_id") % 23).cast("int").alias("t"))
    near = F.filter("pw", lambda p, i: F.abs(i - F.col("t")) <= 1)
    noise = F.filter("pw", lambda p, i: F.abs(i - F.col("t")) > 1)
    found = made.select("vec_id", (F.get("pw", F.col("t")) / S.total(F.col("pw"))).alias("share"), (10 * F.log10(S.total(near) / S.total(noise))).alias("snr_db"))
    return found.select("vec_id", (F.round("share", 6) + 0.0).alias("share"), (F.round("snr_db", 4) + 0.0).alias("snr_db"))


@registry.add(f"""WITH {ROI}, c AS (SELECT vec_id, i, channel, CASE channel WHEN 'pos' THEN pos WHEN 'chrom' THEN chrom ELSE green END AS x FROM z, (VALUES ('pos'), ('chrom'), ('green')) t(channel)),
 {spectrum_sql('c', 'vec_id, channel')}, f AS (SELECT vec_id, channel, greatest(sqi, 0.01::double) AS q FROM quality), t AS (SELECT vec_id, channel, q / sum(q) OVER (PARTITION BY vec_id) AS weight FROM f),
 o AS (SELECT vec_id, i, sum(weight * x) AS v FROM c JOIN t USING (vec_id, channel) GROUP BY vec_id, i)
 SELECT vec_id, {R("max(weight) FILTER (channel = 'pos')")} AS w_pos, {R("max(weight) FILTER (channel = 'chrom')")} AS w_chrom, {R("max(weight) FILTER (channel = 'green')")} AS w_green, any_value(sd) AS deviation FROM t JOIN (SELECT vec_id, {R('stddev_pop(v)')} AS sd FROM o GROUP BY vec_id) USING (vec_id) GROUP BY vec_id""")
def quality_weighted_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("pos", "chrom", "green")
    made = channels(spark, sf_dir).withColumns({f"q_{c}": K.quality(F.col(c), FPS)["sqi"] for c in names})
    signal, weights = S.ensemble([F.col(c) for c in names], [F.col(f"q_{c}") for c in names])
    return rounded(made.select("vec_id", *[w.alias(f"w_{c}") for c, w in zip(names, weights, strict=True)], S.deviation(signal).alias("deviation")))


@registry.add(f"""WITH {LONG} SELECT vec_id, i, {R('avg(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS x FROM s""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long(windows(spark, sf_dir).select("vec_id", S.moving_average(F.col("x"), 2).alias("x")), ["vec_id"], ["x"]))


@registry.add(f"""WITH {LONG}, d AS (SELECT vec_id, abs(x - lag(x) OVER (PARTITION BY vec_id ORDER BY i)) AS d FROM s) SELECT vec_id, {R('max(d) / median(d)')} AS score FROM d WHERE d IS NOT NULL GROUP BY vec_id""")
def max_jump_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows(spark, sf_dir).select("vec_id", S.max_jump(F.col("x")).alias("score")))


@registry.add(f"""WITH {LONG}, o AS (SELECT vec_id, i::int AS i, embedding[(i + 3) % 64 + 1]::double AS y FROM embeddings, range(64) t(i)),
 c AS (SELECT s.vec_id, l::int AS lag, corr(s.x, o.y) AS r FROM s, range(-8, 9) t(l), o WHERE o.vec_id = s.vec_id AND o.i = s.i + l GROUP BY ALL)
 SELECT vec_id, {R('max(r)')} AS best_r, arg_max(lag, r) AS best_lag, {R('max(r) - max(r) FILTER (abs(lag - b) > 3)')} AS margin FROM (SELECT *, arg_max(lag, r) OVER (PARTITION BY vec_id) AS b FROM c) GROUP BY vec_id""")
def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows(spark, sf_dir).select("vec_id", S.lag_curve(F.col("x"), S.rotated(F.col("x"), 3), 8).alias("r"))
    found = made.withColumn("best_r", F.array_max("r")).withColumn("k", F.array_position("r", F.col("best_r")).cast("int") - 1)
    outside = F.array_max(F.filter("r", lambda v, i: F.abs(i - F.col("k")) > 3))
    return rounded(found.select("vec_id", "best_r", (F.col("k") - 8).alias("best_lag"), (F.col("best_r") - outside).alias("margin")))


VARIANTS = ["pos+chrom+green", "pos", "chrom", "green", "pos+chrom", "pos+green", "chrom+green"]


@registry.add(f"""WITH {ROI}, v AS (SELECT unnest({VARIANTS}) AS variant), a AS (SELECT vec_id, i, variant, CASE WHEN contains(variant, 'pos') THEN pos ELSE 0 END + CASE WHEN contains(variant, 'chrom') THEN chrom ELSE 0 END + CASE WHEN contains(variant, 'green') THEN green ELSE 0 END AS x FROM z, v),
 {spectrum_sql('a', 'vec_id, variant')} SELECT variant, count(*) AS n, {R('avg(bpm)', 3)} AS bpm, {R('avg(sqi)', 5)} AS sqi FROM quality GROUP BY variant""")
def channel_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = F.explode(F.array(*[F.lit(v) for v in VARIANTS]))
    kept = lambda c: F.when(F.col("variant").contains(c), F.col(c)).otherwise(F.transform(F.col(c), lambda x: F.lit(0.0)))
    made = channels(spark, sf_dir).withColumn("variant", variants)
    mixed = made.select("vec_id", "variant", S.combine(S.combine(kept("pos"), kept("chrom"), 1.0, 1.0), kept("green"), 1.0, 1.0).alias("x"))
    found = mixed.select("variant", K.quality(F.col("x"), FPS).alias("q")).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("q.bpm").alias("bpm"), F.avg("q.sqi").alias("sqi"))
    return found.select("variant", "n", (F.round("bpm", 3) + 0.0).alias("bpm"), (F.round("sqi", 5) + 0.0).alias("sqi"))


@registry.add(f"""WITH {LONG}, d AS (SELECT vec_id, i, x, regr_slope(x, i) OVER w AS a, regr_intercept(x, i) OVER w AS b FROM s WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, i, {R('x - (a * i + b)')} AS x FROM d""")
def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("vec_id")
    rows = long(windows(spark, sf_dir), ["vec_id"], ["x"])
    return rounded(rows.select("vec_id", "i", (F.col("x") - (F.regr_slope("x", "i").over(w) * F.col("i") + F.regr_intercept("x", "i").over(w))).alias("x")))


# Kernels that SQL would have to spell out by hand: tests hold them against closed forms.
@registry.add()
def bandpassed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows(spark, sf_dir).select("vec_id", K.mapped(K.bandpass, FPS)(F.col("x")).alias("x"))
    return rounded(made.select("vec_id", S.deviation(F.col("x")).alias("deviation"), F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last")))


@registry.add()
def envelope_and_respiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows(spark, sf_dir).select("vec_id", K.mapped(K.analytic_envelope)(F.col("x")).alias("e"))
    return rounded(made.select("vec_id", K.quality(F.col("e"), FPS, low=0.1, high=0.5)["bpm"].alias("breaths"), S.mean(F.col("e")).alias("mean_envelope")))
