"""Queries on recordings, clips and splits over `orders`, `lineitem`, `events` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import signals as S
from ..operators import evaluate, recordings, splits
from . import Registry, rounded
from .evaluation import PRED, predictions
from .series import MANIFEST, SAMPLES, manifest, samples
from .signals import FPS, windows

registry = Registry()
R = lambda x, n=6: f"round({x}, {n}) + 0.0"

#: Orders as recordings with the measures that the gates look at.
GATES = f"""{MANIFEST}, g AS (SELECT recording, subject, dataset, (recording % 40)::double AS seconds, CASE WHEN recording % 11 <> 0 THEN (recording % 13)::double / 10 END AS ecg_range, CASE WHEN recording % 5 <> 0 THEN hr::double END AS ecg_hr,
 (recording % 29)::double / 28 AS ecg_quality, CASE WHEN recording % 7 <> 0 THEN (recording % 31)::double END AS ppg_range, hr::double + recording % 37 - 18 AS ppg_hr, recording % 2 = 0 AS rest, (recording % 26)::double AS no_face, (recording % 19)::double / 18 AS quality FROM p)"""


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("recording")
    of = lambda n, d=1.0: (r % n).cast("double") / d
    hr = F.col("hr").cast("double")
    return manifest(spark, sf_dir).select(
        "recording", "subject", "dataset", of(40).alias("seconds"), F.when(r % 11 != 0, of(13, 10.0)).alias("ecg_range"), F.when(r % 5 != 0, hr).alias("ecg_hr"), of(29, 28.0).alias("ecg_quality"),
        F.when(r % 7 != 0, of(31)).alias("ppg_range"), (hr + r % 37 - 18).alias("ppg_hr"), (r % 2 == 0).alias("rest"), of(26).alias("no_face"), of(19, 18.0).alias("quality"),
    )


@registry.add(f"""WITH {GATES} SELECT recording, CASE WHEN ecg_range IS NULL AND ppg_range IS NULL THEN 'no_ecg_no_ppg' WHEN ecg_range IS NOT NULL AND seconds < 10 THEN 'ecg_too_short' WHEN ecg_range < 0.05::double THEN 'flat_ecg' WHEN ecg_hr IS NOT NULL AND ecg_quality < 0.5::double THEN 'ecg_sqi_low'
 WHEN ppg_range IS NULL THEN 'no_ppg' WHEN ppg_range < 1 THEN 'flat_ppg' WHEN ppg_hr IS NULL OR ppg_hr < 40 OR ppg_hr > 200 THEN 'implausible_hr' WHEN abs(ecg_hr - ppg_hr) > CASE WHEN rest THEN 15 ELSE 20 END THEN 'ecg_ppg_hr_mismatch' WHEN no_face > 20 THEN 'no_face' WHEN quality < 0.1::double THEN 'ensemble_sqi_low' ELSE 'ok' END AS reason FROM g""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    reason = recordings.skip_reason(c("seconds"), c("ecg_range"), c("ecg_hr"), c("ecg_quality"), c("ppg_range"), c("ppg_hr"), c("rest"), c("no_face"), c("quality"), 0.1)
    return gates(spark, sf_dir).select("recording", reason.alias("reason"))


@registry.add(f"""WITH {SAMPLES}, r AS (SELECT rec, count(*) AS n, max(x) - min(x) AS drift, avg(x) AS b, 1 - least(stddev_pop(x) / abs(avg(x)), 1.0::double) AS q, max(t) AS seconds FROM e GROUP BY rec)
 SELECT rec, {R('CASE WHEN n > 1 THEN drift END')} AS hr_drift, n > 1 AND drift > 250 AS hr_nonstationary, n >= seconds / 40000 * 0.9::double AS ref_complete, b BETWEEN 40 AND 55 AS frame_ok, seconds / 40000 >= 60 AND b BETWEEN 40 AND 55 AND q >= 0.02::double AS usable FROM r""")
def recording_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    steady = F.lit(1.0) - F.least(F.stddev_pop("x") / F.abs(F.avg("x")), F.lit(1.0))
    rows = samples(spark, sf_dir).groupBy("rec").agg(F.count("x").alias("rates"), (F.max("x") - F.min("x")).alias("spread"), F.avg("x").alias("b"), steady.alias("q"), (F.max("t") / 40000).alias("seconds"))
    flags = recordings.usable_flags(F.col("seconds"), F.col("b"), F.col("q"), F.col("rates"), F.col("spread"), 60.0, 40.0, 55.0, 0.02, 250.0)
    return rounded(rows.select("rec", *[v.alias(k) for k, v in flags.items()]))


@registry.add(f"""WITH {MANIFEST}, v AS (SELECT dataset, CASE WHEN recording % 9 = 0 THEN 127 ELSE hr END AS hr, CASE WHEN recording % 6 = 0 THEN 255 ELSE recording % 100 END AS spo2 FROM p)
 SELECT dataset, count(*) AS rows, {R('avg((hr IS NOT NULL AND hr <> 127)::int::double)')} AS hr_valid, {R('avg((spo2 <> 255)::int::double)')} AS spo2_valid, {R('avg(coalesce(hr = 127 AND spo2 = 255, false)::int::double)')} AS all_sentinel FROM v GROUP BY dataset""")
def sentinel_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("recording")
    rows = manifest(spark, sf_dir).select("dataset", F.when(r % 9 == 0, 127).otherwise(F.col("hr")).alias("hr"), F.when(r % 6 == 0, 255).otherwise(r % 100).alias("spo2"))
    return rounded(recordings.sentinel_report(rows, ["dataset"], {"hr": 127, "spo2": 255}))


@registry.add(f"""WITH {MANIFEST} SELECT dataset, count(*) AS recordings, count(DISTINCT subject) AS subjects, {', '.join(f'{R(f)} AS {n}' for f, n in (('avg(hr)', 'hr_mean'), ('stddev_samp(hr)', 'hr_sd'), ('min(hr)::double', 'hr_min'), ('max(hr)::double', 'hr_max')))} FROM p GROUP BY dataset""")
def corpus_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recordings.corpus_validation(manifest(spark, sf_dir).withColumn("hr", F.col("hr").cast("double")), "dataset", ["hr"]))


@registry.add(f"""WITH {MANIFEST}, k AS (SELECT subject, count(DISTINCT dataset) FILTER (dataset IN ('F', 'O')) AS n FROM p GROUP BY subject) SELECT count(*) AS subjects, count(*) FILTER (n = 2) AS complete FROM k""")
def complete_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.complete_subjects(manifest(spark, sf_dir), "dataset", ["F", "O"])


@registry.add(f"""WITH {SAMPLES}, f AS (SELECT rec, channel, count(x) AS n, regr_slope(x, t / 60) AS a, var_pop(x) AS s, corr(x, t / 60) AS r FROM e GROUP BY rec, channel)
 SELECT rec, channel, n, CASE WHEN n >= 8 THEN {R('a', 8)} END AS slope, CASE WHEN n >= 8 THEN {R('sqrt(greatest(0, s * (1 - r * r)))', 5)} END AS residual_sd FROM f""")
def brightness_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recordings.linear_trend(samples(spark, sf_dir), ["rec", "channel"], F.col("t") / 60, F.col("x"))
    return found.withColumns({"slope": F.round("slope", 8) + 0.0, "residual_sd": F.round("residual_sd", 5) + 0.0})


@registry.add(f"""WITH {SAMPLES}, a AS (SELECT rec, CASE WHEN event_id % 4 <> 0 THEN x END AS v FROM e) SELECT rec, count(v) AS hits, {R('avg((v IS NOT NULL)::int::double)')} AS detected, {', '.join(f'CASE WHEN count(v) >= 30 THEN {R(f)} END AS {n}' for f, n in (('stddev_pop(v)', 'sd'), ('avg(v)', 'mean'), ('quantile_cont(v, 0.9) - quantile_cont(v, 0.1)', 'range')))} FROM a GROUP BY rec""")
def aperture_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = samples(spark, sf_dir).select("rec", F.when(F.col("event_id") % 4 != 0, F.col("x")).alias("v"))
    return rounded(recordings.aperture_dynamics(frames, ["rec"], "v"))


@registry.add(f"""WITH {PRED}, q AS (SELECT *, (recording % 10)::double / 10 AS quality FROM pred), t AS (SELECT unnest([0.0, 0.25, 0.55]::double[]) AS threshold)
 SELECT dataset, threshold, count(*) AS rows, {R('avg(abs_error)')} AS mae, {R('sqrt(avg(signed_error * signed_error))')} AS rmse FROM q JOIN t ON threshold <= quality GROUP BY dataset, threshold""")
def threshold_rescoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("quality", (F.col("recording") % 10).cast("double") / 10)
    return rounded(recordings.by_threshold(rows, "quality", [0.0, 0.25, 0.55], ["dataset"]).select("dataset", "threshold", "rows", "mae", "rmse"))


@registry.add(f"""WITH {SAMPLES}, c AS (SELECT rec, channel, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT rec, string_agg(channel || '=' || n, ';' ORDER BY channel) AS statuses FROM c GROUP BY rec), a AS (SELECT rec, count(*) AS samples, avg(x) AS x_mean, min(x) AS x_min, max(x) AS x_max FROM e GROUP BY rec)
 SELECT rec, statuses, samples, {R('x_mean')} AS x_mean, {R('x_min')} AS x_min, {R('x_max')} AS x_max FROM m JOIN a USING (rec)""")
def acquisition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recordings.acquisition(samples(spark, sf_dir), ["rec"], ["x"], "channel")
    text = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return rounded(found.withColumn("statuses", text))


PARTS = "".join(f", max({m}) FILTER (role = '{r}') AS {r}_{m}" for r in ("train", "val", "test") for m in ("rows", "subjects", "mean", "p90", "high", "tachy"))
SCORE = "abs(val_rows - test_rows) / 100.0::double + " + " + ".join(f"abs({r}_high - train_high) * 4 + abs({r}_tachy - train_tachy) * 6 + (abs({r}_p90 - train_p90) + abs({r}_mean - train_mean)) / 20 + abs({r}_subjects - 15) * 2" for r in ("val", "test"))


@registry.add(f"""WITH {PRED}, c AS (SELECT subject, target, k::int AS candidate, ('0x' || substr(md5(subject::varchar || ':' || k::varchar), 1, 8))::bigint::double / 4294967296 AS u FROM pred, range(1, 9) t(k)),
 r AS (SELECT candidate, CASE WHEN u < 0.7::double THEN 'train' WHEN u < 0.85::double THEN 'val' ELSE 'test' END AS role, count(*) AS rows, count(DISTINCT subject) AS subjects, avg(target) AS mean, quantile_cont(target, 0.9) AS p90, avg((target >= 100)::int::double) AS high, avg((target >= 120)::int::double) AS tachy FROM c GROUP BY ALL),
 w AS (SELECT candidate{PARTS} FROM r GROUP BY candidate) SELECT candidate, train_subjects, val_subjects, test_subjects, {R(SCORE)} AS score FROM w""")
def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recordings.split_balance(predictions(spark, sf_dir).select("subject", "target"), "subject", 8, (15, 15)))


@registry.add(f"""WITH {PRED}, m AS (SELECT dataset, avg(target) AS m FROM pred WHERE recording % 4 <> 0 GROUP BY dataset), f AS (SELECT dataset, count(*) AS rows, avg(abs_error) AS mae, avg(abs(m - target)) AS b FROM pred JOIN m USING (dataset) WHERE recording % 4 = 0 GROUP BY dataset)
 SELECT dataset, rows, {R('mae')} AS mae, {R('b')} AS baseline_mae, mae < b AS beats_baseline FROM f""")
def head_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recordings.baseline_report(predictions(spark, sf_dir), ["dataset"], F.col("recording") % 4 != 0))


@registry.add(f"""WITH {PRED}, m AS (SELECT role, mode, median(abs_error) AS m FROM pred GROUP BY role, mode) SELECT role, mode, {R('m')} AS median, (rank() OVER (PARTITION BY role ORDER BY m))::int AS rank FROM m""")
def median_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recordings.median_ranks(predictions(spark, sf_dir), "mode", "role", "abs_error"))


SPECTRUM = """s AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id, part) AS v, part FROM (SELECT vec_id, i::int AS i, embedding[(i + part * 9) % 64 + 1]::double * (CASE WHEN part = 1 AND i % 2 = 0 THEN 0.5::double ELSE 1 END) AS x, part FROM embeddings, range(64) t(i), range(2) p(part))),
 w AS (SELECT vec_id, part, k::int AS k, k * 0.125::double AS f, power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2) AS pw FROM s, range(6, 29) t(k) GROUP BY vec_id, part, k)"""


@registry.add(f"""WITH {SPECTRUM}, n AS (SELECT vec_id, pw, abs(f - f0) <= 8 / 60.0::double OR abs(f - 2 * f0) <= 8 / 60.0::double AS near FROM (SELECT *, (60.1::double + vec_id % 60) / 60 AS f0 FROM w WHERE part = 0))
 SELECT vec_id, {R('greatest(-30, least(30, 10 * log10((coalesce(sum(pw) FILTER (near), 0) + 1e-8::double) / (coalesce(sum(pw) FILTER (NOT near), 0) + 1e-8::double))))')} AS snr FROM n GROUP BY vec_id""")
def signal_to_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.lit(60.1) + F.col("vec_id") % 60
    return rounded(windows(spark, sf_dir).select("vec_id", K.snr(F.col("x"), rate, FPS).alias("snr")))


@registry.add(f"""WITH {SPECTRUM}, h AS (SELECT vec_id, k, part, pw / (sum(pw) OVER (PARTITION BY vec_id, part) + 1e-8::double) AS sh FROM w), d AS (SELECT vec_id, sum(power(d, 2)) AS frequency_loss FROM (SELECT vec_id, k, max(sh) FILTER (part = 0) - max(sh) FILTER (part = 1) AS d FROM h GROUP BY vec_id, k) GROUP BY vec_id),
 c AS (SELECT vec_id, 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b) + 1e-8::double) AS pearson_loss FROM (SELECT vec_id, i, max(v) FILTER (part = 0) AS a, max(v) FILTER (part = 1) AS b FROM s GROUP BY vec_id, i) GROUP BY vec_id)
 SELECT vec_id, {R('pearson_loss', 5)} AS pearson_loss, {R('frequency_loss')} AS frequency_loss FROM c JOIN d USING (vec_id)""")
def training_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    halved = F.transform(S.rotated(F.col("x"), 9), lambda v, i: F.when(i % 2 == 0, v * 0.5).otherwise(v))
    pairs = windows(spark, sf_dir).select("vec_id", "x", halved.alias("y"))
    found = pairs.select("vec_id", S.pearson_loss(F.col("x"), F.col("y")).alias("pearson_loss"), K.spectral_distance(F.col("x"), F.col("y"), FPS).alias("frequency_loss"))
    return found.withColumns({"pearson_loss": F.round("pearson_loss", 5) + 0.0, "frequency_loss": F.round("frequency_loss", 6) + 0.0})


@registry.add(f"""WITH {PRED}, m AS MATERIALIZED (SELECT subject * 10 + mode AS id, avg(target) AS target, avg(pred) AS pred FROM pred GROUP BY subject, mode),
 a AS (SELECT r, target, row_number() OVER (PARTITION BY r ORDER BY md5(id || ':' || r || ':1'), id) AS k FROM m, range(100) t(r)), b AS (SELECT r, pred, row_number() OVER (PARTITION BY r ORDER BY md5(id || ':' || r || ':2'), id) AS k FROM m, range(100) t(r)),
 n AS (SELECT r, corr(pred, target) AS null_r FROM a JOIN b USING (r, k) GROUP BY r), o AS (SELECT corr(pred, target) AS own FROM m)
 SELECT {R('any_value(own)')} AS r, {R('avg(null_r)')} AS null_mean, {R('stddev_pop(null_r)')} AS null_sd, {R('(count(*) FILTER (abs(null_r) >= abs(own)) + 1) / (count(*) + 1)')} AS p_value FROM n, o""")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by subject and mode against shuffled ones, in the orders of hashes."""
    means = predictions(spark, sf_dir).groupBy("subject", "mode").agg(F.avg("target").alias("target"), F.avg("pred").alias("pred"))
    return rounded(evaluate.permutation_test(means.withColumn("id", F.col("subject") * 10 + F.col("mode")), 100))


@registry.add(f"""WITH {MANIFEST}, m AS (SELECT dataset, count(*) AS m FROM p GROUP BY dataset), w AS (SELECT recording, p.dataset, power((SELECT count(*) FROM p) / m::double, 0.5::double) * CASE WHEN hr >= 100 THEN 2.0::double ELSE 1.0::double END * CASE WHEN hr >= 120 THEN 1.5::double ELSE 1.0::double END * CASE WHEN p.dataset = 'F' THEN 1.2::double ELSE 1.0::double END AS w,
 ('0x' || substr(md5(recording::varchar || ':42'), 1, 8))::bigint % 1024 AS b FROM p JOIN m ON m.dataset = p.dataset), c AS (SELECT *, sum(w) OVER (ORDER BY b, recording) - w AS start FROM w),
 u AS (SELECT k, ('0x' || substr(md5(k::varchar || ':draw:42'), 1, 8))::bigint::double / 4294967296 * (SELECT sum(w) FROM w) AS spot FROM range(1000) t(k)), d AS (SELECT c.recording, c.dataset FROM u ASOF JOIN c ON u.spot >= c.start)
 SELECT recording, dataset, count(*) AS times FROM d GROUP BY recording, dataset""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly a thousand draws with replacement by sampling weight."""
    rows = splits.with_sampling_weights(manifest(spark, sf_dir), "dataset", F.col("hr"), 0.5, 2.0, 1.5, F.col("dataset") == "F", 1.2)
    return splits.weighted_sample(rows, "weight", "recording", 1000).select("recording", "dataset", "times")
