"""Series, manifest and table-function queries over `events`, `orders`, `part` and others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, splits, windows
from . import Registry, rounded, table

registry = Registry()
R = lambda x, n=6: f"round({x}, {n}) + 0.0"

SAMPLES = "e AS (SELECT user_id::bigint AS rec, event_id::bigint AS event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))::double / 1000000 AS t, event_type AS channel, value::double AS x, props FROM events)"
#: Seconds of a recording that one task scans.
DAY = 86400.0
#: Events as samples; a recording is a user, values times four are beat intervals in ms.


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("rec"), F.col("event_id").cast("bigint").alias("event_id"), us.alias("us"), F.col("event_type").alias("channel"), F.col("value").cast("double").alias("x"), "props")
    first = rows.groupBy("rec").agg(F.min("us").alias("first"))
    return rows.join(first, "rec").withColumn("t", (F.col("us") - F.col("first")).cast("double") / 1000000).drop("us", "first")


@registry.add(f"""WITH {SAMPLES}, d AS (SELECT rec, t, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS d FROM e)
 SELECT rec, count(*) AS n, CASE WHEN count(*) >= 3 THEN {R('1 / median(d) FILTER (d > 0)')} END AS rate, {R('(count(*) - 1) / (max(t) - min(t))')} AS effective_rate FROM d GROUP BY rec""")
def sampling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.sampling_rate(samples(spark, sf_dir), ["rec"], "t", DAY))


@registry.add(f"""WITH {SAMPLES}, l AS (SELECT *, max(t) OVER (PARTITION BY rec) AS m FROM e) SELECT rec, count(*) AS n, {R('min(t)', 3)} AS first_t, {R('max(t)', 3)} AS last_t, {R('avg(x)', 9)} AS mean_x FROM l WHERE t >= m - 86400 GROUP BY rec""")
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.trailing(samples(spark, sf_dir), ["rec"], "t", 86400.0)
    found = kept.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.avg("x").alias("mean_x"))
    return found.select("rec", "n", (F.round("first_t", 3) + 0.0).alias("first_t"), (F.round("last_t", 3) + 0.0).alias("last_t"), (F.round("mean_x", 9) + 0.0).alias("mean_x"))


@registry.add(f"""WITH {SAMPLES}, b AS (SELECT rec, event_id, t, x * 4 AS rr FROM e WHERE x * 4 > 300 AND x * 4 < 2000), d AS (SELECT *, abs(rr - lag(rr) OVER (PARTITION BY rec ORDER BY t, event_id)) AS d FROM b)
 SELECT rec, count(*) AS n, {', '.join(f'CASE WHEN count(*) >= 3 THEN {R(x)} END AS {n}' for x, n in (('avg(rr)', 'mean_rr'), ('stddev_pop(rr)', 'sdnn'), ('sqrt(avg(d * d))', 'rmssd'), ('avg((d > 50)::int::double) * 100', 'pnn50'), ('avg(60000 / rr)', 'hr_mean'), ('min(60000 / rr)', 'hr_min'), ('max(60000 / rr)', 'hr_max')))} FROM d GROUP BY rec""")
def heart_rate_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = samples(spark, sf_dir).withColumn("rr", F.col("x") * 4)
    return rounded(windows.heart_rate_variability(beats, ["rec"], "rr", ["t", "event_id"], DAY))


@registry.add(f"""WITH {SAMPLES} SELECT rec, channel, count(*) AS n, {R('1 - least(stddev_pop(x) / abs(avg(x)), 1.0::double)')} AS steadiness FROM e GROUP BY rec, channel""")
def reference_steadiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples(spark, sf_dir).groupBy("rec", "channel").agg(F.count(F.lit(1)).alias("n"), windows.steadiness(F.col("x")).alias("steadiness")))


@registry.add(f"""WITH {SAMPLES}, v AS (SELECT rec, event_id, t, CASE WHEN x BETWEEN 40 AND 200 THEN x END AS v FROM e)
 SELECT rec, event_id, {R('coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS hr FROM v""")
def cleaned_heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.when(F.col("x").between(40, 200), F.col("x"))
    return rounded(windows.filled(samples(spark, sf_dir).select("rec", "event_id", "t", valid.alias("hr")), ["rec"], "t", "hr", DAY).select("rec", "event_id", "hr"))


@registry.add(f"""WITH {SAMPLES}, v AS (SELECT rec, event_id, t, CASE WHEN event_id % 3 <> 0 THEN x END AS v FROM e), f AS (SELECT *, CASE WHEN v IS NOT NULL THEN t END AS k FROM v),
 w AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1, last_value(k IGNORE NULLS) OVER a AS t0, first_value(k IGNORE NULLS) OVER b AS t1 FROM f WINDOW a AS (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY rec ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT rec, event_id, {R('coalesce(v, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE v0 END, v0, v1)')} AS x FROM w""")
def interpolated_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = samples(spark, sf_dir).select("rec", "event_id", "t", F.when(F.col("event_id") % 3 != 0, F.col("x")).alias("x"))
    return rounded(windows.interpolated(gaps, ["rec"], "t", "x", DAY).select("rec", "event_id", "x"))


@registry.add(f"""WITH {SAMPLES} SELECT rec, event_id, {R('x - lag(x) OVER w', 5)} AS step, {R('sum(x) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING)', 4)} AS running, {R('x / sum(x) OVER (PARTITION BY rec)')} AS share, {R('min(x) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING)')} AS least_so_far FROM e WINDOW w AS (PARTITION BY rec ORDER BY t)""")
def differences_and_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.changes(samples(spark, sf_dir).select("rec", "event_id", "t", "x"), ["rec"], "t", "x", DAY).select("rec", "event_id", "step", "running", "share", "least_so_far")
    digits = {"step": 5, "running": 4, "share": 6, "least_so_far": 6}
    return made.withColumns({c: F.round(c, n) + 0.0 for c, n in digits.items()})


@registry.add(f"""WITH {SAMPLES}, c AS (SELECT rec, min(t) AS t0, max(t) AS t1 FROM e WHERE channel = 'click' GROUP BY rec), i AS (SELECT e.*, max(t) OVER (PARTITION BY rec) - min(t) OVER (PARTITION BY rec) AS l FROM e JOIN c USING (rec) WHERE channel <> 'click' AND t BETWEEN t0 AND t1)
 SELECT rec, count(*) AS n, {R('avg(x)', 9)} AS mean_x FROM i WHERE l >= 5 GROUP BY rec""")
def cropped_to_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    inside = windows.crop(rows.where("channel <> 'click'"), rows.where("channel = 'click'"), ["rec"], "t", 5.0)
    return rounded(inside.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x")), 9)


@registry.add(f"""WITH {SAMPLES}, a AS (SELECT rec, event_id, t FROM e WHERE channel <> 'purchase'), b AS (SELECT rec, t, x FROM e WHERE channel = 'purchase')
 SELECT a.rec, a.event_id, {R('b.x')} AS hr FROM a ASOF LEFT JOIN b ON a.rec = b.rec AND a.t >= b.t""")
def latest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    beats = rows.where("channel = 'purchase'").select("rec", "t", F.col("x").alias("hr"))
    return rounded(windows.as_of(rows.where("channel <> 'purchase'").select("rec", "event_id", "t"), beats, ["rec"], "t", "hr", DAY).select("rec", "event_id", "hr"))


@registry.add(f"""WITH {SAMPLES} SELECT rec, floor(t / 900)::bigint AS measurement, count(*) AS n, count(*) >= 2 AS usable, {R('avg(x)', 9)} AS mean_x FROM e GROUP BY ALL""")
def fixed_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("measurement", F.floor(F.col("t") / 900))
    return rounded(rows.groupBy("rec", "measurement").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 2).alias("usable"), F.avg("x").alias("mean_x")), 9)


@registry.add(f"""WITH {SAMPLES} SELECT channel, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS int)) AS parsed, sum(try_cast(json_extract_string(props, '$.k') AS int))::bigint AS total FROM e GROUP BY channel""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return samples(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("parsed"), F.sum(k).cast("bigint").alias("total"))


@registry.add(f"""WITH {SAMPLES}, c AS (SELECT rec, event_id, t, x * 4 AS rr, sum(x * 4) OVER (PARTITION BY rec ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) / 1000 AS beat FROM e),
 b AS (SELECT rec, beat, rr, lag(rr) OVER w AS r0, lag(beat) OVER w AS b0 FROM c WINDOW w AS (PARTITION BY rec ORDER BY t, event_id)),
 g AS (SELECT rec, b0, beat, r0, rr, unnest(generate_series(ceil(b0 * 4)::bigint, ceil(beat * 4)::bigint - 1)) AS k FROM b WHERE b0 IS NOT NULL)
 SELECT rec, k, {R('r0 + (rr - r0) * (k / 4.0::double - b0) / (beat - b0)', 7)} AS rr FROM g""")
def rsa_tachogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beat intervals on an even grid of 4 Hz."""
    beats = samples(spark, sf_dir).withColumn("rr", F.col("x") * 4)
    return rounded(windows.tachogram(beats, ["rec"], "rr", ["t", "event_id"], DAY, per_second=1000.0), 7)


# Manifest rows from orders.
MANIFEST = """o AS (SELECT o_orderkey::bigint AS recording, o_custkey::bigint AS subject, o_orderstatus AS dataset, (240 + o_orderkey % 600)::int AS n_frames, CASE WHEN o_orderkey % 17 <> 0 THEN floor(o_totalprice)::bigint % 180 END AS hr FROM orders),
 s AS (SELECT *, ('0x' || substr(md5(subject::varchar || ':42'), 1, 8))::bigint::double / 4294967296 AS u FROM o), p AS (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM s)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("recording"), F.col("o_custkey").cast("bigint").alias("subject"), F.col("o_orderstatus").alias("dataset"), (F.col("o_orderkey") % 600 + 240).cast("int").alias("n_frames"), F.when(F.col("o_orderkey") % 17 != 0, F.floor("o_totalprice") % 180).alias("hr")
    )
    return splits.hash_split(rows, "subject")


@registry.add(f"""WITH {MANIFEST}, w AS (SELECT *, unnest(generate_series(0, n_frames - 240, 120)) AS start_frame FROM p), r AS (SELECT recording, start_frame::int AS start_frame, (start_frame + 240)::int AS end_frame, dataset, split, hr, (recording % 23)::double / 100 AS miss, (start_frame / 120 * 7 + recording % 50)::int AS rng FROM w)
 SELECT recording, start_frame, end_frame, CASE WHEN rng < 10 THEN 'stable_lt_10_bpm' WHEN rng < 25 THEN 'moderate_10_25_bpm' WHEN rng < 50 THEN 'unstable_25_50_bpm' ELSE 'highly_unstable_ge_50_bpm' END AS stability,
 CASE WHEN hr IS NULL OR hr < 40 OR hr > 180 OR miss > 0.1::double OR recording % 19 = 0 THEN 'excluded' WHEN dataset = 'P' THEN 'ood_eval' WHEN dataset <> 'F' AND dataset <> 'O' THEN 'eval_only' WHEN split = 'train' THEN 'finetune_train' WHEN split = 'val' THEN 'finetune_val' ELSE 'finetune_test' END AS window_role,
 CASE WHEN hr IS NULL THEN 'missing_target_hr' WHEN hr < 40 OR hr > 180 THEN 'target_hr_out_of_range' WHEN miss > 0.1::double THEN 'too_many_missing_hr_labels' WHEN recording % 19 = 0 THEN 'flat' WHEN dataset = 'P' THEN 'ecg_fitness_reserved_as_ood_stress_test' WHEN dataset <> 'F' AND dataset <> 'O' THEN 'dataset_not_in_first_finetune_set' WHEN split = 'train' THEN 'eligible_training_window' WHEN split = 'val' THEN 'validation_window' ELSE 'test_window' END AS reason,
 coalesce(hr IS NOT NULL AND hr >= 40 AND hr <= 180 AND miss <= 0.1::double AND recording % 19 <> 0 AND dataset IN ('F', 'O') AND split = 'train', false) AS include_in_finetune FROM r""")
def manifest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.sliding(manifest(spark, sf_dir), F.col("n_frames"), F.lit(240), F.lit(120))
    problem = F.when(F.col("recording") % 19 == 0, "flat")
    policy = rules.window_policy(F.col("dataset"), F.col("split"), F.col("hr"), (F.col("recording") % 23).cast("double") / 100, problem, ["F", "O"], ["P"])
    spread = F.floor(F.col("start_frame") / 120) * 7 + F.col("recording") % 50
    return rows.select("recording", "start_frame", "end_frame", rules.stability(spread).alias("stability"), policy.alias("p")).select("recording", "start_frame", "end_frame", "stability", "p.window_role", "p.reason", "p.include_in_finetune")


@registry.add(f"""WITH {MANIFEST} SELECT recording, i::int AS place, floor(240 + (n_frames - 240) * i / 4.0::double)::int AS end_frame FROM p, range(1, 4) t(i)""")
def even_window_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = windows.even_ends(F.col("n_frames"), F.lit(240), 3)
    return manifest(spark, sf_dir).select("recording", F.posexplode(ends).alias("place", "end_frame")).select("recording", (F.col("place") + 1).cast("int").alias("place"), "end_frame")


@registry.add(f"""WITH {MANIFEST}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY recording) - 1 AS k, count(*) OVER (PARTITION BY subject) AS n FROM p)
 SELECT recording, subject FROM n WHERE n <= 4 OR k IN (0, floor((n - 1) / 3.0::double), floor(2 * (n - 1) / 3.0::double), n - 1)""")
def evenly_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.evenly(manifest(spark, sf_dir), ["subject"], ["recording"], 4).select("recording", "subject")


SAMPLING_SQL = f"""WITH {MANIFEST}, c AS (SELECT recording, n_frames, ceil((n_frames / 30.0::double) / 0.1::double)::int AS n FROM p), t AS (SELECT recording, n_frames, unnest(generate_series(0, n - 1)) * 0.1::double AS t, n FROM c),
 a AS (SELECT recording, n_frames, t FROM t UNION ALL SELECT recording, n_frames, n_frames / 30.0::double - 1 / 30.0::double FROM c WHERE n < 2 OR (n - 1) * 0.1::double < n_frames / 30.0::double - 0.075::double)
 SELECT recording, count(DISTINCT f)::int AS frames, sum(DISTINCT f)::bigint AS total FROM (SELECT recording, greatest(0, least(round_even(t * 30, 0)::int, n_frames - 1)) AS f FROM a) GROUP BY recording"""


@registry.add(SAMPLING_SQL)
def simulated_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sum of the frames that sampling at 10 a second would see of each recording."""
    return windows.sampling_counts(manifest(spark, sf_dir), ["recording"], F.lit(0), F.col("n_frames"), F.lit(30.0), 10.0)


@registry.add(SAMPLING_SQL)
def simulated_sampling_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older name of the query over all of `orders`."""
    return simulated_sampling(spark, sf_dir)


@registry.add(f"""WITH {MANIFEST} SELECT dataset, split, count(*) AS rows, count(DISTINCT subject) AS subjects, {R('avg(hr)')} AS mean_hr, count(*) FILTER (hr IS NULL) AS unlabelled FROM p GROUP BY ALL""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(manifest(spark, sf_dir).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("subject").alias("subjects"), F.avg("hr").alias("mean_hr"), F.count_if(F.col("hr").isNull()).alias("unlabelled")))


@registry.add(f"""WITH {MANIFEST}, c AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY dataset) AS m FROM p), w AS (SELECT *, 1 / m AS balanced, power(n / m, 0.5::double) * CASE WHEN hr >= 100 THEN 2.0::double ELSE 1 END * CASE WHEN hr >= 120 THEN 1.5::double ELSE 1 END * CASE WHEN dataset = 'F' THEN 1.2::double ELSE 1 END AS weight FROM c)
 SELECT dataset, count(*) AS rows, {R('sum(balanced)')} AS balanced, {R('sum(weight)', 4)} AS weight, {R('sum(weight) / sum(sum(weight)) OVER ()')} AS share FROM w GROUP BY dataset""")
def sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.with_sampling_weights(manifest(spark, sf_dir), "dataset", F.col("hr"), 0.5, 2.0, 1.5, F.col("dataset") == "F", 1.2)
    found = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum("balanced").alias("balanced"), F.sum("weight").alias("weight"))
    found = found.crossJoin(F.broadcast(found.agg(F.sum("weight").alias("whole")))).withColumn("share", F.col("weight") / F.col("whole")).drop("whole")
    return found.withColumns({c: F.round(c, n) + 0.0 for c, n in (("balanced", 6), ("weight", 4), ("share", 6))})


@registry.add(f"""WITH {MANIFEST}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset, split ORDER BY md5(recording::varchar || ':42'), recording) AS k FROM p) SELECT recording, dataset, split FROM k WHERE k <= 10""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.seeded_sample(manifest(spark, sf_dir), ["dataset", "split"], ["recording"], 10).select("recording", "dataset", "split")


@registry.add(f"""WITH {MANIFEST}, l AS (SELECT p.subject, CASE WHEN p.hr BETWEEN 40 AND 180 THEN p.hr::double END AS hr FROM p)
 SELECT subject, {R('avg(hr)')} AS target_hr_mean, {R('median(hr)')} AS target_hr_median, {R('min(hr)')} AS target_hr_min, {R('max(hr)')} AS target_hr_max, {R('max(hr) - min(hr)')} AS target_hr_range, {R('avg((hr IS NULL)::int::double)')} AS target_nan_frac FROM l GROUP BY subject""")
def label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).select("subject", F.when(F.col("hr").between(40, 180), F.col("hr").cast("double")).alias("hr"))
    return rounded(windows.label_stats(rows, ["subject"], "hr"))


@registry.add(f"""WITH {MANIFEST} SELECT recording, dataset || '__' || lpad(subject::varchar, 6, '0') AS subject_key, printf('%s|%d|%.3f', dataset, recording, n_frames / 30.0::double) AS window_key, try_cast(regexp_extract('training_buffer_sim_' || (recording % 30) || 'fps', 'sim_([0-9.]+)fps', 1) AS double) AS simulated_fps, regexp_extract('rppg_sqi_low (0.' || (recording % 100) || ')', '^(\\w+)', 1) AS skip_code, try_cast(regexp_extract('rppg_sqi_low (0.' || (recording % 100) || ')', '\\(([0-9.]+)\\)', 1) AS double) AS skip_value, concat_ws(' | ', dataset, split) AS label FROM p""")
def key_and_code_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("recording")
    mode = F.concat(F.lit("training_buffer_sim_"), (r % 30).cast("string"), F.lit("fps"))
    skip = F.concat(F.lit("rppg_sqi_low (0."), (r % 100).cast("string"), F.lit(")"))
    return manifest(spark, sf_dir).select(
        "recording", F.concat_ws("__", "dataset", F.lpad(F.col("subject").cast("string"), 6, "0")).alias("subject_key"), F.format_string("%s|%d|%.3f", "dataset", r, F.col("n_frames") / 30.0).alias("window_key"),
        F.expr("try_cast(regexp_extract(m, 'sim_([0-9.]+)fps', 1) as double)".replace("(m,", "(concat('training_buffer_sim_', cast(recording % 30 as string), 'fps'),")).alias("simulated_fps"),
        F.regexp_extract(skip, r"^(\w+)", 1).alias("skip_code"), F.regexp_extract(skip, r"\(([0-9.]+)\)", 1).try_cast("double").alias("skip_value"), F.concat_ws(" | ", "dataset", "split").alias("label"),
    )


@registry.add("""WITH q AS (SELECT p_partkey::bigint AS roi, (p_partkey % 13)::double / 100 AS sat, (p_partkey % 41)::double / 100 AS red, (p_partkey % 29)::double / 100 AS grn, (p_partkey % 17)::double / 70 AS dark, (p_partkey % 251)::double AS mean, (p_partkey % 131)::double AS rng FROM part),
 l AS (SELECT *, list_filter([CASE WHEN sat >= 0.10::double THEN 'saturated' END, CASE WHEN red >= 0.30::double THEN 'red_saturated' END, CASE WHEN grn >= 0.20::double THEN 'green_saturated' END, CASE WHEN dark >= 0.20::double THEN 'dark' END, CASE WHEN mean < 20 THEN 'green_very_low' END], lambda x: x IS NOT NULL) AS bad,
  list_filter([CASE WHEN sat >= 0.02::double THEN 'some_saturated' END, CASE WHEN red >= 0.05::double THEN 'red_risk' END, CASE WHEN mean < 40 THEN 'green_low' END, CASE WHEN mean > 220 THEN 'green_high' END, CASE WHEN dark >= 0.05::double THEN 'some_dark' END, CASE WHEN rng > 120 THEN 'imbalance' END], lambda x: x IS NOT NULL) AS odd FROM q)
 SELECT roi, CASE WHEN len(bad) > 0 THEN 'reject' WHEN len(odd) > 0 THEN 'warning' ELSE 'ok' END AS status, coalesce(array_to_string(CASE WHEN len(bad) > 0 THEN bad ELSE odd END, ';'), '') AS reasons FROM l""")
def roi_image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    of = lambda m, d: (k % m).cast("double") / d
    made = rules.image_quality(of(13, 100), of(41, 100), of(29, 100), of(17, 70), (k % 251).cast("double"), (k % 131).cast("double"))
    return table(spark, sf_dir, "part").select(k.cast("bigint").alias("roi"), *[c.alias(n) for n, c in made.items()])


@registry.add("""WITH r AS (SELECT p_partkey::bigint AS id, (p_partkey % 40)::int AS samples, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 21)::double END AS fps, p_partkey % 4 <> 0 AS accepted, CASE WHEN p_partkey % 11 <> 0 THEN (60 + p_partkey % 37)::double END AS model, (60 + p_partkey % 23)::double AS spectral FROM part)
 SELECT id, CASE WHEN samples < 20 THEN 'waiting' WHEN fps IS NULL OR fps < 8 THEN 'skipped' WHEN NOT accepted THEN 'rejected' WHEN model IS NULL THEN 'unavailable' WHEN abs(model - spectral) > 10 THEN 'disagrees' ELSE 'ok' END AS state, CASE WHEN model IS NULL THEN 'unknown' WHEN abs(model - spectral) <= 5 THEN 'close' WHEN abs(model - spectral) <= 10 THEN 'near' ELSE 'apart' END AS band FROM r""")
def live_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    model, spectral = F.when(k % 11 != 0, (k % 37 + 60).cast("double")), (k % 23 + 60).cast("double")
    state = rules.readiness((k % 40).cast("int"), F.when(k % 9 != 0, (k % 21).cast("double")), k % 4 != 0, model, spectral)
    return table(spark, sf_dir, "part").select(k.cast("bigint").alias("id"), state.alias("state"), rules.agreement_band(model, spectral).alias("band"))


RANGES = {"systolic": (90, 140), "saturation": (95, 100), "hemoglobin": (10, 17)}


@registry.add("WITH b AS (SELECT p_partkey::bigint AS id, (p_partkey % 100 + 60)::double AS systolic, (p_partkey % 12 + 90)::double AS saturation, (p_partkey % 15 + 5)::double AS hemoglobin FROM part) " + " UNION ALL ".join(f"SELECT id, '{n}' AS biomarker, {n} AS value, {a}::double AS low, {b}::double AS high FROM b WHERE {n} < {a} OR {n} > {b}" for n, (a, b) in RANGES.items()))
def biomarker_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.cast("bigint").alias("id"), (k % 100 + 60).cast("double").alias("systolic"), (k % 12 + 90).cast("double").alias("saturation"), (k % 15 + 5).cast("double").alias("hemoglobin"))
    return rules.range_violations(rows, ["id"], RANGES)


TIERS = {"systolic": 1, "saturation": 2, "mood": 3}


@registry.add("WITH b AS (SELECT p_partkey::bigint AS id, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 100 + 60)::double END AS systolic, (p_partkey % 12 + 90)::double AS saturation, (p_partkey % 15 + 5)::double AS hemoglobin, (p_partkey % 9)::double AS mood FROM part) " + " UNION ALL ".join(f"SELECT id, '{n}' AS biomarker, {n} AS value, {TIERS.get(n, 'NULL')}::int AS tier, {f'coalesce({n} BETWEEN {RANGES[n][0]} AND {RANGES[n][1]}, false)' if n in RANGES else 'false'} AS valid FROM b" for n in ("systolic", "saturation", "hemoglobin", "mood")))
def biomarker_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags inside the biomarkers' map, one row each; one of them has no range, one no tier."""
    k = F.col("p_partkey")
    values = {"systolic": F.when(k % 7 != 0, k % 100 + 60), "saturation": k % 12 + 90, "hemoglobin": k % 15 + 5, "mood": k % 9}
    made = table(spark, sf_dir, "part").select(k.cast("bigint").alias("id"), rules.flagged(rules.biomarker_map(values, TIERS), RANGES).alias("biomarkers"))
    return rules.flags_long(made, ["id"], "biomarkers")


@registry.add(f"""WITH {MANIFEST}, k AS (SELECT hr, row_number() OVER (ORDER BY recording) - 1 AS place, count(*) OVER () AS n FROM p), d AS (SELECT floor(('0x' || substr(md5('0:' || i), 1, 8))::bigint::double / 4294967296 * (SELECT count(*) FROM p)) AS place FROM range(200) t(i))
 SELECT count(hr) AS n, min(hr)::double AS low, max(hr)::double AS high, median(hr)::double AS median FROM d JOIN k USING (place)""")
def random_index_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the targets of 200 recordings drawn by random places."""
    return splits.random_spread(manifest(spark, sf_dir), "recording", "hr", 200)
