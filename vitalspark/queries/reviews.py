"""Gates, profiles, lookups and boxes: the rules and small tables of a review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import signals as S
from ..operators import compare, evaluate, rules, splits, windows
from . import Registry, rounded, table
from .evaluation import PRED, against_first, predictions
from .series import MANIFEST, SAMPLES, R, manifest, samples

registry = Registry()


@registry.add("""WITH s AS (SELECT vec_id, unnest(embedding)::double AS x FROM embeddings), d AS (SELECT vec_id, stddev_pop(CASE WHEN vec_id % 11 = 0 THEN 1.0::double ELSE x END) AS sd FROM s GROUP BY vec_id)
 SELECT vec_id, CASE WHEN (vec_id % 7) / 20.0::double > 0.1::double THEN 'missing_labels' WHEN NOT (30 + vec_id % 170) BETWEEN 40 AND 180 THEN 'label_out_of_range' WHEN vec_id % 13 = 0 THEN 'pos_gaps' WHEN sd < 1e-6 THEN 'pos_flat' ELSE 'ok' END AS gate FROM d""")
def training_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.doubles(F.col("embedding"))
    flat, gaps = F.transform(x, lambda v: F.lit(1.0)), F.transform(x, lambda v, i: F.when(i != 3, v))
    signal = F.when(F.col("vec_id") % 13 == 0, gaps).when(F.col("vec_id") % 11 == 0, flat).otherwise(x)
    gate = rules.training_gate((F.col("vec_id") % 7) / 20, (F.col("vec_id") % 170 + 30).cast("double"), {"pos": signal})
    return table(spark, sf_dir, "embeddings").select("vec_id", gate.alias("gate"))


ROLES = "s AS (SELECT mode, avg(abs_error) FILTER (role = 'F') AS v, avg(abs_error) FILTER (role = 'O') AS t, avg(abs_error) FILTER (dataset = 'R') AS o, avg(abs_error) FILTER (high_hr) AS h FROM pred GROUP BY mode), d AS (SELECT c.mode, 20 * (c.v - b.v) AS v, 20 * (c.t - b.t) AS t, 20 * (c.o - b.o) AS o, 20 * (c.h - b.h) AS h FROM s c, s b WHERE b.mode = 1 AND c.mode > 1)"


def role_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twentyfold deltas of every mode against the first, so that the fixed thresholds part them."""
    at = lambda condition: F.avg(F.when(F.expr(condition), F.col("abs_error")))
    summary = predictions(spark, sf_dir).groupBy("mode").agg(at("role = 'F'").alias("v"), at("role = 'O'").alias("t"), at("dataset = 'R'").alias("o"), at("high_hr").alias("h"))
    base = F.broadcast(summary.where("mode = 1").select(*[F.col(c).alias(f"{c}0") for c in "vtoh"]))
    return summary.where("mode > 1").crossJoin(base).select("mode", *[(20 * (F.col(c) - F.col(f"{c}0"))).alias(c) for c in "vtoh"])


@registry.add(f"""WITH {PRED}, {ROLES}, g AS (SELECT mode, v <= -0.2 AS a, t <= -0.1 AS b, o <= 0.5 AS c, h <= 0.25 AS d FROM d)
 SELECT g.mode, a AS passes_val_gain, b AS passes_test_gain, c AS passes_ood, g.d AS passes_high_hr, a AND b AND c AND g.d AS passes_all,
 CASE WHEN v < 0 AND t < 0 AND o <= 0.75 AND NOT h > 0.5 THEN 'balanced_analysis_candidate' WHEN v < 0 AND t < 0 AND o > 1 THEN 'performance_candidate_with_ood_penalty' WHEN v < 0 AND t < 0 THEN 'weak_analysis_candidate' ELSE 'reject' END AS profile,
 CASE WHEN g.mode % 3 = 0 THEN 'smoke_test_only' WHEN a AND b THEN 'adoption_candidate_by_policy' WHEN NOT a AND NOT b THEN 'rejected_candidate' ELSE 'analysis_only_weak_candidate' END AS label FROM g JOIN d USING (mode)""")
def review_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t, o, h = (F.col(c) for c in "vtoh")
    gates = rules.passes({"val_gain": v <= -0.20, "test_gain": t <= -0.10, "ood": o <= 0.50, "high_hr": h <= 0.25})
    rows = role_deltas(spark, sf_dir).withColumns(gates)
    both = F.col("passes_val_gain") & F.col("passes_test_gain")
    status = F.when(~F.col("passes_val_gain") & ~F.col("passes_test_gain"), "reject").otherwise("other")
    return rows.select("mode", *gates, compare.transfer_profile(v, t, o, h).alias("profile"), compare.scientific_label(F.when(F.col("mode") % 3 == 0, "smoke").otherwise("full"), both, status).alias("label"))


@registry.add(f"""WITH {PRED}, {ROLES}, e AS (SELECT 'frozen' AS experiment, 0.0::double AS v, 0.0::double AS t, 0.0::double AS o UNION ALL SELECT 'mode_' || mode, v, t, o FROM d), g AS (SELECT *, -(v + t) / 2 AS gain, greatest(o, 0) AS penalty, v <= -0.2 AND t <= -0.1 AND o <= 0.5 AS adoptable FROM e)
 SELECT experiment, {R('v')} AS val_delta, {R('t')} AS test_delta, {R('o')} AS ood_delta, {R('gain')} AS mean_gain, {R('penalty')} AS ood_penalty, adoptable, (row_number() OVER (ORDER BY adoptable DESC, gain DESC, experiment))::int AS place FROM g""")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role_deltas(spark, sf_dir).select(F.concat(F.lit("mode_"), F.col("mode").cast("string")).alias("experiment"), F.col("v").alias("val_delta"), F.col("t").alias("test_delta"), F.col("o").alias("ood_delta"))
    return rounded(compare.scoreboard("frozen", rows))


@registry.add(f"""WITH {PRED}, s AS (SELECT mode, dataset, avg(abs_error) AS e FROM pred GROUP BY ALL), d AS (SELECT c.mode, dataset, {R('c.e - b.e')} AS delta FROM s c JOIN s b USING (dataset) WHERE b.mode = 1 AND c.mode > 1)
 SELECT mode, arg_min(dataset, (-delta, dataset)) AS worst_dataset, max(delta) AS worst FROM d GROUP BY mode""")
def worst_dataset_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = predictions(spark, sf_dir).groupBy("mode", "dataset").agg(F.avg("abs_error").alias("e"))
    base = summary.where("mode = 1").select("dataset", F.col("e").alias("e0"))
    deltas = rounded(summary.where("mode > 1").join(base, "dataset").select("mode", "dataset", (F.col("e") - F.col("e0")).alias("delta")))
    return compare.worst_delta(deltas, ["mode"], "dataset", "delta")


@registry.add(f"""WITH {PRED} SELECT {R('max(mae)')} AS mae_of_mode_three FROM (SELECT mode, avg(abs_error) AS mae FROM pred GROUP BY mode) WHERE mode = 3""")
def looked_up_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = predictions(spark, sf_dir).groupBy("mode").agg(F.avg("abs_error").alias("mae"))
    return rounded(compare.looked_up(summary, F.col("mode") == 3, "mae", "mae_of_mode_three"))


@registry.add(f"""WITH {PRED}, s AS (SELECT mode, dataset, role, subject, avg(abs_error) AS v FROM pred GROUP BY ALL) SELECT c.mode AS mode, dataset, role, subject, {R('c.v')} AS mae, {R('b.v')} AS baseline_mae FROM s c JOIN s b USING (dataset, role, subject) WHERE c.mode <> 1 AND b.mode = 1""")
def one_to_one_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode and the first joined key by key, once every key is known to be there once on both sides."""
    keys = ["mode", "dataset", "role", "subject"]
    candidate, baseline = against_first(predictions(spark, sf_dir).groupBy(*keys).agg(F.avg("abs_error").alias("mae")))
    return rounded(compare.one_to_one(candidate.join(baseline.select(*keys), keys, "left_semi"), baseline, keys, "mae", "baseline_mae"))


@registry.add(f"""WITH {PRED} SELECT dataset, count(abs_error) AS n, {R('avg(abs_error)')} AS mean, {R('stddev_samp(abs_error)')} AS sd, {R('min(abs_error)')} AS low, {R('max(abs_error)')} AS high, {R('quantile_cont(abs_error, 0.25)')} AS q25, {R('quantile_cont(abs_error, 0.5)')} AS q50, {R('quantile_cont(abs_error, 0.75)')} AS q75 FROM pred GROUP BY dataset""")
def error_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.described(predictions(spark, sf_dir), ["dataset"], "abs_error"))


@registry.add(f"""WITH {PRED} SELECT dataset, {', '.join(f'count(*) FILTER (mode = {m}) AS mode_{m}' for m in range(1, 8))} FROM pred GROUP BY dataset""")
def mode_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.crossed(predictions(spark, sf_dir), "dataset", "mode", list(range(1, 8)))


@registry.add(f"""WITH {PRED}, f AS (SELECT *, (recording % 7)::double AS x1, (mode * 1.5)::double AS x2, recording % 4 <> 0 AS train FROM pred),
 c AS (SELECT dataset, covar_pop(x1, target) AS a, covar_pop(x2, target) AS b, var_pop(x1) AS p, var_pop(x2) AS q, covar_pop(x1, x2) AS r, avg(x1) AS m1, avg(x2) AS m2, avg(target) AS m FROM f WHERE train GROUP BY dataset),
 w AS (SELECT dataset, (q * a - r * b) / (p * q - r * r) AS w1, (p * b - r * a) / (p * q - r * r) AS w2, m1, m2, m FROM c)
 SELECT dataset, count(*) AS rows, {R('avg(abs(m + w1 * (x1 - m1) + w2 * (x2 - m2) - target))')} AS linear_mae FROM f JOIN w USING (dataset) WHERE NOT train GROUP BY dataset""")
def linear_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumns({"x1": (F.col("recording") % 7).cast("double"), "x2": F.col("mode") * 1.5})
    return rounded(evaluate.linear_baseline(rows, ["dataset"], ["x1", "x2"], "target", F.col("recording") % 4 != 0))


@registry.add(f"""WITH {PRED}, d AS (SELECT subject, mode, avg(pred) AS detected, avg(target) AS device FROM pred GROUP BY subject, mode) SELECT subject, mode, {R('detected - device')} AS difference, CASE WHEN abs(detected - device) < 5 THEN 'good' WHEN abs(detected - device) < 10 THEN 'moderate' ELSE 'large' END AS agreement,
 (detected BETWEEN 90 AND 130) AND (device BETWEEN 100 AND 125) AS valid FROM d""")
def detection_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = predictions(spark, sf_dir).groupBy("subject", "mode").agg(F.avg("pred").alias("detected"), F.avg("target").alias("device"))
    gap = F.col("detected") - F.col("device")
    return rounded(means.select("subject", "mode", gap.alias("difference"), rules.detection_agreement(gap).alias("agreement"), rules.valid_targets({"detected": (90.0, 130.0), "device": (100.0, 125.0)}).alias("valid")))


@registry.add(f"""WITH {MANIFEST}, f AS (SELECT recording, dataset, n_frames, CASE WHEN recording % 5 = 0 THEN NULL ELSE recording % 3 <> 0 END AS usable, (recording % 40)::double / 200 AS quality FROM p) SELECT dataset, count(*) AS recordings, sum(n_frames)::bigint AS frames FROM f WHERE coalesce(usable, true) AND quality >= 0.05::double AND n_frames >= 300 GROUP BY dataset""")
def training_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).withColumns({"usable": F.when(F.col("recording") % 5 != 0, F.col("recording") % 3 != 0), "cardiac_sqi": (F.col("recording") % 40).cast("double") / 200})
    return rules.trainable(rows, 0.05, 300).groupBy("dataset").agg(F.count(F.lit(1)).alias("recordings"), F.sum(F.col("n_frames").cast("bigint")).alias("frames"))


@registry.add(f"""WITH {PRED}, f AS (SELECT *, CASE WHEN recording % 10 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN mode % 2 = 0 THEN 'live' ELSE 'stored' END AS kind, CASE WHEN recording % 7 <> 0 THEN pred END AS model_hr FROM pred) SELECT role AS split, count(*) AS rows, {R('regr_slope(model_hr, target)')} AS slope FROM f WHERE status = 'ok' AND kind = 'live' AND model_hr IS NOT NULL AND dataset IN ('A', 'N') GROUP BY role""")
def evaluation_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumns({"preprocessing_status": F.when(F.col("recording") % 10 == 0, "failed").otherwise("ok"), "preprocessing_mode": F.when(F.col("mode") % 2 == 0, "live").otherwise("stored"), "model_hr": F.when(F.col("recording") % 7 != 0, F.col("pred")), "target_hr_mean": F.col("target"), "split": F.col("role")})
    kept = rules.evaluation_rows(rows, "live", ["A", "N"])
    return rounded(kept.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.regr_slope("model_hr", "target").alias("slope")))


@registry.add("""WITH b AS (SELECT p_partkey, (p_size * 7) % 200 AS x, (p_size * 5) % 150 AS y, 40 + p_size * 6 AS w, 50 + p_size * 5 AS h FROM part), r AS (SELECT * FROM (VALUES ('forehead', 0.30::double, 0.70::double, 0.06::double, 0.22::double), ('image_left_cheek', 0.10, 0.34, 0.40, 0.62), ('image_right_cheek', 0.66, 0.90, 0.40, 0.62)) t(region, x0, x1, y0, y1)),
 c AS (SELECT p_partkey, region, greatest(0, least(x + round_even(w * x0, 0)::int, 319))::int AS x_min, greatest(0, least(x + round_even(w * x1, 0)::int, 320))::int AS x_max, greatest(0, least(y + round_even(h * y0, 0)::int, 239))::int AS y_min, greatest(0, least(y + round_even(h * y1, 0)::int, 240))::int AS y_max FROM b, r)
 SELECT p_partkey, region, x_min, x_max, y_min, y_max, greatest(0, x_max - x_min)::int AS width, greatest(0, y_max - y_min)::int AS height, round(greatest(0, x_max - x_min) * greatest(0, y_max - y_min) / 76800.0::double, 6) + 0.0 AS area_fraction FROM c""")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("int")
    face = table(spark, sf_dir, "part").select("p_partkey", F.struct(((size * 7) % 200).alias("x_min"), ((size * 5) % 150).alias("y_min"), (size * 6 + 40).alias("width"), (size * 5 + 50).alias("height")).alias("f"))
    box = lambda name, x, y: F.struct(F.lit(name).alias("region"), *[c.alias(k) for k, c in rules.region_box({k: F.col(f"f.{k}") for k in ("x_min", "y_min", "width", "height")}, x, y, F.lit(320), F.lit(240)).items()])
    rows = face.select("p_partkey", F.explode(F.array(*[box(name, x, y) for name, (x, y) in rules.REGION_SHARES.items()])).alias("b"))
    return rounded(rows.select("p_partkey", "b.*"))


LANDMARKS = "m AS (SELECT l_orderkey::bigint AS face, l_quantity::double / 60 AS x, l_discount::double * 9 AS y FROM lineitem)"


@registry.add(f"""WITH {LANDMARKS}, e AS (SELECT face, count(*) AS landmarks, greatest(0, least(min(x * 320), 319.0::double)) AS a, greatest(0, least(max(x * 320), 319.0::double)) AS b, greatest(0, least(min(y * 240), 239.0::double)) AS c, greatest(0, least(max(y * 240), 239.0::double)) AS d FROM m GROUP BY face)
 SELECT face, landmarks, round_even(a, 0)::int AS x_min, round_even(b, 0)::int AS x_max, round_even(c, 0)::int AS y_min, round_even(d, 0)::int AS y_max, round_even(b - a, 0)::int AS width, round_even(d - c, 0)::int AS height, {R('(b - a) * (d - c) / 76800.0::double')} AS area_fraction FROM e""")
def landmark_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("face"), (F.col("l_quantity").cast("double") / 60).alias("x"), (F.col("l_discount").cast("double") * 9).alias("y"))
    return rounded(rules.landmark_box(marks, ["face"], 320, 240))


PIXELS = "x AS (SELECT l_suppkey::bigint AS frame, (l_orderkey % 64)::int AS px, (l_partkey % 48)::int AS py, (l_quantity * 5)::int % 256 AS r, floor(l_extendedprice)::bigint % 256 AS g, (l_orderkey * 3) % 256 AS b FROM lineitem)"


@registry.add(f"""WITH {PIXELS} SELECT frame, count(*) AS pixels, {', '.join(f'{R(f"{f}({c})")} AS {c}_{n}' for c in 'rgb' for f, n in (('avg', 'mean'), ('stddev_pop', 'sd')))}, {', '.join(f'{f}({c})::bigint AS {c}_{f}' for c in 'rgb' for f in ('min', 'max'))}, {R('(avg(r) + avg(g) + avg(b)) / 3')} AS brightness FROM x WHERE px >= 22 AND px < 41 AND py >= 16 AND py < 31 GROUP BY frame""")
def centre_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the central part of each frame, the screen for dark recordings."""
    pixels = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("frame"), (F.col("l_orderkey") % 64).cast("int").alias("px"), (F.col("l_partkey") % 48).cast("int").alias("py"),
        ((F.col("l_quantity") * 5).cast("int") % 256).cast("bigint").alias("r"), (F.floor("l_extendedprice").cast("bigint") % 256).alias("g"), ((F.col("l_orderkey") * 3) % 256).cast("bigint").alias("b"),
    )
    return rounded(rules.frame_statistics(pixels, ["frame"], rules.centre_box(F.col("px"), F.col("py"), 64, 48)))


STATES = "q AS (SELECT l_orderkey::bigint AS frame, CASE WHEN l_discount >= 0.09 THEN 'reject' WHEN l_discount >= 0.06 THEN 'warning' ELSE 'ok' END AS status FROM lineitem)"


@registry.add(f"""WITH {STATES} SELECT frame, count(*) FILTER (status = 'ok')::int AS ok_regions, count(*) FILTER (status = 'warning')::int AS warning_regions, count(*) FILTER (status = 'reject')::int AS reject_regions, CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'warning' ELSE 'ok' END AS overall FROM q GROUP BY frame""")
def region_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_discount") >= 0.09, "reject").when(F.col("l_discount") >= 0.06, "warning").otherwise("ok")
    frames = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("frame")).agg(F.collect_list(status).alias("s"))  # the few regions of a frame
    return frames.select("frame", *[c.alias(k) for k, c in rules.region_rollup(F.col("s")).items()])


@registry.add("""WITH v AS (SELECT vec_id, label, list_transform(range(3), lambda k: CASE WHEN vec_id % 50 = 0 AND k = 1 THEN embedding[1:60] ELSE embedding END) AS s, CASE WHEN vec_id % 90 = 7 THEN NULL ELSE (40 + vec_id % 100)::double END AS target FROM embeddings)
 SELECT label::int AS label, count(*) AS rows, bool_and(len(list_filter(s, lambda c: len(c) <> 64)) = 0) AS shape_ok, true AS signals_finite, bool_and(target IS NOT NULL) AS target_finite, min(target) AS target_min, max(target) AS target_max FROM v GROUP BY label""")
def cache_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.doubles(F.col("embedding"))
    signals = F.array(x, F.when(F.col("vec_id") % 50 == 0, F.slice(x, 1, 60)).otherwise(x), x)
    target = F.when(F.col("vec_id") % 90 != 7, (F.col("vec_id") % 100 + 40).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), signals.alias("signals"), target.alias("target"))
    return compare.cache_health(rows, ["label"], "signals", "target", 3, 64)


@registry.add(f"""WITH {MANIFEST}, k AS (SELECT subject, row_number() OVER (ORDER BY md5(subject::varchar || ':42'), subject) AS k FROM (SELECT DISTINCT subject FROM p)), r AS (SELECT subject, CASE WHEN k <= 40 THEN 'train' WHEN k <= 55 THEN 'val' WHEN k <= 70 THEN 'test' END AS role FROM k)
 SELECT role, count(DISTINCT subject) AS subjects, count(*) AS recordings FROM p JOIN r USING (subject) WHERE role IS NOT NULL GROUP BY role""")
def counted_subject_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir)
    roles = splits.counted_roles(rows, "subject", {"train": 40, "val": 15, "test": 15}).where("role is not null")
    joined = splits.assigned_roles(rows.join(roles.select("subject"), "subject", "left_semi"), "subject", roles)
    return joined.groupBy("role").agg(F.count_distinct("subject").alias("subjects"), F.count(F.lit(1)).alias("recordings"))


@registry.add("""SELECT c_custkey::bigint AS c_custkey, mode || CASE WHEN fps IS NULL THEN '' ELSE ' @ ' || fps || ' Hz' END AS label, CASE WHEN bpm IS NULL THEN '--' ELSE format('{:.1f} bpm', bpm) END AS rate, CASE WHEN gap IS NULL THEN '--' ELSE format('{:+.1f} bpm', gap) END AS gap FROM
 (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'live' ELSE 'stored' END AS mode, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 30)::int END AS fps, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 120 + 0.3::double END AS bpm, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 40 - 20.3::double END AS gap FROM customer)""")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    mode, fps = F.when(key % 2 == 0, "live").otherwise("stored"), F.when(key % 3 != 0, (key % 30).cast("int"))
    bpm, gap = F.when(key % 7 != 0, (key % 120).cast("double") + 0.3), F.when(key % 5 != 0, (key % 40).cast("double") - 20.3)
    return table(spark, sf_dir, "customer").select(key.cast("bigint").alias("c_custkey"), labels.mode_label(mode, fps).alias("label"), labels.bpm_text(bpm).alias("rate"), labels.bpm_text(gap, signed=True).alias("gap"))


@registry.add("""WITH n AS (SELECT c_custkey::bigint AS c_custkey, 'P' || (c_custkey % 60) || '_' || (c_custkey % 8 + 1) AS stem, '1.5, ' || c_custkey || ',x,, 2' AS list FROM customer)
 SELECT c_custkey, (c_custkey % 60)::varchar AS subject, (c_custkey % 8 + 1)::int AS condition, (c_custkey % 8 % 4 + 1)::int AS lighting, CASE WHEN c_custkey % 8 + 1 <= 4 THEN 'rest' ELSE 'post_exercise' END AS state, (1.5 + c_custkey + 2)::double AS total, 3 AS numbers FROM n""")
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    stem = F.concat(F.lit("P"), (key % 60).cast("string"), F.lit("_"), (key % 8 + 1).cast("string"))
    numbers = labels.number_list(F.concat(F.lit("1.5, "), key.cast("string"), F.lit(",x,, 2")))
    parts = labels.condition_name(stem)
    return table(spark, sf_dir, "customer").select(key.cast("bigint").alias("c_custkey"), *[c.alias(k) for k, c in parts.items()], S.total(numbers).alias("total"), F.size(numbers).alias("numbers"))


@registry.add(f"""WITH {SAMPLES}, l AS (SELECT *, max(t) OVER (PARTITION BY rec) AS m FROM e) SELECT rec, count(*) AS n, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN {R('(count(*) - 1) / (max(t) - min(t))', 9)} END AS rate FROM l WHERE t >= m - 43200 GROUP BY rec""")
def trailing_effective_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective rate of each recording's last half day."""
    kept = windows.trailing(samples(spark, sf_dir), ["rec"], "t", 43200.0)
    return rounded(windows.effective_rate(kept, ["rec"], "t"), 9)


@registry.add(f"""WITH {PRED}, w AS (SELECT DISTINCT subject, mode FROM (SELECT DISTINCT subject FROM pred), range(1, 9) t(mode)) SELECT w.mode::int AS mode, count(*) AS absent FROM w ANTI JOIN pred ON pred.subject = w.subject AND pred.mode = w.mode GROUP BY w.mode""")
def absent_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    wanted = rows.select("subject").distinct().withColumn("mode", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return compare.absent(wanted, rows, ["subject", "mode"]).groupBy("mode").agg(F.count(F.lit(1)).alias("absent"))


@registry.add(f"""WITH {MANIFEST} SELECT recording, subject, n_frames FROM p WHERE split = 'test' ORDER BY n_frames DESC, recording LIMIT 50""")
def first_evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty test recordings of a stated order: a limit is what the operator is."""
    return manifest(spark, sf_dir).where("split = 'test'").orderBy(F.desc("n_frames"), "recording").limit(50).select("recording", "subject", "n_frames")
