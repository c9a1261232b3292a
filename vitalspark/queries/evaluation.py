"""Evaluation queries over `lineitem` read as predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare, evaluate
from ..operators.quantiles import with_quantiles
from . import Registry, rounded, table

registry = Registry()

#: lineitem as prediction rows: datasets, roles and modes, with errors on a decimal grid.
PRED = """pred AS (SELECT *, pred - target AS signed_error, abs(pred - target) AS abs_error, target >= 100 AS high_hr, target >= 120 AS tachy, pred - target <= -10 AS severe_under FROM (
 SELECT 40 + 2.8::double * l_quantity::double AS target,
  (40 + 2.8::double * l_quantity::double) + (l_discount::double - 0.05::double) * 300 + (l_tax::double - 0.04::double) * 100 AS pred,
  l_returnflag AS dataset, l_linestatus AS role, l_linenumber::int AS mode, l_suppkey::bigint AS subject, l_orderkey::bigint AS recording FROM lineitem))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    target = F.lit(40) + F.lit(2.8) * q
    pred = target + (F.col("l_discount").cast("double") - F.lit(0.05)) * 300 + (F.col("l_tax").cast("double") - F.lit(0.04)) * 100
    rows = table(spark, sf_dir, "lineitem").select(
        target.alias("target"), pred.alias("pred"), F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("role"), F.col("l_linenumber").cast("int").alias("mode"), F.col("l_suppkey").cast("bigint").alias("subject"), F.col("l_orderkey").cast("bigint").alias("recording")
    )
    return evaluate.with_errors(rows)


R = lambda x: f"round({x}, 6) + 0.0"
ERRORS = f"""count(*) AS rows, {R('avg(target)')} AS target_mean, {R('avg(pred)')} AS pred_mean, {R('avg(abs_error)')} AS mae, {R('median(abs_error)')} AS mae_median,
 {R('quantile_cont(abs_error, 0.9)')} AS mae_p90, {R('quantile_cont(abs_error, 0.95)')} AS mae_p95, {R('max(abs_error)')} AS mae_max, {R('avg(signed_error)')} AS bias, {R('avg(severe_under::int::double)')} AS severe_rate"""


@registry.add(f"WITH {PRED} SELECT dataset, role, {ERRORS} FROM pred GROUP BY dataset, role")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.error_summary(predictions(spark, sf_dir), ["dataset", "role"]))


@registry.add(f"""WITH {PRED} SELECT dataset, mode, count(*) AS rows, {R('avg(signed_error)')} AS signed_mean, {R('median(signed_error)')} AS signed_median, {R('quantile_cont(signed_error, 0.1)')} AS signed_p10,
 {R('quantile_cont(signed_error, 0.9)')} AS signed_p90, {R('avg((signed_error < 0)::int::double)')} AS under_rate, {R('avg((signed_error <= -10)::int::double)')} AS severe_under_rate, {R('avg((signed_error >= 10)::int::double)')} AS severe_over_rate
 FROM pred GROUP BY dataset, mode""")
def bias_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.bias_summary(predictions(spark, sf_dir), ["dataset", "mode"]))


@registry.add(f"""WITH {PRED}, s AS (SELECT dataset, CASE WHEN mode % 5 <> 0 THEN mode END AS mode, CASE WHEN subject % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN subject % 7 <> 0 THEN abs_error END AS error FROM pred)
 SELECT dataset, mode, count(*) AS rows, count(*) FILTER (status = 'ok') AS ok_rows, count(*) FILTER (status <> 'ok') AS failed_rows, {R('avg(error)')} AS error_mean, {R('median(error)')} AS error_median, {R('quantile_cont(error, 0.9)')} AS error_p90 FROM s GROUP BY dataset, mode""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select(
        "dataset", F.when(F.col("mode") % 5 != 0, F.col("mode")).alias("mode"), F.when(F.col("subject") % 7 == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("subject") % 7 != 0, F.col("abs_error")).alias("error")
    )
    return rounded(evaluate.status_summary(rows, ["dataset", "mode"], "status", ["error"]))


SLICES = {"all": "true", "high_hr": "high_hr", "tachy": "tachy", "dataset_R": "dataset = 'R'", "R_high_hr": "dataset = 'R' AND high_hr", "none": "target > 1000"}


@registry.add(
    f"WITH {PRED} " + " UNION ALL ".join(f"SELECT '{name}' AS slice, {ERRORS} FROM pred WHERE {condition}" for name, condition in SLICES.items())
)
def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.slice_summary(predictions(spark, sf_dir), {name: F.expr(condition) for name, condition in SLICES.items()}))


@registry.add(f"""WITH {PRED}, g AS (SELECT dataset, role, mode, count(*) AS rows, stddev_pop(target) AS st, stddev_pop(pred) AS sp, regr_slope(pred, target) AS a, regr_intercept(pred, target) AS b, regr_slope(signed_error, target) AS e, corr(pred, target) AS r FROM pred GROUP BY dataset, role, mode)
 SELECT dataset, role, mode, rows, CASE WHEN ok THEN {R('a')} END AS slope, CASE WHEN ok THEN {R('b')} END AS intercept, CASE WHEN ok THEN {R('e')} END AS error_slope, CASE WHEN ok THEN {R('r')} END AS r FROM (SELECT *, rows >= 3 AND st >= 1e-6 AND sp >= 1e-6 AS ok FROM g)""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration(predictions(spark, sf_dir), ["dataset", "role", "mode"]))


@registry.add(f"""WITH {PRED}, c AS (SELECT *, avg(target) OVER (PARTITION BY mode) AS m FROM pred)
 SELECT mode, count(*) AS rows, {R('covar_pop(pred, target) / var_pop(target)')} AS slope, {R('stddev_pop(pred) / stddev_pop(target)')} AS spread_ratio, {R('avg(abs_error)')} AS mae, {R('avg(abs(target - m))')} AS baseline_mae, avg(abs_error) < avg(abs(target - m)) AS beats_baseline FROM c GROUP BY mode""")
def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.tracking(predictions(spark, sf_dir), ["mode"]))


@registry.add(f"""WITH {PRED}, fit AS (SELECT avg(target - pred) AS o, regr_slope(target, pred) AS a, regr_intercept(target, pred) AS b FROM pred WHERE role = 'F'),
 c AS (SELECT role, target, k.correction, CASE k.correction WHEN 'none' THEN pred WHEN 'offset' THEN pred + o ELSE a * pred + b END AS v FROM pred, fit, (VALUES ('none'), ('offset'), ('linear')) k(correction))
 SELECT role, correction, count(*) AS rows, {R('avg(abs(v - target))')} AS mae, {R('avg(v - target)')} AS bias, {R('quantile_cont(abs(v - target), 0.9)')} AS p90, {R('regr_slope(v, target)')} AS slope FROM c GROUP BY role, correction""")
def correction_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.fit_and_apply(predictions(spark, sf_dir), F.col("role") == "F", "role"))


FULL = f"""count(*) AS rows, {R('avg(abs_error)')} AS mae, {R('sqrt(avg(signed_error * signed_error))')} AS rmse, {R('avg(abs_error / abs(target)) * 100')} AS mape, {R('corr(pred, target)')} AS r, {R('1 - avg(signed_error * signed_error) / var_pop(target)')} AS r2,
 {R('avg(signed_error)')} AS bias, {R('avg(signed_error) - 1.96::double * stddev_pop(signed_error)')} AS loa_low, {R('avg(signed_error) + 1.96::double * stddev_pop(signed_error)')} AS loa_high"""


@registry.add(f"WITH {PRED} SELECT dataset, {FULL} FROM pred GROUP BY dataset")
def full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.full_evaluation(predictions(spark, sf_dir), ["dataset"]))


@registry.add(f"""WITH {PRED}, m AS (SELECT dataset, subject, avg(target) AS target, avg(pred) AS pred, count(*) AS windows FROM pred GROUP BY dataset, subject), e AS (SELECT *, pred - target AS signed_error, abs(pred - target) AS abs_error FROM m)
 SELECT dataset, {FULL}, sum(windows)::bigint AS windows FROM e GROUP BY dataset""")
def subject_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.subject_level(predictions(spark, sf_dir), ["dataset"], "subject"))


@registry.add(f"""WITH {PRED}, c AS (SELECT dataset, (pred - avg(pred) OVER w) - (target - avg(target) OVER w) AS e FROM pred WINDOW w AS (PARTITION BY dataset, subject))
 SELECT dataset, count(*) AS rows, {R('avg(abs(e))')} AS centred_mae FROM c GROUP BY dataset""")
def within_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.within_subject(predictions(spark, sf_dir), ["dataset"], "subject"))


@registry.add(f"WITH {PRED} SELECT dataset, " + ", ".join(f"{R(f'avg((abs_error < {b})::int::double) * 100')} AS within_{b}" for b in (5, 10, 15)) + " FROM pred GROUP BY dataset")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.coverage(predictions(spark, sf_dir), ["dataset"]))


#: Edges and names of the HR bins.
EDGES, BINS = [0.0, 60.0, 80.0, 100.0, 120.0, 140.0, 220.0], ["under_60", "60_80", "80_100", "100_120", "120_140", "over_140"]
BIN_SQL = "CASE " + " ".join(f"WHEN target >= {a} AND target < {b} THEN '{n}'" for a, b, n in zip(EDGES, EDGES[1:], BINS, strict=False)) + " END"


@registry.add(f"WITH {PRED} SELECT dataset, {BIN_SQL} AS hr_bin, {FULL} FROM pred GROUP BY ALL")
def hr_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("hr_bin", evaluate.cut(F.col("target"), EDGES, BINS))
    return rounded(evaluate.full_evaluation(rows, ["dataset", "hr_bin"]))


@registry.add(f"""WITH {PRED}, f AS (SELECT dataset, role, {BIN_SQL} AS bin FROM pred), b AS (SELECT unnest({BINS}) AS bin), g AS (SELECT DISTINCT dataset, role FROM f),
 c AS (SELECT g.dataset, g.role, b.bin, count(f.bin) AS n FROM g CROSS JOIN b LEFT JOIN f ON f.dataset = g.dataset AND f.role = g.role AND f.bin = b.bin GROUP BY ALL)
 SELECT dataset, role, bin, n, {R('n / sum(n) OVER (PARTITION BY dataset, role)')} AS share FROM c""")
def hr_bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.bin_counts(predictions(spark, sf_dir), ["dataset", "role"], evaluate.cut(F.col("target"), EDGES, BINS), BINS))


@registry.add(f"""WITH {PRED} SELECT dataset, role, count(*) AS rows, {R('avg(target)')} AS mean, {R('median(target)')} AS median, {R('quantile_cont(target, 0.1)')} AS p10, {R('quantile_cont(target, 0.9)')} AS p90, {R('min(target)')} AS min, {R('max(target)')} AS max,
 {R('avg(high_hr::int::double)')} AS high_share, {R('avg(tachy::int::double)')} AS tachy_share FROM pred GROUP BY dataset, role""")
def hr_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.hr_distribution(predictions(spark, sf_dir), ["dataset", "role"]))


@registry.add(f"""WITH {PRED}, k AS (SELECT mode, target, pred, rank() OVER (PARTITION BY mode ORDER BY target) + (count(*) OVER (PARTITION BY mode, target) - 1) / 2.0::double AS a, rank() OVER (PARTITION BY mode ORDER BY pred) + (count(*) OVER (PARTITION BY mode, pred) - 1) / 2.0::double AS b FROM pred)
 SELECT mode, count(*) AS rows, {R('avg(abs(pred - target))')} AS mae, {R('avg((abs(pred - target) <= 2)::int::double)')} AS within_2, {R('avg((abs(pred - target) <= 3)::int::double)')} AS within_3, {R('corr(pred, target)')} AS pearson, {R('corr(a, b)')} AS spearman FROM k GROUP BY mode""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.agreement(predictions(spark, sf_dir), ["mode"]))


@registry.add(f"""WITH {PRED}, m AS (SELECT avg(abs_error) AS mae, quantile_cont(abs_error, 0.9) AS p90, avg(severe_under::int::double) AS s FROM pred WHERE role = 'F')
 SELECT {R('mae')} AS mae, {R('p90')} AS p90, {R('s')} AS severe_rate, {R('mae + 0.5::double * greatest(0.0::double, p90 - 12) + 10 * greatest(0.0::double, s - 0.05::double)')} AS score FROM m""")
def validation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.validation_score(predictions(spark, sf_dir).where("role = 'F'"), 12.0, 0.05, 0.5, 10.0))


@registry.add(f"""WITH {PRED}, c AS (SELECT dataset, greatest(40::double, least(180::double, pred)) AS p FROM pred)
 SELECT dataset, count(*) AS rows, {R('avg((p <= 40)::int::double)')} AS floor_rate, {R('avg((p >= 180)::int::double)')} AS ceiling_rate, {R('avg(p)')} AS clamped_mean FROM c GROUP BY dataset""")
def clamp_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.clamp_collapse(predictions(spark, sf_dir), ["dataset"]))


@registry.add(f"""WITH {PRED} SELECT coalesce(dataset, 'ALL') AS dataset, {ERRORS} FROM pred GROUP BY ROLLUP (dataset)""")
def rollup_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    total = evaluate.error_summary(rows.withColumn("dataset", F.lit("ALL")), ["dataset"])
    return rounded(evaluate.error_summary(rows, ["dataset"]).unionByName(total))


@registry.add(f"""WITH {PRED} SELECT dataset, {R("avg(abs_error) FILTER (role = 'F')")} AS F, {R("avg(abs_error) FILTER (role = 'O')")} AS O FROM pred GROUP BY dataset""")
def error_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predictions(spark, sf_dir).groupBy("dataset").pivot("role", ["F", "O"]).agg(F.avg("abs_error")))


@registry.add(f"""WITH {PRED}, s AS (SELECT mode, dataset, avg(abs_error) AS mae FROM pred GROUP BY mode, dataset), w AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mae, mode) AS k FROM s)
 SELECT dataset, mode AS best_mode, {R('mae')} AS mae FROM w WHERE k = 1""")
def best_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = predictions(spark, sf_dir).groupBy("mode", "dataset").agg(F.avg("abs_error").alias("mae"))
    best = summary.groupBy("dataset").agg(F.min_by("mode", F.struct("mae", "mode")).alias("best_mode"), F.min("mae").alias("mae"))
    return rounded(best)


# Comparisons. The baseline is the first mode, every other one a candidate.
def against_first(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A summary by mode and other keys parted into the candidates' rows and, once for each candidate mode, those of the first mode."""
    candidate, first = made.where("mode <> 1"), made.where("mode = 1").drop("mode")
    modes = candidate.agg(F.collect_set("mode").alias("modes"))  # one row of as many numbers as there are modes
    return candidate, first.crossJoin(F.broadcast(modes)).withColumn("mode", F.explode("modes")).drop("modes")


@registry.add(f"""WITH {PRED}, s AS (SELECT mode, dataset, role, avg(abs_error) AS mae, quantile_cont(abs_error, 0.9) AS mae_p90 FROM pred GROUP BY ALL)
 SELECT c.mode AS mode, dataset, role, {R('c.mae')} AS mae_candidate, {R('c.mae_p90')} AS mae_p90_candidate, {R('b.mae')} AS mae_baseline, {R('b.mae_p90')} AS mae_p90_baseline, {R('c.mae - b.mae')} AS mae_delta, {R('c.mae_p90 - b.mae_p90')} AS mae_p90_delta
 FROM s c JOIN s b USING (dataset, role) WHERE c.mode <> 1 AND b.mode = 1""")
def summary_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidate, baseline = against_first(evaluate.error_summary(predictions(spark, sf_dir), ["mode", "dataset", "role"]))
    return rounded(compare.deltas(candidate, baseline, ["mode", "dataset", "role"], ["mae", "mae_p90"]))


@registry.add(f"""WITH {PRED}, s AS (SELECT mode, dataset, role, subject, floor(target / 5)::int AS part, avg(abs_error) AS v FROM pred GROUP BY ALL), a AS (SELECT * FROM s WHERE mode <> 1), b AS (SELECT m.mode, dataset, role, subject, part, v FROM s, (SELECT DISTINCT mode FROM a) m WHERE s.mode = 1)
 SELECT mode, dataset, role, subject, part, {R('a.v')} AS left_value, {R('b.v')} AS right_value, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'both' WHEN a.v IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side, {R('a.v - b.v')} AS difference FROM a FULL JOIN b USING (mode, dataset, role, subject, part)""")
def outer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode against the first by subject and five-bpm band: many bands have predictions of one mode alone."""
    keys = ["mode", "dataset", "role", "subject", "part"]
    made = predictions(spark, sf_dir).withColumn("part", F.floor(F.col("target") / 5).cast("int")).groupBy(*keys).agg(F.avg("abs_error").alias("v"))
    return rounded(compare.outer_compare(*against_first(made), keys, "v"))


@registry.add(f"""WITH {PRED}, e AS (SELECT * FROM (VALUES ('A', 'F', 14000), ('N', 'F', 10), ('X', 'F', 3)) t(dataset, role, expected)), a AS (SELECT dataset, role, count(*) AS n FROM pred GROUP BY ALL)
 SELECT dataset, role, e.expected::int AS expected, coalesce(a.n, 0) AS actual, coalesce(a.n, 0) = e.expected AS match FROM e LEFT JOIN a USING (dataset, role)""")
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("A", "F", 14000), ("N", "F", 10), ("X", "F", 3)], "dataset string, role string, expected int")
    actual = predictions(spark, sf_dir).groupBy("dataset", "role").agg(F.count(F.lit(1)).alias("n"))
    return compare.expected_counts(expected, actual, ["dataset", "role"])


@registry.add(f"""WITH {PRED}, k AS (SELECT dataset, role, subject FROM pred GROUP BY ALL HAVING count(DISTINCT mode) = (SELECT count(DISTINCT mode) FROM pred))
 SELECT mode, count(*) AS rows, {R('avg(abs_error)')} AS mae FROM pred SEMI JOIN k USING (dataset, role, subject) GROUP BY mode""")
def windows_common_to_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = compare.common_windows(predictions(spark, sf_dir), ["dataset", "role", "subject"], "mode")
    return rounded(common.groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), F.avg("abs_error").alias("mae")))


BLENDS = [0.0, 0.1, 0.25, 0.5, 1.0]
PAIRS = "means AS (SELECT mode, dataset, role, subject, avg(target) AS t, avg(pred) AS p FROM pred GROUP BY ALL), p AS (SELECT c.mode, dataset, role, subject, b.t AS target, b.p AS f, c.p AS c FROM means c JOIN means b USING (dataset, role, subject) WHERE c.mode <> 1 AND b.mode = 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    keys = ["mode", "dataset", "role", "subject"]
    candidate, frozen = against_first(predictions(spark, sf_dir).groupBy(*keys).agg(F.avg("target").alias("target"), F.avg("pred").alias("pred")))
    return frozen, candidate, keys


@registry.add(f"""WITH {PRED}, {PAIRS}, b AS (SELECT mode, role, target, alpha, (1 - alpha) * f + alpha * c AS pred FROM p, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 1.0]::double[]) AS alpha))
 SELECT mode, role, alpha, count(*) AS rows, {R('avg(abs(pred - target))')} AS mae, {R('avg(pred - target)')} AS bias, {R('quantile_cont(abs(pred - target), 0.9)')} AS p90 FROM b GROUP BY mode, role, alpha""")
def blend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen, candidate, keys = _pairs(spark, sf_dir)
    blended = evaluate.with_errors(compare.blend(frozen, candidate, keys, BLENDS))
    found = blended.groupBy("mode", "role", "alpha").agg(F.count(F.lit(1)).alias("rows"), F.avg("abs_error").alias("mae"), F.avg("signed_error").alias("bias"))
    return rounded(with_quantiles(found, blended, ["mode", "role", "alpha"], {"p90": (F.col("abs_error"), 0.9)}))


@registry.add(f"""WITH {PRED}, s AS (SELECT mode, avg(abs_error) FILTER (role = 'F') AS v, avg(abs_error) FILTER (role = 'O') AS t, avg(abs_error) FILTER (dataset = 'R') AS o, avg(abs_error) FILTER (high_hr) AS h, avg(severe_under::int::double) FILTER (high_hr) AS s, quantile_cont(abs_error, 0.9) FILTER (role = 'O') AS p, abs(avg(signed_error) FILTER (role = 'O')) AS b FROM pred GROUP BY mode),
 d AS (SELECT c.mode, c.v - b.v AS v, c.t - b.t AS t, c.o - b.o AS o, c.h - b.h AS h, c.s - b.s AS s, c.p - b.p AS p, c.b - b.b AS b FROM s c, s b WHERE b.mode = 1)
 SELECT mode, {R('v')} AS val_delta, {R('t')} AS test_delta, CASE WHEN v <= -0.2 AND t <= -0.1 AND o <= 0.5 AND h <= 0.25 AND s <= 0.02 THEN 'research_candidate_for_review' WHEN v < 0 AND t < 0 THEN 'analysis_only_tradeoff' ELSE 'reject_or_debug' END AS research,
 CASE WHEN v <= -0.2 AND t <= -0.1 AND o <= 0.3 AND p <= 0.25 AND s <= 0.01 AND b <= 0.25 THEN 'adoption_candidate_for_review' WHEN v <= -0.2 AND t <= -0.1 THEN 'analysis_only_tradeoff' WHEN v <= -0.2 OR t <= -0.1 THEN 'weak_or_incomplete_candidate' ELSE 'reject' END AS adoption FROM d""")
def candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    at = lambda condition, column: F.avg(F.when(F.expr(condition), F.col(column)))
    summary = rows.groupBy("mode").agg(
        at("role = 'F'", "abs_error").alias("v"), at("role = 'O'", "abs_error").alias("t"), at("dataset = 'R'", "abs_error").alias("o"), at("high_hr", "abs_error").alias("h"),
        F.avg(F.when(F.col("high_hr"), F.col("severe_under").cast("double"))).alias("s"), F.abs(at("role = 'O'", "signed_error")).alias("b"),
    )
    summary = with_quantiles(summary, rows, ["mode"], {"p": (F.when(F.col("role") == "O", F.col("abs_error")), 0.9)})
    base = F.broadcast(summary.where("mode = 1").select(*[F.col(c).alias(f"{c}0") for c in "vtohspb"]))
    d = {c: F.col(c) - F.col(f"{c}0") for c in "vtohspb"}
    status = summary.crossJoin(base).select(
        "mode", d["v"].alias("val_delta"), d["t"].alias("test_delta"), compare.research_status(d["v"], d["t"], d["o"], d["h"], d["s"]).alias("research"), compare.adoption_status(d["v"], d["t"], d["o"], d["p"], d["s"], d["b"]).alias("adoption")
    )
    return rounded(status)


@registry.add(f"""WITH {PRED}, {PAIRS}, d AS (SELECT mode, dataset, role, subject, {R('abs(c - target) - abs(f - target)')} AS delta FROM p),
 w AS (SELECT *, row_number() OVER (ORDER BY delta, mode, dataset, role, subject) AS up, row_number() OVER (ORDER BY delta DESC, mode, dataset, role, subject) AS down FROM d)
 SELECT mode, dataset, role, subject, delta, 'improved' AS side FROM w WHERE up <= 20 UNION ALL SELECT mode, dataset, role, subject, delta, 'harmed' FROM w WHERE down <= 20""")
def top_error_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen, candidate, keys = _pairs(spark, sf_dir)
    both = frozen.join(candidate.select(*keys, F.col("pred").alias("other")), keys)
    change = both.select(*keys, (F.abs(F.col("other") - F.col("target")) - F.abs(F.col("pred") - F.col("target"))).alias("delta"))
    return compare.top_changes(rounded(change), "delta", keys, 20)


@registry.add(f"""WITH {PRED}, s AS (SELECT mode, role, avg(abs_error) AS mae, count(*) AS n FROM pred GROUP BY ALL) SELECT mode, {R("max(mae) FILTER (role = 'F')")} AS mae_F, max(n) FILTER (role = 'F') AS n_F, {R("max(mae) FILTER (role = 'O')")} AS mae_O, max(n) FILTER (role = 'O') AS n_O FROM s GROUP BY mode""")
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = predictions(spark, sf_dir).groupBy("mode", "role").agg(F.avg("abs_error").alias("mae"), F.count(F.lit(1)).alias("n"))
    return rounded(compare.by_role(summary, ["mode"], "role", ["F", "O"], ["mae", "n"]))


@registry.add(f"""WITH {PRED}, s AS (SELECT dataset, mode, count(*) AS n, count(*) FILTER (severe_under) AS severe, {R('avg(abs_error)')} AS mae FROM pred GROUP BY ALL)
 SELECT dataset, mode, n, severe, mae, row_number() OVER (ORDER BY severe DESC, mae, dataset, mode)::int AS place, CASE dataset WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 999 END AS role_order, row_number() OVER (PARTITION BY dataset ORDER BY mode)::int AS best_order, min(mae) OVER (PARTITION BY dataset ORDER BY mode ROWS UNBOUNDED PRECEDING) AS best_so_far FROM s""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = rounded(predictions(spark, sf_dir).groupBy("dataset", "mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("severe_under").alias("severe"), F.avg("abs_error").alias("mae")))
    by_mode = Window.partitionBy("dataset").orderBy("mode")
    return summary.withColumns({
        "place": F.row_number().over(Window.orderBy(F.desc("severe"), "mae", "dataset", "mode")),
        "role_order": F.when(F.col("dataset") == "N", 0).when(F.col("dataset") == "A", 1).otherwise(999),
        "best_order": F.row_number().over(by_mode),
        "best_so_far": F.min("mae").over(by_mode.rowsBetween(Window.unboundedPreceding, 0)),
    })
