"""Evaluation of predictions against references: grouped error, bias, calibration and agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S
from .quantiles import mean_ranks, with_quantiles

#: Thresholds of the error flags, in bpm.
HIGH_HR, TACHY, SEVERE = 100.0, 120.0, 10.0

#: Buckets that a replica's rows are dealt to when they are ranked at random.
RANK_BUCKETS = 1024


def rate(condition: Column) -> Column:
    """Share of rows for which a condition holds; rows where it is unknown don't count."""
    return F.avg(condition.cast("double"))


def with_errors(df: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """Add signed_error, abs_error and the flags high_hr, tachy and severe_under."""
    t, p = F.col(target), F.col(pred)
    return df.withColumns({"signed_error": p - t, "abs_error": F.abs(p - t), "high_hr": t >= HIGH_HR, "tachy": t >= TACHY, "severe_under": p - t <= -SEVERE})


def error_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: rows, means, median, p90, p95 and maximum of the absolute error, mean signed error, severe rate."""
    e = F.col("abs_error")
    found = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("target").alias("target_mean"),
        F.avg("pred").alias("pred_mean"),
        F.avg(e).alias("mae"),
        F.max(e).alias("mae_max"),
        F.avg("signed_error").alias("bias"),
        rate(F.col("severe_under")).alias("severe_rate"),
    )
    return with_quantiles(found, errors, keys, {"mae_median": (e, 0.5), "mae_p90": (e, 0.9), "mae_p95": (e, 0.95)})


def bias_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: the distribution of the signed error and the rates of under- and overprediction."""
    s = F.col("signed_error")
    found = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(s).alias("signed_mean"),
        rate(s < 0).alias("under_rate"),
        rate(s <= -SEVERE).alias("severe_under_rate"),
        rate(s >= SEVERE).alias("severe_over_rate"),
    )
    return with_quantiles(found, errors, keys, {"signed_median": (s, 0.5), "signed_p10": (s, 0.1), "signed_p90": (s, 0.9)})


def status_summary(rows: DataFrame, keys: list[str], status: str, metrics: list[str]) -> DataFrame:
    """Per group, null keys included: rows, ok and failed rows, and mean, median and p90 of metrics without nulls."""
    found = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(status) == "ok").alias("ok_rows"), F.count_if(F.col(status) != "ok").alias("failed_rows")]
    wanted = {}
    for m in metrics:
        found.append(F.avg(m).alias(f"{m}_mean"))
        wanted |= {f"{m}_median": (F.col(m), 0.5), f"{m}_p90": (F.col(m), 0.9)}
    return with_quantiles(rows.groupBy(*keys).agg(*found), rows, keys, wanted)


def slice_summary(errors: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """One row a named slice; slices may overlap, and an empty one has null metrics.

    A row counts once for each slice that it is in; the copies are summed up where they are made.
    """
    spark = errors.sparkSession
    tags = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in slices.items()]))
    tagged = errors.withColumn("slice", F.explode(tags))
    summary = error_summary(tagged, ["slice"])
    names = spark.createDataFrame([(name,) for name in slices], "slice string")
    return names.join(summary, "slice", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def calibration(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: slope and intercept of prediction on target, slope of the error, correlation; null for flat groups or under three rows."""
    t, p = F.col("target"), F.col("pred")
    good = (F.col("rows") >= 3) & (F.col("sd_target") >= 1e-6) & (F.col("sd_pred") >= 1e-6)
    fitted = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.stddev_pop(t).alias("sd_target"),
        F.stddev_pop(p).alias("sd_pred"),
        F.regr_slope(p, t).alias("slope"),
        F.regr_intercept(p, t).alias("intercept"),
        F.regr_slope(p - t, t).alias("error_slope"),
        F.corr(p, t).alias("r"),
    )
    return fitted.withColumns({c: F.when(good, F.col(c)) for c in ("slope", "intercept", "error_slope", "r")}).drop("sd_target", "sd_pred")


def tracking(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: slope, ratio of spreads, MAE, the MAE of always saying the mean, and whether it is beaten."""
    means = errors.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.avg("target").alias("mean_target"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    centred = errors.join(means, same) if keys else errors.crossJoin(means)
    t, p = F.col("target"), F.col("pred")
    found = centred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.try_divide(F.covar_pop(p, t), F.var_pop(t)).alias("slope"),
        F.try_divide(F.stddev_pop(p), F.stddev_pop(t)).alias("spread_ratio"),
        F.avg("abs_error").alias("mae"),
        F.avg(F.abs(t - F.col("mean_target"))).alias("baseline_mae"),
    )
    return found.withColumn("beats_baseline", F.col("mae") < F.col("baseline_mae"))


def fit_and_apply(errors: DataFrame, fit_on: Column, split: str) -> DataFrame:
    """Offset and linear corrections fitted on some rows and evaluated on every split: one row a split and correction."""
    t, p = F.col("target"), F.col("pred")
    fit = errors.where(fit_on).agg(F.avg(t - p).alias("offset"), F.regr_slope(t, p).alias("a"), F.regr_intercept(t, p).alias("b"))
    kinds = {"none": p, "offset": p + F.col("offset"), "linear": F.col("a") * p + F.col("b")}
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("correction"), c.alias("corrected")) for k, c in kinds.items()]))
    rows = errors.crossJoin(F.broadcast(fit)).select(split, "target", made.alias("m")).select(split, "target", "m.*")
    error = F.col("corrected") - F.col("target")
    found = rows.groupBy(split, "correction").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"), F.regr_slope("corrected", "target").alias("slope")
    )
    return with_quantiles(found, rows, [split, "correction"], {"p90": (F.abs(error), 0.9)})


def full_evaluation(errors: DataFrame, keys: list[str], ddof: int = 0) -> DataFrame:
    """MAE, RMSE, MAPE, r, R2 and Bland-Altman bias and limits of agreement."""
    s, t = F.col("signed_error"), F.col("target")
    deviation = F.stddev_pop(s) if ddof == 0 else F.stddev_samp(s)
    found = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(s * s)).alias("rmse"),
        (F.avg(F.when(t != 0, F.col("abs_error") / F.abs(t))) * 100).alias("mape"),
        F.corr("pred", "target").alias("r"),
        (1 - F.try_divide(F.avg(s * s), F.var_pop(t))).alias("r2"),
        F.avg(s).alias("bias"),
        deviation.alias("sd"),
    )
    return found.withColumns({"loa_low": F.col("bias") - 1.96 * F.col("sd"), "loa_high": F.col("bias") + 1.96 * F.col("sd")}).drop("sd")


def subject_level(rows: DataFrame, keys: list[str], subject: str) -> DataFrame:
    """Metrics over the means of each subject."""
    means = rows.groupBy(*keys, subject).agg(F.avg("target").alias("target"), F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("windows"))
    return full_evaluation(with_errors(means), keys).join(means.groupBy(*keys).agg(F.sum("windows").alias("windows")), keys)


def within_subject(rows: DataFrame, keys: list[str], subject: str) -> DataFrame:
    """MAE after taking each subject's own means off targets and predictions."""
    own = Window.partitionBy(*keys, subject)
    centred = rows.select(*keys, ((F.col("pred") - F.avg("pred").over(own)) - (F.col("target") - F.avg("target").over(own))).alias("e"))
    return centred.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs("e")).alias("centred_mae"))


def coverage(errors: DataFrame, keys: list[str], bounds: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """Percentages of rows within bounds of the target."""
    return errors.groupBy(*keys).agg(*[(rate(F.col("abs_error") < b) * 100).alias(f"within_{b}") for b in bounds])


def cut(value: Column, edges: list[float], labels: list[str], outside: str | None = None) -> Column:
    """Label of the right-open bin of a value; null (or a label of its own) outside all bins and for null."""
    ladder = reduce(lambda c, k: c.when((value >= edges[k]) & (value < edges[k + 1]), labels[k]), range(1, len(labels)), F.when((value >= edges[0]) & (value < edges[1]), labels[0]))
    return ladder if outside is None else ladder.otherwise(outside)


def bin_counts(rows: DataFrame, keys: list[str], label: Column, labels: list[str]) -> DataFrame:
    """Counts and shares of every bin of every group, empty bins included."""
    spark = rows.sparkSession
    counted = rows.select(*keys, label.alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.select(*keys).distinct()
    every = groups.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in labels], "bin string")))
    filled = every.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))


def with_mean_rank(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add a value's rank within its group, ties sharing their mean rank: found by distinct value, then joined back."""
    ranks = mean_ranks(rows, keys, value, name)
    named = ranks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("v").alias("__rank_of"), name)
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(value).cast("double") == F.col("__rank_of")]
    return rows.join(named, on, "left").drop(*[f"__{k}" for k in keys], "__rank_of")


def agreement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, shares within 2 and 3, Pearson's and Spearman's correlation (ties share their mean rank)."""
    ranked = with_mean_rank(with_mean_rank(rows, keys, "target", "rank_t"), keys, "pred", "rank_p")
    error = F.abs(F.col("pred") - F.col("target"))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(error).alias("mae"), rate(error <= 2).alias("within_2"), rate(error <= 3).alias("within_3"), F.corr("pred", "target").alias("pearson"), F.corr("rank_p", "rank_t").alias("spearman")
    )


def clamp_collapse(rows: DataFrame, keys: list[str], low: float = 40.0, high: float = 180.0) -> DataFrame:
    """How often a prediction clamped to the plausible range sits on either end."""
    clamped = S.clamped(F.col("pred"), low, high)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), rate(clamped <= low).alias("floor_rate"), rate(clamped >= high).alias("ceiling_rate"), F.avg(clamped).alias("clamped_mean"))


def hr_distribution(rows: DataFrame, keys: list[str]) -> DataFrame:
    t = F.col("target")
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(t).alias("mean"), F.min(t).alias("min"), F.max(t).alias("max"), rate(t >= HIGH_HR).alias("high_share"), rate(t >= TACHY).alias("tachy_share"))
    return with_quantiles(found, rows, keys, {"median": (t, 0.5), "p10": (t, 0.1), "p90": (t, 0.9)})


def validation_score(errors: DataFrame, reference_p90: float, reference_rate: float, weight_p90: float, weight_rate: float) -> DataFrame:
    """Validation MAE plus weighted worsening of its p90 and of the severe rate, one row."""
    found = with_quantiles(errors.agg(F.avg("abs_error").alias("mae"), rate(F.col("severe_under")).alias("severe_rate")), errors, [], {"p90": (F.col("abs_error"), 0.9)})
    worse_p90, worse_rate = F.greatest(F.lit(0.0), F.col("p90") - reference_p90), F.greatest(F.lit(0.0), F.col("severe_rate") - reference_rate)
    return found.withColumn("score", F.col("mae") + weight_p90 * worse_p90 + weight_rate * worse_rate)


def shuffled_rank(rows: DataFrame, seed: int, name: str = "k") -> DataFrame:
    """A random place, 1 to n, of every row within its replica: rows with replica and id get `name`.

    The order is that of the md5 of id, replica and seed. Rows are dealt to buckets by its first digits; a place is the sizes of the buckets before plus the
    row number within the bucket, so that no replica has to be sorted in one task.
    """
    text = F.concat_ws(":", F.col("id").cast("string"), F.col("replica").cast("string"), F.lit(str(seed)))
    spread = rows.withColumn("__h", F.md5(text)).withColumn("__b", F.floor(F.conv(F.substring("__h", 1, 4), 16, 10).cast("int") * RANK_BUCKETS / 65536))
    sizes = spread.groupBy("replica", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("replica").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("replica", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("replica", "__b").orderBy("__h", "id"))
    return spread.withColumn(name, within).join(offsets, ["replica", "__b"]).withColumn(name, F.col(name) + F.col("__before")).drop("__h", "__b", "__n", "__before")


def permutation_test(rows: DataFrame, replicas: int, seed: int = 1) -> DataFrame:
    """Null distribution of the correlation of two columns under shuffled pairs, and its p-value.

    A replica deals both columns out in the orders of two seeded hashes; pairs meet by rank.
    rows: a unique id, target, pred.
    """
    copies = rows.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    left = shuffled_rank(copies.select("replica", "id", "target"), seed).select("replica", "k", "target")
    right = shuffled_rank(copies.select("replica", "id", "pred"), seed + 1).select("replica", "k", "pred")
    null = left.join(right, ["replica", "k"]).groupBy("replica").agg(F.corr("pred", "target").alias("null_r"))
    real = rows.agg(F.corr("pred", "target").alias("r"))
    return null.crossJoin(F.broadcast(real)).agg(
        F.first("r").alias("r"), F.avg("null_r").alias("null_mean"), F.stddev_pop("null_r").alias("null_sd"), ((F.count_if(F.abs("null_r") >= F.abs("r")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value")
    )


def described(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of a value by group."""
    v = F.col(value)
    found = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))
    return with_quantiles(found, rows, keys, {"q25": (v, 0.25), "q50": (v, 0.5), "q75": (v, 0.75)})


def crossed(rows: DataFrame, first: str, second: str, values: list) -> DataFrame:
    """Counts of each value of `first` with each stated value of `second`, one column a value."""
    return rows.groupBy(first).agg(*[F.count_if(F.col(second) == v).alias(f"{second}_{v}") for v in values])


def linear_baseline(rows: DataFrame, keys: list[str], features: list[str], target: str, train: Column) -> DataFrame:
    """Test MAE of least squares on a few features, fitted on the training rows of each group.

    Only sums of products, a small matrix a group, are gathered for each fit; groups whose matrix
    can't be solved fall back to the training mean.
    """
    import numpy as np

    names = ["__one", *features]
    design = rows.withColumn("__one", F.lit(1.0)).where(reduce(lambda a, c: a & F.col(c).isNotNull(), [*features, target], F.lit(True)))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, target])]
    fits = []
    for r in design.where(train).groupBy(*keys).agg(*sums).collect():  # a row a group
        m = np.array([[r[f"{i}_{j}"] for j in range(len(names) + 1)] for i in range(len(names))], dtype=float)
        try:
            w = np.linalg.solve(m[:, :-1], m[:, -1])
        except np.linalg.LinAlgError:
            w = np.append(m[0, -1] / m[0, 0], np.zeros(len(features)))
        fits.append((*[r[k] for k in keys], *map(float, w)))
    ddl = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"__w{i} double" for i in range(len(names))])
    weights = rows.sparkSession.createDataFrame(fits, ddl)
    tested = design.where(~train).join(F.broadcast(weights), keys)
    guess = reduce(lambda a, i: a + F.col(f"__w{i}") * F.col(names[i]), range(1, len(names)), F.col("__w0"))
    return tested.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(guess - F.col(target))).alias("linear_mae"))
