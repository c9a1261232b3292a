"""Joins of candidate and baseline tables, blends, and the policies that decide on candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself; when it is computed, a repeated key is an error. The keys are counted in one shuffle."""
    named = F.concat_ws(", ", *[F.coalesce(F.col(f"__{k}").cast("string"), F.lit("null")) for k in keys])
    counted = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    checked = counted.withColumn("__n", F.when(F.col("__n") == 1, F.col("__n")).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), named)).cast("bigint")))
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True))
    return df.join(checked, on).where("__n = 1").drop("__n", *[f"__{k}" for k in keys])


def outer_compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join with an indicator of the sides that have a key, and the difference."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    joined = a.join(b, keys, "full")
    side = F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left_only").otherwise("right_only")
    return joined.select(*keys, "left_value", "right_value", side.alias("side"), (F.col("left_value") - F.col("right_value")).alias("difference"))


def deltas(candidate: DataFrame, baseline: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Inner join of two summaries: each metric of both sides and their difference."""
    a = candidate.select(*keys, *[F.col(m).alias(f"{m}_candidate") for m in metrics])
    b = baseline.select(*keys, *[F.col(m).alias(f"{m}_baseline") for m in metrics])
    return a.join(b, keys).withColumns({f"{m}_delta": F.col(f"{m}_candidate") - F.col(f"{m}_baseline") for m in metrics})


def expected_counts(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected counts with the actual ones, 0 where absent, and whether they match."""
    joined = expected.join(actual.select(*keys, F.col("n").alias("actual")), keys, "left")
    return joined.withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("match", F.col("actual") == F.col("expected"))


def common_windows(rows: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Rows whose window is there in every mode that the table has."""
    modes = rows.agg(F.count_distinct(mode).alias("modes"))
    whole = rows.groupBy(*keys).agg(F.count_distinct(mode).alias("n")).crossJoin(F.broadcast(modes)).where("n = modes").select(*keys)
    return rows.join(whole, keys, "left_semi")


def unfinished(inventory: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not yet among the completed ones."""
    return inventory.join(done.select(*keys).distinct(), keys, "left_anti")


def blend(frozen: DataFrame, candidate: DataFrame, keys: list[str], alphas: list[float]) -> DataFrame:
    """(1 - alpha) of the frozen prediction plus alpha of the candidate's, for every alpha of a grid."""
    a = frozen.select(*keys, "target", F.col("pred").alias("frozen"))
    b = candidate.select(*keys, F.col("pred").alias("candidate"))
    grid = F.explode(F.array(*[F.lit(x) for x in alphas]))
    rows = a.join(b, keys).withColumn("alpha", grid)
    return rows.withColumn("pred", (1 - F.col("alpha")) * F.col("frozen") + F.col("alpha") * F.col("candidate"))


def misaligned(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of the left side that the right one lacks or gives another value."""
    return left.join(right.select(*keys, F.col(value).alias("other")), keys, "left").where(F.col("other").isNull() | (F.col("other") != F.col(value)))


# The words and thresholds of the statuses, profiles and labels below.
def research_status(val: Column, test: Column, ood: Column, high: Column, severe: Column) -> Column:
    """Status of a candidate from its deltas; fixed thresholds in bpm and shares."""
    good = (val <= -0.20) & (test <= -0.10) & (ood <= 0.50) & (high <= 0.25) & (severe <= 0.02)
    return F.when(good, "research_candidate_for_review").when((val < 0) & (test < 0), "analysis_only_tradeoff").otherwise("reject_or_debug")


def adoption_status(val: Column, test: Column, worst_dataset: Column, p90: Column, severe: Column, bias: Column) -> Column:
    """Status with guard rails: gains on validation and test, and no dataset, tail or bias made worse."""
    better_val, better_test = val <= -0.20, test <= -0.10
    safe = (worst_dataset <= 0.30) & (p90 <= 0.25) & (severe <= 0.01) & (bias <= 0.25)
    return (
        F.when(better_val & better_test & safe, "adoption_candidate_for_review")
        .when(better_val & better_test, "analysis_only_tradeoff")
        .when(better_val | better_test, "weak_or_incomplete_candidate")
        .otherwise("reject")
    )


def by_role(summary: DataFrame, keys: list[str], role: str, roles: list[str], metrics: list[str]) -> DataFrame:
    """One row a key with a column for every role and metric, null where a role is absent."""
    found = [F.max(F.when(F.col(role) == r, F.col(m))).alias(f"{m}_{r}") for r in roles for m in metrics]
    return summary.groupBy(*keys).agg(*found)


def top_changes(compared: DataFrame, delta: str, order: list[str], n: int) -> DataFrame:
    """The n largest improvements and the n largest harms."""
    better = compared.orderBy(F.col(delta).asc(), *order).limit(n).withColumn("side", F.lit("improved"))
    worse = compared.orderBy(F.col(delta).desc(), *order).limit(n).withColumn("side", F.lit("harmed"))
    return better.unionByName(worse)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The left side with a value of the right one; repeated keys of either side, and keys that the right lacks, are errors when it is computed."""
    found = assert_unique(right.select(*keys, F.col(value).alias(name), F.lit(True).alias("__found")), keys)
    joined = assert_unique(left, keys).join(found, keys, "left")
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    checked = F.when(F.col("__found"), True).otherwise(F.raise_error(F.concat(F.lit("no counterpart: "), named)).cast("boolean"))
    return joined.where(checked).drop("__found")


def only_both(compared: DataFrame, keys: list[str]) -> DataFrame:
    """An outer comparison in which every key has both sides; any other is an error when it is computed."""
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    return compared.where(F.when(F.col("side") == "both", True).otherwise(F.raise_error(F.concat(F.lit("one side only: "), named)).cast("boolean")))


def looked_up(summary: DataFrame, condition: Column, metric: str, name: str) -> DataFrame:
    """One row of one metric; anything but exactly one matching row is an error when it is computed."""
    found = summary.where(condition).agg(F.count(F.lit(1)).alias("n"), F.max(metric).alias(name))
    wrong = F.raise_error(F.concat(F.lit("expected one row, found "), F.col("n").cast("string"))).cast("boolean")
    return found.where(F.when(F.col("n") == 1, True).otherwise(wrong)).select(name)


def worst_delta(deltas_of: DataFrame, keys: list[str], part: str, delta: str) -> DataFrame:
    """Per key, the part (a dataset, say) that a candidate made worst, and by how much; ties go to the first name."""
    order = F.struct(F.col(delta).alias("worst"), F.col(part).alias("part"))
    top = deltas_of.where(F.col(delta).isNotNull()).groupBy(*keys).agg(F.max(delta).alias("worst"))
    tied = deltas_of.join(top, keys).where(F.col(delta) == F.col("worst"))
    return tied.groupBy(*keys).agg(F.min(F.struct(F.col(part).alias("part"), order["worst"].alias("worst"))).alias("w")).select(*keys, F.col("w.part").alias(f"worst_{part}"), F.col("w.worst").alias("worst"))


#: Gains and penalties, in bpm, by which a candidate is looked at.
GAIN_VAL, GAIN_TEST, OOD_PENALTY = 0.20, 0.10, 0.50


def scoreboard(baseline: str, rows: DataFrame) -> DataFrame:
    """Candidates with a row of zeros for the baseline, their mean gain, penalty and whether they may be adopted, best first by `place`.

    rows: experiment, val_delta, test_delta, ood_delta.
    """
    base = rows.sparkSession.createDataFrame([(baseline, 0.0, 0.0, 0.0)], "experiment string, val_delta double, test_delta double, ood_delta double")
    every = base.unionByName(rows.select(*base.columns)).withColumns({
        "mean_gain": -(F.col("val_delta") + F.col("test_delta")) / 2,
        "ood_penalty": F.greatest(F.col("ood_delta"), F.lit(0.0)),
        "adoptable": (F.col("val_delta") <= -GAIN_VAL) & (F.col("test_delta") <= -GAIN_TEST) & (F.col("ood_delta") <= OOD_PENALTY),
    })
    return every.withColumn("place", F.row_number().over(Window.orderBy(F.desc("adoptable"), F.desc("mean_gain"), "experiment")))  # a row an experiment


# The words and thresholds of profiles and labels.
def transfer_profile(val: Column, test: Column, ood: Column, high: Column) -> Column:
    """Profile of a transferred model from its deltas; fixed thresholds in bpm."""
    useful = (val < 0) & (test < 0)
    return F.when(useful & (ood <= 0.75) & ~(high > 0.50), "balanced_analysis_candidate").when(useful & (ood > 1.0), "performance_candidate_with_ood_penalty").when(useful, "weak_analysis_candidate").otherwise("reject")


def scientific_label(kind: Column, adoptable: Column, status: Column) -> Column:
    """Label of a run on the leaderboard."""
    return F.when(kind == "smoke", "smoke_test_only").when(adoptable, "adoption_candidate_by_policy").when(status == "reject", "rejected_candidate").otherwise("analysis_only_weak_candidate")


def absent(expected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that no row has."""
    return expected.select(*keys).distinct().join(rows.select(*keys).distinct(), keys, "left_anti")


def renamed(df: DataFrame, names: dict[str, str], prefixes: dict[str, str]) -> DataFrame:
    """Columns renamed by name, else by their prefix."""
    made = {c: names[c] if c in names else next((new + c[len(old) :] for old, new in prefixes.items() if c.startswith(old)), c) for c in df.columns}
    return df.withColumnsRenamed({a: b for a, b in made.items() if a != b})


def cache_health(rows: DataFrame, keys: list[str], signals: str, target: str, channels: int = 3, frames: int = 240) -> DataFrame:
    """Per role of a cache of windows: rows, shapes and finite values that hold, and the extremes of the target."""
    numbers = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    shaped = F.coalesce((F.size(signals) == channels) & F.forall(signals, lambda c: F.size(c) == frames), F.lit(False))
    finite = F.coalesce(F.forall(signals, lambda c: F.forall(c, numbers)), F.lit(False))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.every(shaped).alias("shape_ok"), F.every(finite).alias("signals_finite"), F.every(F.coalesce(numbers(F.col(target).cast("double")), F.lit(False))).alias("target_finite"), F.min(target).alias("target_min"), F.max(target).alias("target_max"))
