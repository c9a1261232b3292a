"""Rules: ordered conditions that accept, reject and label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as S


def first_failure(checks: dict[str, Column], otherwise: str = "ok") -> Column:
    """The name of the first condition that holds."""
    names = list(checks)
    return reduce(lambda c, n: c.when(checks[n], n), names[1:], F.when(checks[names[0]], names[0])).otherwise(otherwise)


def stability(range_bpm: Column) -> Column:
    """Bucket of the range of a window's labels."""
    return F.when(range_bpm.isNull(), "unknown").when(range_bpm < 10, "stable_lt_10_bpm").when(range_bpm < 25, "moderate_10_25_bpm").when(range_bpm < 50, "unstable_25_50_bpm").otherwise("highly_unstable_ge_50_bpm")


def window_policy(dataset: Column, split: Column, target: Column, missing: Column, signal_problem: Column, training: list[str], reserved: list[str]) -> Column:
    """Struct of role, include_in_finetune, include_in_eval and reason of a window; the first rule that applies decides.

    Roles, reasons, bounds of the rate and the share of missing labels are fixed values.
    """

    def say(role: str, finetune: bool, evaluate: bool, reason: Column | str) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(role).alias("window_role"), F.lit(finetune).alias("include_in_finetune"), F.lit(evaluate).alias("include_in_eval"), why.alias("reason"))

    return (
        F.when(target.isNull(), say("excluded", False, False, "missing_target_hr"))
        .when((target < 40) | (target > 180), say("excluded", False, False, "target_hr_out_of_range"))
        .when(missing > 0.10, say("excluded", False, False, "too_many_missing_hr_labels"))
        .when(signal_problem.isNotNull(), say("excluded", False, False, signal_problem))
        .when(dataset.isin(reserved), say("ood_eval", False, True, "ecg_fitness_reserved_as_ood_stress_test"))
        .when(~dataset.isin(training), say("eval_only", False, True, "dataset_not_in_first_finetune_set"))
        .when(split == "train", say("finetune_train", True, True, "eligible_training_window"))
        .when(split == "val", say("finetune_val", False, True, "validation_window"))
        .otherwise(say("finetune_test", False, True, "test_window"))
    )


def quality_gate(bpm: dict[str, Column], sqi: dict[str, Column], least: int = 2, spread: float = 20.0) -> dict[str, Column]:
    """Acceptance of a window by its channels: enough moderate channels whose rates agree.

    The bounds of good and moderate quality, 0.50 and 0.30, are fixed values. Columns: n_good,
    n_moderate, spread, accepted, confidence, reasons, and the three consensus rates: mean and
    median of all finite channels and median of the supported ones.
    """
    good = sum((F.coalesce((s >= 0.50).cast("int"), F.lit(0)) for s in sqi.values()), F.lit(0))
    moderate = sum((F.coalesce((s >= 0.30).cast("int"), F.lit(0)) for s in sqi.values()), F.lit(0))
    supported = F.array_compact(F.array(*[F.when(sqi[c] >= 0.30, S.finite(bpm[c])) for c in bpm]))
    valid = F.array_compact(F.array(*[S.finite(b) for b in bpm.values()]))
    gap = F.array_max(supported) - F.array_min(supported)
    enough, close = moderate >= least, F.coalesce(gap <= spread, F.lit(False))
    accepted = enough & close
    why = F.array_compact(F.array(F.when(~enough, "few_supported_channels"), F.when(enough & ~close, "channels_disagree"), F.when(accepted & (good >= 1), "good_channel"), F.when(accepted & (good < 1), "moderate_channels_only")))
    return {
        "n_good": good,
        "n_moderate": moderate,
        "spread": gap,
        "accepted": accepted,
        "confidence": F.when(~accepted, "rejected").when(good >= 1, "good").otherwise("moderate"),
        "reasons": F.array_join(why, ";"),
        "mean_bpm": S.mean(valid),
        "median_bpm": middle(valid),
        "consensus_bpm": middle(supported),
    }


def middle(values: Column) -> Column:
    """Median of a short array; null when empty."""
    ordered, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.try_element_at(ordered, F.floor((n - 1) / 2).cast("int") + 1) + F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2)


def image_quality(saturated: Column, red_saturated: Column, green_saturated: Column, dark: Column, green_mean: Column, channel_range: Column) -> dict[str, Column]:
    """Status of a region's pixels and its reasons; warnings are looked at only when nothing rejects.

    Shares of pixels with a channel of at least 250 or at most 10, the mean of green, and the
    range of the channel means. Thresholds are fixed values.
    """
    rejects = {"saturated": saturated >= 0.10, "red_saturated": red_saturated >= 0.30, "green_saturated": green_saturated >= 0.20, "dark": dark >= 0.20, "green_very_low": green_mean < 20}
    warns = {"some_saturated": saturated >= 0.02, "red_risk": red_saturated >= 0.05, "green_low": green_mean < 40, "green_high": green_mean > 220, "some_dark": dark >= 0.05, "imbalance": channel_range > 120}
    listed = lambda checks: F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))
    bad, odd = listed(rejects), listed(warns)
    reasons = F.when(F.size(bad) > 0, bad).otherwise(odd)
    return {"status": F.when(F.size(bad) > 0, "reject").when(F.size(odd) > 0, "warning").otherwise("ok"), "reasons": F.array_join(reasons, ";")}


def readiness(samples: Column, fps: Column, accepted: Column, model: Column, spectral: Column) -> Column:
    """State of a live prediction: waiting, skipped, rejected, unavailable, disagrees or ok."""
    return (
        F.when(samples < 20, "waiting").when(fps.isNull() | (fps < 8), "skipped").when(~accepted, "rejected").when(model.isNull(), "unavailable").when(F.abs(model - spectral) > 10, "disagrees").otherwise("ok")
    )


def agreement_band(model: Column, spectral: Column) -> Column:
    gap = F.abs(model - spectral)
    return F.when(gap.isNull(), "unknown").when(gap <= 5, "close").when(gap <= 10, "near").otherwise("apart")


def range_violations(df: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Long list of values outside the plausible range of their biomarker: keys, biomarker, value, low, high."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("biomarker"), F.col(n).cast("double").alias("value"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, (a, b) in ranges.items()]))
    return df.select(*keys, rows.alias("r")).select(*keys, "r.*").where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def biomarker_map(values: dict[str, Column], tiers: dict[str, int]) -> Column:
    """A map from name to value and tier; a biomarker without a tier has none."""
    return F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.struct(v.cast("double").alias("value"), F.lit(tiers.get(n)).cast("int").alias("tier")))])


def flagged(biomarkers: Column, ranges: dict[str, tuple[float, float]]) -> Column:
    """The map with `valid` beside value and tier: inside the range of its name, both ends included.

    A null or non-finite value isn't valid, nor is a name without a range; a null entry stays null, and so does a null map.
    """
    bounds = F.create_map(*[x for n, (a, b) in ranges.items() for x in (F.lit(n), F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")))])
    inside = lambda n, v: F.coalesce((v["value"] >= bounds[n]["low"]) & (v["value"] <= bounds[n]["high"]) & ~F.isnan(v["value"]), F.lit(False))
    return F.transform_values(biomarkers, lambda n, v: F.when(v.isNotNull(), F.struct(v["value"].alias("value"), v["tier"].alias("tier"), inside(n, v).alias("valid"))))


def flags_long(df: DataFrame, keys: list[str], biomarkers: str) -> DataFrame:
    """A row a key and biomarker of flagged maps: biomarker, value, tier, valid; empty and null maps give none."""
    return df.select(*keys, F.explode(biomarkers).alias("biomarker", "b")).select(*keys, "biomarker", "b.value", "b.tier", "b.valid")


def flags_wide(df: DataFrame, keys: list[str], biomarkers: str, names: list[str]) -> DataFrame:
    """A row a key: the value of each name and its flag <name>_valid, false where the map lacks it."""
    held = lambda n: F.try_element_at(F.col(biomarkers), F.lit(n))
    return df.select(*keys, *[c for n in names for c in (held(n)["value"].alias(n), F.coalesce(held(n)["valid"], F.lit(False)).alias(f"{n}_valid"))])


def training_gate(missing: Column, label: Column, channels: dict[str, Column], most_missing: float = 0.10, low: float = 40.0, high: float = 180.0) -> Column:
    """Why a training window is left out, first failure first, or ok: labels missing or implausible, a channel with gaps or flat."""
    checks = {"missing_labels": F.coalesce(missing > most_missing, F.lit(True)), "label_out_of_range": ~F.coalesce(label.between(low, high), F.lit(False))}
    for name, signal in channels.items():
        problem = S.validity(signal)
        checks |= {f"{name}_gaps": problem.isin("missing", "nan"), f"{name}_flat": problem == "flat"}
    return first_failure({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})


def passes(checks: dict[str, Column]) -> dict[str, Column]:
    """A column passes_<name> for every gate, and passes_all; an unknown value doesn't pass."""
    made = {f"passes_{name}": F.coalesce(c, F.lit(False)) for name, c in checks.items()}
    return made | {"passes_all": reduce(lambda a, b: a & b, made.values())}


def region_rollup(statuses: Column) -> dict[str, Column]:
    """Counts of a frame's regions by status and the status of all: a warning as soon as one region isn't ok."""
    number = lambda status: F.size(F.filter(statuses, lambda x: x == status))
    counts = {s: number(s) for s in ("ok", "warning", "reject")}
    return {f"{s}_regions": n for s, n in counts.items()} | {"overall": F.when((counts["warning"] > 0) | (counts["reject"] > 0), "warning").otherwise("ok")}


def trainable(df: DataFrame, least_quality: float = 0.05, clip: int = 160) -> DataFrame:
    """Recordings of a training index: usable, of some quality, at least a clip long; an unstated flag counts as usable."""
    return df.where(F.coalesce("usable", F.lit(True)) & (F.coalesce("cardiac_sqi", F.lit(0.0)) >= least_quality) & (F.col("n_frames") >= clip))


def valid_targets(ranges: dict[str, tuple[float, float]]) -> Column:
    """Are all targets numbers inside their ranges?"""
    inside = [F.coalesce(S.finite(F.col(c)).between(a, b), F.lit(False)) for c, (a, b) in ranges.items()]
    return reduce(lambda a, b: a & b, inside)


def evaluation_rows(df: DataFrame, mode: str, datasets: list[str] | None = None) -> DataFrame:
    """Rows of one preprocessing mode that went well and have both values; datasets: those to keep, or all."""
    kept = df.where((F.col("preprocessing_status") == "ok") & (F.col("preprocessing_mode") == mode) & S.finite(F.col("model_hr")).isNotNull() & S.finite(F.col("target_hr_mean")).isNotNull())
    return kept if datasets is None else kept.where(F.col("dataset").isin(datasets))


def detection_agreement(difference: Column) -> Column:
    """How well a detected rate agrees with a device's: good under 5 bpm, moderate under 10."""
    return F.when(difference.isNull(), "unknown").when(F.abs(difference) < 5, "good").when(F.abs(difference) < 10, "moderate").otherwise("large")


def region_box(face: dict[str, Column], x: tuple[float, float], y: tuple[float, float], width: Column, height: Column) -> dict[str, Column]:
    """Pixel box of a region given by shares of the face's box, rounded half to even and kept inside the image."""
    place = lambda start, size, share, least, most: F.greatest(F.lit(least), F.least(face[start] + F.bround(face[size] * share).cast("int"), most))
    x0, x1 = place("x_min", "width", x[0], 0, width - 1), place("x_min", "width", x[1], 0, width)
    y0, y1 = place("y_min", "height", y[0], 0, height - 1), place("y_min", "height", y[1], 0, height)
    w, h = F.greatest(F.lit(0), x1 - x0), F.greatest(F.lit(0), y1 - y0)
    return {"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1, "width": w, "height": h, "area_fraction": F.try_divide((w * h).cast("double"), (width * height).cast("double"))}


#: Shares of the face's box that each region takes, across and down.
REGION_SHARES = {"forehead": ((0.30, 0.70), (0.06, 0.22)), "image_left_cheek": ((0.10, 0.34), (0.40, 0.62)), "image_right_cheek": ((0.66, 0.90), (0.40, 0.62))}


def landmark_box(landmarks: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Pixel box around landmarks given as shares x and y of the image, one row a key."""
    ends = {f"{axis}_{end}": F.greatest(F.lit(0.0), F.least(f(F.col(axis) * size), F.lit(size - 1.0))) for axis, size in (("x", width), ("y", height)) for end, f in (("min", F.min), ("max", F.max))}
    found = landmarks.groupBy(*keys).agg(F.count(F.lit(1)).alias("landmarks"), *[c.alias(k) for k, c in ends.items()])
    size = lambda axis: F.greatest(F.lit(0.0), F.col(f"{axis}_max") - F.col(f"{axis}_min"))
    whole = lambda c: F.bround(c).cast("int")
    return found.select(*keys, "landmarks", *[whole(F.col(k)).alias(k) for k in ends], whole(size("x")).alias("width"), whole(size("y")).alias("height"), (size("x") * size("y") / (width * height)).alias("area_fraction"))


def frame_statistics(pixels: DataFrame, keys: list[str], box: Column | None = None) -> DataFrame:
    """Means, deviations and extremes of r, g and b over a frame's pixels, those inside `box` if it is given; their mean is the brightness."""
    inside = pixels if box is None else pixels.where(box)
    found = [f(c).alias(f"{c}_{name}") for c in "rgb" for name, f in (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))]
    summed = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), *found)
    return summed.withColumn("brightness", (F.col("r_mean") + F.col("g_mean") + F.col("b_mean")) / 3)


def centre_box(x: Column, y: Column, width: int, height: int, share: float = 0.3) -> Column:
    """Is a pixel in the central part of the frame?"""
    low, high = 0.5 - share / 2, 0.5 + share / 2
    return (x >= int(width * low)) & (x < int(width * high)) & (y >= int(height * low)) & (y < int(height * high))
