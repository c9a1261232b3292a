"""Recordings and clips as a whole: skip reasons, usable flags, corpus checks, trends, balanced splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import full_evaluation, rate
from .quantiles import joined, quantiles, with_quantiles
from .rules import first_failure

#: Gates of a recording. Seconds, signal ranges, quality, bpm, percent of frames without a face.
SHORT_S, FLAT_ECG, FLAT_PPG, ECG_QUALITY, HR_LOW, HR_HIGH, NO_FACE = 10.0, 0.05, 1.0, 0.5, 40.0, 200.0, 20.0
#: Most bpm between the two references, at rest and after exercise.
MISMATCH_REST, MISMATCH_EXERCISE = 15.0, 20.0
#: Weights of a split's differences from training in rates of high and of very high targets; bpm and rows that count 1.
HIGH_WEIGHT, TACHY_WEIGHT, BPM_SCALE, ROW_SCALE, SUBJECT_WEIGHT = 4.0, 6.0, 20.0, 100.0, 2.0


def skip_reason(ecg_seconds: Column, ecg_range: Column, ecg_hr: Column, ecg_quality: Column, ppg_range: Column, ppg_hr: Column, rest: Column, no_face: Column, quality: Column, least_quality: float) -> Column:
    """Why a recording is skipped, first failure first, or ok. A null range says that the signal is absent.

    ecg_quality counts only where its rate could be told; the rates are compared only where both are known.
    """
    limit = F.when(rest, MISMATCH_REST).otherwise(MISMATCH_EXERCISE)
    return first_failure(
        {
            "no_ecg_no_ppg": ecg_range.isNull() & ppg_range.isNull(),
            "ecg_too_short": ecg_range.isNotNull() & (ecg_seconds < SHORT_S),
            "flat_ecg": ecg_range < FLAT_ECG,
            "ecg_sqi_low": ecg_hr.isNotNull() & (ecg_quality < ECG_QUALITY),
            "no_ppg": ppg_range.isNull(),
            "flat_ppg": ppg_range < FLAT_PPG,
            "implausible_hr": ppg_hr.isNull() | (ppg_hr < HR_LOW) | (ppg_hr > HR_HIGH),
            "ecg_ppg_hr_mismatch": F.abs(ecg_hr - ppg_hr) > limit,
            "no_face": no_face > NO_FACE,
            "ensemble_sqi_low": quality < least_quality,
        }
    )


def usable_flags(seconds: Column, brightness: Column, quality: Column, rates: Column, spread: Column, least_seconds: float, dark: float, bright: float, least_quality: float, drift: float) -> dict[str, Column]:
    """frame_ok, hr_drift, hr_nonstationary, ref_complete and usable; rates and spread: how many reference rates a recording has, and their range."""
    moved = F.when(rates > 1, spread)
    frame_ok = F.coalesce(brightness.between(dark, bright), F.lit(False))
    return {
        "hr_drift": moved,
        "hr_nonstationary": F.coalesce(moved > drift, F.lit(False)),
        "ref_complete": rates >= seconds * 0.9,
        "frame_ok": frame_ok,
        "usable": F.coalesce((seconds >= least_seconds) & frame_ok & (quality >= least_quality), F.lit(False)),
    }


def sentinel_report(rows: DataFrame, keys: list[str], sentinels: dict[str, float]) -> DataFrame:
    """Share of values that are known, by column, and share of rows where every column holds its sentinel."""
    gone = {c: F.col(c).isNull() | (F.col(c) == s) for c, s in sentinels.items()}
    every = F.lit(True)
    for c, s in sentinels.items():
        every = every & F.coalesce(F.col(c) == s, F.lit(False))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[rate(~g).alias(f"{c}_valid") for c, g in gone.items()], rate(every).alias("all_sentinel"))


def corpus_validation(recordings: DataFrame, state: str, values: list[str]) -> DataFrame:
    """Per state: recordings, subjects and each value's mean, spread (n - 1), least and most."""
    made = [f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return recordings.groupBy(state).agg(F.count(F.lit(1)).alias("recordings"), F.count_distinct("subject").alias("subjects"), *made)


def complete_subjects(recordings: DataFrame, state: str, states: list[str]) -> DataFrame:
    """Subjects, and those of them that have every state; one row."""
    seen = recordings.groupBy("subject").agg(F.count_distinct(F.when(F.col(state).isin(states), F.col(state))).alias("n"))
    return seen.agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("n") == len(states)).alias("complete"))


def linear_trend(samples: DataFrame, keys: list[str], minutes: Column, value: Column, least: int = 8) -> DataFrame:
    """Slope a minute and spread about the line; null under `least` samples."""
    found = samples.select(*keys, minutes.alias("m"), value.alias("v")).groupBy(*keys).agg(F.count("v").alias("n"), F.regr_slope("v", "m").alias("slope"), F.var_pop("v").alias("s"), F.regr_r2("v", "m").alias("r2"))
    enough = F.col("n") >= least
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("s") * (1 - F.col("r2"))))
    return found.select(*keys, "n", F.when(enough, F.col("slope")).alias("slope"), F.when(enough, residual).alias("residual_sd"))


def aperture_dynamics(frames: DataFrame, keys: list[str], aperture: str, least: int = 30) -> DataFrame:
    """Spread, mean and p90 - p10 of the lip aperture, and the share of frames with a face; null under `least` hits."""
    found = frames.groupBy(*keys).agg(F.count(aperture).alias("hits"), rate(F.col(aperture).isNotNull()).alias("detected"), F.stddev_pop(aperture).alias("sd"), F.avg(aperture).alias("mean"), (F.percentile(aperture, F.lit(0.9)) - F.percentile(aperture, F.lit(0.1))).alias("range"))
    return found.withColumns({c: F.when(F.col("hits") >= least, F.col(c)) for c in ("sd", "mean", "range")})


def by_threshold(errors: DataFrame, quality: str, thresholds: list[float], keys: list[str]) -> DataFrame:
    """Metrics of the clips at or above each quality threshold; a row reaches only the thresholds it passes."""
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(quality))
    return full_evaluation(errors.withColumn("threshold", F.explode(passed)), [*keys, "threshold"])


def acquisition(samples: DataFrame, keys: list[str], timings: list[str], status: str) -> DataFrame:
    """Mean, least and most of each timing and a map of the counts of each status."""
    each = samples.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(status, F.lit("unknown")).alias("status"), "n")))).alias("statuses"))
    means = samples.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("samples"), *[f(c).alias(f"{c}_{n}") for c in timings for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    return each.join(means, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])


#: Parts of a split by their shares, in order.
PARTS = ("train", "val", "test")


def target_histogram(rows: DataFrame, subject: str) -> DataFrame:
    """subject, target, __times: how often each subject has each target. Made once for all candidates; null targets are kept."""
    return rows.groupBy(F.col(subject).alias("subject"), F.col("target").cast("double").alias("target")).agg(F.count(F.lit(1)).alias("__times"))


def dealt_subjects(subjects: DataFrame, candidates: int, shares: tuple[float, float]) -> DataFrame:
    """subject, candidate, role: each candidate deals every subject by the hash of its name and the candidate's number."""
    every = subjects.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(candidates))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("subject").cast("string"), F.col("candidate").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return every.select("subject", "candidate", F.when(u < shares[0], PARTS[0]).when(u < shares[1], PARTS[1]).otherwise(PARTS[2]).alias("role"))


def split_balance(rows: DataFrame, subject: str, candidates: int, wanted: tuple[int, int], shares: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """Score of every random split of the subjects, least first: how far validation and test stand from training.

    rows: subject, target. wanted: subjects of validation and of test. Rows are read once, into each
    subject's histogram of targets: candidates multiply subjects and their distinct targets, not
    rows. The sums of a subject are merged by (candidate, role), and so are the histograms, for the
    exact p90. A null subject is a subject; null targets count as rows alone.
    """
    histogram = target_histogram(rows, subject)
    t, n = F.col("target"), F.col("__times")
    some = F.when(t.isNotNull(), n).otherwise(0)
    of = lambda c: F.sum(F.when(c, n).otherwise(0))
    totals = histogram.groupBy("subject").agg(F.sum(n).alias("rows"), F.sum(some).alias("known"), F.sum(t * n).alias("whole"), of(t >= 100).alias("high"), of(t >= 120).alias("tachy"))
    dealt = dealt_subjects(totals, candidates, shares)
    merged = joined(dealt, totals, ["subject"]).groupBy("candidate", "role").agg(F.count("rows").alias("subjects"), *[F.sum(c).alias(c) for c in ("rows", "known", "whole", "high", "tachy")])
    parts = merged.select("candidate", "role", "rows", "subjects", *[F.try_divide(c, F.col("known")).alias(m) for c, m in ((F.col("whole"), "mean"), (F.col("high"), "high"), (F.col("tachy"), "tachy"))])
    spread = joined(histogram, dealt, ["subject"]).groupBy("candidate", "role", "target").agg(F.sum("__times").alias("__times"))
    parts = with_quantiles(parts, spread, ["candidate", "role"], {"p90": (t, 0.9)})
    measures = ["rows", "subjects", "mean", "p90", "high", "tachy"]
    wide = parts.groupBy("candidate").agg(*[F.max(F.when(F.col("role") == r, F.col(m))).alias(f"{r}_{m}") for r in PARTS for m in measures])
    gap = lambda r, m: F.abs(F.col(f"{r}_{m}") - F.col(f"train_{m}"))
    score = F.abs(F.col("val_rows") - F.col("test_rows")) / ROW_SCALE
    for r, k in zip(PARTS[1:], wanted, strict=True):
        score = score + gap(r, "high") * HIGH_WEIGHT + gap(r, "tachy") * TACHY_WEIGHT + (gap(r, "p90") + gap(r, "mean")) / BPM_SCALE + F.abs(F.col(f"{r}_subjects") - k) * SUBJECT_WEIGHT
    return wide.select("candidate", "train_subjects", "val_subjects", "test_subjects", score.alias("score"))


def best_split(rows: DataFrame, subject: str, candidates: int, wanted: tuple[int, int], shares: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """subject, role, candidate and score of the best of the random splits, the lower number of equals; candidates that leave a part empty don't count.

    Two steps: scores by candidate, of which one row is taken; then the subjects dealt by it.
    """
    scores = split_balance(rows, subject, candidates, wanted, shares).where("score is not null")
    best = scores.orderBy("score", "candidate").limit(1).select("candidate", "score")
    dealt = dealt_subjects(rows.select(F.col(subject).alias("subject")).distinct(), candidates, shares)
    return dealt.join(F.broadcast(best), "candidate").select("subject", "role", "candidate", "score")


def baseline_report(rows: DataFrame, keys: list[str], train: Column) -> DataFrame:
    """Test MAE of predictions and of always saying the training mean, per target."""
    means = rows.where(train).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.avg("target").alias("train_mean"))
    tested = rows.where(~train).join(means, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    found = tested.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"), F.avg(F.abs(F.col("train_mean") - F.col("target"))).alias("baseline_mae"))
    return found.withColumn("beats_baseline", F.col("mae") < F.col("baseline_mae"))


def median_ranks(rows: DataFrame, group: str, measure: str, value: str) -> DataFrame:
    """Rank of each group by its median of a value, within a measure."""
    medians = quantiles(rows, [measure, group], F.col(value), {"median": 0.5})
    return medians.withColumn("rank", F.rank().over(Window.partitionBy(measure).orderBy("median")))
