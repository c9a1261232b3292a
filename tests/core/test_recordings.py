import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.functions import kernels as K
from vitalspark.functions import signals as S
from vitalspark.operators import evaluate, recordings, splits


def test_skip_reason_order(spark):
    ddl = "id int, s double, er double, eh double, eq double, pr double, ph double, rest boolean, nf double, q double"
    good = (60.0, 1.0, 70.0, 0.9, 5.0, 72.0, True, 1.0, 0.5)
    rows = [(0, *good)]
    for i, change in enumerate([{1: None, 4: None}, {0: 5.0}, {1: 0.01}, {3: 0.1}, {4: None}, {4: 0.5}, {5: 300.0}, {5: 86.0}, {7: 50.0}, {8: 0.01}, {1: None, 2: None, 3: None, 0: None}, {5: 86.0, 6: False}], 1):
        rows.append((i, *[change.get(k, v) for k, v in enumerate(good)]))
    df = spark.createDataFrame(rows, ddl)
    reason = recordings.skip_reason(*[F.col(c) for c in ("s", "er", "eh", "eq", "pr", "ph", "rest", "nf", "q")], 0.1)
    found = {r["id"]: r["reason"] for r in df.select("id", reason.alias("reason")).collect()}
    assert [found[i] for i in range(13)] == ["ok", "no_ecg_no_ppg", "ecg_too_short", "flat_ecg", "ecg_sqi_low", "no_ppg", "flat_ppg", "implausible_hr", "ecg_ppg_hr_mismatch", "no_face", "ensemble_sqi_low", "ok", "ok"]


def test_flags_of_missing_measures(spark):
    df = spark.createDataFrame([(1, 60.0, 100.0, 0.5, [60.0, 90.0]), (2, None, None, None, None)], "id int, s double, b double, q double, r array<double>")
    flags = recordings.usable_flags(F.col("s"), F.col("b"), F.col("q"), F.size("r"), F.array_max("r") - F.array_min("r"), 10.0, 20.0, 235.0, 0.1, 20.0)
    got = {r["id"]: r for r in df.select("id", *[v.alias(k) for k, v in flags.items()]).collect()}
    assert got[1]["usable"] and got[1]["hr_nonstationary"] and not got[1]["ref_complete"]
    assert not got[2]["usable"] and not got[2]["frame_ok"] and got[2]["hr_drift"] is None


def test_trend_and_empty_groups(spark):
    df = spark.createDataFrame([(k, float(i), 2.0 * i + (0.5 if i % 2 else -0.5) * (k == "a")) for k in ("a", "b") for i in range(10 if k == "a" else 3)], "k string, m double, v double")
    got = {r["k"]: r for r in recordings.linear_trend(df, ["k"], F.col("m"), F.col("v")).collect()}
    line = np.polyfit(range(10), [2.0 * i + (0.5 if i % 2 else -0.5) for i in range(10)], 1)
    rest = np.std([2.0 * i + (0.5 if i % 2 else -0.5) - np.polyval(line, i) for i in range(10)])
    assert np.isclose(got["a"]["slope"], line[0]) and np.isclose(got["a"]["residual_sd"], rest) and got["b"]["slope"] is None
    assert recordings.linear_trend(df.limit(0), ["k"], F.col("m"), F.col("v")).count() == 0


def test_weights_keep_null_groups(spark):
    rows = spark.createDataFrame([("a", 50.0)] * 3 + [(None, 130.0)], "g string, t double")
    got = splits.with_sampling_weights(rows, "g", F.col("t"), 0.5, 2.0, 1.5, F.col("g") == "a", 1.2).collect()
    assert sorted((round(r["balanced"], 4), round(r["weight"], 4)) for r in got) == [(0.3333, round((4 / 3) ** 0.5 * 1.2, 4))] * 3 + [(1.0, round(2.0 * 3.0, 4))]


def test_shuffled_rank_is_a_permutation(spark):
    rows = spark.range(500).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("replica"))
    got = evaluate.shuffled_rank(rows, 3).collect()
    for replica in (0, 1):
        own = sorted((r["k"], r["id"]) for r in got if r["replica"] == replica)
        assert [k for k, _ in own] == list(range(1, 501)) and [i for _, i in own] != list(range(500))


def test_mean_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), (None, 5.0), ("a", None)], "g string, v double")
    got = sorted((str(r["g"]), str(r["v"]), r["rank"]) for r in evaluate.with_mean_rank(df, ["g"], "v", "rank").collect() if r["rank"])
    assert got == [("None", "5.0", 1.0), ("a", "1.0", 1.0), ("a", "3.0", 2.5), ("a", "3.0", 2.5)]


def test_losses(spark):
    t = np.arange(64) / 8.0
    x = np.sin(2 * np.pi * 1.5 * t)
    df = spark.createDataFrame([(1, x.tolist(), 90.0), (2, x.tolist(), 60.0), (3, None, 60.0), (4, x.tolist(), None)], "id int, x array<double>, bpm double")
    got = {r["id"]: r for r in df.select("id", K.snr(F.col("x"), F.col("bpm"), 8.0).alias("snr"), S.pearson_loss(F.col("x"), F.col("x")).alias("p"), K.spectral_distance(F.col("x"), F.col("x"), 8.0).alias("d")).collect()}
    assert got[1]["snr"] == 30.0 and got[2]["snr"] == -30.0 and got[3]["snr"] is None and got[4]["snr"] is None
    assert got[1]["p"] == pytest.approx(0, abs=1e-6) and got[1]["d"] == 0 and got[3]["d"] is None
