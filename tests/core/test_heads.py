"""Fitted heads against NumPy, and the peaks nearest to a rate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.plans import heads, live
from vitalspark.sources import readers


def test_a_head_is_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * (1, 10, 0.1) + (5, -3, 0)
    y = x @ (2.0, -0.5, 7.0) + 4 + rng.normal(size=200)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    head = heads.fit(df, ["a", "b", "c"], "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0]
    assert (*head.weights, head.bias) == pytest.approx(want.tolist(), rel=1e-8)
    found = [r["p"] for r in df.select(head.apply().alias("p")).collect()]
    np.testing.assert_allclose(found[:200], x @ want[:3] + want[3])
    assert found[200] is None and found[201] is None and found[202] is not None
    centred = x - x.mean(axis=0)
    ridge = heads.fit(df, ["a", "b", "c"], "y", ridge=50.0)
    np.testing.assert_allclose(ridge.weights, np.linalg.solve(centred.T @ centred + 50 * np.eye(3), centred.T @ (y - y.mean())))


def test_heads_without_rows_or_with_equal_features(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 4.0), (3.0, 3.0, 6.0)], "a double, b double, y double")
    none = heads.fit(df.where("false"), ["a"], "y")
    assert none.bias is None and df.select(none.apply().alias("p")).where("p is not null").count() == 0
    shared = heads.fit(df, ["a", "b"], "y")
    assert shared.weights == pytest.approx((1.0, 1.0)) and shared.bias == pytest.approx(0, abs=1e-9)
    flat = heads.fit(df.withColumn("a", F.lit(3.0)), ["a"], "y")
    assert flat.weights == pytest.approx((0.0,)) and flat.bias == pytest.approx(4)


def test_comparison_and_peaks(spark):
    tones = readers.tones(spark, [60.0, 72.0, 90.0, 120.0], 8.0, 30.0).withColumn("target", F.when(F.col("bpm") != 90, F.col("bpm")))
    gated = heads.with_gate(tones, 30.0)
    head = heads.fit(gated, ["median_bpm"], "target")
    found = {r["bpm"]: r for r in heads.comparison(gated, ["bpm"], head, "target").collect()}
    assert all(found[b]["direct_hr"] == pytest.approx(b, abs=4) and found[b]["gated_hr"] == found[b]["direct_hr"] and found[b]["spectral_hr"] == pytest.approx(b, abs=4) for b in found)
    assert found[90.0]["direct_error"] is None and found[60.0]["direct_error"] < 4 and found[60.0]["confidence"] == "good"
    far = heads.Head(("median_bpm",), (0.0,), 500.0)
    assert {r["direct_hr"] for r in heads.comparison(gated, ["bpm"], far, "target").collect()} == {180.0}
    noise = gated.withColumns({"accepted": F.lit(False)})
    assert {r["gated_hr"] for r in heads.comparison(noise, ["bpm"], head, "target").collect()} == {None}
    told = heads.peak_table(gated, ["bpm"], 30.0, {"reference": "target", "consensus": "median_bpm"}).collect()
    assert len(told) == 4 * len(live.CHANNELS)
    for r in told:
        assert len(r["peaks"]) >= 1 and (r["reference"] is None) == (r["bpm"] == 90)
        assert r["consensus"]["place"] == 1 and r["consensus"]["bpm"] == pytest.approx(r["bpm"], abs=5) and r["consensus"]["share"] == r["peaks"][0]["share"]
        assert r["consensus"]["distance"] == min(abs(p["bpm"] - (r["consensus"]["bpm"] - r["consensus"]["distance"])) for p in r["peaks"]) or r["consensus"]["distance"] >= 0
