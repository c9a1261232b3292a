import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.functions import kernels as K
from vitalspark.functions import rates
from vitalspark.queries import rates as queries


def wave(hz, fps, seconds, phase=0.0):
    return np.sin(2 * np.pi * hz * np.arange(int(fps * seconds)) / fps + phase)


def test_cardiac_rate_and_guards():
    x = np.stack([wave(1.25, 30, 10), np.ones(300)])
    made = rates.cardiac(x, 30.0)
    assert made["bpm"][0] == pytest.approx(75, abs=3) and made["sqi"][0] > 0.8 and np.isnan(made["bpm"][1]) and made["sqi"][1] == 0
    assert np.isnan(rates.cardiac(x[:, :15], 30.0)["bpm"]).all()


def test_welch_statistics_of_a_tone():
    rng = np.random.default_rng(1)
    x = (wave(1.2, 30, 60) + 0.1 * rng.standard_normal(1800))[None, :]
    made = rates.band_statistics(x, 30.0, 600, 0.7, 3.5)
    assert made["peak"][0] == pytest.approx(1.2, abs=0.05) and made["snr"][0] > 50 and not made["at_edge"][0]
    assert rates.band_statistics(x, 30.0, 600, 1.195, 3.5)["at_edge"][0]
    assert rates.snr_at(x, np.array([1.2]), 30.0, 600)[0] > 50 > rates.snr_at(x, np.array([3.0]), 30.0, 600)[0]


def test_comb_finds_the_absent_fundamental():
    x = (wave(0.5, 30, 150) + 0.8 * wave(0.75, 30, 150))[None, :]
    made = rates.comb(x, 30.0, 4500)
    assert made["per_minute"][0] == pytest.approx(15, abs=0.7)


def test_knee_lies_under_the_plateau():
    rng = np.random.default_rng(2)
    flat = K.highpass(rng.standard_normal((1, 4500)), 30.0, 0.4, 4)
    found = rates.knee(flat, 30.0, 1500)
    assert 0.05 < found["knee"][0] < 0.4 < found["plateau"][0]


def test_rates_from_peaks():
    x = wave(1.2, 30, 20)[None, :]
    assert rates.counted(x, 30.0, 0.7, 3.5)["per_minute"][0] == pytest.approx(72, abs=1)
    t = np.arange(0, 20, 1 / 250)
    ecg = np.exp(-(((t % 0.8) - 0.4) ** 2) / 0.0002)
    made = rates.beats(np.stack([ecg, -ecg]), 250.0)
    assert made["polarity_bpm"] == pytest.approx([75, 75], abs=1) and made["energy_bpm"] == pytest.approx([75, 75], abs=1)
    assert np.isnan(rates.counted(x[:, :20], 30.0, 0.7, 3.5)["per_minute"][0])


def test_breathing():
    x = wave(0.25, 50, 60)[None, :]
    made = rates.breathing(x, 50.0)
    assert made["spectral_per_minute"][0] == pytest.approx(15, abs=1) and made["lag_per_minute"][0] == pytest.approx(15, abs=1) and made["quality"][0] > 0.8
    flat = rates.breathing(np.zeros((1, 3000)), 50.0)
    assert np.isnan(flat["lag_per_minute"][0]) and flat["quality"][0] == 0
    share = rates.breathing_share(x, 50.0)
    assert share["per_minute"][0] == pytest.approx(15, abs=1) and share["share"][0] > 0.9
    slow = rates.slow_peak(x[:, :1500] + np.linspace(0, 5, 1500), 50.0, 0.15, 0.5)
    assert slow["per_minute"][0] == pytest.approx(15, abs=2) and slow["flat_share"][0] == pytest.approx(3 / 11) and slow["lowest_hz"][0] == pytest.approx(1 / 6, abs=0.01)


def test_functions_on_tables(spark):
    rows = [(1, wave(1.2, 30, 10).tolist()), (2, None), (3, [1.0, 2.0]), (4, [5.0] * 300)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    made = {r["id"]: r["m"] for r in df.select("id", rates.measured(rates.cardiac, "bpm double, sqi double", 30.0)(F.col("x")).alias("m")).collect()}
    assert made[1]["bpm"] == pytest.approx(72, abs=3) and made[2]["bpm"] is None and made[3]["bpm"] is None and made[4]["sqi"] == 0
    recoil = {r["id"]: r["y"] for r in df.select("id", rates.motion(F.col("x"), 30.0, rates.MOTION).alias("y")).collect()}
    assert np.std(recoil[1]) == pytest.approx(1, abs=1e-6) and recoil[2] is None and recoil[3] is None


def test_buffers_converge_to_the_full_signal(spark, tmp_path):
    rng = np.random.default_rng(3)
    spark.createDataFrame([(i, rng.standard_normal(64).tolist(), i % 3) for i in range(30)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["buffer"]: r["pos_r"] for r in queries.registry.queries["buffer_sweep"](spark, str(tmp_path)).collect()}
    assert found[64] == pytest.approx(1) and found[32] < found[48] < 1
