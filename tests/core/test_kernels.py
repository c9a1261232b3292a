import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.functions import kernels as K
from vitalspark.functions import signals as S


def tone(bpm, fps, seconds, phase=0.0):
    t = np.arange(int(fps * seconds)) / fps
    return np.sin(2 * np.pi * bpm / 60 * t + phase)


@pytest.mark.parametrize("bpm", range(55, 101, 5))
@pytest.mark.parametrize("seconds", (8, 12, 15, 30))
def test_tones_are_found(bpm, seconds):
    rng = np.random.default_rng(bpm)
    x = tone(bpm, 17.6, seconds) + 0.05 * rng.standard_normal(int(17.6 * seconds))
    found, sqi, _ = K.spectral_quality(x[None, :], 17.6)
    assert abs(found[0] - bpm) < 2 and sqi[0] > 0.5


def test_flat_short_and_impossible_signals_are_invalid():
    for x, fps in ((np.zeros((1, 64)), 8.0), (np.ones((1, 3)), 8.0), (np.ones((1, 64)), 0.0), (np.ones((1, 64)), 0.1)):
        bpm, sqi, peak = K.spectral_quality(x, fps)
        assert np.isnan(bpm[0]) and np.isnan(sqi[0]) and peak[0] == -1


@pytest.mark.parametrize("fps", (8.0, 29.97, 30.0))
def test_butterworth_edges_lose_three_decibels(fps):
    b, a = K.butterworth(4, 0.7, 3.5, fps)
    for f in (0.7, 3.5):
        z = np.exp(-2j * np.pi * f / fps * np.arange(len(b)))
        assert abs((b @ z) / (a @ z)) == pytest.approx(0.5**0.5, abs=1e-6)
    z = np.exp(-2j * np.pi * 1.5652 / fps * np.arange(len(b)))
    assert abs((b @ z) / (a @ z)) == pytest.approx(1.0, abs=1e-3)


def test_bandpass_keeps_the_band_in_phase():
    x = tone(72, 30, 20)
    y = K.bandpass((x + 5 + 2 * tone(6, 30, 20))[None, :], 30.0)[0]
    assert np.corrcoef(x[100:-100], y[100:-100])[0, 1] > 0.999
    assert np.isnan(K.bandpass(x[None, :20], 30.0)).all() and np.isnan(K.bandpass(x[None, :], 6.0)).all()
    assert abs(K.highpass((x + 5)[None, :], 30.0, 0.1)[0, 200:-200].mean()) < 0.05


def test_resampling():
    x = tone(75, 8, 8)
    y = K.fourier_resample(x[None, :], 240)[0]
    assert np.abs(y - np.sin(2 * np.pi * 1.25 * np.arange(240) / 30)).max() < 1e-9
    assert np.allclose(K.fourier_resample(y[None, :], 64)[0], x)
    z = K.polyphase_resample(tone(60, 50, 10)[None, :], 3, 5, 300)[0]
    assert np.abs(z[30:-30] - tone(60, 30, 10)[30:-30]).max() < 0.02


def test_envelope_welch_and_peaks():
    t = np.arange(600) / 30
    x = (1 + 0.5 * np.sin(2 * np.pi * 0.25 * t)) * np.sin(2 * np.pi * 1.2 * t)
    bpm, _, _ = K.spectral_quality(K.analytic_envelope(x[None, :]), 30.0, low=0.1, high=0.5)
    assert abs(bpm[0] - 15) < 1
    f, p = K.welch(x[None, :], 30.0, 256)
    assert abs(f[p[0].argmax()] - 1.2) < 0.15
    peaks = K.find_peaks(tone(72, 30, 10), distance=10, height=0.5, prominence=0.5)
    assert len(peaks) == 12 and np.diff(peaks).min() >= 24
    power = K.hann_power((tone(60, 30, 8) + 0.6 * tone(90, 30, 8))[None, :])[0]
    assert [round(b) for b, _ in K.top_peaks(power, np.fft.rfftfreq(240, 1 / 30), count=2)] == [60, 90]
    rate, quality = K.respiration_quality(tone(15, 10, 60), 10.0)
    assert abs(rate - 15) < 0.5 and quality > 0.8


def colour(bpm, fps=30, seconds=8, regions=3):
    p = tone(bpm, fps, seconds)
    base = np.stack([100 + 1.8 * p, 105 + 3 * p, 95 + 1.2 * p], axis=-1)
    return np.stack([base + 0.25 * k for k in range(regions)])[None]


def test_pulse_signals_follow_the_pulse():
    for made in (K.live_signals(colour(72)), K.training_signals(colour(72), 30.0)):
        for name, x in made.items():
            bpm, sqi, _ = K.spectral_quality(x, 30.0)
            assert abs(bpm[0] - 72) < 2 and sqi[0] > 0.5, name
    assert (K.live_signals(np.full((1, 3, 100, 3), 90.0))["green"] == 0).all()
    rgb = colour(72)[0, 0]
    rgb[10:13] = np.nan
    bpm, _, _ = K.spectral_quality(K.overlap_add_pos(rgb, 30.0)[None, :], 30.0)
    assert abs(bpm[0] - 72) < 3


def test_column_functions_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(50)
    y = np.roll(x, -5)
    df = spark.createDataFrame([(x.tolist(), [3.0] * 50, [None, 1.0])], "x array<double>, flat array<double>, gap array<double>")
    c = F.col("x")
    row = df.select(
        S.zscore(c).alias("z"), S.zscore(F.col("flat"), "padded").alias("f"), S.resampled(c, 120).alias("r"), S.correlation(c, S.rotated(c, 5)).alias("c"), S.correlation(c, F.col("flat")).alias("none"), S.moving_average(c, 2).alias("m"),
        S.max_jump(c).alias("j"), S.autocorrelation_quality(c, F.lit(60.0), 8.0).alias("a"), S.validity(F.col("gap")).alias("v1"), S.validity(F.col("flat")).alias("v2"), S.validity(c).alias("v3"), S.ensemble([c, F.col("flat")], [F.lit(0.5), F.lit(0.0)])[0].alias("e"),
        S.simulated_frames(F.lit(30), F.lit(90), F.lit(30.0), 7.5).alias("s"), S.mean_of([c, c]).alias("mean"),
    ).first()
    assert row["z"] == pytest.approx(((x - x.mean()) / x.std()).tolist())
    assert row["f"] == [0.0] * 50 and row["none"] is None
    assert row["r"] == pytest.approx(np.interp(np.linspace(0, 49, 120), np.arange(50), x).tolist())
    assert row["c"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert row["m"] == pytest.approx([x[max(0, i - 2) : i + 3].mean() for i in range(50)])
    assert row["j"] == pytest.approx(np.abs(np.diff(x)).max() / np.median(np.abs(np.diff(x))))
    d = x - x.mean()
    assert row["a"] == pytest.approx(min(1, max(0, (d[:-8] * d[8:]).sum() / (d * d).sum())))
    assert (row["v1"], row["v2"], row["v3"]) == ("nan", "flat", None)
    assert row["e"] == pytest.approx((x * 0.5 / 0.51 + 3 * 0.01 / 0.51).tolist()) and row["mean"] == pytest.approx(x.tolist())
    times = np.append(np.arange(1.0, 3.0, 1 / 7.5), 3.0 - 1 / 30)  # the last sample leaves more than 0.75 steps
    assert row["s"] == sorted({int(min(89, max(30, np.rint(t * 30)))) for t in times})
