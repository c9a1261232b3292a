"""Rates and quality of whole signals: spectra by Welch, peaks, breathing, motion, and their Arrow functions.

As in `kernels`, a kernel takes a matrix, a row a signal, and never raises; it returns a column of
values for each field of its result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K

#: Fixed values, in Hz: bands of head motion at the heart's rate, of breathing motion, of a QRS complex, of resting breath.
MOTION, BREATH, QRS, RESTING = (0.7, 5.0), (0.1, 0.5), (5.0, 15.0), (0.1, 0.4)
#: Rate that breathing is brought down to, its high-pass, and the grid and tolerance of the comb.
BREATH_FPS, DRIFT, COMB, COMB_REACH = 10.0, 0.08, (0.10, 0.501, 0.005), 0.02


def measured(kernel, ddl: str, *options):
    """An Arrow function from array<double> to a struct of numbers, true or false, and lists of numbers."""
    names = [part.split()[0] for part in ddl.split(", ")]

    @F.pandas_udf(ddl)
    def run(signals: pd.Series) -> pd.DataFrame:
        out = {name: [None] * len(signals) for name in names}
        for rows, x in K._matrices(signals):
            for name, values in kernel(x, *options).items():
                for k, v in zip(rows, values, strict=True):
                    out[name][k] = None if isinstance(v, float) and np.isnan(v) else v
        return pd.DataFrame(out, columns=names)

    return run


def detrended(x: np.ndarray) -> np.ndarray:
    """Rows less their own straight line."""
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    slope = (x @ t) / max((t @ t), 1e-300)
    return x - x.mean(axis=1, keepdims=True) - slope[:, None] * t


def cardiac(x: np.ndarray, fps: float) -> dict[str, np.ndarray]:
    """Rate and quality without refining; no rate and a quality of 0 for under 16 samples, gaps and flat rows."""
    bpm, sqi, _ = K.spectral_quality(x, fps, refine=False, least=0.0)
    bad = ~np.isfinite(x).all(axis=1) | (x.std(axis=1) < 1e-9) | (x.shape[1] < 16) | np.isnan(bpm)
    return {"bpm": np.where(bad, np.nan, bpm).tolist(), "sqi": np.where(bad, 0.0, sqi).tolist()}


def strongest(x: np.ndarray, fps: float, count: int = 3) -> dict[str, list]:
    """The strongest separate peaks of the Hann spectrum, rates and their shares of the band's power."""
    power, freqs = K.hann_power(x), np.fft.rfftfreq(x.shape[1], 1 / fps)
    band = K.band_mask(freqs, K.LOW, K.HIGH)
    found = [K.top_peaks(row, freqs, count=count) for row in power]
    whole = np.maximum(power[:, band].sum(axis=1), 1e-300)
    return {"bpm": [[b for b, _ in f] for f in found], "share": [[p / w for _, p in f] for f, w in zip(found, whole.tolist(), strict=True)]}


def slow_peak(x: np.ndarray, fps: float, low: float, high: float) -> dict[str, list]:
    """Peak of the detrended Hann spectrum in a slow band, a minute, its three-bin share, and what a flat spectrum would give."""
    if x.shape[1] < 8:
        return {k: [float("nan")] * len(x) for k in ("per_minute", "share", "flat_share", "lowest_hz")}
    freqs = np.fft.rfftfreq(x.shape[1], 1 / fps)
    inside, power = np.flatnonzero((freqs >= low) & (freqs <= high)), np.abs(np.fft.rfft(detrended(x) * np.hanning(x.shape[1]), axis=1)) ** 2
    if not len(inside):
        return {k: [float("nan")] * len(x) for k in ("per_minute", "share", "flat_share", "lowest_hz")}
    at = inside[power[:, inside].argmax(axis=1)]
    rows, whole = np.arange(len(x)), power[:, inside].sum(axis=1)
    near = sum(np.where((at + k >= inside[0]) & (at + k <= inside[-1]), power[rows, np.clip(at + k, 0, len(freqs) - 1)], 0.0) for k in (-1, 0, 1))
    share = np.where(whole > 0, near / np.where(whole > 0, whole, 1.0), np.nan)
    return {"per_minute": np.where(whole > 0, freqs[at] * 60, np.nan).tolist(), "share": share.tolist(), "flat_share": [3 / len(inside)] * len(x), "lowest_hz": [float(freqs[inside[0]])] * len(x)}


def density(x: np.ndarray, fps: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and Welch densities without the constant part, of detrended rows."""
    freqs, power = K.welch(detrended(x), fps, segment)
    return freqs[1:], power[:, 1:]


def _near(power: np.ndarray, freqs: np.ndarray, f0, reach: float) -> np.ndarray:
    """Highest density within a reach of a frequency, 0 where there is no bin; f0 may be one a row."""
    inside = np.abs(freqs[None, :] - np.broadcast_to(np.asarray(f0, dtype=float).reshape(-1, 1), (len(power), 1))) <= reach + 1e-12
    return np.where(inside, power, 0.0).max(axis=1)


def band_statistics(x: np.ndarray, fps: float, segment: int, low: float, high: float, edge: float = 0.01) -> dict[str, list]:
    """Peak of a band, its ratio to the band's median, and whether it stands at the rim."""
    freqs, power = density(x, fps, segment)
    inside = (freqs >= low) & (freqs <= high)
    if not inside.any():
        return {"peak": [float("nan")] * len(x), "snr": [float("nan")] * len(x), "at_edge": [True] * len(x)}
    f, p = freqs[inside], power[:, inside]
    peak = f[p.argmax(axis=1)]
    ratio = p.max(axis=1) / np.maximum(np.median(p, axis=1), 1e-300)
    return {"peak": peak.tolist(), "snr": ratio.tolist(), "at_edge": ((peak <= low + edge) | (peak >= high - edge)).tolist()}


def comb(x: np.ndarray, fps: float, segment: int, multiples: tuple[int, ...] = (2, 3)) -> dict[str, list]:
    """The fundamental, a minute, whose harmonics hold the most density: the product over the multiples, on a grid."""
    freqs, power = density(x, fps, segment)
    grid = np.arange(*COMB)
    logs = np.stack([sum(np.log(np.maximum(_near(power, freqs, f * m, COMB_REACH), 1e-30)) for m in multiples) for f in grid], axis=1)
    return {"per_minute": (grid[logs.argmax(axis=1)] * 60).tolist(), "log_score": logs.max(axis=1).tolist()}


def knee(x: np.ndarray, fps: float, segment: int, low: float = 0.3, high: float = 2.0, drop_db: float = 30.0) -> dict[str, list]:
    """Highest frequency under the plateau's peak at which the density is `drop_db` below it, and that peak."""
    freqs, power = density(x, fps, segment)
    inside = (freqs >= low) & (freqs <= high)
    if not inside.any():
        return {"knee": [float("nan")] * len(x), "plateau": [float("nan")] * len(x)}
    top = freqs[inside][power[:, inside].argmax(axis=1)]
    bound = power[:, inside].max(axis=1) / 10 ** (drop_db / 10)
    below = (freqs[None, :] < top[:, None]) & (freqs > 0.01)[None, :] & (power < bound[:, None])
    found = np.where(below, freqs[None, :], -np.inf).max(axis=1)
    return {"knee": np.where(np.isfinite(found), found, np.nan).tolist(), "plateau": top.tolist()}


def snr_at(x: np.ndarray, reference_hz: np.ndarray, fps: float, segment: int, half: float = 0.1) -> np.ndarray:
    """Density near a known rate over the band's median away from it and from its double."""
    freqs, power = K.welch(detrended(x), fps, segment)
    away = lambda f: np.abs(freqs[None, :] - f[:, None]) > half
    quiet = (freqs >= K.LOW)[None, :] & (freqs <= K.HIGH)[None, :] & away(reference_hz) & away(2 * reference_hz)
    noise = np.array([np.median(p[q]) if q.any() else np.nan for p, q in zip(power, quiet, strict=True)])
    return _near(power, freqs, reference_hz, half) / (noise + 1e-30)


def _rate(peaks: np.ndarray, fps: float) -> float:
    return float(60 * fps / np.median(np.diff(peaks))) if len(peaks) >= 3 else float("nan")


def counted(x: np.ndarray, fps: float, low: float, high: float) -> dict[str, list]:
    """Rate a minute from the peaks of the band-passed rows, without any spectrum."""
    made = K.bandpass(x, fps, low, high)
    found = [K.find_peaks(row, distance=max(1, int(fps / high))) if np.isfinite(row).all() else np.zeros(0) for row in made]
    return {"per_minute": [_rate(p, fps) for p in found], "peaks": [len(p) for p in found]}


def beats(x: np.ndarray, fps: float) -> dict[str, list]:
    """Rates of an ECG: by prominent peaks of either polarity, and by the energy of its QRS band."""
    unit = detrended(x)
    unit = unit / (unit.std(axis=1, keepdims=True) + 1e-9)
    upright = []
    for row in unit:
        rates = (_rate(K.find_peaks(sign * row, distance=max(1, int(0.33 * fps)), prominence=2.0), fps) for sign in (1, -1))
        upright.append(next((r for r in rates if 30 < r < 220), float("nan")))
    sharp = K.bandpass(detrended(x), fps, *QRS)
    width = max(1, int(0.15 * fps))
    energy = []
    for row in sharp:
        if not np.isfinite(row).all():
            energy.append(float("nan"))
            continue
        flow = np.convolve(row**2, np.ones(width) / width, mode="same")
        energy.append(_rate(K.find_peaks(flow, distance=max(1, int(0.30 * fps)), height=flow.mean() + 0.5 * flow.std()), fps))
    return {"polarity_bpm": upright, "energy_bpm": energy}


def breathing(x: np.ndarray, fps: float) -> dict[str, list]:
    """Breaths a minute and periodicity of a breathing signal, brought down to BREATH_FPS, de-drifted and band-passed."""
    low, high = RESTING
    slow = K.polyphase_resample(x, int(BREATH_FPS), int(fps)) if int(fps) != int(BREATH_FPS) else x
    made = K.bandpass(K.highpass(detrended(slow), BREATH_FPS, DRIFT), BREATH_FPS, low, high)
    freqs = np.fft.rfftfreq(made.shape[1], 1 / BREATH_FPS)
    inside = (freqs >= low) & (freqs <= high)
    rate, lag_rate, quality = [], [], []
    first, stop = int(BREATH_FPS / high), int(BREATH_FPS / low)
    for row in made:
        c = row - row.mean()
        zero = float((c * c).sum())
        values = np.array([(c[:-k] * c[k:]).sum() / zero for k in range(first, min(stop, len(c) - 1))]) if np.isfinite(zero) and zero > 1e-12 else np.zeros(0)
        if len(values) < 2 or not inside.any():
            rate.append(float("nan"))
            lag_rate.append(float("nan"))
            quality.append(0.0)
            continue
        power = np.abs(np.fft.rfft(c * np.hanning(len(c)))) ** 2
        rate.append(float(freqs[inside][power[inside].argmax()] * 60))
        lag_rate.append(float(60 * BREATH_FPS / (first + int(values.argmax()))))
        quality.append(float(values.max()))
    return {"spectral_per_minute": rate, "lag_per_minute": lag_rate, "quality": quality}


def breathing_share(x: np.ndarray, fps: float) -> dict[str, list]:
    """Breaths a minute of the de-drifted spectrum and the share of its energy at that peak."""
    low, high = BREATH
    made = K.highpass(detrended(x), fps, DRIFT)
    freqs, power = np.fft.rfftfreq(x.shape[1], 1 / fps), np.abs(np.fft.rfft(made * np.hanning(x.shape[1]), axis=1)) ** 2
    inside, whole = np.flatnonzero((freqs >= low) & (freqs <= high)), power[:, (freqs > 0.05) & (freqs < 2.0)].sum(axis=1)
    if not len(inside):
        return {"per_minute": [float("nan")] * len(x), "share": [0.0] * len(x)}
    part = power[:, inside]
    at = part.argmax(axis=1)
    near = np.array([p[max(0, k - 2) : k + 3].sum() for p, k in zip(part, at, strict=True)])
    ok = whole > 0
    return {"per_minute": np.where(ok, freqs[inside][at] * 60, np.nan).tolist(), "share": np.where(ok, near / np.where(ok, whole, 1.0), 0.0).tolist()}


def motion(difference: Column, fps: float, band: tuple[float, float]) -> Column:
    """Displacements band-passed and scaled: head recoil from nose against forehead, breathing from nose and chin."""

    def kernel(x: np.ndarray) -> np.ndarray:
        made = K.bandpass(x - x.mean(axis=1, keepdims=True), fps, *band)
        return (made - made.mean(axis=1, keepdims=True)) / (made.std(axis=1, keepdims=True) + 1e-8)

    return K.mapped(kernel)(difference)


def referenced_snr(signal: Column, hz: Column, fps: float, segment: int, half: float = 0.1) -> Column:
    """snr_at of each row's own reference; null where either is null."""

    @F.pandas_udf("double")
    def run(signals: pd.Series, references: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=signals.index)
        for rows, x in K._matrices(signals):
            out.iloc[rows] = snr_at(x, references.to_numpy(dtype=float)[rows], fps, segment, half)
        return out.where(references.notna() & out.notna(), None)

    return run(signal, hz)


def overlapped_pos(r: Column, g: Column, b: Column, fps: float, normalise: bool) -> Column:
    """POS over overlapping windows of a recording's colours, added up."""

    @F.pandas_udf("array<double>")
    def run(red: pd.Series, green: pd.Series, blue: pd.Series) -> pd.Series:
        made = []
        for colours in zip(red, green, blue, strict=True):
            if any(c is None for c in colours) or len({len(c) for c in colours}) > 1:
                made.append(None)
                continue
            pulse = K.overlap_add_pos(np.stack([np.asarray(c, dtype=float) for c in colours], axis=1), fps, normalise=normalise)
            made.append(None if np.isnan(pulse).any() else pulse.tolist())
        return pd.Series(made, index=red.index, dtype=object)

    return run(r, g, b)
