"""Signal kernels in NumPy over batches of rows, and the Arrow functions that run them.

Kernels take a matrix, a row a signal, and never raise for bad rows: such rows give NaN or empty
results, because the engine may evaluate them for rows that a condition leaves out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cardiac band in Hz and the bounds of the status of a quality index.
LOW, HIGH, GOOD, MODERATE = 0.7, 3.5, 0.50, 0.30


def hann_power(x: np.ndarray, window: bool = True) -> np.ndarray:
    """Power of the demeaned, Hann-windowed rows."""
    x = x - x.mean(axis=1, keepdims=True)
    if window:
        x = x * np.hanning(x.shape[1])
    return np.abs(np.fft.rfft(x, axis=1)) ** 2


def band_mask(freqs: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bins inside a band, compared in single precision as stored frequencies are."""
    f = freqs.astype(np.float32)
    return (f >= np.float32(low)) & (f <= np.float32(high))


def spectral_quality(x: np.ndarray, fps: float, low: float = LOW, high: float = HIGH, reach: int = 1, window: bool = True, refine: bool = True, least: float = 1e-12):
    """Dominant rate in bpm, share of the band's power at the peak and its neighbours, and the peak's bin.

    The peak is refined by a parabola through the logarithms of the three bins around it, unless
    it stands at the rim of the band, the parabola is degenerate or its top more than half a bin off.
    """
    n = x.shape[1]
    empty = np.full(len(x), np.nan)
    if n < 4 or not fps > 0:
        return empty, empty, np.full(len(x), -1)
    power = hann_power(x, window)
    freqs = np.fft.rfftfreq(n, 1 / fps)
    bins = np.flatnonzero(band_mask(freqs, low, high))
    if not len(bins):
        return empty, empty, np.full(len(x), -1)
    inside = power[:, bins]
    whole = inside.sum(axis=1)
    peak = bins[inside.argmax(axis=1)]
    rows = np.arange(len(x))
    near = sum(np.where((peak + k >= bins[0]) & (peak + k <= bins[-1]), power[rows, np.clip(peak + k, 0, power.shape[1] - 1)], 0.0) for k in range(-reach, reach + 1))
    offset = np.zeros(len(x))
    if refine:
        ok = (peak > bins[0]) & (peak < bins[-1])
        a, b, c = (np.log(power[rows, np.clip(peak + k, 0, power.shape[1] - 1)] + 1e-20) for k in (-1, 0, 1))
        curve = a - 2 * b + c
        with np.errstate(divide="ignore", invalid="ignore"):
            shift = 0.5 * (a - c) / curve
        ok &= (np.abs(curve) >= 1e-12) & (np.abs(shift) <= 0.5)
        offset = np.where(ok, shift, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = near / whole
    bad = ~(whole > least)
    bpm = (peak + offset) * (fps / n) * 60
    return np.where(bad, np.nan, bpm), np.where(bad, np.nan, share), np.where(bad, -1, peak)


def butterworth(order: int, low: float, high: float | None, fps: float, kind: str = "band") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter by the bilinear transform with pre-warped edges."""
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    warp = lambda f: 4 * np.tan(np.pi * f / fps)
    if kind == "band":
        a, b = warp(low), warp(high)
        width, centre = b - a, np.sqrt(a * b)
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, gain = np.concatenate((half + root, half - root)), np.zeros(order), width**order
    elif kind == "high":
        edge = warp(low)
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = edge / poles, np.zeros(order)
    else:
        edge = warp(low)
        poles, zeros, gain = poles * edge, np.zeros(0), edge**order
    double = 4.0
    gain = gain * np.real(np.prod(double - zeros) / np.prod(double - poles))
    zeros = np.concatenate(((double + zeros) / (double - zeros), -np.ones(len(poles) - len(zeros))))
    poles = (double + poles) / (double - poles)
    return gain * np.real(np.poly(zeros)), np.real(np.poly(poles))


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed over rows; state: rows by order."""
    out = np.empty_like(x)
    z = state.copy()
    for i in range(x.shape[1]):
        v = x[:, i]
        y = b[0] * v + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(v, b[1:-1]) - np.outer(y, a[1:-1])
        z[:, -1] = b[-1] * v - a[-1] * y
        out[:, i] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension and steady initial state; NaN rows when too short."""
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        return np.full_like(x, np.nan)
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:] / a[0]
    companion[1:, :-1] += np.eye(n - 1)
    steady = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])
    head, tail = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = np.concatenate((head, x, tail), axis=1)
    for _ in range(2):
        y = _run(b, a, y, np.outer(y[:, 0], steady))[:, ::-1]
    return y[:, pad:-pad]


def bandpass(x: np.ndarray, fps: float, low: float = LOW, high: float = HIGH, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band-pass; NaN rows for an impossible rate or band."""
    if not fps > 0 or high >= fps / 2 or x.shape[1] == 0:
        return np.full_like(x, np.nan)
    return zero_phase(*butterworth(order, low, high, fps), x)


def highpass(x: np.ndarray, fps: float, low: float, order: int = 2) -> np.ndarray:
    if not fps > 0 or low >= fps / 2:
        return np.full_like(x, np.nan)
    return zero_phase(*butterworth(order, low, None, fps, "high"), x)


def fourier_resample(x: np.ndarray, length: int) -> np.ndarray:
    """Resampling by cutting or padding the spectrum; the Nyquist bin is halved or doubled as it is shared."""
    n = x.shape[1]
    if n < 8:
        return np.full((len(x), length), np.nan)
    spectrum = np.fft.rfft(x, axis=1)
    keep = min(n, length)
    out = np.zeros((len(x), length // 2 + 1), dtype=complex)
    out[:, : keep // 2 + 1] = spectrum[:, : keep // 2 + 1]
    if keep % 2 == 0 and n != length:
        out[:, keep // 2] *= 2.0 if length < n else 0.5
    return np.fft.irfft(out, length, axis=1) * (length / n)


def polyphase_resample(x: np.ndarray, up: int, down: int, length: int | None = None) -> np.ndarray:
    """Resampling by a rational factor through a Kaiser-windowed low-pass; cut or padded with the last value to a length."""
    common = np.gcd(up, down)
    up, down = up // common, down // common
    widest = max(up, down)
    half = 10 * widest
    taps = np.arange(-half, half + 1)
    filt = np.sinc(taps / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    filt *= up / filt.sum()
    stuffed = np.zeros((len(x), x.shape[1] * up))
    stuffed[:, ::up] = x
    full = np.stack([np.convolve(row, filt)[half : half + stuffed.shape[1]] for row in stuffed])[:, ::down]
    if length is not None:
        full = full[:, :length]
        full = np.concatenate((full, np.repeat(full[:, -1:], length - full.shape[1], axis=1)), axis=1)
    return full


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1))


def welch(x: np.ndarray, fps: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean density of demeaned, Hann-windowed half-overlapping segments."""
    segment = min(segment, x.shape[1])
    window = np.hanning(segment + 1)[:-1]
    starts = range(0, x.shape[1] - segment + 1, max(1, segment // 2))
    scale = 1 / (fps * (window**2).sum())
    total = 0.0
    for s in starts:
        part = x[:, s : s + segment]
        total = total + np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 * scale
    density = total / len(starts)
    density[:, 1 : (-1 if segment % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(segment, 1 / fps), density


def find_peaks(x: np.ndarray, distance: int = 1, height: float = -np.inf, prominence: float = 0.0) -> np.ndarray:
    """Local maxima of one signal, highest first for the distance rule, with a least height and prominence."""
    inner = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    inner = inner[x[inner] >= height]
    kept: list[int] = []
    for p in inner[np.argsort(-x[inner], kind="stable")]:
        if all(abs(p - q) >= distance for q in kept):
            kept.append(int(p))

    def stands_out(p: int) -> bool:
        left, right = x[: p + 1], x[p:]
        higher_left, higher_right = np.flatnonzero(left > x[p]), np.flatnonzero(right > x[p])
        a = left[higher_left[-1] :].min() if len(higher_left) else left.min()
        b = right[: higher_right[0] + 1].min() if len(higher_right) else right.min()
        return x[p] - max(a, b) >= prominence

    return np.array(sorted(p for p in kept if stands_out(p)), dtype=int)


def top_peaks(power: np.ndarray, freqs: np.ndarray, low: float = LOW, high: float = HIGH, count: int = 3, apart_bpm: float = 7.5) -> list[tuple[float, float]]:
    """The strongest local maxima of a band, each at least `apart_bpm` from the stronger ones: (bpm, power)."""
    inside = np.flatnonzero(band_mask(freqs, low, high))
    maxima = [i for i in inside if 0 < i < len(power) - 1 and power[i] >= power[i - 1] and power[i] >= power[i + 1]]
    chosen: list[tuple[float, float]] = []
    for i in sorted(maxima, key=lambda i: (-power[i], i)):
        bpm = float(freqs[i] * 60)
        if all(abs(bpm - b) >= apart_bpm for b, _ in chosen):
            chosen.append((bpm, float(power[i])))
        if len(chosen) == count:
            break
    return chosen


def overlap_add_pos(rgb: np.ndarray, fps: float, seconds: float = 1.6, normalise: bool = True) -> np.ndarray:
    """POS over overlapping windows of one recording's colour (frames by 3), added up; gaps are interpolated.

    The last start is a window's length before the last frame; a window with a dark channel (mean 0,
    or under it when windows are normalised) adds nothing.
    """
    frames = len(rgb)
    rgb = np.stack([np.interp(np.arange(frames), np.flatnonzero(np.isfinite(c)), c[np.isfinite(c)]) if np.isfinite(c).any() else c for c in rgb.T], axis=1)
    size = int(seconds * fps)
    if size < 2 or frames <= size or not np.isfinite(rgb).all():
        return np.full(frames, np.nan)
    parts = np.lib.stride_tricks.sliding_window_view(rgb, size, axis=0)[: frames - size].transpose(0, 2, 1)
    level = parts.mean(axis=1, keepdims=True)
    lit = (level > 0 if normalise else level != 0).all(axis=(1, 2))
    scaled = parts[lit] / level[lit]
    first, second = scaled[..., 1] - scaled[..., 2], scaled[..., 1] + scaled[..., 2] - 2 * scaled[..., 0]
    pulse = first + (first.std(axis=1) / (second.std(axis=1) + 1e-12))[:, None] * second
    pulse -= pulse.mean(axis=1, keepdims=True)
    if normalise:
        pulse /= pulse.std(axis=1, keepdims=True) + 1e-12
    out = np.zeros(frames)
    np.add.at(out, np.flatnonzero(lit)[:, None] + np.arange(size), pulse)
    return out


def respiration_quality(x: np.ndarray, fps: float, low: float = 0.10, high: float = 0.50) -> tuple[float, float]:
    """Breaths a minute and quality: the highest autocorrelation among the lags of a breathing band."""
    c = x - x.mean()
    zero = float((c * c).sum())
    lags = np.arange(max(1, int(fps / high)), min(len(c) - 1, int(fps / low)) + 1)
    if zero <= 1e-12 or not len(lags):
        return float("nan"), float("nan")
    values = np.array([(c[:-k] * c[k:]).sum() / zero for k in lags])
    best = int(values.argmax())
    return float(60 * fps / lags[best]), float(np.clip(values[best], 0, 1))


def signal_to_noise(x: np.ndarray, bpm: np.ndarray, fps: float, low: float = LOW, high: float = HIGH, reach_bpm: float = 8.0) -> np.ndarray:
    """Decibels, within 30 either way, of the band's power near the true rate and its double over the rest of the band."""
    power, freqs = hann_power(x, window=False), np.fft.rfftfreq(x.shape[-1], 1 / fps)
    band = band_mask(freqs, low, high)
    rate = np.clip(np.asarray(bpm, dtype=float) / 60, low + 0.05, high - 0.05)[:, None]
    near = ((np.abs(freqs - rate) <= reach_bpm / 60) | (np.abs(freqs - 2 * rate) <= reach_bpm / 60)) & band
    signal, noise = (power * near).sum(axis=1) + 1e-8, (power * (band & ~near)).sum(axis=1) + 1e-8
    return np.clip(10 * np.log10(signal / noise), -30, 30)


def frequency_loss(a: np.ndarray, b: np.ndarray, fps: float, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sum of squared differences of the two spectra, each normalised over the band."""
    band = band_mask(np.fft.rfftfreq(a.shape[-1], 1 / fps), low, high)
    shares = [p / (p.sum(axis=1, keepdims=True) + 1e-8) for p in (hann_power(x, window=False)[:, band] for x in (a, b))]
    return ((shares[0] - shares[1]) ** 2).sum(axis=1)


def _z(x: np.ndarray) -> np.ndarray:
    d = x.std(axis=1, keepdims=True)
    return np.where(d < 1e-8, 0.0, (x - x.mean(axis=1, keepdims=True)) / np.where(d < 1e-8, 1.0, d))


def model_ready(x: np.ndarray, length: int) -> np.ndarray:
    """Rows resampled to a length and scaled."""
    return _z(fourier_resample(x, length))


def _projections(rgb: np.ndarray, pad: float) -> tuple[np.ndarray, np.ndarray]:
    """POS and CHROM of colour (rows, frames, 3) normalised by its means; pad is added to the divisor of alpha."""
    c = rgb / (rgb.mean(axis=1, keepdims=True) + 1e-8)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    out = []
    for first, second, sign in ((g - b, g + b - 2 * r, 1.0), (3 * r - 2 * g, 1.5 * r + g - 1.5 * b, -1.0)):
        d = second.std(axis=1, keepdims=True)
        alpha = first.std(axis=1, keepdims=True) / np.where(d < 1e-8, 1.0, d + pad)
        out.append(np.where(d < 1e-8, first, first + sign * alpha * second))
    return out[0], out[1]


def live_signals(rois: np.ndarray) -> dict[str, np.ndarray]:
    """GREEN, POS and CHROM of colour (rows, regions, frames, 3): regions are combined before projection."""
    colour = rois.mean(axis=1)
    pos, chrom = _projections(colour, 0.0)
    return {"green": _z(colour[..., 1]), "pos": _z(pos), "chrom": _z(chrom)}


def training_signals(rois: np.ndarray, fps: float, order: int = 4) -> dict[str, np.ndarray]:
    """The same of each region by itself, then averaged over regions and band-passed."""
    each = [_projections(rois[:, k], 1e-8) for k in range(rois.shape[1])]
    green = rois[..., 1] / (rois[..., 1].mean(axis=2, keepdims=True) + 1e-8)
    raw = {"green": green.mean(axis=1), "pos": np.mean([p for p, _ in each], axis=0), "chrom": np.mean([c for _, c in each], axis=0)}
    return {name: _z(bandpass(x, fps, order=order)) for name, x in raw.items()}


def buffered_channels(rois: np.ndarray, fps: float, window: int, length: int) -> dict[str, np.ndarray]:
    """Training-style channels of a buffer, their last `window` frames resampled and scaled; NaN for a shorter buffer."""
    short = rois.shape[2] < window
    return {name: np.full((len(x), length), np.nan) if short else model_ready(x[:, -window:], length) for name, x in training_signals(rois, fps).items()}


# Arrow functions.
def pulse_signals(r: Column, g: Column, b: Column, regions: int, kernel=live_signals, *options) -> Column:
    """Struct of green, pos and chrom arrays from colours, each the frames of all regions one after another."""

    @F.pandas_udf("green array<double>, pos array<double>, chrom array<double>")
    def run(red: pd.Series, green: pd.Series, blue: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([None] * len(red), dtype=object) for c in ("green", "pos", "chrom")})
        for rows, x in _matrices(red):
            parts = [x, *(np.stack(c.iloc[rows].to_numpy()).astype(float) for c in (green, blue))]
            cube = np.stack([p.reshape(len(rows), regions, -1) for p in parts], axis=-1)
            for name, signal in kernel(cube, *options).items():
                out[name] = out[name].astype(object)
                for k, row in zip(rows, signal, strict=True):
                    out.at[k, name] = None if np.isnan(row).any() else row.tolist()
        return out

    return run(r, g, b)


def _matrices(signals: pd.Series):
    """Rows of one length at a time: (row numbers, matrix)."""
    lengths = signals.map(lambda x: -1 if x is None else len(x)).to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        yield rows, np.stack(signals.iloc[rows].to_numpy()).astype(float)


def quality(signal: Column, fps: float, **options) -> Column:
    """Struct of bpm, sqi and bin by `spectral_quality`; nulls for unusable rows."""

    @F.pandas_udf("bpm double, sqi double, bin int")
    def run(signals: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"bpm": np.full(len(signals), np.nan), "sqi": np.full(len(signals), np.nan), "bin": np.full(len(signals), -1)})
        for rows, x in _matrices(signals):
            bpm, sqi, peak = spectral_quality(x, fps, **options)
            out.iloc[rows, 0], out.iloc[rows, 1], out.iloc[rows, 2] = bpm, sqi, peak
        return out

    return run(signal)


def snr(signal: Column, bpm: Column, fps: float) -> Column:
    """signal_to_noise of equally long signals; null for nulls."""

    @F.pandas_udf("double")
    def run(signals: pd.Series, rates: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=signals.index)
        for rows, x in _matrices(signals):
            out.iloc[rows] = signal_to_noise(x, rates.to_numpy(dtype=float)[rows], fps)
        return out.where(rates.notna() & out.notna(), None)

    return run(signal, bpm)


def spectral_distance(a: Column, b: Column, fps: float) -> Column:
    """frequency_loss of pairs of equally long signals; null where either is null or the lengths differ."""

    @F.pandas_udf("double")
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=first.index)
        fits = pd.Series([x is not None and y is not None and len(x) == len(y) for x, y in zip(first, second, strict=True)], index=first.index)
        for rows, x in _matrices(first.where(fits, None)):
            out.iloc[rows] = frequency_loss(x, np.stack([second.iloc[r] for r in rows]).astype(float), fps)
        return out.where(out.notna(), None)

    return run(a, b)


def mapped(kernel, *options) -> object:
    """An Arrow function from array<double> to array<double> by a kernel over matrices."""

    @F.pandas_udf("array<double>")
    def run(signals: pd.Series) -> pd.Series:
        out = np.full(len(signals), None, dtype=object)
        for rows, x in _matrices(signals):
            made = kernel(x, *options)
            whole = ~np.isnan(made).any(axis=1)
            for k, row in zip(rows[whole], made[whole], strict=True):
                out[k] = row
        return pd.Series(out)

    return run


def status(sqi: Column) -> Column:
    """good, moderate, poor or invalid."""
    return F.when(sqi.isNull() | F.isnan(sqi), "invalid").when(sqi >= GOOD, "good").when(sqi >= MODERATE, "moderate").otherwise("poor")
