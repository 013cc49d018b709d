"""Signal operators on epochs held as arrays.

A row is one epoch of one channel, so its length is bounded and every operator below is a batched array function: no
recording is gathered in one task. Per-recording results (mean spectra, fits) come from ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from ..functions.scalars import finite
from ..session import checkpoint

# Defaults of the spectral fit.
FIT_RANGE = (1.0, 45.0)
WELCH_SEGMENT = 512
PEAK_WIDTHS = (1.0, 12.0)
MAX_PEAKS = 6
MIN_PEAK_HEIGHT = 0.1


def _stacks(x: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each length, and those rows as one matrix."""
    sizes = x.map(len).to_numpy()
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        yield places, np.stack(x.to_numpy()[places]).astype(float)


def _by_length(x: pd.Series, fn: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """Apply a batched function to rows of equal length together."""
    out = np.empty(len(x), dtype=object)
    for places, rows in _stacks(x):
        out[places] = list(fn(rows))
    return pd.Series(out, index=x.index)


# ---- resampling and filters ------------------------------------------------------------------------------------------


def _kernel(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed sinc low-pass at the lower of the two Nyquist rates, ten zero crossings to a side."""
    top = max(up, down)
    half = 10 * top
    t = np.arange(-half, half + 1)
    h = np.sinc(t / top) / top * np.kaiser(2 * half + 1, 5.0)
    return up * h / h.sum()


def resample_rows(x: np.ndarray, up: int, down: int) -> np.ndarray:
    n = x.shape[1]
    h = _kernel(up, down)
    half = (len(h) - 1) // 2
    spread = np.zeros((len(x), n * up))
    spread[:, ::up] = x
    size = 1 << int(np.ceil(np.log2(n * up + len(h))))
    full = np.fft.irfft(np.fft.rfft(spread, size) * np.fft.rfft(h, size), size)
    return full[:, half : half + n * up : down][:, : -(-n * up // down)]


def resample(epochs: DataFrame, fs_in: float, fs_out: float, vec: str = "x") -> DataFrame:
    """Change the sampling rate by the ratio of the rounded rates; equal rates pass through."""
    a, b = int(round(fs_in)), int(round(fs_out))
    if a == b:
        return epochs
    g = gcd(a, b)
    up, down = b // g, a // g

    @F.pandas_udf("array<double>")
    def change(x: pd.Series) -> pd.Series:
        return _by_length(x, lambda m: resample_rows(m, up, down))

    return epochs.withColumn(vec, change(A.as_double(vec)))


class FilterPlan:
    """Which filters apply at a sampling rate: a low-pass at or above 0.99 of Nyquist is dropped, notch harmonics stop
    below it."""

    def __init__(self, sfreq, highpass=0.5, lowpass=99.5, notch=60.0, harmonics=False, notch_q=30.0, order=4):
        nyquist = sfreq / 2.0
        self.sfreq, self.highpass, self.order, self.notch_q = float(sfreq), highpass, order, notch_q
        self.lowpass = None if lowpass is None or lowpass >= 0.99 * nyquist else lowpass
        lines = [] if notch is None else [float(notch)]
        if notch is not None and harmonics:
            lines += [float(k * notch) for k in range(2, int(0.99 * nyquist / notch) + 1) if k * notch < 0.99 * nyquist]
        self.notches = [f for f in lines if 0.0 < f < nyquist]

    def gain(self, freqs: np.ndarray) -> np.ndarray:
        """Zero-phase power response: Butterworth edges and second-order notches, applied forward and backward."""
        g = np.ones_like(freqs)
        with np.errstate(divide="ignore", over="ignore"):
            warped = np.tan(np.pi * np.minimum(freqs, self.sfreq / 2 * (1 - 1e-9)) / self.sfreq)
            edge = lambda f: np.tan(np.pi * f / self.sfreq)
            if self.highpass is not None and self.lowpass is not None:
                lo, hi = edge(self.highpass), edge(self.lowpass)
                shape = (warped**2 - lo * hi) / np.maximum(warped * (hi - lo), 1e-300)
                g = g / (1.0 + shape ** (2 * self.order))
            elif self.highpass is not None:
                g = g / (1.0 + (edge(self.highpass) / np.maximum(warped, 1e-300)) ** (2 * self.order))
            elif self.lowpass is not None:
                g = g / (1.0 + (warped / edge(self.lowpass)) ** (2 * self.order))
            for f in self.notches:
                width = np.tan(np.pi * f / self.notch_q / self.sfreq)
                centre = np.cos(2 * np.pi * f / self.sfreq)
                off = np.cos(2 * np.pi * freqs / self.sfreq) - centre
                across = width * np.sin(2 * np.pi * freqs / self.sfreq)
                g = g * off**2 / np.maximum(off**2 + across**2, 1e-300)
        return np.where(freqs == 0, 0.0 if self.highpass is not None else g, g)


def filter_rows(x: np.ndarray, plan: FilterPlan) -> np.ndarray:
    n = x.shape[1]
    pad = max(0, min(n - 1, n))
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    long = np.hstack([left, x, right])
    spectrum = np.fft.rfft(long) * plan.gain(np.fft.rfftfreq(long.shape[1], 1.0 / plan.sfreq))
    return np.fft.irfft(spectrum, long.shape[1])[:, pad : pad + n]


def clean(epochs: DataFrame, plan: FilterPlan, vec: str = "x") -> DataFrame:
    """Notches and band-pass along time, zero phase, with odd reflection at both ends."""

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return _by_length(x, lambda m: filter_rows(m, plan))

    return epochs.withColumn(vec, apply(A.as_double(vec)))


def rereference_arrays(epochs: DataFrame, keys: Sequence[str], channels: Sequence[str] | None = None, ch: str = "ch", vec: str = "x") -> DataFrame:
    """Subtract the mean over (all or the named) channels of the same epoch, sample by sample."""
    source = epochs
    if channels is not None:
        source = epochs.where(F.upper(F.trim(ch)).isin([c.strip().upper() for c in channels]))
    mean = source.groupBy(*keys).agg(Summarizer.metrics("mean").summary(array_to_vector(A.as_double(vec))).alias("_m"))
    mean = mean.select(*keys, vector_to_array("_m.mean").alias("_m"))
    return epochs.join(mean, list(keys)).withColumn(vec, A.subtract(A.as_double(vec), F.col("_m"))).drop("_m")


def device_clean(epochs: DataFrame, plan: FilterPlan, reref: str | Sequence[str] | None = None, keys: Sequence[str] = ("recording_id", "epoch"), ch: str = "ch", vec: str = "x") -> DataFrame:
    """Front end of a live device: re-reference, notch, band-pass."""
    if reref == "average":
        epochs = rereference_arrays(epochs, keys, None, ch, vec)
    elif reref is not None:
        epochs = rereference_arrays(epochs, keys, list(reref), ch, vec)
    return clean(epochs, plan, vec)


# ---- spectra ------------------------------------------------------------------------------------------------------------


def welch_rows(x: np.ndarray, sfreq: float, segment: int) -> np.ndarray:
    """Power density per row: Hann segments with half overlap, mean removed, one-sided."""
    size = min(segment, x.shape[1])
    hop = size - size // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, x.shape[1] - size + 1, hop)
    total = 0.0
    for s in starts:
        part = x[:, s : s + size]
        part = (part - part.mean(axis=1, keepdims=True)) * window
        total = total + np.abs(np.fft.rfft(part)) ** 2
    density = total / len(starts) / (sfreq * (window**2).sum())
    last = -1 if size % 2 == 0 else None
    density[:, 1:last] *= 2.0
    return density


def welch_psd(epochs: DataFrame, sfreq: float, keys: Sequence[str] = ("recording_id", "ch"), segment: int = WELCH_SEGMENT, band: tuple[float, float] | None = None, vec: str = "x") -> DataFrame:
    """``keys, freq, psd``: spectrum averaged over the epochs of a key, in long form, cut to ``band``."""

    @F.pandas_udf("array<double>")
    def density(x: pd.Series) -> pd.Series:
        return _by_length(x, lambda m: welch_rows(m, sfreq, segment))

    size = F.least(F.lit(segment), F.size(vec)).alias("_size")
    spectra = epochs.select(*keys, size, density(A.as_double(vec)).alias("_p"))
    mean = spectra.groupBy(*keys, "_size").agg(Summarizer.metrics("mean").summary(array_to_vector("_p")).alias("_m"))
    long = mean.select(*keys, "_size", F.posexplode(vector_to_array("_m.mean")).alias("bin", "psd"))
    out = long.select(*keys, "bin", (F.col("bin") * F.lit(float(sfreq)) / F.col("_size")).alias("freq"), "psd")
    if band is not None:
        out = out.where((F.col("freq") >= band[0]) & (F.col("freq") <= band[1]))
    return out


def _spectra(psd: DataFrame, keys: list[str], fit_range: tuple[float, float]) -> DataFrame:
    """One row for each key with the arrays ``_f``, ``_p`` of its bins in range, in order of frequency. A spectrum has a
    fixed number of bins."""
    inside = psd.where((F.col("freq") >= fit_range[0]) & (F.col("freq") <= fit_range[1]) & (F.col("freq") > 0))
    packed = inside.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("freq").cast("double").alias("freq"), F.col("psd").cast("double").alias("psd")))).alias("_s"))
    return packed.select(*keys, F.transform("_s", lambda s: s["freq"]).alias("_f"), F.transform("_s", lambda s: s["psd"]).alias("_p"))


def _line(f: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """Level and slope of the least-squares line; NaN where all f are equal."""
    off = f - f.mean()
    spread = float(off @ off)
    slope = float(off @ (p - p.mean())) / spread if spread > 0 else float("nan")
    return float(p.mean()) - slope * float(f.mean()), slope


def _log_line(freq: np.ndarray, power: np.ndarray, quantile: float) -> tuple[float, float, float]:
    """b, chi, r2 of a spectrum; all NaN where no line can be drawn."""
    f, p = np.log10(freq), np.log10(power)
    b, slope = _line(f, p)
    flat = np.maximum(p - (b + slope * f), 0.0)
    low = flat <= np.quantile(flat, quantile)
    if np.isnan(slope) or not low.any():
        return (float("nan"),) * 3
    b, slope = _line(f[low], p[low])
    hat = b + slope * f
    spread = p.std() * hat.std()
    r2 = (((p - p.mean()) * (hat - hat.mean())).mean() / spread) ** 2 if spread > 0 else float("nan")
    return b, -slope, float(r2)


def aperiodic_fit(psd: DataFrame, keys: Sequence[str] = ("recording_id", "ch"), fit_range: tuple[float, float] = FIT_RANGE, quantile: float = 0.025) -> DataFrame:
    """``keys, b, chi, r2`` of log10 P = b - chi log10 f.

    Two passes: a first line, then a line through the bins whose flattened power is lowest (so that peaks do not tilt
    it). Keys with a non-positive or non-finite power in range get no row. ``r2`` compares the line with all bins.
    Each spectrum is packed once and fitted as an array.
    """
    keys = list(keys)

    @F.pandas_udf("b double, chi double, r2 double")
    def fit(freq: pd.Series, power: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_log_line(np.asarray(f), np.asarray(p), quantile) for f, p in zip(freq, power)], columns=["b", "chi", "r2"])

    spectra = _spectra(psd, keys, fit_range).where(F.forall("_p", lambda p: F.coalesce((p > 0) & finite(p), F.lit(False))))
    return spectra.select(*keys, fit("_f", "_p").alias("_fit")).select(*keys, "_fit.*")


def _peaks(freq: np.ndarray, flat: np.ndarray, max_peaks: int, min_height: float, widths: tuple[float, float]) -> list[dict]:
    """Local maxima of a flattened spectrum, tallest first."""
    top = np.zeros(len(flat), bool)
    top[1:-1] = (flat[1:-1] > flat[:-2]) & (flat[1:-1] >= flat[2:])
    found = []
    for i in np.flatnonzero(top & (flat >= min_height)):
        below = np.abs(freq - freq[i])[flat <= flat[i] / 2.0]
        half = below.min() if len(below) else widths[1] / 2.0
        found.append((-flat[i], freq[i], float(np.clip(2.0 * half, *widths))))
    return [{"peak": k, "cf": float(cf), "amp": float(-amp), "bw": bw} for k, (amp, cf, bw) in enumerate(sorted(found)[:max_peaks], 1)]


def spectral_peaks(psd: DataFrame, fit: DataFrame, keys: Sequence[str] = ("recording_id", "ch"), fit_range: tuple[float, float] = FIT_RANGE, max_peaks: int = MAX_PEAKS, min_height: float = MIN_PEAK_HEIGHT, widths: tuple[float, float] = PEAK_WIDTHS) -> DataFrame:
    """``keys, peak, cf, amp, bw``: local maxima of the flattened log spectrum, tallest first.

    The width is twice the smaller distance to half height, clipped to ``widths``. Spectra without a fit have no peaks.
    """
    keys = list(keys)

    @F.pandas_udf("array<struct<peak:int,cf:double,amp:double,bw:double>>")
    def find(freq: pd.Series, power: pd.Series, b: pd.Series, chi: pd.Series) -> pd.Series:
        flat = [np.log10(p) - (level - slope * np.log10(f)) for f, p, level, slope in zip(freq, power, b, chi)]
        return pd.Series([_peaks(np.asarray(f), r, max_peaks, min_height, widths) for f, r in zip(freq, flat)], dtype=object)

    lines = fit.where(F.col("b").isNotNull() & ~F.isnan("b")).select(*keys, "b", "chi")
    joined = _spectra(psd, keys, fit_range).join(lines, keys)
    return joined.select(*keys, F.inline(find("_f", "_p", "b", "chi")))


def spectral_gain(power: np.ndarray, freqs: np.ndarray, line: np.ndarray, peaks: np.ndarray, mode: str) -> np.ndarray:
    """Real factor for each row and frequency that takes the fitted parts out of a spectrum.

    ``line`` is log10 of the 1/f power (rows, frequencies), ``peaks`` centre, log10 height and width (rows, peaks, 3;
    height 0 for none). Without its peaks a spectrum keeps the share of its power that the peaks do not explain, none
    if they explain more than there is; without the 1/f part it is measured in units of it.
    """
    share = np.ones_like(power)
    if mode != "aperiodic_removed":
        centre, height, width = (peaks[:, :, i, None] for i in range(3))
        rise = np.power(10.0, height * np.exp(-2.0 * ((freqs - centre) / np.where(width > 0, width, 1.0)) ** 2))
        excess = np.power(10.0, line) * (rise.sum(axis=1) - peaks.shape[1])
        share -= np.divide(excess, power, out=np.ones_like(power), where=power > 0)
    if mode != "periodic_removed":
        share *= np.power(10.0, -np.maximum(line, -16.0))
    return np.sqrt(np.maximum(share, 0.0))


def _peak_table(found: pd.Series) -> np.ndarray:
    """(rows, peaks, 3) of lists of peaks, short and missing lists filled up with peaks of height 0."""
    lists = [() if f is None else f for f in found]
    out = np.zeros((len(lists), max(map(len, lists), default=0), 3))
    for i, listed in enumerate(lists):
        for j, peak in enumerate(listed):
            out[i, j] = peak["cf"], peak["amp"], peak["bw"]
    return out


def spectral_ablate(epochs: DataFrame, sfreq: float, mode: str = "aperiodic_removed", keys: Sequence[str] = ("recording_id", "ch"), fit: DataFrame | None = None, peaks: DataFrame | None = None, fit_range: tuple[float, float] = FIT_RANGE, vec: str = "x") -> DataFrame:
    """Remove the aperiodic or the periodic part of each channel of a recording, with one fit per channel and recording.
    A channel without a fit passes through."""
    if mode not in ("aperiodic_removed", "periodic_removed", "both_removed"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = list(keys)
    if fit is None:
        # read four times below, and small beside the epochs: one spectrum per channel and recording
        psd = checkpoint(welch_psd(epochs, sfreq, keys, vec=vec))
        fit = aperiodic_fit(psd, keys, fit_range)
        peaks = spectral_peaks(psd, fit, keys, fit_range)
    if peaks is not None:
        listed = peaks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("peak", "cf", "amp", "bw"))).alias("_peaks"))
        fit = fit.join(listed, keys, "left")
    else:
        fit = fit.withColumn("_peaks", F.lit(None).cast("array<struct<peak:int,cf:double,amp:double,bw:double>>"))
    low = fit_range[0]

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series, b: pd.Series, chi: pd.Series, bumps: pd.Series) -> pd.Series:
        out, level, slope = x.to_numpy().copy(), b.to_numpy(float), chi.to_numpy(float)
        fitted = np.flatnonzero(~np.isnan(level))
        for within, rows in _stacks(x.iloc[fitted]):
            places = fitted[within]
            size = rows.shape[1]
            freqs, spectrum = np.fft.rfftfreq(size, 1.0 / sfreq), np.fft.rfft(rows)
            line = level[places, None] - slope[places, None] * np.log10(np.maximum(freqs, low))
            gain = spectral_gain(np.abs(spectrum) ** 2 / size, freqs, line, _peak_table(bumps.iloc[places]), mode)
            out[places] = list(np.fft.irfft(gain * spectrum, size))
        return pd.Series(out)

    joined = epochs.join(fit.select(*keys, "b", "chi", "_peaks"), keys, "left")
    return joined.withColumn(vec, apply(A.as_double(vec), "b", "chi", "_peaks")).drop("b", "chi", "_peaks")


def representative_recording(fit: DataFrame, recording: str = "recording_id") -> DataFrame:
    """The recording with the best mean fit over its channels, and its mean level and slope."""
    per = fit.groupBy(recording).agg(F.avg("r2").alias("r2"), F.avg("b").alias("b"), F.avg("chi").alias("chi"))
    best = per.agg(F.min_by(F.struct(recording, "r2", "b", "chi"), F.struct(-F.col("r2"), F.col(recording))).alias("p"))
    return best.select("p.*")


def fitted_curve(psd: DataFrame, representative: DataFrame, recording: str = "recording_id") -> DataFrame:
    """Mean spectrum of the representative recording beside its fitted 1/f curve."""
    rows = psd.join(F.broadcast(representative), recording)
    return rows.where(F.col("freq") > 0).groupBy(recording, "freq").agg(
        F.avg("psd").alias("psd"), F.max(F.pow(F.lit(10.0), F.col("b")) / F.pow("freq", "chi")).alias("fit")
    )
