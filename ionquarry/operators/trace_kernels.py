"""Kernels over one trace (numpy arrays of equal length): smoothing, baselines, peak picking, peak details.

A trace is rt, mz, y (intensity) in order of rt. Peaks are dicts of positions and measures. All kernels are total: an
empty trace has no peaks, a flat one no maxima.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ionquarry.operators.chrom import gaussian_weights, savgol_weights

#: Default signal level below a peak when neither baseline nor edges are above 0.
LAST_LEVEL = 10.0
#: Shifts of traces of more points than this, both together, are correlated by Fourier transforms.
LONG = 4096


@dataclass(frozen=True)
class Picking:
    """Peak picking options; ``baseline``: drop_top, or max or median of the smoothed intensity outside peaks."""

    smoother: str = "gaussian"
    smoothing: int = 5
    baseline_smoothing: int = 5
    drop_top: float = 80.0
    bounds: bool = True
    edges: bool = False
    rt_fraction: float = -1.0
    slope: float = -1.0
    baseline: str = "drop_top"
    to_raw_apex: bool = False


@lru_cache(maxsize=1024)
def _weights(half: tuple[float, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The symmetric kernel, and the sum of its parts that lie inside a trace of ``n`` points, for each point."""
    kernel = np.array(half[:0:-1] + half)
    return kernel, np.convolve(np.ones(n), kernel)[len(half) - 1 : len(half) - 1 + n]


def convolved(y: np.ndarray, half: list[float]) -> np.ndarray:
    """Weighted means with a symmetric kernel, of which parts outside the trace are left out; in single precision, so that a flat trace stays flat."""
    kernel, weight = _weights(tuple(half), len(y))
    return (np.convolve(y, kernel)[len(half) - 1 : len(half) - 1 + len(y)] / weight).astype(np.float32).astype(float)


def gaussian(y: np.ndarray, window: int) -> np.ndarray:
    return convolved(y, gaussian_weights(window))


def moving_average(y: np.ndarray, window: int) -> np.ndarray:
    return convolved(y, [1.0] * (max(window, 1) // 2 + 1))


def savgol(y: np.ndarray, window: int, order: int = 4) -> np.ndarray:
    """Least-squares smoothing; points without a whole window are copied, negative results are 0."""
    if len(y) < 2 * window + 1 or 2 * window < order:
        return y.copy()
    weights = savgol_weights(window, window, order)
    out = y.copy()
    inner = np.convolve(y, np.array([weights[k] for k in range(-window, window + 1)])[::-1], "valid")
    out[window : len(y) - window] = np.maximum(inner, 0)
    return out


def smoothed(y: np.ndarray, window: int, smoother: str = "gaussian") -> np.ndarray:
    """The trace smoothed over a window of at most a third of it; as it is for one point or none."""
    window = min(window, len(y) // 3)
    if window <= 1:
        return y.copy()
    return {"gaussian": gaussian, "average": moving_average, "savgol": savgol}[smoother](y, window)


def baseline(y: np.ndarray, window: int, drop_top: float) -> tuple[np.ndarray, float]:
    """The trace clipped at a quantile and smoothed, and that quantile; -1 and no clipping where drop_top is not in 0..100."""
    cut = -1.0
    if 0 <= drop_top <= 100 and len(y):
        cut = float(np.sort(y)[min(int(len(y) * (100 - drop_top) / 101), len(y) - 1)])
    held = np.minimum(y, cut) if cut >= 0 else y
    return gaussian(held, window) if len(y) else held, cut


def maxima(s: np.ndarray | list[float], plateaus: bool = True) -> list[int]:
    """Points above both neighbours; of a plateau with a rise before and a fall after it, the last point."""
    out, i, n = [], 1, len(s)
    while i < n - 1:
        if s[i] > s[i - 1]:
            j = i
            while plateaus and j < n - 1 and s[j + 1] == s[i]:
                j += 1
            if j < n - 1 and s[j] > s[j + 1]:
                out.append(j)
            i = j
        i += 1
    return out


def global_maximum(s: np.ndarray) -> list[int]:
    """The highest of the strict maxima, if it is higher than the first point; of equal ones the first."""
    best = 0
    for i in maxima(s, plateaus=False):
        if s[i] > s[best]:
            best = i
    return [best] if best else []


def _descent(i: int, step: int, rt: list[float], y: list[float], s: list[float], tops: set[int], threshold: float, slope: float) -> tuple[int, int | None]:
    """From the maximum at ``i`` down one side: the bound, and the half-height index if half height was reached."""
    n, at = len(y), i + step
    if not 0 <= at < n:
        return i, None
    bound = half = at
    reached = False
    while y[at] >= threshold and at not in tops:
        # to the left, the point itself is tested; to the right, the one stored last, so its index lies below half height
        reached = reached or s[at if step < 0 else half] < 0.5 * s[i]
        if not reached:
            half = at
        if s[at] < s[bound]:
            bound = at
        ahead = at + step
        if not 0 <= ahead < n:
            break
        if slope > 0:
            fall = s[at] - s[ahead]
            if fall < 1e-10 or fall / s[i] / abs(rt[at] - rt[ahead]) < slope:
                bound = at
                break
        at = ahead
    return bound, half if reached else None


def pick(rt: np.ndarray, mz: np.ndarray, y: np.ndarray, o: Picking = Picking()) -> list[dict]:
    """Peaks of the trace with bounds by descent, details and rank, in order of rt; edges as ``o.edges`` says."""
    n = len(y)
    if not n:
        return []
    s = smoothed(y, o.smoothing, o.smoother)
    base, cut = baseline(y, o.baseline_smoothing, o.drop_top)
    # single points of lists are read faster than those of arrays
    times, raw, smooth = rt.tolist(), y.tolist(), s.tolist()
    tops = [i for i in maxima(smooth, plateaus=False) if raw[i] > cut]
    if not o.bounds:
        return [{"pos": i, "rt": times[i]} for i in tops]
    if o.edges and n >= 3:
        tops = [0] * bool(s[0] > s[1]) + tops + [n - 1] * bool(s[-1] > s[-2])
    peaks, marked = [], set(tops)
    for i in tops:
        threshold = max(cut, o.rt_fraction * raw[i]) if 0 < o.rt_fraction < 1 else cut
        left, half_left = _descent(i, -1, times, raw, smooth, marked, threshold, o.slope)
        right, half_right = _descent(i, 1, times, raw, smooth, marked, threshold, o.slope)
        whole = half_left is not None and half_right is not None
        peaks.append({"pos": i, "minpos": left, "maxpos": right, "half_left": half_left if whole else 0, "half_right": half_right if whole else 0})
    if o.baseline != "drop_top" and peaks:
        base = non_peak_baseline(y, s, base, peaks, o)
    return ranked([details(p, rt, mz, y, s, base, o.to_raw_apex) for p in peaks])


def non_peak_baseline(y: np.ndarray, s: np.ndarray, base: np.ndarray, peaks: list[dict], o: Picking) -> np.ndarray:
    """The baseline from the smoothed intensity outside all peaks; as it was where peaks cover all."""
    free = np.ones(len(y), bool)
    for p in peaks:
        free[p["minpos"] : p["maxpos"] + 1] = False
    if not free.any():
        return base
    cut = s[free].max() if o.baseline == "non_peak_max" else np.median(s[free])
    return gaussian(np.minimum(y, cut), o.baseline_smoothing)


def ranked(peaks: list[dict]) -> list[dict]:
    """Peaks in order of rt, with rank, from 0, by fractional corrected area."""
    for k, p in enumerate(sorted(peaks, key=lambda p: (-p["area_fractional"], p["pos"]))):
        p["rank"] = k
    return sorted(peaks, key=lambda p: (p["rt"], p["pos"]))


def pattern(y: np.ndarray, base: np.ndarray) -> str:
    """For each point 0 at or below the baseline, + where it rises, - where it falls, else as the point before."""
    out, last = "", y[0] if len(y) else 0.0
    for v, b in zip(y, base, strict=True):
        same = out[-1] if len(out) > 1 else "0"
        out += "0" if v <= b else "+" if v > last else "-" if v < last else same
        last = v
    return out


def longest_symmetry(text: str, x: str = "+", y: str = "-") -> int:
    """Twice the shorter of the runs of x and y that meet, at the place where that is largest."""
    best = 0
    for i in range(len(text) - 1):
        if text[i] == x and text[i + 1] == y:
            before = len(text[: i + 1]) - len(text[: i + 1].rstrip(x))
            after = len(text[i + 1 :]) - len(text[i + 1 :].lstrip(y))
            best = max(best, 2 * min(before, after))
    return best


def longest_stretch(text: str, c: str) -> int:
    return max((len(run) for run in "".join(k if k == c else " " for k in text).split()), default=0)


def switches(text: str, x: str | None = None, y: str | None = None) -> int:
    """Changes from one character to another: all of them, those from x, or those from x to y."""
    return sum(a != b and x in (None, a) and y in (None, b) for a, b in zip(text, text[1:], strict=False))


def noisiness(text: str) -> float:
    """Share of zeros, dips and drops to zero between the first and the last character that is not 0; 0 without any."""
    core = text.strip("0")
    if not core:
        return 0.0
    return sum(a == "0" or a + b in ("-+", "+0") for a, b in zip(core, core[1:] + " ", strict=True)) / len(core)


def gaussian_fit(y: np.ndarray) -> tuple[float, float]:
    """(sigma, error) of the best Gaussian around the middle point, sigma from 20 down in steps of 1.25; (0, 0.03) where none fits."""
    n = len(y)
    if n < 3:
        return 0.0, 0.03
    low, high = min(y[0], y[-1]), max(y[n // 2 - 1 : n // 2 + 2])
    if np.count_nonzero(y > low) <= 3 or high <= low:
        return 0.0, 0.03
    x, seen = np.arange(n) - n // 2, np.maximum((y - low) / (high - low), 0)
    sigma, best, least = 20.0, 0.0, math.inf
    for _ in range(21):
        error = float(((np.exp(-0.5 * (x / sigma) ** 2) - seen) ** 2).sum())
        if error >= least:
            break
        best, least, sigma = sigma, error, sigma / 1.25
    return best, least / (n * n)


def _leading(flags: np.ndarray) -> int:
    """How many of the first flags are true."""
    k = int(flags.argmin()) if len(flags) else 0
    return len(flags) if len(flags) and flags[k] else k


def details(peak: dict, rt: np.ndarray, mz: np.ndarray, y: np.ndarray, s: np.ndarray, base: np.ndarray, to_raw_apex: bool = False) -> dict:
    """``peak`` with its areas, levels, m/z and shape measures; its apex moves to the highest raw point if asked."""
    lo, hi, pos = peak["minpos"], peak["maxpos"], peak["pos"]
    if to_raw_apex:
        top = lo + int(np.argmax(y[lo : hi + 1]))
        pos = top if y[top] > y[pos] else pos
    own, under = slice(lo, hi + 1), base[lo : hi + 1]
    edges = sorted((y[lo], y[hi]))
    level = next((float(v) for v in (base[pos], *edges) if v > 0), LAST_LEVEL)
    total = np.add.reduce
    area, under_area, s_area = float(total(y[own])), float(total(under)), float(total(s[own]))
    around = slice(max(pos - 1, 0), pos + 2)
    clear = y > base
    width = 1 + _leading(clear[lo + 1 : pos][::-1]) + _leading(clear[pos + 1 : hi])
    masses = mz[own]
    masses = masses[masses > 0]
    half = slice(peak.get("half_left", 0), peak.get("half_right", 0) + 1)
    has_half = peak.get("half_left", 0) > 0 and peak.get("half_right", 0) > 0
    reach = min(pos - lo, hi - pos)
    sigma, error = gaussian_fit(y[pos - reach : pos + reach + 1]) if reach >= 3 else (0.0, 0.03)
    return peak | {
        "pos": pos, "rt": float(rt[pos]), "rtmin": float(rt[lo]), "rtmax": float(rt[hi]), "mz": float(mz[pos]),
        "intensity": float(y[pos]), "smoothed": float(s[pos]), "area": area, "smoothed_area": s_area, "area_corrected": area - under_area,
        "area_fractional": (area - under_area) / (float(total(y)) + 1), "area_top": float(total(y[around]) / len(y[around])), "smoothed_area_top": float(total(s[around]) / len(y[around])),
        "area_fwhm": float(total(y[half])) if has_half else 0.0, "smoothed_area_fwhm": float(total(s[half])) if has_half else 0.0,
        "baseline": level, "signal_to_noise": float(y[pos]) / level, "smoothed_signal_to_noise": float(s[pos]) / level,
        "no_noise": int(np.count_nonzero(clear[own])), "no_noise_fraction": float(np.count_nonzero(clear[own])) / (int(np.count_nonzero(clear)) + 1), "width": width,
        "mz_median": float(np.median(masses)) if len(masses) else float(mz[pos]), "mz_mean": float(masses.mean()) if len(masses) else 0.0,
        "mz_min": float(masses.min()) if len(masses) else 0.0, "mz_max": float(masses.max()) if len(masses) else 0.0,
        "symmetry": longest_symmetry(pattern(y[own], under)) if width >= 5 else 0, "sigma": sigma, "fit_error": error,
    }


def walked_bounds(pos: int, y: np.ndarray, s: np.ndarray, base: np.ndarray) -> tuple[int, int, int]:
    """(apex, left, right) by walking from ``pos`` to a second rise by over 1 %, zero, the baseline or 1 % of the apex."""
    n, ends = len(y), []
    for step in (-1, 1):
        at = end = pos + step
        rises, last = 0, s[pos]
        while 0 < at < n:
            rises = rises + 1 if last and (s[at] - last) / last > 0.01 else 0
            if y[at] <= y[end]:
                end = at
            if s[at] == 0 or s[at] <= base[at] or s[at] <= 0.01 * s[pos] or rises >= 2:
                break
            last, at = s[at], at + step
        ends.append(min(max(end, 0), n - 1))
    left, right = ends
    inside = y[left:right]
    if len(inside) and inside.max() > y[pos]:
        pos = left + int(inside.argmax())
    while left < pos and y[left] <= 0 and left + 1 < pos:
        left += 1
    while right > pos and y[right] <= 0 and right - 1 > pos:
        right -= 1
    return pos, max(left if left != pos else pos - 1, 0), min(right if right != pos else pos + 1, n - 1)


def simple_peaks(rt: np.ndarray, mz: np.ndarray, y: np.ndarray, o: Picking = Picking(), least: float = 0.0, single: bool = False) -> list[dict]:
    """Maxima of the smoothed trace (of at least ``least``, or only the highest) with walked bounds, less those that others cover."""
    if len(y) < 3:
        return []
    s, (base, _) = smoothed(y, o.smoothing, o.smoother), baseline(y, o.baseline_smoothing, o.drop_top)
    tops = global_maximum(s) if single else [i for i in maxima(s) if s[i] >= least]
    found = []
    for i in tops:
        pos, lo, hi = walked_bounds(i, y, s, base)
        found.append(details({"pos": pos, "minpos": lo, "maxpos": hi}, rt, mz, y, s, base))
    return ranked(without_covered(found))


def overlap(a0: float, a1: float, b0: float, b1: float) -> float:
    """Shared over joint length; 1 if either interval holds the other, 0 if they lie apart."""
    if (a0 <= b0 and a1 >= b1) or (b0 <= a0 and b1 >= a1):
        return 1.0
    shared = min(a1, b1) - max(a0, b0)
    return shared / (max(a1, b1) - min(a0, b0)) if shared > 0 else 0.0


def without_covered(peaks: list[dict], most: float = 0.95) -> list[dict]:
    """Without peaks that overlap one of larger area (of equal ones, an earlier one) by more than ``most``."""
    rank = sorted(range(len(peaks)), key=lambda i: (-peaks[i]["area"], i))
    out: list[int] = []
    for i in rank:
        p = peaks[i]
        if all(overlap(p["rtmin"], p["rtmax"], peaks[j]["rtmin"], peaks[j]["rtmax"]) <= most for j in out):
            out.append(i)
    return [peaks[i] for i in sorted(out)]


def interpolated(y: np.ndarray) -> np.ndarray:
    """Zeros between points above 0 on the line between these."""
    some = np.flatnonzero(y > 0)
    if len(some) < 2:
        return y.copy()
    out, inner = y.astype(float), np.arange(some[0], some[-1] + 1)
    out[inner] = np.interp(inner, some, y[some])
    return out


def centroided(y: np.ndarray, mz: np.ndarray) -> list[tuple[float, float]]:
    """(mz, intensity) of the strict maxima of a profile smoothed twice (order 2, half window of a 20th, 2 to 10 points)."""
    n = len(y)
    if n < 5:
        return []
    half = n // 20
    half = 2 if half < 1 else min(half, 10)
    if n < 2 * half + 1:
        half = (n - 1) // 2
    s = savgol(savgol(y, half, 2), half, 2)
    tops = [i for i in range(1, n - 2) if s[i] > s[i - 1] and s[i] > s[i + 1]]
    return [(float(mz[i]), float(max(y[i - 1 : i + 2]))) for i in tops]


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (x, y), x growing, at the points ``at``; straight for two points."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    system = np.eye(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
    right = np.zeros(n)
    right[1:-1] = 6 * (np.diff(y)[1:] / h[1:] - np.diff(y)[:-1] / h[:-1])
    bend = np.linalg.solve(system, right)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    d, e = at - x[k], x[k + 1] - at
    return (bend[k] * e**3 + bend[k + 1] * d**3) / (6 * h[k]) + (y[k] / h[k] - bend[k] * h[k] / 6) * e + (y[k + 1] / h[k] - bend[k + 1] * h[k] / 6) * d


def power_spectrum(y: np.ndarray) -> np.ndarray:
    """Squared magnitudes of the Fourier coefficients of the trace, padded with zeros to a power of two."""
    size = 1 << max(0, (len(y) - 1).bit_length())
    return np.abs(np.fft.rfft(y, size)) ** 2


def _shifted_by_fft(x: np.ndarray, y: np.ndarray, shifts: np.ndarray) -> float:
    """``shifted_correlation_z`` of two centred traces: the sums of all shifts at once, norms from running sums of squares."""
    size = 1 << (len(x) + len(y) - 1).bit_length()
    sums = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y[::-1], size), size)[shifts]
    yp, xp = np.clip(len(y) - shifts - 1, 0, len(y) - 1), np.clip(shifts - len(y) + 1, 0, len(x) - 1)
    n = np.minimum(len(x) - xp, len(y) - yp)
    x2, y2 = np.r_[0.0, np.cumsum(x * x)], np.r_[0.0, np.cumsum(y * y)]
    scale = np.sqrt(np.maximum((x2[xp + n] - x2[xp]) * (y2[yp + n] - y2[yp]), 0.0))
    r = np.divide(sums, scale, out=np.zeros(len(sums)), where=scale > 0)
    apart = (xp > 0) | (yp > 0)
    return min((float(r[~apart].sum()) - float(r[apart].mean())) / 0.05, 100.0) if apart.any() else 0.0


def shifted_correlation_z(x: np.ndarray, y: np.ndarray, offset: float = 0.45) -> float:
    """How far the correlation of two traces exceeds its mean over shifts, in steps of 0.05, 100 at most; 0 without shifts."""
    if not len(x) or not len(y):
        return 0.0
    x, y, total = x - x.mean(), y - y.mean(), len(x) + len(y) - 1
    if total > LONG:
        return _shifted_by_fft(x, y, np.arange(int(offset * total), math.ceil(total * (1 - offset))))
    seen, expected = 0.0, []
    for i in range(int(offset * total), math.ceil(total * (1 - offset))):
        yp, xp = min(max(len(y) - i - 1, 0), len(y) - 1), min(max(i - len(y) + 1, 0), len(x) - 1)
        n = min(len(x) - xp, len(y) - yp)
        a, b = x[xp : xp + n], y[yp : yp + n]
        scale = math.sqrt(float((a * a).sum() * (b * b).sum()))
        r = float((a * b).sum()) / scale if scale else 0.0
        if xp or yp:
            expected.append(r)
        else:
            seen = r
    return min((seen - float(np.mean(expected))) / 0.05, 100.0) if expected else 0.0
