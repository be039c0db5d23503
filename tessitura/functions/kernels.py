"""NumPy kernels for the steps that are filter banks or inherently sequential. No Spark here.

Filter banks use |DTFT|^2 as one matrix product over strided frames; it equals the Goertzel recurrence.
"""

from __future__ import annotations

import functools

import numpy as np

from .profiles import template

EPS = 1.1920929e-07


def frames_of(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


@functools.lru_cache(maxsize=16)
def _bands(size: int, rate: float) -> np.ndarray:
    f = 50.0 * (11000.0 / 50.0) ** (np.arange(24) / 23)
    turn = 2 * np.pi * np.outer(np.arange(size), f) / rate
    return np.concatenate([np.cos(turn), np.sin(turn)], 1) * hann(size)[:, None]


def onset_envelope(x: np.ndarray, size: int = 1024, hop: int = 512, band_rate: float = 44100.0) -> np.ndarray:
    """Rectified flux of 24 band magnitudes, the first frame against silence, less a quarter of its mean."""
    fr = frames_of(np.where(np.isfinite(x), x, 0.0), size, hop)
    if not len(fr):
        return np.zeros(0)
    both = fr @ _bands(size, band_rate)
    mag = np.hypot(both[:, :24], both[:, 24:])
    flux = np.maximum(np.diff(mag, axis=0, prepend=np.zeros((1, 24))), 0).sum(1)
    return np.maximum(flux - 0.25 * flux.mean(), 0)


def autocorrelation(x: np.ndarray, lag: int) -> float:
    if lag == 0:
        return 1.0
    a, b = x[lag:], x[:-lag]
    return float((a * b).sum() / max(np.sqrt((a * a).sum() * (b * b).sum()), EPS))


def interval_histogram(x: np.ndarray, low: int, high: int) -> np.ndarray:
    out = np.zeros(high + 1)
    mid = x[1:-1]
    peak = 1 + np.flatnonzero((mid > x.mean() + 0.5 * x.std()) & (mid >= x[:-2]) & (mid > x[2:]))
    for d in range(1, len(peak)):
        gap = peak[d:] - peak[:-d]
        on = (gap >= low) & (gap <= high)
        if gap.min() > high:
            break
        np.add.at(out, gap[on], np.sqrt(x[peak[d:]] * x[peak[:-d]])[on])
    return out


def estimate_tempo(x: np.ndarray, rate: float, min_bpm: float = 60.0, max_bpm: float = 200.0):
    """(bpm, confidence) or None."""
    if len(x) < 4 or (x <= EPS).all():
        return None
    low, high = max(1, int(np.ceil(60 * rate / max_bpm))), min(int(60 * rate / min_bpm), len(x) - 1)
    if low > high:
        return None
    corr = np.array([autocorrelation(x, k) for k in range(min(high + 2, len(x) - 1) + 1)])
    hist = interval_histogram(x, low, high)
    top = max(hist.max(), EPS)
    base = np.zeros(high + 1)
    for k in range(low, high + 1):
        a, b = max(k - 1, 1), min(k + 1, high)
        base[k] = 0.65 * hist[a : b + 1].sum() / top + 0.35 * max(corr[a : b + 1].max(), 0)
    lags = np.arange(low, high + 1)
    score = base[lags].copy()
    for times, w in ((2, 0.35), (3, 0.15)):
        ok = lags * times <= high
        score[ok] += base[lags[ok] * times] * w
    for num, den, w in ((3, 2, 0.25), (4, 3, 0.20)):
        sub = lags * num // den
        ok = (sub >= low) & (sub <= high)
        score[ok] += base[sub[ok]] * w
    score *= 0.75 + 0.25 * np.exp(-(np.log2(60 * rate / lags / 120) ** 2) / 8)
    best = len(score) - 1 - int(np.argmax(score[::-1]))
    lag = resolve_subharmonic(int(lags[best]), float(score[best]), 60 * rate / lags[best], low, high, dict(zip(lags.tolist(), score.tolist())))
    final = float(score[lag - low])
    rest = score[np.abs(lags - lag) > 2]
    second = max(float(rest.max()) if len(rest) else 0.0, 0.0)
    near = np.arange(max(lag - 1, low), min(lag + 1, high) + 1)
    period = float((hist[near] * near).sum() / hist[near].sum()) if hist[near].sum() > EPS else float(lag)
    bpm = float(np.clip(60 * rate / period, min_bpm, max_bpm))
    apart = np.clip((final - second) / final, 0, 1) if final > EPS else 0.0
    sure = np.clip(corr[min(lag, len(corr) - 1)], 0, 1) * (0.75 + 0.25 * apart) * np.clip(np.sqrt((x * x).sum() / len(x)) * 100, 0, 1)
    return bpm, float(np.clip(sure, 0, 1))


def resolve_subharmonic(lag: int, score: float, bpm: float, low: int, high: int, scores: dict[int, float]) -> int:
    """A slower lag (3/2, then 4/3) in place of a fast best one, if its support is close."""
    if bpm <= 135:
        return lag
    now, kept = score, lag
    for num, den in ((3, 2), (4, 3)):
        other = lag * num // den
        s = scores.get(other)
        if low <= other <= high and s is not None and s > 0.7 * score and s > 0.9 * now:
            now, kept = s, other
    return kept


def track_beats(onset: np.ndarray, bpm: float, rate: float) -> np.ndarray:
    """Beat frames: dynamic programming over predecessors within a quarter of the period."""
    period = 60 * rate / bpm
    n = len(onset)
    if period < 1 or not n:
        return np.zeros(0, int)
    whole, reach = int(np.floor(period + 0.5)), int(np.floor(period * 0.25 + 0.5))
    total = np.zeros(n)
    back = np.zeros(n, int)
    start = min(2 * whole, n)
    total[:start] = onset[:start]
    back[:start] = np.arange(start)
    for i in range(max(0, whole - reach), n):
        a, b = max(0, i - whole - reach), min(max(0, i - max(0, whole - reach)), i)
        if b <= a:
            continue
        gap = i - np.arange(a, b) - period
        s = total[a:b] + 0.5 * np.exp(-(gap * gap) / (2 * (0.5 * period) ** 2))
        k = int(np.argmax(s))
        if onset[i] + s[k] > total[i]:
            total[i], back[i] = onset[i] + s[k], a + k
    tail = max(0, n - 2 * whole)
    at = n - 1 - int(np.argmax(total[tail:][::-1]))
    out = [at]
    while back[at] < at:
        at = back[at]
        out.append(at)
    return np.array(out[::-1])


def downbeat_phase(onset: np.ndarray, beats: np.ndarray) -> int:
    if len(beats) < 4:
        return 0
    return int(np.argmax([onset[beats[p::4]].sum() for p in range(4)]))


def bar_positions(n: int, phase: int) -> np.ndarray:
    return (np.arange(n) + 4 - phase) % 4 + 1


def tempo_segments(onset: np.ndarray, rate: float, duration: float, whole, window: float = 12.0, hop: float = 6.0, change: float = 0.04, bounds=(60.0, 200.0)):
    """(start, end, bpm, confidence) of runs of windows whose tempo stays near the window's before."""
    w, h = int(np.floor(window * rate + 0.5)), int(np.floor(hop * rate + 0.5))
    if w <= 0 or h <= 0 or len(onset) < w + h:
        return [(0.0, duration, *whole)]
    local = []
    for a in range(0, len(onset) - w + 1, h):
        t = estimate_tempo(onset[a : a + w], rate, *bounds)
        if t:
            local.append(((a + w / 2) / rate, *t))
    if not local:
        return [(0.0, duration, *whole)]
    groups = [[local[0]]]
    for before, now in zip(local, local[1:]):
        (groups.append([now]) if abs(now[1] - before[1]) / max(before[1], 1.0) > change else groups[-1].append(now))
    out = []
    for i, g in enumerate(groups):
        a = 0.0 if i == 0 else (groups[i - 1][-1][0] + g[0][0]) / 2
        b = duration if i == len(groups) - 1 else (g[-1][0] + groups[i + 1][0][0]) / 2
        out.append((a, b, float(np.mean([x[1] for x in g])), float(np.mean([x[2] for x in g]))))
    return out


def bpm_matches(a: float, b: float, ratio: float) -> bool:
    return abs(a - b) / max(abs(a), abs(b), EPS) <= ratio


def alternate_tempo(segments, primary: float, ratio: float = 0.04, least: float = 0.25):
    """(bpm, coverage) of the longest cluster of segments away from the primary tempo, or None."""
    if least <= 0 or not segments:
        return None
    total = sum(max(0.0, s[1] - s[0]) for s in segments)
    clusters: list[list[float]] = []
    for a, b, bpm, *_ in segments:
        d = max(0.0, b - a)
        if d <= 2.2e-16 or bpm_matches(bpm, primary, ratio):
            continue
        for c in clusters:
            if bpm_matches(c[0], bpm, ratio):
                c[0], c[1] = (c[0] * c[1] + bpm * d) / (c[1] + d), c[1] + d
                break
        else:
            clusters.append([bpm, d])
    if total <= 2.2e-16 or not clusters:
        return None
    best = max(reversed(clusters), key=lambda c: c[1])
    cover = best[1] / total
    return (best[0], cover) if cover + EPS >= least else None


def display_bpm(bpm: float, times: np.ndarray) -> float:
    """The whole number next to bpm whose grid the beats fit better."""
    if len(times) < 4:
        return float(np.floor(bpm + 0.5))

    def misfit(candidate: float) -> float:
        off = times - np.arange(len(times)) * 60.0 / candidate
        return float(np.abs(off - np.sort(off)[len(off) // 2]).mean())

    low, high = float(np.floor(bpm)), float(np.ceil(bpm))
    return low if low > 0 and misfit(low) <= misfit(high) else high


# ---- key ------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=16)
def note_bank(rate: int, size: int, low: int = 36, high: int = 95):
    """(basis, matrix): magnitudes of frame @ basis, folded by matrix to 12 classes with harmonics and weights."""
    midi = np.arange(low, high + 1)
    f = 440.0 * 2.0 ** ((midi - 69) / 12)
    midi, f = midi[f < 0.45 * rate], f[f < 0.45 * rate]
    turn = 2 * np.pi * np.outer(np.arange(size), f) / rate
    w = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / max(size - 1, 1)))[:, None]
    weight = 1 / np.sqrt(f)
    fold = np.zeros((len(midi), 12))
    place = {m: i for i, m in enumerate(midi.tolist())}
    share = np.zeros(12)
    for i, m in enumerate(midi.tolist()):
        share[m % 12] += weight[i]
        for step, part in ((0, 1.0), (12, 0.5), (19, 0.33), (24, 0.25)):
            if m + step in place:
                fold[place[m + step], m % 12] += part * weight[i]
    return np.concatenate([np.cos(turn), np.sin(turn)], 1) * w, fold / np.where(share > EPS, share, 1)


@functools.lru_cache(maxsize=8)
def constant_q(rate: int, low: int = 36, high: int = 95):
    """(class, window length, kernel of cosines and sines) for each note."""
    q = 1 / (2 ** (1 / 12) - 1)
    out = []
    for m in range(low, high + 1):
        f = 440.0 * 2.0 ** ((m - 69) / 12)
        n = min(int(np.ceil(q * rate / f)), rate)
        if f < 0.45 * rate and n >= 4:
            turn = 2 * np.pi * f / rate * np.arange(n)
            out.append((m % 12, n, np.stack([np.cos(turn), np.sin(turn)], 1) * hann(n)[:, None]))
    return out


def constant_q_chroma(x: np.ndarray, centers: np.ndarray, rate: int, low: int = 36, high: int = 95) -> np.ndarray:
    """Power by pitch class at each center; a note's window that starts before 0 is moved to 0."""
    out = np.zeros((len(centers), 12))
    for pc, n, kernel in constant_q(rate, low, high):
        start = np.maximum(centers - n // 2, 0)
        size = np.minimum(start + n, len(x)) - start
        full = np.flatnonzero(size == n)
        if len(full):
            at = np.lib.stride_tricks.sliding_window_view(x, n)[start[full]]
            p = at @ kernel
            out[full, pc] += (p * p).sum(1) / (n * n)
        for i in np.flatnonzero((size < n) & (size >= n // 2) & (size > 0)):
            p = x[start[i] : start[i] + size[i]] @ kernel[: size[i]]
            out[i, pc] += (p * p).sum() / (size[i] * size[i])
    return out


def l1(v: np.ndarray) -> np.ndarray:
    s = v.sum(-1, keepdims=True)
    return np.where(s > EPS, v / np.where(s > EPS, s, 1), v)


def white(v: np.ndarray) -> np.ndarray:
    return l1(np.where(v > 0, np.sqrt(np.maximum(v, 0)), v))


def chroma_frames(x: np.ndarray, rate: int, size: int = 4096, hop: int = 2048, low: int = 36, high: int = 95):
    """(center seconds, chroma, energy) of the frames that are not silent."""
    if rate == 0 or size < 32 or hop == 0 or len(x) < size or low > high:
        return np.zeros(0), np.zeros((0, 12)), np.zeros(0)
    clean = np.where(np.isfinite(x), x, 0.0)
    fr = frames_of(clean, size, hop)
    energy = (fr * fr).sum(1) / size
    keep = np.flatnonzero(energy > 1e-8)
    basis, fold = note_bank(rate, size, low, high)
    both = fr[keep] @ basis
    half = both.shape[1] // 2
    g = white(np.hypot(both[:, :half], both[:, half:]) @ fold)
    c = white(constant_q_chroma(clean, keep * hop + size // 2, rate, low, high))
    out = np.where(c.sum(1, keepdims=True) > EPS, l1((g + c) / 2), g)
    return (keep * hop + size / 2) / rate, out, energy[keep]


def tuning(chroma: np.ndarray) -> float:
    p, n = np.roll(chroma, 1, 1), np.roll(chroma, -1, 1)
    den = 2 * chroma - p - n
    on = (chroma > p) & (chroma > n) & (chroma > EPS) & (den > EPS)
    w = chroma[on].sum()
    return float(np.clip((0.5 * (n - p)[on] / den[on] * chroma[on]).sum() / w, -0.5, 0.5)) if w > EPS else 0.0


def shift(v: np.ndarray, offset: float) -> np.ndarray:
    src = np.arange(12) - offset
    lo = np.floor(src)
    a = lo.astype(int) % 12
    return v[a] * (1 - (src - lo)) + v[(a + 1) % 12] * (src - lo)


ORDER = np.array([t + 12 * m for t in range(12) for m in (0, 1)])


def key_scores(v: np.ndarray) -> np.ndarray:
    d = v - v.mean()
    return template() @ (d / max(np.linalg.norm(d), EPS))


def classify(v: np.ndarray):
    """(key, best score, second score)."""
    s = key_scores(v)
    a, b = ORDER[np.argsort(-s[ORDER], kind="stable")[:2]]
    key = a
    relative = (a < 12) != (b < 12) and (min(a, b) + 9) % 12 == max(a, b) - 12
    if s[a] - s[b] <= 0.05 and relative and v[b % 12] > v[a % 12] * 1.2:
        key = b
    return int(key), float(s[a]), float(s[b])


def key_confidence(best: float, second: float) -> float:
    return float(np.clip((best - second) / abs(best), 0, 1)) if abs(best) > EPS else 0.0


def majority(keys: list[int]) -> int:
    """Most frequent; of equals the one that appears first latest."""
    first = list(dict.fromkeys(keys))
    return max(first, key=lambda k: (keys.count(k), first.index(k)))


def merge_short(segments: list[list], least: float) -> list[list]:
    """Rows [start, end, key, confidence]: the first short one joins its longer neighbour, the earlier row's key stays."""
    out = [list(s) for s in segments]
    while len(out) > 1:
        short = next((i for i, s in enumerate(out) if s[1] - s[0] < least), None)
        if short is None:
            break
        if short == 0:
            other = 1
        elif short == len(out) - 1:
            other = short - 1
        else:
            size = lambda s: s[1] - s[0]
            other = short - 1 if size(out[short - 1]) >= size(out[short + 1]) else short + 1
        keep, gone = sorted((short, other))
        out[keep][0], out[keep][1] = min(out[keep][0], out[gone][0]), max(out[keep][1], out[gone][1])
        del out[gone]
    return out


def key_segments(centers, chroma, duration, whole, window=12.0, hop=6.0, sure=0.35, least=12.0):
    if duration < window + hop:
        return [[0.0, duration, *whole]]
    local, a = [], 0.0
    while a + window <= duration:
        on = (centers >= a) & (centers < a + window)
        if on.any():
            k, s1, s2 = classify(l1(chroma[on].sum(0)))
            local.append((a + window / 2, k, key_confidence(s1, s2)))
        a += hop
    if not local:
        return [[0.0, duration, *whole]]
    groups = [[local[0]]]
    for before, now in zip(local, local[1:]):
        (groups.append([now]) if now[1] != before[1] and now[2] >= sure else groups[-1].append(now))
    out = []
    for i, g in enumerate(groups):
        s = 0.0 if i == 0 else (groups[i - 1][-1][0] + g[0][0]) / 2
        e = duration if i == len(groups) - 1 else (g[-1][0] + groups[i + 1][0][0]) / 2
        out.append([s, e, majority([x[1] for x in g]), float(np.mean([x[2] for x in g]))])
    return merge_short(out, least)


def alternate_key(segments, primary: int, least: float = 0.25):
    total = sum(max(0.0, s[1] - s[0]) for s in segments)
    held: dict[int, float] = {}
    for s in segments:
        if s[2] != primary and s[1] > s[0]:
            held[s[2]] = held.get(s[2], 0.0) + s[1] - s[0]
    if least <= 0 or total <= 0 or not held:
        return None
    key = max(reversed(list(held)), key=lambda k: held[k])
    return (key, held[key] / total) if held[key] / total + EPS >= least else None


# ---- matching, peaks, spectrograms, reranker ------------------------------------------------


def match_events(reference, detected, tolerance: float) -> tuple[int, int, int]:
    """(matched, missed, extra): each reference in turn takes the nearest free detection within tolerance."""
    where = np.argsort(np.asarray(detected, float), kind="stable")
    times = np.asarray(detected, float)[where]
    free, hit = np.ones(len(times), bool), 0
    for r in reference:
        # Only the detections within tolerance are looked at, whatever their number elsewhere.
        a, b = np.searchsorted(times, r - 2 * tolerance), np.searchsorted(times, r + 2 * tolerance, "right")
        near = [(abs(times[i] - r), where[i], i) for i in range(a, b) if free[i] and abs(times[i] - r) <= tolerance]
        if near:
            free[min(near)[2]] = False
            hit += 1
    return hit, len(reference) - hit, int(free.sum())


def assign_downbeats(times, activation, hop: int, rate: int) -> np.ndarray:
    """Position in the bar (1..4) of each beat: the phase whose beats have most activation, the first of equals; under four beats, by turn."""
    n = len(times)
    if n < 4:
        return np.arange(n) % 4 + 1
    frame = (np.asarray(times) * rate / hop).astype(int)
    level = np.where(frame < len(activation), np.append(activation, 0.0)[np.minimum(frame, len(activation))], 0.0)
    phase = int(np.argmax([level[p::4].sum() for p in range(4)]))
    return (np.arange(n) + 4 - phase) % 4 + 1


# ---- waveform columns -----------------------------------------------------------------------


def time_balance(x: np.ndarray) -> float:
    level = np.abs(x).sum()
    if len(x) < 2 or level <= EPS:
        return 0.5
    return 0.7 * min(1.0, np.abs(np.diff(x)).sum() / (2 * level)) + 0.3 * float(((x[1:] >= 0) != (x[:-1] >= 0)).mean())


def spectral_balance(x: np.ndarray, rate: int, bands: int = 8) -> float:
    """Energy-weighted place, 0 to 1, among log-spaced bands from 80 Hz."""
    if len(x) < 2:
        return 0.5
    top = min(max(rate / 2, 80.0), 10_000.0)
    if rate == 0 or top <= 80.0:
        return time_balance(x)
    spot = np.arange(bands) / (bands - 1)
    t = np.arange(len(x))
    turn = 2 * np.pi * (80.0 * (top / 80.0) ** spot) / rate
    energy = np.abs(np.exp(-1j * turn[:, None] * t) @ (x * (0.5 - 0.5 * np.cos(2 * np.pi * t / max(len(x) - 1, 1))))) ** 2
    return float(np.clip((energy * spot).sum() / energy.sum(), 0, 1)) if energy.sum() > 2.220446049250313e-16 else time_balance(x)


def display_heights(peak: np.ndarray, rms: np.ndarray) -> np.ndarray:
    """Root of peak times rms over its 95th percentile (half the largest at least), to the power 0.6."""
    energy = np.where((peak <= EPS) | (rms <= EPS), 0.0, np.sqrt(peak * rms))
    if not len(energy) or energy.max() <= EPS:
        return np.zeros(len(energy))
    top = max(np.sort(energy)[int(np.floor((len(energy) - 1) * 0.95 + 0.5))], energy.max() * 0.5)
    return np.where(energy <= EPS, 0.0, np.clip(energy / top, 0, 1) ** 0.6)


def pick_peaks(x: np.ndarray, threshold: float, hop: int, rate: int = 44100) -> list[int]:
    """Local maxima over five frames on each side, at least 0.2 s apart."""
    gap, out = int(0.2 * rate / hop), []
    for i in range(5, len(x) - 5):
        if x[i] >= threshold and x[i] >= x[i - 5 : i + 6].max() and (not out or i - out[-1] >= gap):
            out.append(i)
    return out


def mel_filters(n_mels: int, bins: int, rate: int) -> np.ndarray:
    to = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, to(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.arange(bins) * rate / (2 * (bins - 1))
    up = (f - edge[:-2, None]) / np.maximum(edge[1:-1] - edge[:-2], 1e-12)[:, None]
    down = (edge[2:, None] - f) / np.maximum(edge[2:] - edge[1:-1], 1e-12)[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, n_fft: int, hop: int, n_mels: int, rate: int = 44100) -> np.ndarray:
    fr = frames_of(x, n_fft, hop)
    power = np.abs(np.fft.rfft(fr * hann(n_fft), axis=1)) ** 2 / n_fft
    return np.log(np.maximum(power @ mel_filters(n_mels, power.shape[1], rate).T, 1e-10))


SHAPES = {
    "conv": (3, 3), "conv_b": (3,), "position": (256, 36), "n1": (36,), "n1_b": (36,), "proj": (108, 36), "proj_b": (108,), "out": (36, 36), "out_b": (36,), "n2": (36,), "n2_b": (36,),
    "up": (72, 36), "up_b": (72,), "down": (36, 72), "down_b": (36,), "n": (36,), "n_b": (36,), "head": (24, 36), "head_b": (24,), "prior": (24, 24),
}


def unpack_weights(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The flat little-endian float32 layout, in the order of SHAPES (21,528 numbers)."""
    need = sum(int(np.prod(s)) for s in SHAPES.values())
    if len(flat) != need:
        raise ValueError(f"expected {need} weights, got {len(flat)}")
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = np.asarray(flat[at : at + n], np.float64).reshape(shape)
        at += n
    return out


def _norm(v: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = v - v.mean(-1, keepdims=True)
    v /= np.sqrt(np.einsum("...i,...i->...", v, v)[..., None] / v.shape[-1] + 1e-5)
    v *= g
    v += b
    return v


def _heads(h: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Queries (divided by 3), keys and values of hidden rows: (3, head, ..., row, 9)."""
    p = _norm(h, w["n1"], w["n1_b"]) @ w["proj"].T + w["proj_b"]
    out = np.ascontiguousarray(np.moveaxis(p.reshape(*h.shape[:-1], 3, 4, 9), (-3, -2), (0, 1)))
    out[0] /= 3.0
    return out


def rerank(frames: np.ndarray, scores: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """24 logits from up to 256 chroma frames and the 24 profile scores."""
    return rerank_all(np.asarray(frames)[None], np.asarray(scores)[None], w)[0]


def rerank_all(frames: np.ndarray, scores: np.ndarray, w: dict[str, np.ndarray], chunk: int = 16) -> np.ndarray:
    """(track, 24) logits from (track, frame, 12) chroma and (track, 24) profile scores.

    A track's frames are followed by silence up to 256 rows. What those rows are before attention, and what they attend to in one
    another, is the same for all tracks and computed once; a track adds the attention from and to its own frames.
    """
    frames = frames[:, :256]
    t = frames.shape[1]
    conv_b = np.repeat(w["conv_b"], 12)
    h0 = conv_b + w["position"][t:]
    q0, k0, v0 = _heads(h0, w)
    k0t = k0.transpose(0, 2, 1)
    att = q0 @ k0t
    top0 = att.max(-1, initial=-np.inf)
    att = np.exp(att - top0[..., None])
    sum0, ctx0 = att.sum(-1), att @ v0

    out = np.empty((len(frames), 24))
    for at in range(0, len(frames), chunk):
        f = frames[at : at + chunk]
        n = len(f)
        s = np.abs(f).sum(-1, keepdims=True)
        x = np.where(s > EPS, f / np.where(s > EPS, s, 1), f)
        taps = np.stack([np.roll(x, 1, -1), x, np.roll(x, -1, -1)], -1)
        h = np.empty((n, 256, 36))
        h[:, t:] = h0
        h[:, :t] = (taps @ w["conv"].T).swapaxes(-1, -2).reshape(n, t, 36) + conv_b + w["position"][:t]
        q, k, v = _heads(h[:, :t], w)

        def flat(a):
            return a.reshape(4, n * t, 9)

        ctx = np.empty((n, 256, 4, 9))
        # the track's frames attend to silence and to one another
        far, near = (flat(q) @ k0t).reshape(4, n, t, 256 - t), q @ k.swapaxes(-1, -2)
        top = np.maximum(far.max(-1, initial=-np.inf), near.max(-1, initial=-np.inf))[..., None]
        far, near = np.exp(far - top), np.exp(near - top)
        c = (far.reshape(4, n * t, 256 - t) @ v0).reshape(4, n, t, 9) + near @ v
        ctx[:, :t] = (c / (far.sum(-1) + near.sum(-1))[..., None]).transpose(1, 2, 0, 3)
        # silence attends to the track's frames: (head, track, frame, silent row)
        near = (flat(k) @ q0.transpose(0, 2, 1)).reshape(4, n, t, 256 - t)
        top = np.maximum(top0[:, None], near.max(2, initial=-np.inf))
        near = np.exp(near - top[:, :, None])
        less = np.exp(top0[:, None] - top)
        total = sum0[:, None] * less + near.sum(2)
        c = near.swapaxes(-1, -2) @ v
        c += ctx0[:, None] * less[..., None]
        ctx[:, t:] = (c / total[..., None]).transpose(1, 2, 0, 3)

        h += ctx.reshape(n, 256, 36) @ w["out"].T
        h += w["out_b"]
        up = _norm(h, w["n2"], w["n2_b"]) @ w["up"].T
        up += w["up_b"]
        pooled = h.mean(1) + np.maximum(up, 0, out=up).mean(1) @ w["down"].T + w["down_b"]
        out[at : at + n] = _norm(pooled, w["n"], w["n_b"]) @ w["head"].T + w["head_b"]
    return out + scores @ w["prior"].T
