"""Whole-track analysis: one row of samples in, one nested record out, one Arrow pass, no shuffle.

A task holds one Arrow batch; a track is independent of every other, so skew is bounded by the longest track.
Failures are a column (``error``), never a failed job.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions.keys import ENUM_NAMES

_d, _i, _b, _s = T.DoubleType(), T.IntegerType(), T.BooleanType(), T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


KEY = _struct(tonic=_s, mode=_s)
BEAT = _struct(version=_i, global_bpm=_d, display_bpm=_d, display_bpm_decimals=_i, confidence=_d, beats=T.ArrayType(_struct(time_seconds=_d, confidence=_d, position_in_bar=_i)), tempo_segments=T.ArrayType(_struct(start_seconds=_d, end_seconds=_d, bpm=_d, confidence=_d)), multi_tempo=_b, alternate_bpm=_d, alternate_coverage=_d)
KEYS = _struct(version=_i, key=KEY, confidence=_d, estimator=_s, dsp_key=KEY, chroma=T.ArrayType(_d), segments=T.ArrayType(_struct(start_seconds=_d, end_seconds=_d, key=KEY, confidence=_d)), multi_key=_b, alternate_key=KEY, alternate_coverage=_d)
WAVE = _struct(version=_i, sample_rate=_i, source_samples=T.LongType(), columns=T.ArrayType(_struct(min=_d, max=_d, rms=_d, display_height=_d, spectral_centroid=_d)))
ANALYSIS = _struct(version=_i, duration_seconds=_d, beat=BEAT, key=KEYS, waveform=WAVE)


def key_record(k: int | None):
    return None if k is None else {"tonic": ENUM_NAMES[k % 12], "mode": "Minor" if k >= 12 else "Major"}


def analyze_beats(x: np.ndarray, rate: int, size: int = 1024, hop: int = 512, bounds=(60.0, 200.0), coverage: float = 0.25) -> dict:
    empty = {"version": 4, "global_bpm": None, "display_bpm": None, "display_bpm_decimals": 0, "confidence": 0.0, "beats": [], "tempo_segments": [], "multi_tempo": False, "alternate_bpm": None, "alternate_coverage": 0.0}
    if rate == 0 or hop == 0 or len(x) < 2 * size or bounds[0] <= 0 or bounds[1] <= bounds[0]:
        return empty
    env, r, duration = K.onset_envelope(x, size, hop), rate / hop, len(x) / rate
    got = K.estimate_tempo(env, r, *bounds)
    if got is None:
        return empty
    frames = K.track_beats(env, got[0], r)
    times = frames * hop / rate
    pos = K.bar_positions(len(frames), K.downbeat_phase(env, frames))
    keep = times <= duration
    segs = K.tempo_segments(env, r, duration, got, bounds=bounds)
    other = K.alternate_tempo(segs, got[0], least=coverage)
    return empty | {
        "global_bpm": got[0], "display_bpm": K.display_bpm(got[0], times[keep]), "confidence": got[1],
        "beats": [{"time_seconds": float(t), "confidence": got[1], "position_in_bar": int(p)} for t, p in zip(times[keep], pos[keep])],
        "tempo_segments": [dict(zip(("start_seconds", "end_seconds", "bpm", "confidence"), s)) for s in segs],
        "multi_tempo": other is not None, "alternate_bpm": other and other[0], "alternate_coverage": other[1] if other else 0.0,
    }


def analyze_key(x: np.ndarray, rate: int, size: int = 4096, hop: int = 2048, window: float = 12.0, step: float = 6.0, sure: float = 0.35, least: float = 12.0, coverage: float = 0.25) -> dict:
    empty = {"version": 7, "key": None, "confidence": 0.0, "estimator": "dsp", "dsp_key": None, "chroma": [0.0] * 12, "segments": [], "multi_key": False, "alternate_key": None, "alternate_coverage": 0.0}
    centers, chroma, energy = K.chroma_frames(x, rate, size, hop) if window > 0 and step > 0 else (np.zeros(0),) * 3
    if not len(centers):
        return empty
    root = np.sqrt(energy)
    weight = 1 + 4 * np.maximum(0, np.diff(root, prepend=root[:1]))
    mid = np.sort(chroma * weight[:, None], axis=0)[len(chroma) // 2]
    off = K.tuning(chroma)
    if abs(off) > 0.01:
        mid = K.shift(mid, off)
    mid = K.l1(mid)
    key, best, second = K.classify(mid)
    whole = (key, K.key_confidence(best, second))
    segs = K.key_segments(centers, chroma, len(x) / rate, whole, window, step, sure, least)
    if len(segs) > 1:
        key = max(enumerate(segs), key=lambda s: (s[1][1] - s[1][0], s[0]))[1][2]
    other = K.alternate_key(segs, key, coverage)
    return empty | {
        "key": key_record(key), "dsp_key": key_record(key), "confidence": whole[1], "chroma": mid.tolist(),
        "segments": [{"start_seconds": a, "end_seconds": b, "key": key_record(k), "confidence": c} for a, b, k, c in segs],
        "multi_key": other is not None, "alternate_key": key_record(other[0]) if other else None, "alternate_coverage": other[1] if other else 0.0,
    }


def analyze_wave(x: np.ndarray, rate: int, target: int = 1500) -> dict:
    x = np.clip(np.where(np.isfinite(x), x, 0.0), -1, 1)
    n = len(x)
    c = min(target, n)
    cut = np.arange(c + 1) * n // max(c, 1)
    parts = [x[a : max(b, a + 1)] for a, b in zip(cut[:-1], cut[1:])]
    rms = [float(np.sqrt((p * p).mean())) for p in parts]
    heights = K.display_heights(np.array([np.abs(p).max() for p in parts]), np.array(rms)) if parts else []
    cols = [{"min": float(p.min()), "max": float(p.max()), "rms": r, "display_height": float(h), "spectral_centroid": K.spectral_balance(p, rate)} for p, r, h in zip(parts, rms, heights)]
    return {"version": 1, "sample_rate": rate, "source_samples": n, "columns": cols}


def analyze_samples(x: np.ndarray, rate: int, columns: int = 1500, times: dict | None = None) -> dict:
    """The whole record; ``times`` gets the milliseconds of each part."""

    def clocked(name, f, *args):
        start = time.perf_counter()
        out = f(*args)
        if times is not None:
            times[name] = (time.perf_counter() - start) * 1000
        return out

    return {
        "version": 1, "duration_seconds": len(x) / rate if rate else 0.0, "beat": clocked("beat_analysis_milliseconds", analyze_beats, x, rate), "key": clocked("key_analysis_milliseconds", analyze_key, x, rate),
        "waveform": clocked("waveform_analysis_milliseconds", analyze_wave, x, rate, columns),
    }


PARTS = ("beat_analysis_milliseconds", "key_analysis_milliseconds", "waveform_analysis_milliseconds")


def analyze(tracks: DataFrame, columns: int = 1500, timed: bool = False) -> DataFrame:
    """tracks: track_id, samples (array of float), sample_rate. Returns track_id, analysis, error.

    With ``timed``: also the milliseconds of decoding (passed through), of each part and of all parts; ``decode_error`` is passed on as the error.
    """
    more = ["decode_milliseconds", "analysis_milliseconds", *PARTS] if timed else []
    schema = T.StructType([tracks.schema["track_id"], T.StructField("analysis", ANALYSIS), T.StructField("error", _s), *[T.StructField(c, _d) for c in more]])
    names = ["track_id", "samples", "sample_rate", *[c for c in ("decode_milliseconds", "decode_error") if timed and c in tracks.columns]]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                times: dict[str, float] = {}
                got, error = None, r.get("decode_error")
                try:
                    if r["samples"] is None:
                        raise ValueError(error or "no samples")
                    got = analyze_samples(np.asarray(r["samples"], np.float64), int(r["sample_rate"]), columns, times)
                except Exception as e:  # one bad track is one error row
                    error = error or f"{type(e).__name__}: {e}"
                spent = [times.get(p) for p in PARTS]
                rows.append((r["track_id"], got, error, *([r.get("decode_milliseconds"), sum(spent) if got else None, *spent] if timed else [])))
            yield pd.DataFrame(rows, columns=["track_id", "analysis", "error", *more])

    return tracks.select(*names).mapInPandas(run, schema)


def per_track(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """applyInPandas by track: for recurrences that no window function expresses."""
    return rows.groupBy("track").applyInPandas(kernel, schema)
