"""Deterministic tracks: an A major chord and decaying clicks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def clicks(bpm: float, seconds: float, rate: int = 44100) -> np.ndarray:
    x = np.zeros(int(seconds * rate))
    ramp = 1 - np.arange(128) / 128
    for a in range(0, len(x), int(60 / bpm * rate)):
        n = min(128, len(x) - a)
        x[a : a + n] = ramp[:n]
    return x


def chord(freqs, seconds: float, rate: int = 44100) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    return np.mean([np.sin(2 * np.pi * f * t) for f in freqs], axis=0)


def mixed(bpm: float, seconds: float = 20.0, rate: int = 44100) -> np.ndarray:
    return 0.2 * chord((220.0, 277.18, 329.63), seconds, rate) + 0.8 * clicks(bpm, seconds, rate)


def synthetic_tracks(spark: SparkSession, tempi, seconds: float = 20.0, rate: int = 44100) -> DataFrame:
    """track_id, samples, sample_rate: made on the executors."""

    def make(batches):
        for pdf in batches:
            for bpm in pdf["bpm"]:
                yield pd.DataFrame({"track_id": [f"click-{bpm}"], "samples": [mixed(bpm, seconds, rate).astype(np.float32)], "sample_rate": [rate]})

    ids = spark.createDataFrame([(int(b),) for b in tempi], "bpm int").repartition(len(tuple(tempi)))
    return ids.mapInPandas(make, "track_id string, samples array<float>, sample_rate int")
