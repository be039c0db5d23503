"""Waveform overviews and brightness as array expressions over a track's samples (one row a track).

Full-rate samples stay in their row: an overview is a transform over column bounds, so nothing is
exploded or shuffled however long the track.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chroma import EPS, bound, total


def sanitize(x: Column) -> Column:
    """Clamped to -1..1; what is not finite is 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def duration_seconds(samples: Column, rate: Column) -> Column:
    return F.when(rate == 0, 0.0).otherwise(F.size(samples) / rate)


def overview(clips: DataFrame, target: int) -> DataFrame:
    """``clips`` (track, samples) with columns: array of (column_index, min, max, rms)."""

    def columns(s: Column) -> Column:
        n = F.size(s)
        c = F.least(F.lit(target), n)
        low = lambda i: F.floor(i * n / c).cast("int")

        def one(i: Column) -> Column:
            part = F.slice(s, low(i) + 1, F.greatest(low(i + 1) - low(i), F.lit(1)))
            return bound(part, lambda p: F.struct(i.cast("int").alias("column_index"), F.array_min(p).alias("min"), F.array_max(p).alias("max"), F.sqrt(total(F.transform(p, lambda x: x * x)) / F.size(p)).alias("rms")))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), c - 1), one)).otherwise(F.array().cast("array<struct<column_index:int,min:double,max:double,rms:double>>"))

    return clips.withColumn("columns", bound(F.transform("samples", sanitize), columns))


def percentile(values: Column, p: float) -> Column:
    """Nearest rank: element round((n - 1) p) of the sorted values."""
    return F.get(F.array_sort(values), F.round((F.size(values) - 1) * F.lit(p)).cast("int"))


def display_heights(columns: DataFrame) -> DataFrame:
    """Adds heights: (energy / ceiling) ** 0.6, ceiling the larger of the 95th percentile and half the maximum."""
    energy = F.transform("columns", lambda c: F.sqrt(F.greatest(F.abs(c["min"]), F.abs(c["max"])) * c["rms"]))

    def scaled(e: Column) -> Column:
        return bound(F.greatest(percentile(e, 0.95), F.array_max(e) * 0.5), lambda top: F.transform(e, lambda x: F.when(top > EPS, F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / top)), F.lit(0.6))).otherwise(0.0)))

    return columns.withColumn("heights", bound(energy, scaled))


def goertzel_energy(samples: Column, size: int, rate: int, freq: float) -> Column:
    """|DTFT|^2 of the Hann-windowed samples at one frequency: two dot products with literal arrays."""
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / max(size - 1, 1)) for i in range(size)]
    turn = 2 * math.pi * freq / rate
    parts = [F.array(*[F.lit(w[i] * f(turn * i)) for i in range(size)]) for f in (math.cos, math.sin)]
    dot = [total(F.zip_with(samples, p, lambda a, b: a * b)) for p in parts]
    return dot[0] * dot[0] + dot[1] * dot[1]


def spectral_balance(samples: Column, size: int, rate: int, bands: int = 8) -> Column:
    """Energy-weighted place, 0 to 1, among log-spaced bands from 80 Hz; samples must have ``size`` elements."""
    top = min(max(rate / 2, 80.0), 10_000.0)
    if size < 2:
        return F.lit(0.5)
    if rate == 0 or top <= 80.0:
        return time_balance(samples)

    def place(s: Column) -> Column:
        energies = F.array(*[goertzel_energy(s, size, rate, 80.0 * (top / 80.0) ** (b / (bands - 1))) for b in range(bands)])
        spots = F.array(*[F.lit(b / (bands - 1)) for b in range(bands)])
        return bound(energies, lambda e: bound(total(e), lambda t: F.when(t > 2.220446049250313e-16, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(F.zip_with(e, spots, lambda a, b: a * b)) / t))).otherwise(time_balance(s))))

    return bound(F.transform(samples, sanitize), place)


def time_balance(samples: Column) -> Column:
    """0.7 times relative change plus 0.3 times the rate of zero crossings; 0.5 for silence."""

    def place(s: Column) -> Column:
        n = F.size(s)
        pairs = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: F.struct(F.abs(b - a).alias("d"), F.when((a >= 0) != (b >= 0), 1.0).otherwise(0.0).alias("z")))
        level = total(F.transform(s, lambda x: F.abs(x)))
        return F.when((n < 2) | (level <= EPS), 0.5).otherwise(0.7 * F.least(F.lit(1.0), total(F.transform(pairs, lambda p: p["d"])) / (2.0 * level)) + 0.3 * total(F.transform(pairs, lambda p: p["z"])) / (n - 1))

    return bound(F.transform(samples, sanitize), place)


def resample(samples: Column, ratio: float) -> Column:
    """Every ``ratio``-th sample by linear interpolation; the last sample is held."""

    def out(s: Column) -> Column:
        n = F.size(s)

        def one(i: Column) -> Column:
            at = i * F.lit(ratio)
            low = F.floor(at).cast("int")
            part = at - low
            return F.when(low + 1 < n, F.get(s, low) * (1.0 - part) + F.get(s, low + 1) * part).otherwise(F.get(s, n - 1))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / F.lit(ratio)).cast("int") - 1), one)).otherwise(F.array().cast("array<double>"))

    return bound(samples, out)
