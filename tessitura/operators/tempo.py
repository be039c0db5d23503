"""Tempo from lag scores: one row a track holds its lags as an array, so candidates need no self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1.1920929e-07


def gather(base: DataFrame) -> DataFrame:
    """track, lags: array of (lag, r, h, s) by lag, from base scores (at most max_lag rows a track)."""
    return base.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("lag", "r", "h", "s"))).alias("lags"))


def _score(lags: Column, lag: Column, low: int) -> Column:
    """Score at a lag; null outside."""
    i = (lag - low).cast("int")
    return F.when(i >= 0, F.get(lags, i)["s"])


def family(lags: DataFrame, rate: float, low: int) -> DataFrame:
    """Scores with the support of related lags and a preference for tempi near 120."""

    def one(x: Column) -> Column:
        at = lambda lag: F.coalesce(_score(F.col("lags"), lag, low), F.lit(0.0))
        lag = x["lag"]
        f = x["s"] + at(lag * 2) * 0.35 + at(lag * 3) * 0.15 + at(F.floor(lag * 3.0 / 2)) * 0.25 + at(F.floor(lag * 4.0 / 3)) * 0.2
        prior = 0.75 + 0.25 * F.exp(-F.pow(F.log2(60.0 * rate / lag / 120), F.lit(2.0)) / 8)
        return F.struct(lag.alias("lag"), x["r"].alias("r"), x["h"].alias("h"), (f * prior).alias("s"))

    return lags.withColumn("cand", F.transform("lags", one))


def estimate(cand: DataFrame, activity: DataFrame, rate: float, low: int, min_bpm: float, max_bpm: float) -> DataFrame:
    """track, lag, bpm, confidence. ``activity``: track and the envelope's root mean square."""
    best = F.array_max(F.transform("cand", lambda x: F.struct(x["s"].alias("s"), x["lag"].alias("lag"))))
    a = cand.withColumn("best", best)
    fast = 60.0 * rate / F.col("best.lag") > 135
    now_lag, now_s = F.col("best.lag"), F.col("best.s")
    for num, den, name in ((3.0, 2, "t1"), (4.0, 3, "t2")):
        other = F.floor(F.col("best.lag") * num / den).cast("int")
        s = _score(F.col("cand"), other, low)
        take = F.coalesce(fast & (s > 0.7 * F.col("best.s")) & (s > 0.9 * now_s), F.lit(False))
        a = a.withColumn(name, F.struct(F.when(take, other).otherwise(now_lag).alias("lag"), F.when(take, s).otherwise(now_s).alias("s")))
        now_lag, now_s = F.col(f"{name}.lag"), F.col(f"{name}.s")
    own = F.get("cand", (F.col("t2.lag") - low).cast("int"))
    near = F.filter("cand", lambda x: F.abs(x["lag"] - F.col("t2.lag")) <= 1)
    add = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda t, x: t + f(x))
    second = F.aggregate(F.filter("cand", lambda x: F.abs(x["lag"] - F.col("t2.lag")) > 2), F.lit(0.0), lambda m, x: F.greatest(m, x["s"]))
    a = a.select("track", F.col("t2.lag").alias("lag"), own.alias("own"), second.alias("s2"), add(near, lambda x: x["h"]).alias("hs"), add(near, lambda x: x["h"] * x["lag"]).alias("hl"))
    period = F.when(F.col("hs") > EPS, F.col("hl") / F.col("hs")).otherwise(F.col("lag").cast("double"))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    apart = F.when(F.col("own.s") > EPS, clip((F.col("own.s") - F.col("s2")) / F.col("own.s"))).otherwise(0.0)
    sure = clip(clip(F.col("own.r")) * (0.75 + 0.25 * apart) * F.least(F.lit(1.0), F.col("rms") * 100))
    return a.join(activity, "track").select("track", "lag", F.greatest(F.lit(min_bpm), F.least(F.lit(max_bpm), 60.0 * rate / period)).alias("bpm"), sure.alias("confidence"))
