"""Scores of predictions against references, as aggregates that Spark combines map-side.

Rows: track, tool, expected_key, detected_key (indices), expected_bpm, detected_bpm, elapsed; a null
detection is a failed track. Means skip nulls; key accuracy over a corpus counts a failure as wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K

KEY_RELATIONS = ("exact", "fifth", "relative", "parallel", "tritone", "other")
ACCURACY_2 = ("exact", "double", "half", "triple", "third")


def _rate(on: Column, known: Column) -> Column:
    return F.round(F.avg(F.when(known, F.when(on, 1.0).otherwise(0.0))), 6)


def tempo_taxonomy(rows: DataFrame, by: list[str]) -> DataFrame:
    r = F.col("relation")
    counts = [F.count_if(r == n).alias(f"{n}_n") for n in (*[n for n, _ in K.TEMPO_RATIOS], "other")]
    told = rows.withColumn("relation", K.tempo_relation(F.col("expected_bpm"), F.col("detected_bpm")))
    return told.groupBy(*by).agg(*counts, _rate(r == "exact", r.isNotNull()).alias("accuracy_1"), _rate(r.isin(*ACCURACY_2), r.isNotNull()).alias("accuracy_2"))


def key_taxonomy(rows: DataFrame, by: list[str]) -> DataFrame:
    told = rows.withColumn("relation", K.key_relation(F.col("expected_key"), F.col("detected_key")))
    return told.groupBy(*by).agg(*[F.count_if(F.col("relation") == n).alias(f"{n}_n") for n in KEY_RELATIONS])


def key_summary(rows: DataFrame) -> DataFrame:
    e, d = F.col("expected_key"), F.col("detected_key")
    ok = rows.where(d.isNotNull())
    return ok.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"), _rate(e == d, F.lit(True)).alias("accuracy"), F.round(F.avg(K.mirex_score(e, d)), 6).alias("weighted_score"),
        _rate(F.pmod(d, F.lit(12)) == 0, F.lit(True)).alias("tonic_c_share"), F.round(F.avg("elapsed"), 4).alias("mean_elapsed"),
    )


def tempo_summary(rows: DataFrame) -> DataFrame:
    e, d = F.col("expected_bpm"), F.col("detected_bpm")
    near = lambda m: F.abs(d - e * m) <= 0.04 * e * m
    any_of = near(1.0)
    for m in (0.5, 2.0, 1 / 3, 3.0):
        any_of = any_of | near(m)
    ok = rows.where(d.isNotNull())
    return ok.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"), _rate(near(1.0), F.lit(True)).alias("accuracy_1"), _rate(any_of, F.lit(True)).alias("accuracy_2"),
        F.round(F.avg(F.abs(d - e)), 6).alias("mae"), F.round(F.median(F.abs(d - e)), 6).alias("median_ae"), F.round(F.avg("elapsed"), 4).alias("mean_elapsed"),
    )


def corpus_summary(rows: DataFrame) -> DataFrame:
    ek, dk, eb, db = (F.col(c) for c in ("expected_key", "detected_key", "expected_bpm", "detected_bpm"))
    err = F.abs(db - eb)
    return rows.agg(
        F.count(F.lit(1)).alias("tracks"), F.count(dk).alias("analyzed"), (F.count(F.lit(1)) - F.count(dk)).alias("failed"),
        F.round(F.avg(F.when(ek.eqNullSafe(dk), 1.0).otherwise(0.0)), 6).alias("key_accuracy"), F.round(F.avg(K.mirex_score(ek, dk)), 6).alias("mean_mirex"),
        F.round(F.avg(err), 6).alias("bpm_mae"), F.round(F.median(err), 6).alias("bpm_median_ae"), F.round(F.avg(K.octave_aware_error(eb, db)), 6).alias("octave_mae"), F.count_if(err <= 1).alias("within_1"),
    )


def metric_diff(baseline: DataFrame, current: DataFrame, key: str, better_up: dict[str, bool]) -> DataFrame:
    """key, metric, baseline, current, delta, verdict ('=', better or REGRESSION)."""
    long = lambda df, name: df.unpivot([key], list(better_up), "metric", name)
    both = long(baseline.select(key, *[F.col(m).cast("double").alias(m) for m in better_up]), "baseline").join(long(current.select(key, *[F.col(m).cast("double").alias(m) for m in better_up]), "current"), [key, "metric"])
    up = F.col("metric").isin([m for m, v in better_up.items() if v])
    d = F.col("current") - F.col("baseline")
    return both.select(key, "metric", "baseline", "current", F.round(d, 6).alias("delta"), F.when(F.abs(d) < 1e-9, "=").when((d > 0) == up, "better").otherwise("REGRESSION").alias("verdict"))


def learn_profiles(rows: DataFrame, key: Column, chroma: Column) -> DataFrame:
    """minor, degree, weight: per mode the median of each bin after turning a chroma to its tonic."""
    each = rows.select((key >= 12).alias("minor"), F.pmod(key, F.lit(12)).alias("tonic"), F.posexplode(chroma).alias("bin", "x"))
    return each.groupBy("minor", F.pmod(F.col("bin") - F.col("tonic"), F.lit(12)).cast("int").alias("degree")).agg(F.round(F.median("x"), 6).alias("weight"))
