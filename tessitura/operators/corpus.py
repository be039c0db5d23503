"""A corpus evaluated: annotated tracks joined to their analyses, scored one by one, then summed up.

``tracks`` are manifest rows (``sources.manifest``), ``analyses`` rows of id, analysis, error and, where measured, times.
The join is on id; everything within a track is array expressions on its row, so a corpus of any size is one join and
one aggregate that Spark combines map-side. A track without analysis, or with a label that can't be read, is an error row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as N
from ..functions import keys as K
from . import evaluation as E

TIMES = ("decode", "analysis", "beat_analysis", "key_analysis", "waveform_analysis")
BEAT_TOLERANCE = 0.070


def key_index(key: Column) -> Column:
    """Index of a {tonic, mode} record."""
    tonics = {n: i for i, n in enumerate(K.ENUM_NAMES)}
    return F.when(key.isNotNull(), K.key_of(K._lookup(tonics, key["tonic"]), key["mode"] == "Minor"))


def mean_of(values: Column) -> Column:
    """Mean of an array without its nulls; null if nothing is left."""
    v = F.array_compact(values)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def tempo_segment_error(expected: Column, detected: Column) -> Column:
    """Mean |bpm difference| of expected segments and the first detected one that holds their midpoint."""

    def one(s: Column) -> Column:
        middle = (s["start_seconds"] + s["end_seconds"]) / 2
        hit = F.get(F.filter(detected, lambda d: (middle >= d["start_seconds"]) & (middle < d["end_seconds"])), F.lit(0))
        return F.abs(hit["bpm"].cast("double") - s["bpm"].cast("double"))

    return mean_of(F.transform(expected, one))


def with_index(segments: Column, read) -> Column:
    """Segments with ``index``, their key as ``read`` has it."""
    return F.transform(segments, lambda s: F.struct(s["start_seconds"].alias("start_seconds"), s["end_seconds"].alias("end_seconds"), read(s["key"]).alias("index"), (s["confidence"] if read is key_index else F.lit(None)).cast("double").alias("confidence")))


def key_segment_accuracy(expected: Column, detected: Column) -> Column:
    """Seconds in which detected and expected key agree, over the expected ones; null without expected segments."""
    add = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda s, x: s + f(x))

    def shared(e: Column, d: Column) -> Column:
        overlap = F.least(e["end_seconds"], d["end_seconds"]) - F.greatest(e["start_seconds"], d["start_seconds"])
        return F.when((overlap > 0) & (d["index"] == e["index"]), overlap).otherwise(0.0)

    hit = add(expected, lambda e: add(detected, lambda d: shared(e, d)))
    return F.when(F.size(expected) > 0, hit / F.greatest(add(expected, lambda e: e["end_seconds"] - e["start_seconds"]), F.lit(2.220446049250313e-16)))


_COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("hits", "missed", "extra")])


@F.pandas_udf(_COUNTS)
def match_counts(reference: pd.Series, detected: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
    """Each reference time in turn takes the nearest free detection within tolerance."""
    rows = [N.match_events([] if r is None else list(r), [] if d is None else list(d), float(t)) for r, d, t in zip(reference, detected, tolerance)]
    return pd.DataFrame(rows, columns=["hits", "missed", "extra"])


def precision_recall(hits: Column, missed: Column, extra: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where a denominator is."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(hits, hits + extra), ratio(hits, hits + missed)
    return p, r, ratio(2 * p * r, p + r)


def agreement(name: str, bpm: Column, parsed: Column, detected_bpm: Column, detected_key: Column) -> list[Column]:
    """How far another tool's tempo and key (its index) agree with ours; null where it has none or they can't be read."""
    return [
        F.abs(detected_bpm - bpm).alias(f"{name}_bpm_absolute_agreement"), K.octave_aware_error(bpm, detected_bpm).alias(f"{name}_bpm_octave_aware_absolute_agreement"),
        F.when(parsed.isNotNull(), parsed.eqNullSafe(detected_key)).alias(f"{name}_exact_key_agreement"),
    ]


def evaluate_tracks(tracks: DataFrame, analyses: DataFrame) -> DataFrame:
    """One result row per track."""
    a = analyses.select(F.col("id").alias("__id"), "analysis", F.col("error").alias("__error"), *[F.col(c) for c in analyses.columns if c.endswith("_milliseconds")])
    for t in TIMES:
        if f"{t}_milliseconds" not in a.columns:
            a = a.withColumn(f"{t}_milliseconds", F.lit(None).cast("double"))
    j = tracks.join(a, tracks["id"] == a["__id"], "left")
    # Each label is read once a row: what stands in a column of its own isn't expanded wherever it is used.
    j = j.withColumns({"__ek": K.parse_key(F.col("expected_key")), "__dk": key_index(F.col("analysis.key.key")), "__dsp": key_index(F.col("analysis.key.dsp_key")), "__expected": with_index(F.col("expected_key_segments"), K.parse_key), "__detected": with_index(F.col("analysis.key.segments"), key_index)})
    ek = F.col("__ek")
    bad = F.when(F.col("expected_key").isNotNull() & ek.isNull(), F.concat(F.lit("unsupported key "), "expected_key"))
    bad_segment = F.when(F.exists("__expected", lambda s: s["index"].isNull()), F.lit("unsupported key in a segment"))
    missing = F.when(F.col("__id").isNull() | F.col("analysis").isNull(), F.lit("no analysis"))
    j = j.withColumn("error", F.coalesce("__error", missing, bad, bad_segment)).withColumn("ok", F.col("error").isNull())
    on = lambda c: F.when(F.col("ok"), c)
    beat, key = F.col("analysis.beat"), F.col("analysis.key")
    db, dk, eb = beat["global_bpm"], F.col("__dk"), F.col("expected_bpm").cast("double")
    times = lambda c: F.transform(c, lambda x: x["time_seconds"])
    j = j.withColumn("__m", F.when(F.col("ok") & (F.size("expected_beats") > 0), match_counts(times("expected_beats"), times(beat["beats"]), F.lit(BEAT_TOLERANCE))))
    p, r, f1 = (F.when(F.col("__m").isNotNull(), c) for c in precision_recall(F.col("__m.hits"), F.col("__m.missed"), F.col("__m.extra")))
    for name, read in (("serato", K.parse_camelot_or_key), ("apple_music_understanding", K.parse_key)):
        j = j.withColumn(f"__{name}", read(F.col(f"{name}.key")))
    j = j.withColumns({"__relation": K.key_relation(ek, dk), "__dsp_relation": K.key_relation(ek, F.col("__dsp"))})
    outside = [x for name in ("serato", "apple_music_understanding") for x in agreement(name, F.col(f"{name}.bpm").cast("double"), F.col(f"__{name}"), on(db), on(dk))]
    return j.select(
        "id", "split", on(F.col("analysis.duration_seconds")).alias("duration_seconds"), *[on(F.col(f"{t}_milliseconds")).alias(f"{t}_milliseconds") for t in TIMES],
        "expected_bpm", on(db).alias("detected_bpm"), on(F.abs(db - eb)).alias("bpm_absolute_error"), on(K.octave_aware_error(eb, db)).alias("bpm_octave_aware_absolute_error"),
        on(K.tempo_relation(eb, db)).alias("tempo_relation"), ek.alias("expected_key"), on(dk).alias("detected_key"), on(F.when(ek.isNotNull(), ek.eqNullSafe(dk))).alias("exact_key_match"),
        on(K.score_of(F.col("__relation"))).alias("mirex_score"), on(F.col("__relation")).alias("key_relation"), on(key["estimator"]).alias("key_estimator"), on(K.score_of(F.col("__dsp_relation"))).alias("dsp_mirex_score"),
        on(tempo_segment_error(F.col("expected_tempo_segments"), beat["tempo_segments"])).alias("tempo_segment_mean_absolute_error"),
        on(key_segment_accuracy(F.col("__expected"), F.col("__detected"))).alias("key_segment_exact_accuracy"),
        F.transform(on(F.col("__detected")), lambda s: F.struct(s["start_seconds"].alias("start_seconds"), s["end_seconds"].alias("end_seconds"), K.key_name(s["index"]).alias("key"), s["confidence"].alias("confidence"))).alias("detected_key_segments"),
        on(f1).alias("beat_f1"), on(p).alias("beat_precision"), on(r).alias("beat_recall"),
        F.coalesce(on(beat["multi_tempo"]), F.lit(False)).alias("multi_tempo"), on(beat["alternate_bpm"]).alias("alternate_bpm"), F.coalesce(on(key["multi_key"]), F.lit(False)).alias("multi_key"),
        on(key_index(key["alternate_key"])).alias("alternate_key"), *outside, on(key["chroma"]).alias("chroma"), "error",
    )


#: Corpus means by the column they average.
MEANS = {
    "bpm_mean_absolute_error": "bpm_absolute_error", "bpm_octave_aware_mean_absolute_error": "bpm_octave_aware_absolute_error", "exact_key_accuracy": "exact_key_match", "mirex_weighted_score": "mirex_score",
    "tempo_segment_mean_absolute_error": "tempo_segment_mean_absolute_error", "key_segment_exact_accuracy": "key_segment_exact_accuracy", "beat_f1": "beat_f1", "beat_precision": "beat_precision", "beat_recall": "beat_recall",
    **{f"{n}_bpm_mean_absolute_agreement": f"{n}_bpm_absolute_agreement" for n in ("serato", "apple_music_understanding")},
    **{f"{n}_bpm_octave_aware_mean_absolute_agreement": f"{n}_bpm_octave_aware_absolute_agreement" for n in ("serato", "apple_music_understanding")},
    **{f"{n}_exact_key_agreement": f"{n}_exact_key_agreement" for n in ("serato", "apple_music_understanding")},
    **{f"mean_{t}_milliseconds": f"{t}_milliseconds" for t in TIMES},
}


def summarize(results: DataFrame) -> DataFrame:
    """The corpus summary: counts, means that skip nulls (null if nothing is left) and both taxonomies, in one pass."""
    number = lambda c: (F.col(c).cast("int") if dict(results.dtypes)[c] == "boolean" else F.col(c)).cast("double")
    tempo, key = F.col("tempo_relation"), F.col("key_relation")
    rate = lambda on: F.round(F.avg(F.when(tempo.isNotNull(), F.when(on, 1.0).otherwise(0.0))), 6)
    return results.agg(
        F.count_if(F.col("error").isNull()).alias("analyzed_tracks"), F.count_if(F.col("error").isNotNull()).alias("failed_tracks"), F.count_if(F.coalesce("multi_tempo", F.lit(False))).alias("multi_tempo_tracks"), F.count_if(F.coalesce("multi_key", F.lit(False))).alias("multi_key_tracks"),
        *[F.round(F.avg(number(c)), 6).alias(name) for name, c in MEANS.items()], *[F.count_if(tempo == n).alias(f"tempo_{n}") for n in (*[n for n, _ in K.TEMPO_RATIOS], "other")],
        rate(tempo == "exact").alias("tempo_accuracy_1"), rate(tempo.isin(*E.ACCURACY_2)).alias("tempo_accuracy_2"), *[F.count_if(key == n).alias(f"key_{n}") for n in E.KEY_RELATIONS],
    )


def run_manifest(spark: SparkSession, manifest_path: str, limit: int | None = None) -> DataFrame:
    """Results for the tracks of a manifest file: audio beside it is decoded and analysed, in manifest order up to ``limit``.

    Paths are taken as they are if absolute, else from the manifest's folder. A file that is missing or can't be decoded is an error row.
    """
    from ..sources.audio import read_files
    from ..sources.manifest import read_manifest, resolved
    from .analysis import analyze

    tracks = read_manifest(spark, manifest_path)
    if limit is not None:
        tracks = tracks.orderBy("ordinal").limit(limit)
    tracks = resolved(tracks, manifest_path)
    audio = read_files(spark, [r["full_path"] for r in tracks.select("full_path").distinct().collect()])  # names of one manifest's files
    got = analyze(tracks.select(F.col("id").alias("track_id"), "full_path").join(audio, "full_path", "left").select("track_id", "samples", "sample_rate", "decode_milliseconds", F.col("error").alias("decode_error")), timed=True)
    return evaluate_tracks(tracks, got.withColumnRenamed("track_id", "id"))


def boundaries(segments: Column) -> Column:
    """Starts of segments whose key differs from that of the one before, both being known."""
    n = F.size(segments)
    known = lambda k: F.coalesce(k, F.lit("")) != ""
    pair = F.zip_with(F.slice(segments, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(segments, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(known(a["key"]) & known(b["key"]) & (a["key"] != b["key"]), b["start_seconds"].cast("double")))
    return F.coalesce(F.array_compact(pair), F.array().cast("array<double>"))


def boundary_matches(manifest: DataFrame, report: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Per manifest track: boundaries of both sides, matches and error. ``manifest``: id, expected_key_segments; ``report``: id, detected_key_segments, error.

    A track that the report lacks is an error.
    """
    m = manifest.select("id", boundaries(F.col("expected_key_segments")).alias("reference_boundaries"))
    r = report.select(F.col("id").alias("__id"), boundaries(F.col("detected_key_segments")).alias("detected_boundaries"), F.col("error"))
    j = m.join(r, F.col("id") == F.col("__id"), "left")
    j = j.withColumn("error", F.coalesce("error", F.when(F.col("__id").isNull(), F.lit("not in the report"))))
    c = match_counts("reference_boundaries", F.coalesce("detected_boundaries", F.array().cast("array<double>")), F.lit(tolerance))
    return j.withColumn("c", c).select("id", "reference_boundaries", "detected_boundaries", *[F.when(F.col("error").isNull(), F.col(f"c.{x}")).alias(y) for x, y in (("hits", "true_positives"), ("extra", "false_positives"), ("missed", "false_negatives"))], "error")


def boundary_scores(matches: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 over the tracks without error; failed ones are counted apart."""
    ok = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long").alias(c)
    s = matches.agg(F.count_if(ok).alias("evaluated_tracks"), F.count_if(~ok).alias("failed_tracks"), total("true_positives"), total("false_positives"), total("false_negatives"))
    p, r, f1 = precision_recall(F.col("true_positives"), F.col("false_negatives"), F.col("false_positives"))
    return s.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def compare_library(library: DataFrame, analyses: DataFrame) -> DataFrame:
    """A library's own tempo and key against the displayed tempo and key of an analysis.

    ``library``: path, bpm, key; ``analyses``: path, found (the file is there), analysis, error. status: missing_file, decode_error, no_bpm or analyzed.
    """
    a = analyses.select(F.col("path").alias("__path"), "found", "analysis", F.col("error").alias("__error"))
    j = library.join(a, library["path"] == a["__path"], "left")
    shown = F.col("analysis.beat.display_bpm")
    status = F.when(~F.coalesce("found", F.lit(False)), "missing_file").when(F.col("__error").isNotNull() | F.col("analysis").isNull(), "decode_error").when(shown.isNull(), "no_bpm").otherwise("analyzed")
    j = j.withColumns({"status": status, "__lk": K.parse_camelot_or_key(F.col("key")), "__dk": key_index(F.col("analysis.key.key"))})
    j = j.withColumn("__relation", K.key_relation(F.col("__lk"), F.col("__dk")))
    dk = F.col("__dk")
    fine = F.col("status") == "analyzed"
    on = lambda c: F.when(fine, c)
    b, lk = F.col("bpm").cast("double"), F.col("__lk")
    heard = F.col("status").isin("analyzed", "no_bpm")
    return j.select(
        "path", "bpm", "key", F.when(heard, F.col("analysis.beat.global_bpm")).alias("global_bpm"), on(shown).alias("display_bpm"), on(F.abs(shown - b)).alias("bpm_absolute_error"), on(K.octave_aware_error(b, shown)).alias("bpm_octave_aware_error"),
        on(K.tempo_relation(b, shown)).alias("tempo_relation"), F.when(heard, dk).alias("detected_key"), on(lk == dk).alias("exact_key_match"), on(K.score_of(F.col("__relation"))).alias("mirex_score"), on(F.col("__relation")).alias("key_relation"), "status",
        F.when(F.col("status") == "missing_file", F.lit("missing file")).when(F.col("status") == "decode_error", F.coalesce("__error", F.lit("no analysis"))).alias("error"),
    )


def library_summary(rows: DataFrame) -> DataFrame:
    """``rows``: bpm_absolute_error, bpm_octave_aware_error, exact_key_match, mirex_score, tempo_relation, key_relation."""
    err, octave = F.col("bpm_absolute_error"), F.col("bpm_octave_aware_error")
    return rows.agg(
        F.round(F.avg(err), 6).alias("bpm_mean_absolute_error"), F.round(F.median(err), 6).alias("bpm_median_absolute_error"), F.round(F.avg(octave), 6).alias("bpm_octave_aware_mean_absolute_error"),
        F.count_if(err <= 1).alias("bpm_within_one"), F.count_if(octave <= 1).alias("bpm_octave_within_one"), F.round(F.avg(F.col("exact_key_match").cast("int").cast("double")), 6).alias("key_exact_accuracy"), F.round(F.avg("mirex_score"), 6).alias("key_mirex_mean"),
        *[F.count_if(F.col("tempo_relation") == n).alias(f"tempo_{n}") for n in (*[n for n, _ in K.TEMPO_RATIOS], "other")], *[F.count_if(F.col("key_relation") == n).alias(f"key_{n}") for n in E.KEY_RELATIONS],
    )


def eligible_jobs(tracks: DataFrame, tool: str, done: DataFrame | None = None) -> DataFrame:
    """Tracks that ``tool`` can be scored on and hasn't done: key tools (by name, or libkeyfinder) need a key, others a tempo."""
    is_key = "key" in tool or tool == "libkeyfinder"
    ready = tracks.where(F.col("expected_key" if is_key else "expected_bpm").isNotNull()).withColumn("tool", F.lit(tool))
    return ready if done is None else ready.join(done.where(F.col("tool") == tool).select(F.col("track_id").alias("id")), "id", "left_anti")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays; 0 if either hardly varies."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    from ..functions.chroma import bound

    centred = lambda a: bound(mean(a), lambda m: F.transform(a, lambda v: v - m))
    return bound(centred(x), lambda u: bound(centred(y), lambda v: bound(F.sqrt(dot(u, u) * dot(v, v)), lambda d: F.when(d < 1e-12, 0.0).otherwise(dot(u, v) / d))))


def classify_with_profiles(chroma: Column, major: Column, minor: Column) -> Column:
    """Index of the key whose profile correlates best; the first of equals in the order C major, C minor, C# major, ..."""
    from ..functions.chroma import bound

    turned = lambda r: F.concat(F.slice(chroma, r + 1, 12 - r), F.slice(chroma, F.lit(1), r))
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda r: F.array(F.struct(correlation(turned(r), major).alias("s"), r.alias("key")), F.struct(correlation(turned(r), minor).alias("s"), (r + 12).alias("key")))))
    best = lambda all_: F.get(F.filter(all_, lambda x: x["s"] == F.array_max(F.transform(all_, lambda y: y["s"]))), F.lit(0))["key"]
    return bound(each, best).cast("int")


def learn_profile_arrays(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, major, minor: median profiles of rows (by, key, chroma); flat ones where a mode has no rows."""
    each = rows.select(*by, (F.col("key") >= 12).alias("is_minor"), F.pmod("key", F.lit(12)).alias("tonic"), F.posexplode("chroma").alias("bin", "x"))
    med = each.groupBy(*by, "is_minor", F.pmod(F.col("bin") - F.col("tonic"), F.lit(12)).alias("degree")).agg(F.median("x").alias("w"))
    arr = lambda m: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_minor") == m, F.struct("degree", "w")))), lambda x: x["w"])
    got = med.groupBy(*by).agg(arr(False).alias("major"), arr(True).alias("minor"))
    both = (F.size("major") == 12) & (F.size("minor") == 12)
    flat = F.array_repeat(F.lit(1.0), 12)
    return got.select(*by, *[F.when(both, F.col(m)).otherwise(flat).alias(m) for m in ("major", "minor")])


def cross_validate(rows: DataFrame, folds: int = 5) -> DataFrame:
    """fold, n, correct: profiles learned on the other folds, tried on this one. ``rows``: track, key, chroma; folds by SHA-256 of the track.

    Every row is learned from in ``folds`` - 1 folds, so it is repeated so often, in narrow rows, before the medians.
    """
    fold = F.pmod(F.conv(F.substring(F.sha2(F.col("track").cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    known = rows.where(F.col("key").isNotNull() & F.col("chroma").isNotNull()).select("track", "key", "chroma", fold.alias("own"))
    others = known.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> own")
    profiles = learn_profile_arrays(others, ["fold"])
    tried = known.join(profiles, known["own"] == profiles["fold"]).withColumn("got", classify_with_profiles(F.col("chroma"), F.col("major"), F.col("minor")))
    return tried.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("key")).alias("correct"))
