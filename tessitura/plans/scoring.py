"""Queries that score predictions: relations, taxonomies, corpus summaries, label parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import evaluation as E
from ..sources.driver_views import frame_of, with_views


def preds(spark, sf_dir) -> DataFrame:
    return frame_of(spark, sf_dir, "preds")


def tempo_relation(spark, sf_dir):
    return preds(spark, sf_dir).select("track", K.tempo_relation(F.col("expected_bpm"), F.col("detected_bpm")).alias("relation"))


def octave_error(spark, sf_dir):
    return preds(spark, sf_dir).select("track", F.round(K.octave_aware_error(F.col("expected_bpm"), F.col("detected_bpm")), 6).alias("err"))


def tempo_taxonomy(spark, sf_dir):
    return E.tempo_taxonomy(preds(spark, sf_dir), [])


def accuracy_by_tool(spark, sf_dir):
    return E.tempo_summary(preds(spark, sf_dir))


def key_relation(spark, sf_dir):
    e, d = F.col("expected_key"), F.col("detected_key")
    return preds(spark, sf_dir).select("track", K.key_relation(e, d).alias("relation"), K.mirex_score(e, d).alias("score"))


def key_taxonomy(spark, sf_dir):
    return E.key_taxonomy(preds(spark, sf_dir), ["tool"])


def key_summary_by_tool(spark, sf_dir):
    return E.key_summary(preds(spark, sf_dir))


def corpus_summary(spark, sf_dir):
    return E.corpus_summary(preds(spark, sf_dir))


def metric_diff(spark, sf_dir):
    p = preds(spark, sf_dir)
    return E.metric_diff(E.key_summary(p.where("track % 2 = 0")), E.key_summary(p.where("track % 2 = 1")), "tool", {"accuracy": True, "weighted_score": True, "mean_elapsed": False})


def camelot_decode(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.concat((F.pmod("p_partkey", F.lit(15))).cast("string"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("b"))
    return p.select("p_partkey", label.alias("label"), K.camelot_to_key(label).alias("key"), K.key_name(K.camelot_to_key(label)).alias("name"))


_LABELS = ("C major", "c# MINOR", "Abm", "F#", "Eb min", "Bbmaj", "E# maj", "H major", "Cbm", "A  minor", "Gm ", "D minor flat", "", "B♭ minor")


def key_label_parse(spark, sf_dir):
    label = F.get(F.array(*[F.lit(x) for x in _LABELS]), F.pmod("track", F.lit(len(_LABELS))).cast("int"))
    return preds(spark, sf_dir).select("track", K.parse_camelot_or_key(label).alias("key"))


def mel_scale(spark, sf_dir):
    from ..functions.mel import hz_to_mel, mel_to_hz

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.round(hz_to_mel(F.col("p_retailprice")), 5).alias("mel"), F.round(mel_to_hz(F.col("p_size").cast("double") * 50), 5).alias("hz"))


def profile_learning(spark, sf_dir):
    from .signals import folded

    return E.learn_profiles(folded(spark, sf_dir), F.pmod("track", F.lit(24)).cast("int"), F.col("v"))


REL = """CASE WHEN expected_key IS NULL OR detected_key IS NULL THEN NULL WHEN expected_key = detected_key THEN 'exact'
WHEN (expected_key >= 12) = (detected_key >= 12) AND ((detected_key - expected_key) % 12 + 12) % 12 IN (5, 7) THEN 'fifth'
WHEN (expected_key >= 12) <> (detected_key >= 12) AND ((detected_key - expected_key) % 12 + 12) % 12 = CASE WHEN expected_key < 12 THEN 9 ELSE 3 END THEN 'relative'
WHEN (expected_key >= 12) <> (detected_key >= 12) AND expected_key % 12 = detected_key % 12 THEN 'parallel'
WHEN (expected_key >= 12) = (detected_key >= 12) AND ((detected_key - expected_key) % 12 + 12) % 12 = 6 THEN 'tritone' ELSE 'other' END"""
SCORE = "CASE relation WHEN 'exact' THEN 1.0::DOUBLE WHEN 'fifth' THEN 0.5::DOUBLE WHEN 'relative' THEN 0.3::DOUBLE WHEN 'parallel' THEN 0.2::DOUBLE ELSE CASE WHEN relation IS NOT NULL THEN 0.0::DOUBLE END END"
_T = [("exact", "1.0::DOUBLE"), ("double", "2.0::DOUBLE"), ("half", "0.5::DOUBLE"), ("triple", "3.0::DOUBLE"), ("third", "1.0::DOUBLE/3"), ("three_to_two", "1.5::DOUBLE"), ("two_to_three", "2.0::DOUBLE/3"), ("four_to_three", "4.0::DOUBLE/3"), ("three_to_four", "0.75::DOUBLE")]
TEMPO = "CASE WHEN expected_bpm IS NULL OR detected_bpm IS NULL THEN NULL " + " ".join(f"WHEN abs(detected_bpm / expected_bpm - {r}) <= 0.04::DOUBLE * {r} THEN '{n}'" for n, r in _T) + " ELSE 'other' END"
KEYS = f"k AS (SELECT *, {SCORE} AS score FROM (SELECT *, {REL} AS relation FROM preds) q)"
TEMPI = f"t AS (SELECT *, {TEMPO} AS relation FROM preds)"
SUMMARY = """SELECT tool, count(*) AS n, round(avg(CASE WHEN relation = 'exact' THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(score), 6) AS weighted_score,
round(avg(CASE WHEN detected_key % 12 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS tonic_c_share, round(avg(elapsed), 4) AS mean_elapsed FROM k WHERE detected_key IS NOT NULL"""
_PARSE = {0: 0, 1: 13, 2: 20, 3: 6, 4: 15, 5: 10, 6: 5, 8: 23, 9: 21, 10: 19, 13: 22}
ORACLE = {
    "tempo_relation": f"SELECT track, {TEMPO} AS relation FROM preds",
    "octave_error": "SELECT track, round(least(abs(detected_bpm - expected_bpm), abs(2 * detected_bpm - expected_bpm), abs(detected_bpm / 2 - expected_bpm)), 6) AS err FROM preds",
    "tempo_taxonomy": f"WITH {TEMPI} SELECT " + ", ".join(f"count(*) FILTER (relation = '{n}') AS {n}_n" for n, _ in _T) + ", count(*) FILTER (relation = 'other') AS other_n, round(avg(CASE WHEN relation IS NULL THEN NULL WHEN relation = 'exact' THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy_1, round(avg(CASE WHEN relation IS NULL THEN NULL WHEN relation IN ('exact', 'double', 'half', 'triple', 'third') THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy_2 FROM t",
    "accuracy_by_tool": """SELECT tool, count(*) AS n, round(avg(CASE WHEN abs(detected_bpm - expected_bpm) <= 0.04::DOUBLE * expected_bpm THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy_1,
round(avg(CASE WHEN """ + " OR ".join(f"abs(detected_bpm - expected_bpm * {m}) <= 0.04::DOUBLE * expected_bpm * {m}" for m in ("1.0::DOUBLE", "0.5::DOUBLE", "2.0::DOUBLE", "(1.0::DOUBLE/3)", "3.0::DOUBLE")) + """ THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy_2, round(avg(abs(detected_bpm - expected_bpm)), 6) AS mae, round(median(abs(detected_bpm - expected_bpm)), 6) AS median_ae, round(avg(elapsed), 4) AS mean_elapsed FROM preds WHERE detected_bpm IS NOT NULL GROUP BY tool""",
    "key_relation": f"WITH {KEYS} SELECT track, relation, score FROM k",
    "key_taxonomy": f"WITH {KEYS} SELECT tool, " + ", ".join(f"count(*) FILTER (relation = '{n}') AS {n}_n" for n in ("exact", "fifth", "relative", "parallel", "tritone", "other")) + " FROM k GROUP BY tool",
    "key_summary_by_tool": f"WITH {KEYS} {SUMMARY} GROUP BY tool",
    "corpus_summary": f"""WITH {KEYS} SELECT count(*) AS tracks, count(detected_key) AS analyzed, (count(*) - count(detected_key)) AS failed, round(avg(CASE WHEN detected_key IS NOT DISTINCT FROM expected_key THEN 1.0::DOUBLE ELSE 0 END), 6) AS key_accuracy,
round(avg(score), 6) AS mean_mirex, round(avg(abs(detected_bpm - expected_bpm)), 6) AS bpm_mae, round(median(abs(detected_bpm - expected_bpm)), 6) AS bpm_median_ae,
round(avg(least(abs(detected_bpm - expected_bpm), abs(2 * detected_bpm - expected_bpm), abs(detected_bpm / 2 - expected_bpm))), 6) AS octave_mae, count(*) FILTER (abs(detected_bpm - expected_bpm) <= 1) AS within_1 FROM k""",
    "metric_diff": f"""WITH {KEYS}, a AS ({SUMMARY} AND track % 2 = 0 GROUP BY tool), b AS ({SUMMARY} AND track % 2 = 1 GROUP BY tool),
u AS (SELECT a.tool, m AS metric, CASE m WHEN 'accuracy' THEN a.accuracy WHEN 'weighted_score' THEN a.weighted_score ELSE a.mean_elapsed END AS baseline, CASE m WHEN 'accuracy' THEN b.accuracy WHEN 'weighted_score' THEN b.weighted_score ELSE b.mean_elapsed END AS current, m <> 'mean_elapsed' AS up FROM a JOIN b USING (tool), (VALUES ('accuracy'), ('weighted_score'), ('mean_elapsed')) v(m))
SELECT tool, metric, baseline, current, round(current - baseline, 6) AS delta, CASE WHEN abs(current - baseline) < 1e-9 THEN '=' WHEN (current > baseline) = up THEN 'better' ELSE 'REGRESSION' END AS verdict FROM u""",
    "camelot_decode": """WITH l AS (SELECT p_partkey, (p_partkey % 15)::VARCHAR || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'b' END AS label, p_partkey % 15 AS n, p_size % 2 = 0 AS minor FROM part),
k AS (SELECT *, CASE WHEN n BETWEEN 1 AND 12 THEN (CASE WHEN minor THEN (8 + 7 * (n - 1)) % 12 + 12 ELSE (11 + 7 * (n - 1)) % 12 END)::INTEGER END AS key FROM l)
SELECT p_partkey, label, key, coalesce(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][key % 12 + 1] || ' ' || CASE WHEN key >= 12 THEN 'minor' ELSE 'major' END, '') AS name FROM k""",
    "key_label_parse": f"SELECT track, (CASE track % {len(_LABELS)} " + " ".join(f"WHEN {i} THEN {k}" for i, k in _PARSE.items()) + " END)::INTEGER AS key FROM preds",
    "mel_scale": "SELECT p_partkey, round(2595::DOUBLE * log10(1 + p_retailprice / 700), 5) AS mel, round(700::DOUBLE * (pow(10::DOUBLE, p_size * 50 / 2595::DOUBLE) - 1), 5) AS hz FROM part",
}
ORACLE = {k: with_views(v, "duckdb") for k, v in ORACLE.items()}


def _profile_sql() -> str:
    from .signals import FOLDED_SQL

    return f"WITH {FOLDED_SQL}, r AS (SELECT (track % 24) >= 12 AS minor, ((bin - track % 12 + 12) % 12)::INTEGER AS degree, x FROM folded) SELECT minor, degree, round(median(x), 6) AS weight FROM r GROUP BY minor, degree"


ORACLE["profile_learning"] = _profile_sql()
QUERIES = {f.__name__: f for f in (tempo_relation, octave_error, tempo_taxonomy, accuracy_by_tool, key_relation, key_taxonomy, key_summary_by_tool, corpus_summary, metric_diff, camelot_decode, key_label_parse, mel_scale, profile_learning)}
