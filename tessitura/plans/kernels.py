"""Queries over sequential kernels, one track at a time; the SQL of the greedy ones is recursive over lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import analysis as A
from ..sources.driver_views import frame_of
from ..sources.synthetic import synthetic_tracks
from .corpus import greedy, recursive

_GAP = "abs(c.bpm - s[k].bpm) / greatest(abs(c.bpm), abs(s[k].bpm), 1.1920929e-07::DOUBLE) <= 0.04::DOUBLE"
SQL = {
    "beat_f1_greedy": "WITH RECURSIVE " + greedy("m", "SELECT track, list(start_s ORDER BY idx) AS r, list(end_s - 300 ORDER BY idx) AS d FROM segs GROUP BY track", 600.0) + """
SELECT track, hits, round(hits / dets::DOUBLE, 6) AS precision, round(hits / refs::DOUBLE, 6) AS recall, round(CASE WHEN hits > 0 THEN 2 * (hits / dets::DOUBLE) * (hits / refs::DOUBLE) / (hits / dets::DOUBLE + hits / refs::DOUBLE) ELSE 0 END, 6) AS f1 FROM m""",
    "merge_short_segments": """WITH RECURSIVE go AS (SELECT track, list({'a': start_s, 'b': end_s, 'k': key_idx} ORDER BY idx) AS l FROM segs GROUP BY track UNION ALL
SELECT track, list_concat(list_concat(l[1:g - 1], [{'a': least(l[g].a, l[g + 1].a), 'b': greatest(l[g].b, l[g + 1].b), 'k': l[g].k}]), l[g + 2:]) FROM (SELECT *, least(i, CASE WHEN i = 1 THEN 2 WHEN i = len(l) THEN i - 1 WHEN l[i - 1].b - l[i - 1].a >= l[i + 1].b - l[i + 1].a THEN i - 1 ELSE i + 1 END) AS g
  FROM (SELECT *, list_position(list_transform(l, lambda s: s.b - s.a < 3600), true) AS i FROM go) p WHERE len(l) > 1 AND i > 0) q),
last AS (SELECT track, arg_min(l, len(l)) AS l FROM go GROUP BY track)
SELECT track, (i - 1)::INTEGER AS idx, l[i].a AS start_s, l[i].b AS end_s, l[i].k AS key_idx FROM (SELECT track, l, unnest(range(1, len(l) + 1)) AS i FROM last) q""",
    "alternate_tempo": f"""WITH RECURSIVE t AS (SELECT track, list({{'d': greatest(end_s - start_s, 0), 'bpm': (60 + key_idx * 5)::DOUBLE}} ORDER BY idx) AS s FROM segs GROUP BY track),
go AS (SELECT track, 1 AS k, []::STRUCT(bpm DOUBLE, d DOUBLE)[] AS cl FROM t UNION ALL
SELECT track, k + 1, CASE WHEN s[k].d <= 2.2e-16 OR abs(s[k].bpm - s[1].bpm) / greatest(s[k].bpm, s[1].bpm) <= 0.04::DOUBLE THEN cl
  WHEN len(list_filter(cl, lambda c: {_GAP})) = 0 THEN list_append(cl, {{'bpm': s[k].bpm, 'd': s[k].d}})
  ELSE list_transform(cl, lambda c, i: CASE WHEN i = list_position(list_transform(cl, lambda c: {_GAP}), true) THEN {{'bpm': (c.bpm * c.d + s[k].bpm * s[k].d) / (c.d + s[k].d), 'd': c.d + s[k].d}} ELSE c END) END
FROM go JOIN t USING (track) WHERE k <= len(s)),
last AS (SELECT track, arg_max(cl, k) AS cl FROM go GROUP BY track),
best AS (SELECT track, list_reduce(cl, lambda a, b: CASE WHEN b.d >= a.d THEN b ELSE a END) AS c, list_sum(list_transform(s, lambda x: x.d)) AS total FROM last JOIN t USING (track) WHERE len(cl) > 0)
SELECT t.track, CASE WHEN c.d / total + 1.1920929e-07 >= 0.05 THEN round(c.bpm, 5) END AS bpm, CASE WHEN c.d / total + 1.1920929e-07 >= 0.05 THEN round(c.d / total, 6) END AS coverage FROM t LEFT JOIN best USING (track)""",
    "pick_peaks": """WITH w AS (SELECT track, idx, x, max(x) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m, count(*) OVER (PARTITION BY track) AS n FROM onset),
p AS (SELECT track, idx, idx - row_number() OVER (PARTITION BY track ORDER BY idx) AS run FROM w WHERE idx >= 5 AND idx < n - 5 AND x >= 50 AND x >= m)
SELECT track, idx AS frame FROM (SELECT *, row_number() OVER (PARTITION BY track, run ORDER BY idx) AS k FROM p) q WHERE k % 2 = 1""",
}
ORACLE: dict[str, str] = {name: recursive(sql) for name, sql in SQL.items()}


def dp_beats(spark, sf_dir):
    def kernel(pdf):
        pdf = pdf.sort_values("idx")
        x = pdf["x"].to_numpy() / 100
        got = K.estimate_tempo(x, 16.0)
        b = K.track_beats(x, got[0], 16.0) if got else np.zeros(0, int)
        pos = K.bar_positions(len(b), K.downbeat_phase(x, b))
        return pd.DataFrame({"track": pdf["track"].iloc[0], "frame": b, "position_in_bar": pos})

    return A.per_track(frame_of(spark, sf_dir, "onset"), kernel, "track long, frame int, position_in_bar int")


def beat_f1_greedy(spark, sf_dir):
    def kernel(pdf):
        pdf = pdf.sort_values("idx")
        ref, det = pdf["start_s"].to_numpy(), pdf["end_s"].to_numpy() - 300
        hit, missed, extra = K.match_events(ref, det, 600.0)
        p, r = hit / max(hit + extra, 1), hit / max(hit + missed, 1)
        return pd.DataFrame({"track": [pdf["track"].iloc[0]], "hits": [hit], "precision": [round(p, 6)], "recall": [round(r, 6)], "f1": [round(2 * p * r / (p + r), 6) if p + r else 0.0]})

    return A.per_track(frame_of(spark, sf_dir, "segs"), kernel, "track long, hits long, precision double, recall double, f1 double")


def merge_short_segments(spark, sf_dir):
    def kernel(pdf):
        pdf = pdf.sort_values("idx")
        rows = pdf[["start_s", "end_s", "key_idx"]].assign(c=0.5).values.tolist()
        out = K.merge_short(rows, 3600.0)
        return pd.DataFrame([(pdf["track"].iloc[0], i, a, b, int(k)) for i, (a, b, k, _) in enumerate(out)], columns=["track", "idx", "start_s", "end_s", "key_idx"])

    return A.per_track(frame_of(spark, sf_dir, "segs"), kernel, "track long, idx int, start_s double, end_s double, key_idx int")


def alternate_tempo(spark, sf_dir):
    def kernel(pdf):
        pdf = pdf.sort_values("idx")
        segs = [(a, b, 60.0 + k * 5) for a, b, k in zip(pdf["start_s"], pdf["end_s"], pdf["key_idx"])]
        got = K.alternate_tempo(segs, segs[0][2], 0.04, 0.05)
        return pd.DataFrame({"track": [pdf["track"].iloc[0]], "bpm": [got and round(got[0], 5)], "coverage": [got and round(got[1], 6)]}, dtype=object)

    return A.per_track(frame_of(spark, sf_dir, "segs"), kernel, "track long, bpm double, coverage double")


def pick_peaks(spark, sf_dir):
    def kernel(pdf):
        pdf = pdf.sort_values("idx")
        got = K.pick_peaks(pdf["x"].to_numpy(), 50.0, 4410, 44100)
        return pd.DataFrame({"track": pdf["track"].iloc[0], "frame": np.array(got, int)})

    return A.per_track(frame_of(spark, sf_dir, "onset"), kernel, "track long, frame int")


def reranker_forward(spark, sf_dir):
    """Logits under fixed pseudo-random weights: the published ones aren't available."""
    from .signals import clips

    weights = np.random.Generator(np.random.PCG64(1729)).normal(0, 0.05, 21528)

    def run(batches):
        w = K.unpack_weights(weights)
        for pdf in batches:
            if len(pdf):
                f = np.abs(np.stack([np.asarray(x)[:60].reshape(5, 12) for x in pdf["samples"]]))
                logits = K.rerank_all(f, np.stack([K.key_scores(v) for v in K.l1(f[:, 0])]), w)
                yield pd.DataFrame({"track": pdf["track"], "key": 23 - logits[:, ::-1].argmax(1), "logit": logits.max(1)})

    return clips(spark, sf_dir, dealt=True).mapInPandas(run, "track long, key int, logit double")


def log_mel(spark, sf_dir):
    from .signals import clips

    def run(batches):
        for pdf in batches:
            for track, x in zip(pdf["track"], pdf["samples"]):
                m = K.log_mel(np.asarray(x), 32, 16, 8, 8000)
                f, b = np.meshgrid(np.arange(m.shape[0]), np.arange(m.shape[1]), indexing="ij")
                yield pd.DataFrame({"track": track, "frame": f.ravel(), "mel": b.ravel(), "value": m.ravel()})

    return clips(spark, sf_dir).mapInPandas(run, "track long, frame int, mel int, value double")


def synthetic_analysis(spark, sf_dir):
    """Chord and clicks at 90, 120 and 128 BPM, analysed end to end."""
    a = A.analyze(synthetic_tracks(spark, (90, 120, 128)), 100)
    return a.select("track_id", F.round("analysis.beat.global_bpm", 1).alias("bpm"), F.size("analysis.beat.beats").alias("beats"), F.col("analysis.key.key.tonic").alias("tonic"), F.col("analysis.key.key.mode").alias("mode"), F.size("analysis.waveform.columns").alias("columns"), "error")


QUERIES = {f.__name__: f for f in (dp_beats, beat_f1_greedy, merge_short_segments, alternate_tempo, pick_peaks, reranker_forward, log_mel, synthetic_analysis)}
