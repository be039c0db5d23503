"""Queries over ordered series: onset envelopes, tempo candidates, segments and their joins, in SQL.

``BODIES`` is the SQL that DuckDB answers; the functions below answer the same by the DataFrame operators of
``operators.series``, ``operators.tempo`` and ``sources.manifest``.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import tempo as T
from ..sources import manifest as M
from ..sources.driver_views import frame_of, run_sql, with_views

RATE = 16  # nominal envelope frames a second
MIN_LAG, MAX_LAG = 5, 16  # 60..200 BPM

LAGS = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS lag" for i in range(1, MAX_LAG + 1))
D = lambda x: f"CAST({x} AS DOUBLE)"

CORR = f"""lags AS ({LAGS}), sized AS (SELECT track, count(*) AS n FROM onset GROUP BY track),
corr AS (SELECT b.track, l.lag, sum(a.x * b.x) / greatest(sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 1.1920929e-07) AS r
FROM onset b CROSS JOIN lags l JOIN onset a ON a.track = b.track AND a.idx = b.idx - l.lag GROUP BY b.track, l.lag)"""

PEAKS = """level AS (SELECT track, avg(x) + stddev_pop(x) / 2 AS t FROM onset GROUP BY track),
near AS (SELECT track, idx, x, lag(x) OVER (PARTITION BY track ORDER BY idx) AS p, lead(x) OVER (PARTITION BY track ORDER BY idx) AS n FROM onset),
peaks AS (SELECT near.track, idx, x FROM near JOIN level ON near.track = level.track WHERE x > t AND x >= p AND x > n)"""

HIST = f"""hist AS (SELECT a.track, CAST(b.idx - a.idx AS INTEGER) AS lag, sum(sqrt(a.x * b.x)) AS h
FROM peaks a JOIN peaks b ON a.track = b.track AND b.idx - a.idx BETWEEN {MIN_LAG} AND {MAX_LAG} GROUP BY a.track, b.idx - a.idx)"""

BASE = f"""hmax AS (SELECT track, max(h) AS hm FROM hist GROUP BY track),
grid AS (SELECT c.track, c.lag, c.r, coalesce(h.h, 0) AS h, greatest(coalesce(m.hm, 0), 1.1920929e-07) AS hm FROM corr c
LEFT JOIN hist h ON h.track = c.track AND h.lag = c.lag LEFT JOIN hmax m ON m.track = c.track),
around AS (SELECT track, lag, r, h, sum(h) OVER w / hm AS i, greatest(max(r) OVER w, 0) AS p FROM grid
WINDOW w AS (PARTITION BY track ORDER BY lag ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
base AS (SELECT track, lag, r, h, {D(0.65)} * i + {D(0.35)} * p AS s FROM around WHERE lag >= {MIN_LAG})"""

FAMILY = f"""fam AS (SELECT a.track, a.lag, a.r, a.h, a.s + coalesce(b.s, 0) * {D(0.35)} + coalesce(c.s, 0) * {D(0.15)} + coalesce(d.s, 0) * {D(0.25)} + coalesce(e.s, 0) * {D(0.2)} AS f
FROM base a LEFT JOIN base b ON b.track = a.track AND b.lag = 2 * a.lag LEFT JOIN base c ON c.track = a.track AND c.lag = 3 * a.lag
LEFT JOIN base d ON d.track = a.track AND d.lag = CAST(floor(a.lag * {D(3)} / 2) AS INTEGER) LEFT JOIN base e ON e.track = a.track AND e.lag = CAST(floor(a.lag * {D(4)} / 3) AS INTEGER)),
cand AS (SELECT track, lag, r, h, f * ({D(0.75)} + {D(0.25)} * exp(-power(log2({D(60 * RATE)} / lag / 120), 2) / 8)) AS s FROM fam)"""

#: Best lag (ties to the last), a slower one where that is fast and well supported, its refined period.
ESTIMATE = f"""best AS (SELECT track, lag AS best_lag, s AS best_s FROM (SELECT track, lag, s, row_number() OVER (PARTITION BY track ORDER BY s DESC, lag DESC) AS k FROM cand) q WHERE k = 1),
slow AS (SELECT b.*, x.lag AS l1, x.s AS s1, y.lag AS l2, y.s AS s2 FROM best b
LEFT JOIN cand x ON x.track = b.track AND x.lag = CAST(floor(best_lag * {D(3)} / 2) AS INTEGER) LEFT JOIN cand y ON y.track = b.track AND y.lag = CAST(floor(best_lag * {D(4)} / 3) AS INTEGER)),
first_try AS (SELECT *, CASE WHEN {D(60 * RATE)} / best_lag > 135 AND s1 > {D(0.7)} * best_s AND s1 > {D(0.9)} * best_s THEN l1 ELSE best_lag END AS la,
CASE WHEN {D(60 * RATE)} / best_lag > 135 AND s1 > {D(0.7)} * best_s AND s1 > {D(0.9)} * best_s THEN s1 ELSE best_s END AS sa FROM slow),
final AS (SELECT track, CASE WHEN {D(60 * RATE)} / best_lag > 135 AND s2 > {D(0.7)} * best_s AND s2 > {D(0.9)} * sa THEN l2 ELSE la END AS lag FROM first_try),
own AS (SELECT f.track, f.lag, c.s, c.r FROM final f JOIN cand c ON c.track = f.track AND c.lag = f.lag),
other AS (SELECT o.track, greatest(coalesce(max(CASE WHEN abs(c.lag - o.lag) > 2 THEN c.s END), 0), 0) AS s2 FROM own o JOIN cand c ON c.track = o.track GROUP BY o.track),
refined AS (SELECT o.track, CASE WHEN sum(c.h) > 1.1920929e-07 THEN sum(c.h * c.lag) / sum(c.h) ELSE {D("max(o.lag)")} END AS period FROM own o JOIN cand c ON c.track = o.track AND c.lag BETWEEN o.lag - 1 AND o.lag + 1 GROUP BY o.track),
energy AS (SELECT track, sqrt(sum(x * x) / count(*)) AS a FROM onset GROUP BY track)
SELECT o.track, o.lag, round(greatest(60, least(200, {D(60 * RATE)} / period)), 5) AS bpm,
round(greatest(0, least(1, greatest(0, least(1, r)) * ({D(0.75)} + {D(0.25)} * CASE WHEN s > 1.1920929e-07 THEN greatest(0, least(1, (s - s2) / s)) ELSE 0 END) * least(1, a * 100))), 5) AS confidence
FROM own o JOIN other USING (track) JOIN refined USING (track) JOIN energy USING (track)"""

EXPECTED = "ref AS (SELECT track, start_s, end_s, key_idx FROM segs), det AS (SELECT track, start_s + {q} AS start_s, end_s + {q} AS end_s, CASE WHEN idx % 3 = 0 THEN (key_idx + 7) % 24 ELSE key_idx END AS key_idx, idx FROM segs)".replace("{q}", "(end_s - start_s) / 4")

BODIES = {
    "onset_flux": "SELECT track, idx, round(greatest(x - coalesce(lag(x) OVER (PARTITION BY track ORDER BY idx), 0), 0), 6) AS flux FROM onset",
    "onset_peaks": f"WITH {PEAKS} SELECT track, idx, round(x, 6) AS x FROM peaks",
    "interval_histogram": f"WITH {PEAKS}, {HIST} SELECT track, lag, round(h, 5) AS h FROM hist",
    "autocorrelation": f"WITH {CORR} SELECT track, lag, round(r, 6) AS r FROM corr",
    "tempo_base_score": f"WITH {CORR}, {PEAKS}, {HIST}, {BASE} SELECT track, lag, round(s, 5) AS s FROM base",
    "tempo_candidates": f"WITH {CORR}, {PEAKS}, {HIST}, {BASE}, {FAMILY} SELECT track, lag, round(s, 5) AS s FROM cand",
    "tempo_estimate": f"WITH {CORR}, {PEAKS}, {HIST}, {BASE}, {FAMILY}, {ESTIMATE}",
    "tempo_islands": f"""WITH w AS (SELECT track, (idx // 4)::INTEGER AS idx, avg(x) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) + 60 AS bpm, idx AS i, count(*) OVER (PARTITION BY track) AS n FROM onset),
g AS (SELECT track, idx, i + {D(4)} AS mid, n, bpm, abs(bpm - lag(bpm) OVER (PARTITION BY track ORDER BY idx)) / greatest(lag(bpm) OVER (PARTITION BY track ORDER BY idx), 1) > {D(0.04)} AS c FROM w WHERE i % 4 = 0 AND i + 8 <= n),
i AS (SELECT *, sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY idx) AS island FROM g),
r AS (SELECT track, island, min(mid) AS a, max(mid) AS b, max(n) AS n, avg(bpm) AS bpm, count(*) AS windows FROM i GROUP BY track, island)
SELECT track, CAST(island AS BIGINT) AS island, round(coalesce((lag(b) OVER q + a) / 2, 0), 3) AS start_s, round(coalesce((b + lead(a) OVER q) / 2, n), 3) AS end_s, round(bpm, 5) AS bpm, windows FROM r WINDOW q AS (PARTITION BY track ORDER BY island)""",
    "event_islands": """WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY track ORDER BY idx) THEN 0 ELSE 1 END AS change FROM segs),
i AS (SELECT *, sum(change) OVER (PARTITION BY track ORDER BY idx) AS island FROM g)
SELECT track, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, round(max(end_s) - min(start_s), 3) AS seconds FROM i GROUP BY track, island""",
    "plausible_intervals": f"""WITH d AS (SELECT track, (end_s - start_s) / 86400 AS d FROM segs)
SELECT track, count(*) AS n, round(60 / median(d), 6) AS bpm FROM d WHERE d BETWEEN {D(0.25)} AND 2 GROUP BY track""",
    "downbeat_phase": """WITH s AS (SELECT track, idx % 4 AS phase, sum(x) AS s, count(*) AS n FROM onset GROUP BY track, idx % 4),
r AS (SELECT track, phase, s, row_number() OVER (PARTITION BY track ORDER BY s DESC, phase) AS k FROM s)
SELECT track, CAST(phase AS INTEGER) AS phase, round(s, 6) AS strength FROM r WHERE k = 1""",
    "display_bpm": f"""WITH d AS (SELECT track, 60 / median((end_s - start_s) / 86400) AS est FROM segs WHERE end_s > start_s GROUP BY track), t AS (SELECT track, idx, start_s / 86400 AS t, est FROM segs JOIN d USING (track)),
c AS (SELECT track, idx, t, floor(est) AS bpm, 0 AS side FROM t UNION ALL SELECT track, idx, t, ceil(est), 1 FROM t),
o AS (SELECT track, side, bpm, t - idx * {D(60)} / bpm AS o FROM c WHERE bpm > 0), m AS (SELECT *, row_number() OVER (PARTITION BY track, side ORDER BY o) - 1 AS k, count(*) OVER (PARTITION BY track, side) AS n FROM o),
f AS (SELECT track, side, max(CASE WHEN k = n // 2 THEN o END) AS off FROM m GROUP BY track, side),
e AS (SELECT o.track, o.side, any_value(bpm) AS bpm, avg(abs(o.o - f.off)) AS err FROM o JOIN f ON f.track = o.track AND f.side = o.side GROUP BY o.track, o.side),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(err, 9), side) AS k FROM e)
SELECT track, bpm, round(err, 6) AS err FROM r WHERE k = 1""",
    "key_segments": f"""WITH w AS (SELECT s.track, s.idx, (start_s + end_s) / 2 AS mid, key_idx, x - floor(x) AS confidence, max(end_s) OVER (PARTITION BY s.track) AS hi FROM segs s JOIN onset o ON o.track = s.track AND o.idx = s.idx),
g AS (SELECT *, CASE WHEN key_idx <> lag(key_idx) OVER (PARTITION BY track ORDER BY idx) AND confidence >= {D(0.35)} THEN 1 ELSE 0 END AS c FROM w),
i AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY idx) AS island FROM g),
k AS (SELECT track, island, key_idx, row_number() OVER (PARTITION BY track, island ORDER BY count(*) DESC, min(idx) DESC) AS rn FROM i GROUP BY track, island, key_idx),
r AS (SELECT track, island, min(mid) AS a, max(mid) AS b, max(hi) AS hi, avg(confidence) AS confidence, count(*) AS windows FROM i GROUP BY track, island)
SELECT r.track, CAST(r.island AS BIGINT) AS island, round(coalesce((lag(b) OVER q + a) / 2, 0), 3) AS start_s, round(coalesce((b + lead(a) OVER q) / 2, hi), 3) AS end_s, key_idx, round(confidence, 5) AS confidence, windows
FROM r JOIN k ON k.track = r.track AND k.island = r.island AND k.rn = 1 WINDOW q AS (PARTITION BY r.track ORDER BY r.island)""",
    "key_majority": """WITH c AS (SELECT track, key_idx, count(*) AS n, min(idx) AS first_idx FROM segs GROUP BY track, key_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, first_idx DESC) AS k FROM c) SELECT track, key_idx, n FROM r WHERE k = 1""",
    "key_alternate": f"""WITH p AS (SELECT track, key_idx AS home FROM segs WHERE idx = 0), d AS (SELECT s.track, s.key_idx, sum(end_s - start_s) AS d, max(idx) AS last_idx FROM segs s JOIN p ON p.track = s.track AND s.key_idx <> p.home GROUP BY s.track, s.key_idx),
t AS (SELECT track, sum(end_s - start_s) AS total FROM segs GROUP BY track), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY d DESC, last_idx DESC) AS k FROM d)
SELECT r.track, key_idx, round(d / total, 6) AS coverage FROM r JOIN t ON t.track = r.track WHERE k = 1 AND d / total >= {D(0.1)}""",
    "longest_segment": "SELECT track, idx, key_idx, round(end_s - start_s, 3) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY end_s - start_s DESC, idx DESC) AS k FROM segs) q WHERE k = 1",
    "key_boundaries": "SELECT track, round(start_s, 3) AS at FROM (SELECT track, start_s, key_idx, lag(key_idx) OVER (PARTITION BY track ORDER BY idx) AS p FROM segs) q WHERE p IS NOT NULL AND p <> key_idx",
    "midpoint_segment_error": f"""WITH {EXPECTED}, m AS (SELECT r.track, r.start_s, {D(5)} * abs(r.key_idx - d.key_idx) AS err, row_number() OVER (PARTITION BY r.track, r.start_s ORDER BY d.idx) AS k
FROM ref r JOIN det d ON d.track = r.track AND (r.start_s + r.end_s) / 2 >= d.start_s AND (r.start_s + r.end_s) / 2 < d.end_s)
SELECT track, round(avg(err), 6) AS err, count(*) AS n FROM m WHERE k = 1 GROUP BY track""",
    "segment_overlap_accuracy": f"""WITH {EXPECTED}, o AS (SELECT r.track, sum(least(r.end_s, d.end_s) - greatest(r.start_s, d.start_s)) AS hit
FROM ref r JOIN det d ON d.track = r.track AND d.start_s < r.end_s AND r.start_s < d.end_s AND r.key_idx = d.key_idx GROUP BY r.track),
t AS (SELECT track, sum(end_s - start_s) AS total FROM ref GROUP BY track) SELECT t.track, round(coalesce(hit, 0) / total, 6) AS accuracy FROM t LEFT JOIN o ON o.track = t.track""",
    "tap_tempo": """WITH d AS (SELECT track, idx, start_s / 86400 AS t, start_s / 86400 - lag(start_s / 86400) OVER (PARTITION BY track ORDER BY idx) AS gap FROM segs),
g AS (SELECT *, sum(CASE WHEN gap > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY idx) AS run FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY track, run ORDER BY idx DESC) AS back, row_number() OVER (PARTITION BY track, run ORDER BY idx) AS pos FROM g)
SELECT track, CAST(run AS BIGINT) AS run, count(*) AS taps, round(60 / median(CASE WHEN pos > 1 THEN gap END), 5) AS bpm FROM k WHERE back <= 8 GROUP BY track, run HAVING median(CASE WHEN pos > 1 THEN gap END) > 0""",
    "manifest_violations": """SELECT track, rule, count(*) AS n FROM (
SELECT track, 'bpm' AS rule FROM preds WHERE detected_bpm IS NULL OR detected_bpm <= 0 UNION ALL
SELECT track, 'key' AS rule FROM preds WHERE detected_key IS NULL UNION ALL
SELECT track, 'order' AS rule FROM (SELECT track, start_s, lag(end_s) OVER (PARTITION BY track ORDER BY idx) AS p FROM segs) a WHERE start_s < p UNION ALL
SELECT track, 'range' AS rule FROM segs WHERE end_s <= start_s OR start_s < 0 UNION ALL
SELECT track, 'unique' AS rule FROM (SELECT o_custkey AS track, count(*) AS n FROM orders GROUP BY o_custkey) b WHERE n > 1) q GROUP BY track, rule""",
    "stable_sample": "SELECT o_orderkey, h FROM (SELECT o_orderkey, substr(h, 1, 16) AS h FROM (SELECT o_orderkey, {sha:concat('sample:', CAST(o_orderkey AS VARCHAR(20)))} AS h FROM orders) p ORDER BY p.h LIMIT 500) q",
    "upsert_tracks": """WITH old AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 <> 0), new AS (SELECT c_custkey AS id, c_mktsegment AS name, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(new.id, old.id) AS id, coalesce(new.name, old.name) AS name, round(coalesce(new.v, old.v), 4) AS v, CASE WHEN old.id IS NULL THEN 'imported' WHEN new.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old FULL OUTER JOIN new ON old.id = new.id""",
    "resume_anti_join": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "blocked_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND (n_name LIKE 'NATION_1%' OR n_regionkey = 2))",
    "consensus_bpm": """SELECT sound, round(median(bpm), 6) AS bpm, count(*) AS n FROM (SELECT event_id // 3 AS sound, round(value / 50) AS bpm FROM events WHERE event_type <> 'click' AND event_id % 4 <> 0 AND value IS NOT NULL) q
GROUP BY sound HAVING count(*) >= 2 AND max(bpm) - min(bpm) <= 1""",
    "missing_audio": "SELECT count(*) AS listed, CAST(sum(CASE WHEN l.l_partkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) l ON l.l_partkey = p.p_partkey",
    "nearest_rank_by_region": """SELECT r_name, count(*) AS n, round(avg(s_acctbal), 5) AS mean, round(list_sort(list(s_acctbal))[count(*) // 2 + 1], 5) AS middle, round(list_sort(list(s_acctbal))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS BIGINT) + 1], 5) AS p95
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
}


def _sha(body: str) -> str:
    return re.sub(r"\{sha:(.*?)\} AS", r"sha256(\1) AS", body)


def _cand(spark, sf_dir):
    return T.family(T.gather(_base(spark, sf_dir)), RATE, MIN_LAG)


def tempo_candidates(spark, sf_dir):
    return _cand(spark, sf_dir).select("track", F.inline("cand")).select("track", "lag", F.round("s", 5).alias("s"))


def tempo_estimate(spark, sf_dir):
    rms = run_sql(spark, sf_dir, "SELECT track, sqrt(sum(x * x) / count(*)) AS rms FROM onset GROUP BY track")
    got = T.estimate(_cand(spark, sf_dir), rms, RATE, MIN_LAG, 60.0, 200.0)
    return got.select("track", "lag", F.round("bpm", 5).alias("bpm"), F.round("confidence", 5).alias("confidence"))


def _onset(spark, sf_dir):
    return frame_of(spark, sf_dir, "onset")


def _segs(spark, sf_dir):
    return frame_of(spark, sf_dir, "segs")


def _rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _detected(segs):
    q = (F.col("end_s") - F.col("start_s")) / 4
    return segs.select("track", "idx", (F.col("start_s") + q).alias("start_s"), (F.col("end_s") + q).alias("end_s"), F.when(F.col("idx") % 3 == 0, (F.col("key_idx") + 7) % 24).otherwise(F.col("key_idx")).alias("key_idx"))


def onset_flux(spark, sf_dir):
    return _rounded(S.flux(_onset(spark, sf_dir)), flux=6)


def onset_peaks(spark, sf_dir):
    return _rounded(S.peaks(_onset(spark, sf_dir)), x=6)


def interval_histogram(spark, sf_dir):
    return _rounded(S.interval_histogram(S.peaks(_onset(spark, sf_dir)), MIN_LAG, MAX_LAG), h=5)


def autocorrelation(spark, sf_dir):
    return _rounded(S.autocorrelation(_onset(spark, sf_dir), MAX_LAG), r=6)


def _base(spark, sf_dir):
    onset = _onset(spark, sf_dir)
    return S.base_score(S.autocorrelation(onset, MAX_LAG), S.interval_histogram(S.peaks(onset), MIN_LAG, MAX_LAG), MIN_LAG)


def tempo_base_score(spark, sf_dir):
    return _rounded(_base(spark, sf_dir).select("track", "lag", "s"), s=5)


def tempo_islands(spark, sf_dir):
    """Windows of eight onsets, four apart, whose level stands for a tempo."""
    w = S.in_order().rowsBetween(0, 7)
    n = F.count(F.lit(1)).over(S.whole_track())
    each = _onset(spark, sf_dir).select("track", F.col("idx").alias("i"), F.floor(F.col("idx") / 4).cast("int").alias("idx"), (F.col("idx") + 4.0).alias("at"), (F.avg("x").over(w) + 60).alias("bpm"), F.lit(0.0).alias("lo"), n.cast("double").alias("hi"))
    got = S.tempo_segments(each.where("i % 4 = 0 AND i + 8 <= hi"))
    return _rounded(got.select("track", "island", "start_s", "end_s", "bpm", "windows"), start_s=3, end_s=3, bpm=5)


def event_islands(spark, sf_dir):
    runs = S.islands(_segs(spark, sf_dir), ~F.col("event_type").eqNullSafe(F.lag("event_type").over(S.in_order())))
    return runs.groupBy("track", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.round(F.max("end_s") - F.min("start_s"), 3).alias("seconds"))


def plausible_intervals(spark, sf_dir):
    d = (F.col("end_s") - F.col("start_s")) / 86400
    return _segs(spark, sf_dir).select("track", d.alias("d")).where(F.col("d").between(0.25, 2)).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.round(60 / F.median("d"), 6).alias("bpm"))


def downbeat_phase(spark, sf_dir):
    return _rounded(S.downbeat_phase(_onset(spark, sf_dir)), strength=6)


def display_bpm(spark, sf_dir):
    segs = _segs(spark, sf_dir)
    tempi = segs.where("end_s > start_s").groupBy("track").agg((60 / F.median((F.col("end_s") - F.col("start_s")) / 86400)).alias("bpm"))
    return S.display_bpm(segs.select("track", "idx", (F.col("start_s") / 86400).alias("t")), tempi).select("track", "bpm", F.round("misfit", 6).alias("err"))


def key_segments(spark, sf_dir):
    """Segments as windows, their onset's fraction as the confidence."""
    sure = _onset(spark, sf_dir).select("track", "idx", (F.col("x") - F.floor("x")).alias("confidence"))
    w = _segs(spark, sf_dir).join(sure, ["track", "idx"]).select("track", "idx", ((F.col("start_s") + F.col("end_s")) / 2).alias("at"), "key_idx", "confidence", F.lit(0.0).alias("lo"), F.max("end_s").over(S.whole_track()).alias("hi"))
    return _rounded(S.key_segments(w).select("track", "island", "start_s", "end_s", "key_idx", "confidence", "windows"), start_s=3, end_s=3, confidence=5)


def key_majority(spark, sf_dir):
    return S.majority(_segs(spark, sf_dir), ["track"], "key_idx", "idx")


def key_alternate(spark, sf_dir):
    segs = _segs(spark, sf_dir).withColumn("home", F.first("key_idx").over(S.in_order().rowsBetween(Window.unboundedPreceding, 0)))
    total = segs.groupBy("track").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("total"))
    held = segs.where("key_idx <> home").groupBy("track", "key_idx").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("d"), F.max("idx").alias("last"))
    best = held.groupBy("track").agg(F.max(F.struct("d", "last", "key_idx")).alias("b")).join(total, "track")
    return best.select("track", "b.key_idx", (F.col("b.d") / F.col("total")).alias("coverage")).where("coverage >= 0.1").select("track", "key_idx", F.round("coverage", 6).alias("coverage"))


def longest_segment(spark, sf_dir):
    best = _segs(spark, sf_dir).groupBy("track").agg(F.max(F.struct((F.col("end_s") - F.col("start_s")).alias("d"), "idx", "key_idx")).alias("b"))
    return best.select("track", "b.idx", "b.key_idx", F.round("b.d", 3).alias("seconds"))


def key_boundaries(spark, sf_dir):
    edge = _segs(spark, sf_dir).withColumn("p", F.lag("key_idx").over(S.in_order())).where("p <> key_idx")
    return edge.select("track", F.round("start_s", 3).alias("at"))


def midpoint_segment_error(spark, sf_dir):
    value = lambda df: df.withColumn("value", 60 + 5.0 * F.col("key_idx"))
    segs = _segs(spark, sf_dir)
    got = S.midpoint_pairs(value(segs), value(_detected(segs)))
    return got.groupBy("track").agg(F.round(F.avg(F.abs(F.col("r_value") - F.col("d_value"))), 6).alias("err"), F.count(F.lit(1)).alias("n"))


def segment_overlap_accuracy(spark, sf_dir):
    segs = _segs(spark, sf_dir)
    return _rounded(S.overlap_accuracy(segs, _detected(segs)), accuracy=6)


def tap_tempo(spark, sf_dir):
    return _rounded(S.tap_tempo(_segs(spark, sf_dir).select("track", "idx", (F.col("start_s") / 86400).alias("t"))), bpm=5)


def upsert_tracks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = c.where("c_custkey % 3 <> 0 OR c_custkey % 2 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 4).alias("v"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.round(F.col("c_acctbal") * 2, 4).alias("v"))
    return M.upsert(old, new, "id", keep=())


def manifest_violations(spark, sf_dir):
    p, segs = frame_of(spark, sf_dir, "preds"), _segs(spark, sf_dir)
    each = p.select("track", F.array_compact(F.array(F.when(~F.coalesce(F.col("detected_bpm") > 0, F.lit(False)), "bpm"), F.when(F.col("detected_key").isNull(), "key"))).alias("rules"))
    early = F.coalesce(F.col("start_s") < F.lag("end_s").over(S.in_order()), F.lit(False))
    ranges = segs.select("track", F.array_compact(F.array(F.when(early, "order"), F.when((F.col("end_s") <= F.col("start_s")) | (F.col("start_s") < 0), "range"))).alias("rules"))
    counted = each.unionByName(ranges).select("track", F.explode("rules").alias("rule")).groupBy("track", "rule").agg(F.count(F.lit(1)).alias("n"))
    twice = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("track")).count().where("count > 1").select("track", F.lit("unique").alias("rule"), F.lit(1).cast("long").alias("n"))
    return counted.unionByName(twice)


def stable_sample(spark, sf_dir):
    got = M.stable_sample(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "sample", 500, "o_orderkey")
    return got.select("o_orderkey", F.substring(F.sha2(F.concat(F.lit("sample:"), F.col("o_orderkey").cast("string")), 256), 1, 16).alias("h"))


def resume_anti_join(spark, sf_dir):
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.remaining_jobs(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), done, ["o_orderkey"])


def blocked_semi_join(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("corpus"), "n_name", "n_regionkey")
    blocked = M.blocked(nations, F.col("n_name"), ("NATION_1",), F.col("n_regionkey").isin(2)).select(F.col("corpus").alias("c_nationkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(blocked, "c_nationkey", "left_semi").select("c_custkey", "c_name")


def consensus_bpm(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    notes = e.select(F.floor(F.col("event_id") / 3).alias("sound"), F.round(F.col("value") / 50).alias("bpm"), (F.col("event_type") == "click").alias("discard"), (F.col("event_id") % 4 != 0).alias("well_cut"))
    return M.consensus(notes).select("sound", F.round("bpm", 6).alias("bpm"), "n")


def missing_audio(spark, sf_dir):
    here = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("here", F.lit(True))
    return spark.read.parquet(f"{sf_dir}/part.parquet").join(here, "p_partkey", "left").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("here").isNull()).alias("missing"))


def nearest_rank_by_region(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    j = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    order = F.row_number().over(Window.partitionBy("r_name").orderBy("s_acctbal")) - 1
    ranked = j.select("r_name", "s_acctbal", order.alias("k"), F.count(F.lit(1)).over(Window.partitionBy("r_name")).alias("n"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.round("s_acctbal", 5)))
    return ranked.groupBy("r_name").agg(F.max("n").alias("n"), F.round(F.avg("s_acctbal"), 5).alias("mean"), at(F.floor(F.col("n") / 2)).alias("middle"), at(F.floor((F.col("n") - 1) * 0.95 + 0.5)).alias("p95"))


OWN = (
    onset_flux, onset_peaks, interval_histogram, autocorrelation, tempo_base_score, tempo_islands, event_islands, plausible_intervals, downbeat_phase, display_bpm, key_segments, key_majority, key_alternate, longest_segment, key_boundaries,
    midpoint_segment_error, segment_overlap_accuracy, tap_tempo, manifest_violations, upsert_tracks, stable_sample, resume_anti_join, blocked_semi_join, consensus_bpm, missing_audio, nearest_rank_by_region,
)
QUERIES = {f.__name__: f for f in OWN} | {"tempo_candidates": tempo_candidates, "tempo_estimate": tempo_estimate}
ORACLE = {name: with_views(_sha(body), "duckdb") for name, body in BODIES.items()}
