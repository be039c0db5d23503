"""Queries over clips and chroma vectors: in-row array expressions, no shuffle where none is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chroma as C
from ..functions.profiles import template
from ..operators import waveform as W


def clips(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """track, samples. ``dealt``: over spark.sql.shuffle.partitions tasks, for work that outweighs moving the clips: a file of one row group is one task."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    if dealt:
        e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return e.select(F.col("vec_id").alias("track"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five |x| 12-vectors of elements 1..60, normalised, and their energies."""
    raw = lambda f: F.transform(F.slice("samples", f * 12 + 1, 12), lambda x: F.abs(x))
    each = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda f: F.struct(f.alias("frame_idx"), raw(f).alias("raw")))
    return clips(spark, sf_dir).select("track", F.explode(each).alias("f")).select("track", "f.frame_idx", C.normalize(F.col("f.raw")).alias("v"), C.total(F.col("f.raw")).alias("energy"))


FRAMES_SQL = """raw AS (SELECT vec_id AS track, f AS frame_idx, b AS bin, abs(embedding[f * 12 + b + 1])::DOUBLE AS x FROM embeddings, range(0, 5) a(f), range(0, 12) c(b)),
frames AS (SELECT track, frame_idx, bin, x / sum(x) OVER (PARTITION BY track, frame_idx) AS x, sum(x) OVER (PARTITION BY track, frame_idx) AS energy FROM raw)"""


def waveform_columns(spark, sf_dir):
    return W.overview(clips(spark, sf_dir), 16).select("track", F.explode("columns").alias("c")).select("track", "c.column_index", *[F.round(f"c.{x}", 6).alias(x) for x in ("min", "max", "rms")])


WAVE = """x AS (SELECT vec_id AS track, unnest(range(0, 64))::INTEGER AS i, greatest(-1, least(1, unnest(embedding)::DOUBLE)) AS x FROM embeddings),
cols AS (SELECT track, (i // 4)::INTEGER AS column_index, min(x) AS mn, max(x) AS mx, sqrt(avg(x * x)) AS rms FROM x GROUP BY track, i // 4)"""


def waveform_heights(spark, sf_dir):
    return W.display_heights(W.overview(clips(spark, sf_dir), 16)).select("track", F.posexplode("heights").alias("column_index", "h")).select("track", "column_index", F.round("h", 6).alias("height"))


def spectral_balance(spark, sf_dir):
    return clips(spark, sf_dir).select("track", F.round(W.spectral_balance(F.col("samples"), 64, 8000), 6).alias("balance"))


def zero_crossing_balance(spark, sf_dir):
    return clips(spark, sf_dir).select("track", F.round(W.time_balance(F.col("samples")), 6).alias("balance"))


def resample(spark, sf_dir):
    out = W.resample(F.col("samples"), 1.5)
    return clips(spark, sf_dir).select("track", F.posexplode(out).alias("i", "x")).select("track", "i", F.round("x", 6).alias("x"))


def chroma_whiten(spark, sf_dir):
    w = C.normalize(C.whiten(F.col("v")))
    return frames(spark, sf_dir).select("track", "frame_idx", F.posexplode(w).alias("bin", "x")).select("track", "frame_idx", "bin", F.round("x", 6).alias("x"))


def chroma_tuning(spark, sf_dir):
    s = frames(spark, sf_dir).select("track", C.peak_offsets(F.col("v")).alias("p")).groupBy("track").agg(F.sum("p.o").alias("o"), F.sum("p.w").alias("w"))
    return s.select("track", F.round(F.when(F.col("w") > C.EPS, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("o") / F.col("w")))).otherwise(0.0), 6).alias("tuning"))


def chroma_shift(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select("track", "frame_idx", F.posexplode(C.shift(F.col("v"), F.lit(0.25))).alias("bin", "x")).select("track", "frame_idx", "bin", F.round("x", 6).alias("x"))


def chroma_weighted_median(spark, sf_dir):
    f = frames(spark, sf_dir).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "energy", "v"))).alias("f"))
    previous = lambda i: F.when(i > 0, F.sqrt(F.get(F.col("f.energy"), (i - 1).cast("int")))).otherwise(None)
    weight = lambda x, i: 1.0 + 4.0 * F.greatest(F.lit(0.0), F.coalesce(F.sqrt(x["energy"]) - previous(i), F.lit(0.0)))
    weighted = f.select("track", F.transform("f", lambda x, i: F.struct(weight(x, i).alias("w"), x["v"].alias("v"))).alias("f"))
    pick = lambda b: F.get(F.array_sort(F.transform("f", lambda x: x["w"] * F.get(x["v"], b))), F.floor(F.size("f") / 2).cast("int"))
    return weighted.select("track", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(11)), pick)).alias("bin", "x")).select("track", "bin", F.round("x", 6).alias("x"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, v: all |x| of a clip folded onto twelve bins, normalised."""
    fold = lambda b: F.aggregate(F.filter("samples", lambda x, i: i % 12 == b), F.lit(0.0), lambda s, x: s + F.abs(x))
    return clips(spark, sf_dir).select("track", F.transform(F.sequence(F.lit(0), F.lit(11)), fold).alias("raw")).select("track", C.normalize(F.col("raw")).alias("v"))


FOLDED_SQL = """ch AS (SELECT vec_id AS track, (i - 1) % 12 AS bin, sum(abs(embedding[i]::DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY vec_id, (i - 1) % 12),
folded AS (SELECT track, bin, x / sum(x) OVER (PARTITION BY track) AS x FROM ch)"""


def _scores(spark, sf_dir) -> DataFrame:
    return folded(spark, sf_dir).select("track", "v", C.key_scores(F.col("v")).alias("scores"))


def key_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("track", F.posexplode("scores").alias("key", "s")).select("track", "key", F.round("s", 6).alias("score"))


def key_classify(spark, sf_dir):
    top = _scores(spark, sf_dir).select("track", "v", C.top_two(F.col("scores")).alias("top"))
    return top.select("track", F.get("top", F.lit(0))["key"].alias("best"), F.get("top", F.lit(1))["key"].alias("second"), C.choose_key(F.col("v"), F.col("top")).alias("chosen"), F.round(C.confidence(F.col("top")), 5).alias("confidence"))


_TEMPLATE = "tmpl(key, bin, p) AS (VALUES " + ", ".join(f"({k}, {b}, {float(x)!r}::DOUBLE)" for k, row in enumerate(template()) for b, x in enumerate(row)) + ")"
SCORES_SQL = f"""{FOLDED_SQL}, {_TEMPLATE}, c AS (SELECT track, bin, x, x - avg(x) OVER (PARTITION BY track) AS d FROM folded),
n AS (SELECT track, bin, x, d / greatest(sqrt(sum(d * d) OVER (PARTITION BY track)), 1.1920929e-07::DOUBLE) AS d FROM c),
scores AS (SELECT track, key::INTEGER AS key, sum(p * d) AS s FROM n JOIN tmpl USING (bin) GROUP BY track, key)"""

PI = "3.141592653589793::DOUBLE"
ORACLE = {
    "waveform_columns": f"WITH {WAVE} SELECT track, column_index, round(mn, 6) AS min, round(mx, 6) AS max, round(rms, 6) AS rms FROM cols",
    "waveform_heights": f"""WITH {WAVE}, e AS (SELECT track, column_index, sqrt(greatest(abs(mn), abs(mx)) * rms) AS e FROM cols),
l AS (SELECT track, list_sort(list(e)) AS es FROM e GROUP BY track),
m AS (SELECT track, greatest(es[round((len(es) - 1) * 0.95::DOUBLE)::INTEGER + 1], 0.5::DOUBLE * es[len(es)]) AS top FROM l)
SELECT track, column_index, round(CASE WHEN top > 1.1920929e-07::DOUBLE THEN pow(greatest(0, least(1, e / top)), 0.6::DOUBLE) ELSE 0::DOUBLE END, 6) AS height FROM e JOIN m USING (track)""",
    "spectral_balance": f"""WITH x AS (SELECT vec_id AS track, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
w AS (SELECT track, i, x * (0.5 - 0.5 * cos(2 * {PI} * i / 63))::DOUBLE AS x FROM x), b AS (SELECT b, 80 * pow(50::DOUBLE, b / 7::DOUBLE) AS f FROM range(0, 8) t(b)),
e AS (SELECT track, b, pow(sum(x * cos(2 * {PI} * f / 8000 * i)), 2) + pow(sum(x * sin(2 * {PI} * f / 8000 * i)), 2) AS e FROM w, b GROUP BY track, b)
SELECT track, round(sum(e * b / 7::DOUBLE) / sum(e), 6) AS balance FROM e GROUP BY track""",
    "zero_crossing_balance": """WITH x AS (SELECT vec_id AS track, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
d AS (SELECT track, x, lag(x) OVER (PARTITION BY track ORDER BY i) AS p FROM x)
SELECT track, round(CASE WHEN sum(abs(x)) > 1.1920929e-07::DOUBLE THEN 0.7::DOUBLE * least(1, sum(abs(x - p)) / (2 * sum(abs(x)))) + 0.3::DOUBLE * sum(CASE WHEN (x >= 0) <> (p >= 0) THEN 1 ELSE 0 END) / 63 ELSE 0.5::DOUBLE END, 6) AS balance FROM d GROUP BY track""",
    "resample": """SELECT vec_id AS track, i::INTEGER AS i, round(CASE WHEN floor(i * 1.5::DOUBLE) + 1 < 64 THEN embedding[floor(i * 1.5::DOUBLE)::INTEGER + 1]::DOUBLE * (1 - (i * 1.5::DOUBLE - floor(i * 1.5::DOUBLE))) + embedding[floor(i * 1.5::DOUBLE)::INTEGER + 2]::DOUBLE * (i * 1.5::DOUBLE - floor(i * 1.5::DOUBLE)) ELSE embedding[64]::DOUBLE END, 6) AS x FROM embeddings, range(0, 43) t(i)""",
    "chroma_whiten": f"WITH {FRAMES_SQL} SELECT track, frame_idx::INTEGER AS frame_idx, bin::INTEGER AS bin, round(sqrt(x) / sum(sqrt(x)) OVER (PARTITION BY track, frame_idx), 6) AS x FROM frames",
    "chroma_tuning": f"""WITH {FRAMES_SQL}, p AS (SELECT a.track, a.x AS c, l.x AS p, n.x AS n FROM frames a JOIN frames l ON a.track = l.track AND a.frame_idx = l.frame_idx AND l.bin = (a.bin + 11) % 12 JOIN frames n ON a.track = n.track AND a.frame_idx = n.frame_idx AND n.bin = (a.bin + 1) % 12)
SELECT track, round(coalesce(greatest(-0.5, least(0.5, sum(0.5 * (n - p) / (2 * c - p - n) * c) FILTER (c > p AND c > n) / sum(c) FILTER (c > p AND c > n))), 0)::DOUBLE, 6) AS tuning FROM p GROUP BY track""",
    "chroma_shift": f"""WITH {FRAMES_SQL} SELECT a.track, a.frame_idx::INTEGER AS frame_idx, ((a.bin + 1) % 12)::INTEGER AS bin, round(a.x * 0.25::DOUBLE + b.x * 0.75::DOUBLE, 6) AS x FROM frames a JOIN frames b ON a.track = b.track AND a.frame_idx = b.frame_idx AND b.bin = (a.bin + 1) % 12""",
    "chroma_weighted_median": f"""WITH {FRAMES_SQL}, e AS (SELECT DISTINCT track, frame_idx, energy FROM frames), w AS (SELECT track, frame_idx, 1 + 4 * greatest(0, coalesce(sqrt(energy) - lag(sqrt(energy)) OVER (PARTITION BY track ORDER BY frame_idx), 0)) AS w FROM e)
SELECT track, bin::INTEGER AS bin, round(list_sort(list(x * w))[3], 6) AS x FROM frames JOIN w USING (track, frame_idx) GROUP BY track, bin""",
    "key_scores": f"WITH {SCORES_SQL} SELECT track, key, round(s, 6) AS score FROM scores",
    "key_classify": f"""WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY s DESC, key % 12, key) AS rn FROM scores),
t AS (SELECT a.track, a.key AS best, b.key AS second, a.s AS s1, b.s AS s2 FROM r a JOIN r b ON a.track = b.track AND a.rn = 1 AND b.rn = 2),
q AS (SELECT t.*, x.x AS e1, y.x AS e2 FROM t JOIN folded x ON x.track = t.track AND x.bin = best % 12 JOIN folded y ON y.track = t.track AND y.bin = second % 12)
SELECT track, best, second, CASE WHEN s1 - s2 <= 0.05 AND e2 > e1 * 1.2::DOUBLE AND ((best < 12 AND second >= 12 AND (best + 9) % 12 = second - 12) OR (best >= 12 AND second < 12 AND (second + 9) % 12 = best - 12)) THEN second ELSE best END AS chosen,
round(CASE WHEN abs(s1) > 1.1920929e-07::DOUBLE THEN greatest(0, least(1, (s1 - s2) / abs(s1))) ELSE 0 END, 5) AS confidence FROM q""",
}
QUERIES = {f.__name__: f for f in (waveform_columns, waveform_heights, spectral_balance, zero_crossing_balance, resample, chroma_whiten, chroma_tuning, chroma_shift, chroma_weighted_median, key_scores, key_classify)}
