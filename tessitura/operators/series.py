"""Ordered series and segments as DataFrame operators: windows per track, interval joins by time buckets.

Series have track, idx, x; segments track, idx, start_s, end_s, key_idx. Interval joins deal both sides into buckets as
wide as a track's mean segment, so a track of n segments makes about 2 n rows and no task compares all pairs of a long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EPS = 1.1920929e-07


def in_order() -> WindowSpec:
    return Window.partitionBy("track").orderBy("idx")


def whole_track() -> WindowSpec:
    return Window.partitionBy("track")


def flux(series: DataFrame) -> DataFrame:
    """Rises from value to value; the first counts in full."""
    return series.select("track", "idx", F.greatest(F.col("x") - F.coalesce(F.lag("x").over(in_order()), F.lit(0.0)), F.lit(0.0)).alias("flux"))


def peaks(series: DataFrame) -> DataFrame:
    """Values over mean plus half a deviation that no neighbour exceeds (the right one is lower)."""
    told = series.select("*", (F.avg("x").over(whole_track()) + F.stddev_pop("x").over(whole_track()) / 2).alias("level"), F.lag("x").over(in_order()).alias("before"), F.lead("x").over(in_order()).alias("after"))
    return told.where("x > level AND x >= before AND x > after").select("track", "idx", "x")


def interval_histogram(found: DataFrame, least: int, most: int) -> DataFrame:
    """track, lag, h: root products of peaks that are ``lag`` apart, summed. A peak's partners are met one lag at a time, by key."""
    ahead = found.select("track", "x", (F.explode(F.sequence(F.lit(least), F.lit(most)))).alias("lag"), "idx").withColumn("idx", F.col("idx") + F.col("lag"))
    met = ahead.withColumnRenamed("x", "a").join(found.withColumnRenamed("x", "b"), ["track", "idx"])
    return met.groupBy("track", "lag").agg(F.sum(F.sqrt(F.col("a") * F.col("b"))).alias("h"))


def autocorrelation(series: DataFrame, most: int) -> DataFrame:
    """track, lag, r: normalised correlation at lags 1 .. most, from one pass of lagged windows."""
    lagged = series.select("track", "x", *[F.lag("x", k).over(in_order()).alias(f"l{k}") for k in range(1, most + 1)])
    parts = [f(k).alias(f"{n}{k}") for k in range(1, most + 1) for n, f in (("ab", lambda k: F.sum(F.col("x") * F.col(f"l{k}"))), ("aa", lambda k: F.sum(F.col(f"l{k}") * F.col(f"l{k}"))), ("bb", lambda k: F.sum(F.when(F.col(f"l{k}").isNotNull(), F.col("x") * F.col("x")))))]
    summed = lagged.groupBy("track").agg(*parts)
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"ab{k}") / F.greatest(F.sqrt(F.col(f"aa{k}") * F.col(f"bb{k}")), F.lit(EPS))).alias("r")) for k in range(1, most + 1)])
    return summed.select("track", F.explode(rows).alias("c")).select("track", "c.*").where("r IS NOT NULL")


def base_score(corr: DataFrame, hist: DataFrame, least: int) -> DataFrame:
    """track, lag, r, h, s: 0.65 of the smoothed histogram over its largest count and 0.35 of the best neighbouring correlation."""
    top = hist.groupBy("track").agg(F.max("h").alias("top"))
    grid = corr.join(hist, ["track", "lag"], "left").join(top, "track", "left").fillna(0.0, ["h", "top"])
    near = Window.partitionBy("track").orderBy("lag").rowsBetween(-1, 1)
    scored = grid.select("track", "lag", "r", "h", (0.65 * F.sum("h").over(near) / F.greatest("top", F.lit(EPS)) + 0.35 * F.greatest(F.max("r").over(near), F.lit(0.0))).alias("s"))
    return scored.where(F.col("lag") >= least)


def islands(rows: DataFrame, changed: Column) -> DataFrame:
    """Adds island: the number of rows of the track up to this one where ``changed`` holds."""
    return rows.withColumn("__c", F.coalesce(changed, F.lit(False)).cast("int")).withColumn("island", F.sum("__c").over(in_order().rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__c")


def segment_bounds(groups: DataFrame) -> DataFrame:
    """Groups of windows (first_at, last_at: their outer centres; lo, hi: the track's ends) to segments that meet half-way between groups."""
    w = Window.partitionBy("track").orderBy("island")
    start = F.coalesce((F.lag("last_at").over(w) + F.col("first_at")) / 2, F.col("lo"))
    end = F.coalesce((F.col("last_at") + F.lead("first_at").over(w)) / 2, F.col("hi"))
    return groups.select("*", start.alias("start_s"), end.alias("end_s"))


def tempo_segments(windows: DataFrame, change: float = 0.04) -> DataFrame:
    """windows: track, idx, at (centre), bpm, lo, hi. Runs whose tempo stays within ``change`` of the window's before."""
    before = F.lag("bpm").over(in_order())
    runs = islands(windows, F.abs(F.col("bpm") - before) / F.greatest(before, F.lit(1.0)) > change)
    return segment_bounds(runs.groupBy("track", "island").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.avg("bpm").alias("bpm"), F.count(F.lit(1)).alias("windows")))


def majority(values: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, value, n: the most frequent value; of equals the one that comes up last for the first time."""
    counted = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    best = counted.groupBy(*by).agg(F.max(F.struct("n", "first_seen", value)).alias("best"))
    return best.select(*by, f"best.{value}", "best.n")


def key_segments(windows: DataFrame, sure: float = 0.35) -> DataFrame:
    """windows: track, idx, at, key_idx, confidence, lo, hi. A new segment starts where the key changes with enough confidence."""
    runs = islands(windows, (F.col("key_idx") != F.lag("key_idx").over(in_order())) & (F.col("confidence") >= sure))
    keys = majority(runs, ["track", "island"], "key_idx", "idx")
    groups = runs.groupBy("track", "island").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("windows"))
    return segment_bounds(groups.join(keys.drop("n"), ["track", "island"]))


def downbeat_phase(series: DataFrame) -> DataFrame:
    """track, phase, strength: the phase of every fourth value that sums highest, the first of equals."""
    s = series.groupBy("track", F.pmod("idx", F.lit(4)).cast("int").alias("phase")).agg(F.sum("x").alias("strength"))
    return s.groupBy("track").agg(F.max(F.struct("strength", (-F.col("phase")).alias("turn"))).alias("b")).select("track", (-F.col("b.turn")).alias("phase"), "b.strength")


def display_bpm(beats: DataFrame, tempi: DataFrame) -> DataFrame:
    """track, bpm, misfit: the whole number next to a tempo whose grid the beats fit better, the lower of equals. beats: track, idx, t; tempi: track, bpm."""
    off = lambda bpm: F.sort_array(F.transform("t", lambda x, i: x - i * 60.0 / bpm))
    middle = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    misfit = lambda a: F.aggregate(F.transform(a, lambda x: F.abs(x - middle(a))), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    rows = beats.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]).alias("t")).join(tempi, "track")
    rows = rows.withColumns({"low": F.floor("bpm").cast("double"), "high": F.ceil("bpm").cast("double")})
    rows = rows.withColumns({"ol": off(F.col("low")), "oh": off(F.col("high"))}).withColumns({"el": misfit(F.col("ol")), "eh": misfit(F.col("oh"))})
    lower = (F.col("low") > 0) & (F.round("el", 9) <= F.round("eh", 9))
    return rows.select("track", F.when(lower, F.col("low")).otherwise(F.col("high")).alias("bpm"), F.when(lower, F.col("el")).otherwise(F.col("eh")).alias("misfit"))


def _bucketed(rows: DataFrame, scale: DataFrame, low: Column, high: Column) -> DataFrame:
    at = lambda x: F.floor((x - F.col("lo")) / F.col("width")).cast("long")
    return rows.join(scale, "track").withColumn("first_bucket", at(low)).withColumn("bucket", F.explode(F.sequence(at(low), at(high)))).drop("lo", "width")


def _scale(ref: DataFrame) -> DataFrame:
    """track, lo, width: where a track's segments begin and how long one is on average."""
    return ref.groupBy("track").agg(F.min("start_s").alias("lo"), F.greatest((F.max("end_s") - F.min("start_s")) / F.count(F.lit(1)), F.lit(1e-9)).alias("width"))


def overlap_pairs(ref: DataFrame, det: DataFrame) -> DataFrame:
    """r.*, d.*, seconds for each pair of segments of a track that overlap; a pair is kept in the first bucket that both are in."""
    scale = _scale(ref)
    r = _bucketed(ref.where("end_s > start_s"), scale, F.col("start_s"), F.col("end_s")).alias("r")
    d = _bucketed(det.where("end_s > start_s"), scale, F.col("start_s"), F.col("end_s")).alias("d")
    met = r.join(d, (F.col("r.track") == F.col("d.track")) & (F.col("r.bucket") == F.col("d.bucket")) & (F.col("d.start_s") < F.col("r.end_s")) & (F.col("r.start_s") < F.col("d.end_s")))
    once = met.where(F.col("r.bucket") == F.greatest("r.first_bucket", "d.first_bucket"))
    return once.withColumn("seconds", F.least("r.end_s", "d.end_s") - F.greatest("r.start_s", "d.start_s"))


def overlap_accuracy(ref: DataFrame, det: DataFrame) -> DataFrame:
    """track, accuracy: seconds in which both have the same key over the reference's."""
    hit = overlap_pairs(ref, det).where("r.key_idx = d.key_idx").groupBy(F.col("r.track").alias("track")).agg(F.sum("seconds").alias("hit"))
    total = ref.groupBy("track").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("total"))
    return total.join(hit, "track", "left").select("track", (F.coalesce("hit", F.lit(0.0)) / F.col("total")).alias("accuracy"))


def midpoint_pairs(ref: DataFrame, det: DataFrame) -> DataFrame:
    """track, idx, r_value, d_value: each reference segment and the first detected one that holds its midpoint. Both: track, idx, start_s, end_s, value."""
    scale = _scale(ref)
    middle = (F.col("start_s") + F.col("end_s")) / 2
    r = _bucketed(ref.withColumn("at", middle), scale, F.col("at"), F.col("at")).alias("r")
    d = _bucketed(det, scale, F.col("start_s"), F.col("end_s")).alias("d")
    met = r.join(d, (F.col("r.track") == F.col("d.track")) & (F.col("r.bucket") == F.col("d.bucket")) & (F.col("r.at") >= F.col("d.start_s")) & (F.col("r.at") < F.col("d.end_s")))
    first = met.groupBy(F.col("r.track").alias("track"), F.col("r.idx").alias("idx"), F.col("r.value").alias("r_value")).agg(F.min(F.struct("d.idx", "d.value")).alias("f"))
    return first.select("track", "idx", "r_value", F.col("f.value").alias("d_value"))


def tap_tempo(taps: DataFrame, pause: float = 2.5, keep: int = 8) -> DataFrame:
    """taps: track, idx, t. A gap over ``pause`` starts anew; the median gap of the last ``keep`` taps of a run gives the tempo."""
    gap = taps.withColumn("gap", F.col("t") - F.lag("t").over(in_order()))
    runs = islands(gap, F.col("gap") > pause).withColumnRenamed("island", "run")
    per = runs.groupBy("track", "run").agg(F.array_sort(F.collect_list(F.struct("idx", "gap"))).alias("g"))
    inner = F.transform("g", lambda x, i: F.struct(i.alias("i"), x["gap"].alias("gap")))
    kept = F.slice(inner, F.greatest(F.size("g") - keep + 1, F.lit(1)), F.lit(keep))
    each = per.select("track", "run", F.explode(kept).alias("k"))
    got = each.groupBy("track", "run").agg(F.count(F.lit(1)).alias("taps"), F.median(F.when(F.col("k.i") > 0, F.col("k.gap"))).alias("mid"))
    return got.where("mid > 0").select("track", "run", "taps", (60 / F.col("mid")).alias("bpm"))
