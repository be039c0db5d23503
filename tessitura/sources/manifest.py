"""Annotation manifests: schema, reading, validation, upserts, sampling, fingerprints, importers."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "array<struct<start_seconds:double,end_seconds:double,{},confidence:float>>"
TRACK = f"""struct<id:string,path:string,split:string,source:struct<name:string,version:string,item_id:string,citation:string>,expected_bpm:float,expected_key:string,
expected_beats:array<struct<time_seconds:double,position_in_bar:tinyint>>,expected_tempo_segments:{SEGMENT.format("bpm:float,end_bpm:float")},expected_key_segments:{SEGMENT.format("key:string")},
change_events:array<struct<time_seconds:double,structure_changed:boolean,tempo_changed:boolean,key_changed:boolean,label:string,confidence:float>>,
serato:struct<bpm:float,key:string,beat_grid_seconds:array<double>,bpm_user_edited:boolean,key_user_edited:boolean,version:string>,apple_music_understanding:struct<bpm:float,key:string,beat_times_seconds:array<double>,version:string>,
annotation:struct<status:string,reviewer:string,confidence:float,notes:string>>""".replace("\n", "")
SCHEMA = f"version int, tracks array<{TRACK}>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a track, in file order (``ordinal``), with the manifest's version."""
    m = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return m.select("version", F.posexplode("tracks").alias("ordinal", "t")).select("version", "ordinal", "t.*")


def violations(tracks: DataFrame) -> DataFrame:
    """id, rule: every broken rule of every track."""
    good = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    sure = lambda c: F.coalesce(good(c) & c.between(0, 1), F.lit(True))
    flow = lambda arr, bad: F.coalesce(F.exists(F.zip_with(F.slice(arr, F.lit(1), F.greatest(F.size(arr) - 1, F.lit(0))), F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0))), bad), lambda b: b), F.lit(False))

    tempo = lambda b: b.isNotNull() & ~(good(b) & (b > 0))
    times = lambda arr: F.coalesce(F.exists(arr, lambda x: ~(good(x) & (x >= 0))), F.lit(False)) | flow(arr, lambda a, b: b < a)

    def ranges(c: str):
        each = F.coalesce(F.exists(c, lambda s: ~(good(s["start_seconds"]) & good(s["end_seconds"]) & (s["start_seconds"] >= 0) & (s["end_seconds"] > s["start_seconds"]) & sure(s["confidence"]))), F.lit(False))
        return each | flow(F.col(c), lambda a, b: b["start_seconds"] < a["end_seconds"])

    t = tracks.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    rules = {
        "version": F.col("version") != 1,
        "id": F.trim(F.coalesce("id", F.lit(""))) == "",
        "unique": F.col("__n") > 1,
        "path": F.trim(F.coalesce("path", F.lit(""))) == "",
        "bpm": tempo(F.col("expected_bpm")),
        "beats": times(F.transform("expected_beats", lambda b: b["time_seconds"])),
        "tempo_segments": ranges("expected_tempo_segments") | F.coalesce(F.exists("expected_tempo_segments", lambda s: tempo(s["bpm"]) | tempo(s["end_bpm"])), F.lit(False)),
        "key_segments": ranges("expected_key_segments") | F.coalesce(F.exists("expected_key_segments", lambda s: F.trim(F.coalesce(s["key"], F.lit(""))) == ""), F.lit(False)),
        "change_events": times(F.transform("change_events", lambda e: e["time_seconds"])) | F.coalesce(F.exists("change_events", lambda e: ~sure(e["confidence"]) | ~(F.coalesce(e["structure_changed"], F.lit(False)) | F.coalesce(e["tempo_changed"], F.lit(False)) | F.coalesce(e["key_changed"], F.lit(False)))), F.lit(False)),
        "annotation": ~sure(F.col("annotation.confidence")),
        "observed_bpm": tempo(F.col("serato.bpm")) if "serato" in tracks.columns else F.lit(False),
        "observed_beats": times(F.col("serato.beat_grid_seconds")) if "serato" in tracks.columns else F.lit(False),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return t.select("id", F.explode(broken).alias("rule"))


def resolved(tracks: DataFrame, manifest_path: str) -> DataFrame:
    """Adds full_path: ``path`` itself if it is absolute, else below the manifest's folder."""
    base = manifest_path.rsplit("/", 1)[0] if "/" in manifest_path else "."
    return tracks.withColumn("full_path", F.when(F.col("path").rlike(r"^(/|[a-z0-9]+:)"), F.col("path")).otherwise(F.concat(F.lit(f"{base}/"), "path")))


#: Where datasets keep their annotations, the first that exists counts.
FOLDERS = {"tempo": ("annotations_v2/tempo", "annotations/tempo", "annotations/giantsteps"), "key": ("annotations/giantsteps", "annotations/key", "annotations/jams"), "table": ("metadata.csv", "fmakv2.csv", "FMAKv2.csv", "annotations.csv")}


def find_annotations(spark: SparkSession, root: str, kind: str) -> str:
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for name in FOLDERS[kind]:
        p = path(f"{root.rstrip('/')}/{name}")
        if p.getFileSystem(conf).exists(p):
            return p.toString()
    raise FileNotFoundError(f"no {kind} annotations under {root}")


def audio_paths(items: DataFrame, files: DataFrame, nested: bool = False, of: tuple[str, ...] = ()) -> DataFrame:
    """items with path and found. ``files``: path, relative to the audio folder. ``nested``: six-digit ids in folders of their first three digits, where such a file exists.

    ``of``: columns of both that tell whose file it is; an item is then looked for among its own files only, whatever others are called.
    """
    plain = F.concat("item", F.lit(".mp3"))
    deep = F.concat(F.substring("item", 1, 3), F.lit("/"), plain)
    known = files.select(F.col("path").alias("__file"), *[F.col(c).alias(f"__{c}") for c in of]).distinct()
    look = lambda rows, path: rows.join(known, [path == F.col("__file"), *[F.col(c) == F.col(f"__{c}") for c in of]], "left")
    flat = look(items, plain).withColumn("__flat", F.col("__file").isNotNull()).drop(*known.columns)
    if not nested:
        return flat.select(*items.columns, plain.alias("path"), F.col("__flat").alias("found"))
    both = look(flat, deep)
    return both.select(*items.columns, F.when(F.col("__file").isNotNull(), deep).otherwise(plain).alias("path"), (F.col("__flat") | F.col("__file").isNotNull()).alias("found"))


def import_counts(upserted: DataFrame, read: int, usable: int, missing_audio: int) -> dict[str, int]:
    """imported, updated, skipped (annotations that hold no value), missing_audio."""
    by = {r["action"]: r["count"] for r in upserted.groupBy("action").count().collect()}  # three rows at most
    return {"imported": by.get("imported", 0), "updated": by.get("updated", 0), "skipped": read - usable, "missing_audio": missing_audio}


def delete_tracks(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    """The manifest without the tracks whose id is in ``ids``."""
    return tracks.join(ids.select("id").distinct(), "id", "left_anti")


def track_paths(ids: DataFrame, tracks: DataFrame) -> DataFrame:
    """id, path (null for an unknown track)."""
    return ids.select("id").join(tracks.select("id", "path"), "id", "left")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ("split",)) -> DataFrame:
    """Full outer join on ``key``: new values win, ``keep`` columns of a known row stay; adds ``action``."""
    o, n = old.alias("o"), new.alias("n")
    cols = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), (F.col(f"n.{c}") if c in new.columns else F.lit(None))
        cols.append((F.coalesce(a, b) if c in keep else F.coalesce(b, a)).alias(c))
    action = F.when(F.col(f"o.{key}").isNull(), "imported").when(F.col(f"n.{key}").isNull(), "kept").otherwise("updated")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols, action.alias("action"))


def stable_sample(rows: DataFrame, namespace: str, count: int, key: str = "id") -> DataFrame:
    """The ``count`` rows of lowest SHA-256 of 'namespace:id', in id order."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{namespace}:"), F.col(key).cast("string")), 256)).limit(count).orderBy(key)


def blocked(corpora: DataFrame, name: Column, prefixes: tuple[str, ...], source_blocked: Column) -> DataFrame:
    """Corpora that are development data: by a prefix of their name, or by their source."""
    by_name = F.lit(False)
    for p in prefixes:
        by_name = by_name | F.startswith(name, F.lit(p))
    return corpora.where(by_name | source_blocked)


def remaining_jobs(jobs: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return jobs.join(done.select(*on), on, "left_anti")


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def fingerprint(manifest: dict) -> str:
    """SHA-256 of the manifest without its paths."""
    tracks = [{k: v for k, v in t.items() if k != "path"} for t in manifest.get("tracks", [])]
    return hashlib.sha256(canonical_json({**manifest, "tracks": tracks})).hexdigest()


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def save_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """Validated, then written whole or not at all."""
    rows = spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize([json.dumps(manifest)]))
    tracks = rows.select("version", F.explode("tracks").alias("t")).select("version", "t.*")
    broken = [tuple(r) for r in violations(tracks).limit(5).collect()]
    if manifest.get("version") != 1 or broken:
        raise ValueError(f"manifest breaks rules: {broken or 'version'}")
    save_json(manifest, path)


def save_json(value, path: str) -> None:
    """Written whole or not at all."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(temp, path)


def read_annotations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """item, value from one-file-an-item annotations: the first line that is neither blank nor a comment.

    ``kind`` 'tempo' reads a positive number, 'key' the text after an optional 'key <time>'.
    """
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("item"), F.split("value", r"\r?\n").alias("lines"))
    line = F.trim(F.get(F.filter("lines", lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("#"))), F.lit(0)))
    if kind == "tempo":
        return f.select("item", line.try_cast("double").alias("value")).where((F.col("value") > 0) & (F.col("value") < float("inf")))
    return f.select("item", F.regexp_replace(line, r"^key\s+[-\d.]+\s+", "").alias("value")).where(F.col("value") != "")


def read_key_table(spark: SparkSession, path: str) -> DataFrame:
    """item, key from CSV metadata: columns track_id or id, and key_and_mode or key and mode, in any spelling of case and spaces.

    Ids are padded to six digits; longer ones stay whole.
    """
    csv = spark.read.csv(path, header=True, quote='"', escape='"')
    named = csv.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in csv.columns])
    item = F.trim("track_id" if "track_id" in named.columns else "id")
    mode = lambda c: F.lower(F.trim(c))
    both = F.trim(F.col("key_and_mode")) if "key_and_mode" in named.columns else F.concat_ws(" ", F.trim("key"), mode(F.col("mode")))
    return named.select(F.lpad(item, F.greatest(F.length(item), F.lit(6)), "0").alias("item"), both.alias("key")).where(F.col("key") != "")


def consensus(annotations: DataFrame) -> DataFrame:
    """sound, bpm, n: median tempo of loops that at least two usable annotations agree on within 1 BPM."""
    bpm = F.col("bpm").try_cast("double")
    ok = annotations.where(~F.coalesce("discard", F.lit(False)) & F.coalesce("well_cut", F.lit(False))).withColumn("bpm", bpm).where(F.col("bpm").isNotNull())
    return ok.groupBy("sound").agg(F.median("bpm").alias("bpm"), F.count(F.lit(1)).alias("n"), (F.max("bpm") - F.min("bpm")).alias("spread")).where("n >= 2 AND spread <= 1").drop("spread")


def library_tracks(tracks: DataFrame, folder: str, limit: int | None = None) -> DataFrame:
    """Present tracks under a folder that carry both a tempo and a key, in path order."""
    got = tracks.where(F.col("relative_path").startswith(folder.rstrip("/") + "/") & (F.col("serato_missing") == 0) & F.col("bpm").isNotNull() & F.col("musical_key").isNotNull()).orderBy("relative_path")
    return got if limit is None else got.limit(limit)


def segments_of(annotations: DataFrame, end: float = 120.0) -> DataFrame:
    """Parallel arrays key, start_times, end_times (centiseconds) to key segments and change events."""
    from ..functions.keys import parse_key

    z = F.arrays_zip("key", "start_times", "end_times")
    sure = F.greatest(F.lit(0.25), F.least(F.lit(1.0), (F.col("confidence") + 1) / 4))
    n = F.size("key")
    seg = F.transform(z, lambda s, i: F.struct((s["start_times"] / 100.0).alias("start_seconds"), F.when(i == n - 1, F.lit(end)).otherwise(s["end_times"] / 100.0).alias("end_seconds"), parse_key(s["key"]).alias("key"), sure.alias("confidence")))
    readable = F.forall("key", lambda k: parse_key(k).isNotNull())
    return annotations.select("*", F.when(readable, seg).alias("segments")).withColumn("change_events", F.slice("segments", F.lit(2), F.greatest(n - 1, F.lit(0))))
