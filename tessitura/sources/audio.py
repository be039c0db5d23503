"""Audio files to mono PCM rows. WAV by the standard library, uncompressed AIFF here; other codecs give an error column."""

from __future__ import annotations

import io
import time
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, samples array<float>, sample_rate int, source_channels int, error string, decode_milliseconds double"
KNOWN = ("wav", "wave", "aif", "aiff", "flac", "mp3", "mp4", "m4a", "aac")


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """Mean over channels as float in -1..1, rate, channels."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    if not len(x):
        raise ValueError("empty audio")
    return x.reshape(-1, channels).mean(1), rate, channels


def decode_aiff(data: bytes) -> tuple[np.ndarray, int, int]:
    """Uncompressed AIFF: mean over channels as float in -1..1, rate, channels."""
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise ValueError("not an AIFF file")
    at, parts = 12, {}
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        parts.setdefault(data[at : at + 4], data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    common, sound = parts.get(b"COMM", b""), parts.get(b"SSND", b"")
    if len(common) < 18 or len(sound) < 8:
        raise ValueError("AIFF file without sound")
    channels, bits = int.from_bytes(common[:2], "big"), int.from_bytes(common[6:8], "big")
    kind = common[18:22] if data[8:12] == b"AIFC" else b"NONE"
    if kind not in (b"NONE", b"sowt") or bits not in (8, 16, 24, 32) or not channels:
        raise ValueError("unsupported audio codec")
    rate = round(int.from_bytes(common[10:18], "big") * 2.0 ** ((int.from_bytes(common[8:10], "big") & 0x7FFF) - 16383 - 63))
    width, raw = bits // 8, sound[8 + int.from_bytes(sound[:4], "big") :]
    raw = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    raw = raw if kind == b"NONE" else raw[:, ::-1]
    x = np.zeros(len(raw), np.int64)
    for i in range(width):
        x = (x << 8) | raw[:, i]
    x = np.where(x >= 1 << (bits - 1), x - (1 << bits), x) / float(1 << (bits - 1))
    if not len(x):
        raise ValueError("empty audio")
    return x.reshape(-1, channels).mean(1).astype(np.float32), rate, channels


DECODERS = {"wav": decode_wav, "wave": decode_wav, "aif": decode_aiff, "aiff": decode_aiff}


def _decode(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            ext, start = path.rsplit(".", 1)[-1].lower(), time.perf_counter()
            spent = lambda: (time.perf_counter() - start) * 1000  # noqa: B023, E731
            try:
                if ext not in DECODERS:
                    raise ValueError("unsupported audio codec" if ext in KNOWN else "not an audio file")
                x, rate, channels = DECODERS[ext](bytes(content))
                rows.append((path, x.astype(np.float32), rate, channels, None, spent()))
            except Exception as e:  # a file that can't be read is a row with an error
                rows.append((path, None, None, None, str(e) or type(e).__name__, spent()))
        yield pd.DataFrame(rows, columns=["path", "samples", "sample_rate", "source_channels", "error", "decode_milliseconds"])


def read_audio(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content").mapInPandas(_decode, SCHEMA)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """full_path (as given), samples, sample_rate, ..., for those of the named files that exist."""
    by_name = spark.createDataFrame([(p, p.rsplit("/", 1)[-1]) for p in paths], "full_path string, name string")
    fs = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := fs(p)).getFileSystem(conf).exists(q)]
    if not there:
        empty = spark.createDataFrame([], SCHEMA)
        return empty.withColumnRenamed("path", "full_path")
    files = spark.read.format("binaryFile").load(there).select("path", "content").mapInPandas(_decode, SCHEMA)
    plain = lambda c: F.regexp_replace(c, r"^[a-z]+:/*", "/")
    return files.join(by_name, plain(F.col("path")) == plain(F.col("full_path"))).drop("path", "name")


def analyze_path(spark: SparkSession, path: str, columns: int = 1500) -> DataFrame:
    """Decode, then analyse; files that failed keep their error."""
    from ..operators.analysis import analyze

    got = read_audio(spark, path)
    ok = analyze(got.where("error IS NULL").select(F.col("path").alias("track_id"), "samples", "sample_rate"), columns)
    bad = got.where("error IS NOT NULL").select(F.col("path").alias("track_id"), F.lit(None).cast(ok.schema["analysis"].dataType).alias("analysis"), "error")
    return ok.unionByName(bad)
