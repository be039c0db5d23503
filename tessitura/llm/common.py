"""Pieces the training-data operators share: tables, shared scratch tables, word hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own.get("dir")
        if not base:
            base = _own["dir"] = tempfile.mkdtemp(prefix="tessitura-shared-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_own: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    What ``drop`` has not removed goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the JVM may have ended first; the shared folder is scratch space
            return

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def one_row_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each group of rows that agree in ``keys`` (nulls agree): that with the least hash of its columns.

    Aggregated map-side, so a row repeated a million times is one row a task before the shuffle.
    """
    mine = rows.columns
    plain = [F.col(c) for c, kind in rows.dtypes if not re.search(r"map<|variant|void", kind)]
    packed = rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.xxhash64(*plain).alias("__turn"), F.struct(*mine).alias("__row"))
    return packed.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by("__row", "__turn").alias("__row")).select("__row.*")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def squeeze(text: Column) -> Column:
    """The text without its ASCII white space; '' for null."""
    return F.coalesce(F.regexp_replace(text, SPACE + "+", ""), F.lit(""))


def unit(seed: str, *keys: Column) -> Column:
    """A uniform number in [0, 1) from md5 over seed and keys; any engine with md5 can repeat it."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


# ---- words of an Arrow batch, hashed in bulk ------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
BLOCK_BYTES = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _rng.integers(1, 1 << 63, BLOCK_BYTES, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all the texts end to end, and n + 1 offsets into them; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 21):
    """Row ranges whose texts hold about ``limit`` bytes (a longer text has one of its own)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the place of its first word (n + 1 entries)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] |= solid[cuts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[cuts - 1] |= solid[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``values``: run i starts at begins[i] and has sizes[i] numbers; between runs stand zeros.

    Each number is weighted by its place in a block of BLOCK_BYTES. A longer run's blocks are hashed
    apart, each with its number, so blocks that change places change the hash.
    """
    if not len(begins):
        return np.zeros(0, np.uint64)
    blocks = np.maximum(1, -(-sizes // BLOCK_BYTES))
    head = np.cumsum(blocks) - blocks
    turn = np.arange(int(blocks.sum())) - np.repeat(head, blocks)
    at = np.repeat(begins, blocks) + turn * BLOCK_BYTES
    whole = np.int32 if len(values) < 1 << 31 else np.int64
    place = np.arange(len(values), dtype=whole)
    base = np.zeros(len(values), whole)
    base[at] = at
    place -= np.maximum.accumulate(base, out=base)
    np.minimum(place, BLOCK_BYTES - 1, out=place)  # zeros after a run may reach further
    sums = np.add.reduceat(values * _PLACES[place], at)
    long = np.repeat(blocks > 1, blocks)
    sums[long] = mix(sums[long] + (turn[long].astype(np.uint64) + np.uint64(1)) * _STEP)
    return mix(np.add.reduceat(sums, head) + sizes.astype(np.uint64) * _STEP)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes (A-Z as a-z if ``lower``)."""
    return run_hashes((_LOWER if lower else _BYTE)[raw], starts, ends - starts)


_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text.

    A text of fewer words has its whole sequence as its one shingle, one without words none.
    """
    starts, ends, first = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
