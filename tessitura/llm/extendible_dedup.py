"""Exact deduplication over an extendible-hash index on shared files (native).

1. One scan writes narrow entries (64-bit key, length, doc_id, digest, row number) to the shared folder.
2. Copies are collapsed map-side into one index row per key. A histogram over the leading FINE_BITS key bits (at
   most 2**FINE_BITS numbers, whatever the input) comes to the driver, where the directory grows: it
   doubles while a bucket that can still split holds more than ``capacity`` keys. A bucket of depth d takes the slots
   that share d leading bits, so hot regions get deep buckets and the rest stay shallow. At FINE_BITS a
   bucket keeps an overfull chain, which loses nothing.
3. The index is written range-partitioned by (bucket, key): an owner task has whole buckets, sorted by key.
4. Rows look their bucket up in the directory (a broadcast of at most 2**FINE_BITS rows) and meet the owner's entry by
   (bucket, key). Keys with more than one row are proven by bytes: their rows are re-read (a broadcast of at
   most 2**20 key slots, a fixed bound, keeps other texts out of the shuffle) and compared with the text of
   the key's representative, in a sort-merge join whose hot keys Spark splits at run time. Keys
   under which texts differ are collisions: their bucket chains one entry per text behind the key, told apart by
   SHA-256.

Null text counts as empty, so null and white-space-only texts form one group. Of equal texts the
row with most code points, then smallest doc_id stays; of rows equal in these too exactly one, and each counts in
group_size. A row without doc_id can stay only if no other can. Columns beyond doc_id and text are ignored by the
report. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, one_row_each, squeeze

SLOTS = 1 << 20
FINE_BITS = 16


def grow_directory(loads: dict[int, int], capacity: int, max_depth: int = FINE_BITS) -> list[tuple[int, int, int]]:
    """(slot, bucket, depth) for each slot of ``loads`` (keys per slot): a bucket is named by its first slot.

    Starts from one bucket of depth 0. Splitting a bucket as deep as the directory doubles the directory.
    """
    depth, done, open_ = 0, [], [(0, 0, sorted(loads.items()))]
    while open_:
        bucket, local, held = open_.pop()
        if local == max_depth or sum(n for _, n in held) <= capacity:
            done.extend((slot, bucket, local) for slot, _ in held)
            continue
        depth = max(depth, local + 1)
        middle = bucket + (1 << (max_depth - local - 1))
        open_.append((bucket, local + 1, [x for x in held if x[0] < middle]))
        open_.append((middle, local + 1, [x for x in held if x[0] >= middle]))
    return sorted(done)


def directory(index: DataFrame, capacity: int, max_depth: int = FINE_BITS) -> DataFrame:
    """(slot, bucket, depth) of the slots that hold keys."""
    slot = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
    loads = {r["slot"]: r["n"] for r in index.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return index.sparkSession.createDataFrame(grow_directory(loads, capacity, max_depth), "slot int, bucket int, depth int")


def _bucketed(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows with ``key`` and their bucket and its depth, looked up in the directory."""
    return rows.join(F.broadcast(slots), F.shiftrightunsigned("key", 64 - FINE_BITS).cast("int") == F.col("slot")).drop("slot")


def _judged(docs: DataFrame, scratch: Scratch, key_of, capacity: int) -> DataFrame:
    """One row per row of docs: doc_id, points, sha, n, rep_id, rep_points, kept."""
    key_of = key_of or (lambda t: F.xxhash64(t))
    body = squeeze(F.col("text"))
    points = F.coalesce(F.length("text"), F.lit(0)).alias("points")
    read = docs.select("doc_id", points, body.alias("body")).select("doc_id", "points", "body", key_of(F.col("body")).alias("key"))
    entries = scratch.cut(read.select("doc_id", "points", "key", F.sha2("body", 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "entries")
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row"))
    index = scratch.cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best.alias("best")), "keys")
    slots = scratch.cut(directory(index, capacity), "directory")
    told: list[Column] = [F.col("best.id").alias("rep_id"), (-F.col("best.less")).alias("rep_points"), F.col("best.row").alias("rep_row")]
    owned = _bucketed(index, slots).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    paged = scratch.cut(owned.select("bucket", "depth", "key", "n", *told), "index")
    # Proof by bytes of the keys with several rows.
    many = paged.where("n > 1").select("bucket", "key", "rep_id", "rep_points")
    slot_of = lambda c: F.pmod(c, F.lit(SLOTS))
    taken = scratch.cut(many.select(slot_of(F.col("key")).alias("s")).distinct(), "slots")
    member = _bucketed(read.join(F.broadcast(taken), slot_of(F.col("key")) == F.col("s"), "left_semi"), slots)
    rep = member.join(many, ["bucket", "key"]).where(F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("points") == F.col("rep_points")))
    # Written between, so that the join's hot keys can be split: one row or a few of each key are left.
    rep = scratch.cut(rep.select("bucket", "key", "body"), "representatives").groupBy("bucket", "key").agg(F.min("body").alias("rep_body"))
    odd = scratch.cut(member.join(rep, ["bucket", "key"]).where(F.col("body") != F.col("rep_body")).select("bucket", "key").distinct(), "collisions")
    rows = _bucketed(entries, slots)
    out = ["doc_id", "points", "sha", "n", "rep_id", "rep_points", (F.col("row") == F.col("rep_row")).alias("kept")]
    plain = rows.join(paged.select("bucket", "key", "n", "rep_id", "rep_points", "rep_row"), ["bucket", "key"])
    if odd.isEmpty():
        return plain.select(*out)
    chained = rows.join(odd, ["bucket", "key"], "left_semi")
    chain = chained.groupBy("bucket", "key", "sha").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).select("bucket", "key", "sha", "n", *told)
    return plain.join(odd, ["bucket", "key"], "left_anti").select(*out).unionByName(chained.join(chain, ["bucket", "key", "sha"]).select(*out))


def classes(docs: DataFrame, key_of=None, capacity: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    ``key_of`` maps the squeezed text to its 64-bit key (xxhash64); tests pass a weak one to force
    collisions. ``capacity``: keys in a bucket before it splits.
    """
    got = _judged(docs, Scratch(docs.sparkSession, "exact"), key_of, capacity)
    return got.select("doc_id", F.col("rep_id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def exact_report(docs: DataFrame) -> DataFrame:
    return classes(docs)


def keep_one(docs: DataFrame, key_of=None, capacity: int = 4096) -> DataFrame:
    """The rows that stay, one of each group, columns unchanged."""
    scratch = Scratch(docs.sparkSession, "exact-ids")
    got = scratch.cut(_judged(docs, scratch, key_of, capacity), "judged")
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("points") == F.col("rep_points"))
    stay = got.where(same).groupBy(F.col("doc_id").alias("__id"), F.col("points").alias("__points"), F.col("sha").alias("__sha")).agg(F.count(F.lit(1)).alias("__times"))
    stay = scratch.cut(stay, "stay")
    own = docs.withColumn("__own", F.sha2(squeeze(F.col("text")), 256))
    match = own["doc_id"].eqNullSafe(F.col("__id")) & (F.coalesce(F.length(own["text"]), F.lit(0)) == F.col("__points")) & (own["__own"] == F.col("__sha"))
    once = own.join(stay.where("__times = 1"), match, "left_semi").drop("__own")
    several = one_row_each(own.join(stay.where("__times > 1"), match, "left_semi"), ["doc_id", "__own"]).drop("__own")
    return once.unionByName(several)


REPORT_SQL = """
WITH s AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS body FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id ASC NULLS LAST) AS turn,
  count(*) OVER (PARTITION BY body) AS group_size FROM s)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, turn = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""
