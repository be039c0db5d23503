"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (native).

A window is a run of a text's words as long as an item (the whole text if that is shorter). Item and window are
multisets of k-word shingles; they match if their weighted Jaccard (sum of least over sum of greatest multiplicities) is
``threshold`` or more. An item of fewer than k words is one shingle of all its words.

1. Anchors: a match shares at least ceil(threshold * S) of an item's S shingles, so it holds one of its rarest
   S - ceil(threshold * S) + 1 (rarest by the number of items that have them). One pass of the texts' shingle
   hashes against these finds all (text, item) pairs that can match; phrases that many items share are no anchors
   of items that have rarer ones.
2. For these pairs all places of the item's shingles are counted: every window start with enough places in reach
   is kept, wherever in the item they stand. Moved, swapped or inserted words lose no window.
3. Each such window gets a 128-bit SimHash of its shingles, counted in packed 16-bit lanes.
4. Multi-index Hamming search: 16 blocks of 8 bits; two fingerprints within RADIUS = 47 differ by at most
   two bits in some block, so the items' blocks are indexed with all their variants of up to two bits and joined by
   (words, block, value). Every pair within the radius is a candidate. At a similarity of 0.8 the distance has mean 19 and
   deviation 4: a match lies beyond the radius with a probability of 1e-11. Windows of more than LANE_LIMIT
   shingles, whose lanes would overflow, go to step 5 with the items of step 1.
5. Candidates are verified by their exact weighted Jaccard, from counts per shingle.

Only texts with anchors move (kept out of the shuffle by a broadcast of at most 2**20 slots). The
item tables are joined by Spark's own size check. Windows are cut from whole texts.

Null and empty texts are clean. Words are lower-cased. Items that repeat are one; an empty item matches nothing. Rows
that repeat a doc_id are one document: it is contaminated if one of its texts is; a row without doc_id is
judged by its own text. Other columns are kept. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

SLOTS = 1 << 20
LANES = 4  # 16-bit counters in a long
LANE_LIMIT = 65_535
RADIUS, BLOCKS = 47, 16


def word_array(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.col(text)), SPACE + "+"), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_array(words: Column, k: Column | int) -> Column:
    """Hashes of the k-word shingles in order; none for fewer words."""
    none = F.array().cast("array<long>")
    k = k if isinstance(k, Column) else F.lit(k)
    run = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))
    return bound(words, lambda w: F.when(F.size(w) >= F.greatest(k, F.lit(1)), run(w)).otherwise(none))


def _fingerprints(cells: DataFrame, key: list[str]) -> DataFrame:
    """fp0, fp1 of the groups ``key`` of rows (h, c): shingle and multiplicity."""
    one = cells.select(*key, "c", "h", F.xxhash64(F.col("h"), F.lit(1)).alias("g"))

    def lane(h: str, group: int) -> Column:
        x = F.shiftrightunsigned(F.col(h), group * LANES)
        bit = lambda j: F.shiftleft(F.shiftrightunsigned(x, j).bitwiseAND(F.lit(1).cast("long")), 16 * j)
        return reduce(lambda a, b: a.bitwiseOR(b), [bit(j) for j in range(LANES)]) * F.col("c")

    groups = range(64 // LANES)
    summed = one.groupBy(*key).agg(F.sum("c").alias("n"), *[F.sum(lane(h, g)).alias(f"{h}{g}") for h in ("h", "g") for g in groups])

    def bits(h: str) -> Column:
        over = lambda g, j: F.shiftleft((F.shiftrightunsigned(F.col(f"{h}{g}"), 16 * j).bitwiseAND(F.lit(0xFFFF).cast("long")) * 2 > F.col("n")).cast("long"), g * LANES + j)
        return reduce(lambda a, b: a.bitwiseOR(b), [over(g, j) for g in groups for j in range(LANES)])

    return summed.select(*key, bits("h").alias("fp0"), bits("g").alias("fp1"))


def _blocks(df: DataFrame, keep: list[str], near: bool) -> DataFrame:
    """(keep, block, value); with ``near`` also all values one or two bits away."""
    part = lambda b: F.shiftrightunsigned(F.col("fp0" if b < 8 else "fp1"), 8 * (b % 8)).bitwiseAND(F.lit(255).cast("long"))
    rows = df.select(*keep, F.posexplode(F.array(*[part(b) for b in range(BLOCKS)])).alias("block", "value"))
    if near:
        flips = sorted({(1 << i) ^ (1 << j) for i in range(8) for j in range(8)} | {1 << i for i in range(8)})
        rows = rows.select(*keep, "block", F.explode(F.transform(F.array(*[F.lit(f) for f in flips]).cast("array<long>"), lambda f: F.col("value").bitwiseXOR(f))).alias("value"))
    return rows


def _cells(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, h, c) of rows with an array ``shingles``."""
    return rows.select(*key, F.explode("shingles").alias("h")).groupBy(*key, "h").agg(F.count(F.lit(1)).alias("c"))


TEXT = ["k0", "k1"]  # a text: its doc_id (0 for none) and its hash


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("k0"), F.xxhash64("doc_id", "text").alias("k1"), F.col("doc_id").isNull().alias("no_id"), "text")


def _places(texts: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """(keep, kk, p, h, n): shingles of each size in ``sizes``, their places and number."""
    each = [texts.select(*keep, F.lit(kk).alias("kk"), shingle_array(word_array(), kk).alias("all")).select(*keep, "kk", F.size("all").alias("n"), F.posexplode("all").alias("p", "h")) for kk in sizes]
    return reduce(DataFrame.unionByName, each)


def _starts(s: Column, n: Column, places: Column, threshold: float) -> Column:
    """Starts of windows of s shingles (of all n if these are fewer) that hold enough of the sorted ``places``."""
    need = F.ceil(F.lit(threshold) / (1 + threshold) * (s + F.least(s, n)) - 1e-9).cast("int")
    last = F.greatest(n - s, F.lit(0))
    here = lambda j: F.sequence(F.greatest(F.get(places, j + need - 1) - s + 1, F.lit(0)), F.least(F.get(places, j), last))
    none = F.array().cast("array<int>")
    first = lambda j: F.get(places, j + need - 1) - s + 1
    run = F.transform(F.sequence(F.lit(0), F.size(places) - need), lambda j: F.when((first(j) <= F.get(places, j)) & (first(j) <= last), here(j)).otherwise(none))
    return F.when(F.size(places) >= need, F.array_distinct(F.flatten(run))).otherwise(none)


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(k0, k1, no_id, item_id, item, start, similarity): windows as similar to an item as ``threshold`` or more. k0, k1: the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), word_array().alias("words")).where(F.size("words") > 0).distinct()
    items = items.select("item_id", F.size("words").alias("size"), F.least(F.size("words"), F.lit(k)).alias("kk"), "words")
    items = items.select("item_id", "size", "kk", shingle_array(F.col("words"), F.col("kk")).alias("shingles"), (F.col("size") - F.col("kk") + 1).alias("s"))
    items = scratch.cut(items.withColumn("item", F.monotonically_increasing_id()), "items")
    sizes = sorted(r["kk"] for r in items.select("kk").distinct().collect()) or [k]  # at most k numbers
    bag = scratch.cut(_cells(items, ["item", "kk", "s"]), "bag")
    shared = bag.groupBy("kk", "h").agg(F.count(F.lit(1)).alias("df"))
    # Occurrences of an item's shingles from the rarest on: ``s`` is bounded by the item's own length.
    order = F.array_sort(F.collect_list(F.struct("df", "h", "c")))
    least = F.ceil(F.lit(threshold) * F.col("s") - 1e-9).cast("int")
    rare = bag.join(shared, ["kk", "h"]).groupBy("item", "kk", "s").agg(order.alias("order"))
    rare = rare.select("item", "kk", F.explode(F.slice(F.flatten(F.transform("order", lambda x: F.array_repeat(x["h"], x["c"].cast("int")))), F.lit(1), F.col("s") - least + 1)).alias("h"))
    rare = scratch.cut(rare.distinct(), "rare")
    texts = _texts(docs)
    cand = scratch.cut(_places(texts, TEXT, sizes).join(rare, ["kk", "h"]).select(*TEXT, "item").distinct(), "candidates")
    slot = F.pmod(F.xxhash64(*TEXT), F.lit(SLOTS))
    slots = scratch.cut(cand.select(slot.alias("slot")).distinct(), "slots")
    chosen = texts.join(F.broadcast(slots), slot == F.col("slot"), "left_semi")
    # Places of an item's shingles in the texts it may be in: joined by text and shingle, so no shared phrase fans out.
    asked = cand.join(bag.select("item", "kk", "h", "s"), "item")
    hits = _places(chosen, TEXT, sizes).join(asked, [*TEXT, "kk", "h"]).groupBy(*TEXT, "kk", "item", "s", "n").agg(F.array_sort(F.collect_set("p")).alias("places"))
    found = scratch.cut(hits.select(*TEXT, "kk", "item", "s", "n", _starts(F.col("s"), F.col("n"), F.col("places"), threshold).alias("starts")).where(F.size("starts") > 0), "found")
    wins = scratch.cut(found.select(*TEXT, "kk", "s", F.explode("starts").alias("start")).distinct(), "wins")
    per = wins.groupBy(*TEXT, "kk").agg(F.collect_list(F.struct("s", "start")).alias("wins"))
    shingles = reduce(DataFrame.unionByName, [chosen.select(*TEXT, "no_id", F.lit(kk).alias("kk"), shingle_array(word_array(), kk).alias("all")) for kk in sizes])
    cuts = F.transform("wins", lambda w: F.struct(w["s"].alias("s"), w["start"].alias("start"), F.slice("all", w["start"] + 1, w["s"]).alias("shingles")))
    windows = shingles.dropDuplicates([*TEXT, "kk"]).join(per, [*TEXT, "kk"]).select(*TEXT, "no_id", "kk", F.explode(cuts).alias("x")).select(*TEXT, "no_id", "kk", "x.*")
    windows = scratch.cut(windows.withColumn("win", F.monotonically_increasing_id()), "windows")
    cells = scratch.cut(_cells(windows, ["win", "kk", "s"]), "cells")
    # Written between: the packed counters' code is too long to be fused with that of the blocks.
    prints = scratch.cut(_fingerprints(cells.where(F.col("s") <= LANE_LIMIT), ["win", "kk", "s"]), "prints")
    models = scratch.cut(_fingerprints(bag.where(F.col("s") <= LANE_LIMIT), ["item", "kk", "s"]), "models")
    index = scratch.cut(_blocks(models, ["item", "kk", "s", "fp0", "fp1"], True), "index")
    probe = _blocks(prints, ["win", "kk", "s", "fp0", "fp1"], False)
    far = F.bit_count(F.col("i.fp0").bitwiseXOR(F.col("p.fp0"))) + F.bit_count(F.col("i.fp1").bitwiseXOR(F.col("p.fp1")))
    same = reduce(lambda a, b: a & b, [F.col(f"i.{c}") == F.col(f"p.{c}") for c in ("kk", "s", "block", "value")])
    pairs = probe.alias("p").join(index.alias("i"), same & (far <= RADIUS)).select("p.win", "i.item")
    wide = windows.where(F.col("s") > LANE_LIMIT).select("win", *TEXT, "kk", "s").join(found.select(*TEXT, "kk", "s", "item"), [*TEXT, "kk", "s"]).select("win", "item")
    pairs = scratch.cut(pairs.unionByName(wide).distinct(), "pairs")
    common = pairs.join(cells.select("win", "h", F.col("c").alias("cw")), "win").join(bag.select("item", "h", F.col("c").alias("ci")), ["item", "h"])
    common = scratch.cut(common.groupBy("win", "item").agg(F.sum(F.least("cw", "ci")).alias("both")), "common")
    full = common.join(windows.select(*TEXT, "no_id", "win", "start", F.size("shingles").alias("nw")), "win").join(items.select("item", "item_id", "s"), "item")
    # The quotient of two whole numbers: compared without rounding.
    return full.where(F.col("both") >= threshold * (F.col("nw") + F.col("s") - F.col("both")) - 1e-9).select(*TEXT, "no_id", "item_id", "item", "start", (F.col("both") / (F.col("nw") + F.col("s") - F.col("both"))).alias("similarity"))


def _verdicts(docs: DataFrame, benchmark: DataFrame, k: int, threshold: float, scratch: Scratch) -> DataFrame:
    """One row per contaminated document (v0: its doc_id, v1: 0) or text without doc_id (v0: 0, v1: its hash)."""
    best = F.max(F.struct(F.round("similarity", 6).alias("s"), (-F.col("item_id")).alias("i")))
    v1 = F.when(F.col("no_id"), F.col("k1")).otherwise(F.lit(0).cast("long"))
    found = matches(docs, benchmark, k, threshold).groupBy(F.col("k0").alias("v0"), v1.alias("v1")).agg(F.countDistinct("item").alias("n_items"), best.alias("b"))
    return scratch.cut(found.select("v0", "v1", "n_items", (-F.col("b.i")).alias("first_item"), F.col("b.s").alias("similarity")), "verdicts")


def _same_document(docs: DataFrame) -> Column:
    own = docs["doc_id"].isNull()
    return (F.coalesce(docs["doc_id"], F.lit(0)).cast("long") == F.col("v0")) & (F.when(own, F.xxhash64(docs["doc_id"], docs["text"])).otherwise(F.lit(0).cast("long")) == F.col("v1"))


def report(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, contaminated, n_items, first_item (the most similar, then least id) and similarity, for every row."""
    found = _verdicts(docs, benchmark, k, threshold, Scratch(docs.sparkSession, "leak-report"))
    lean = docs.select("doc_id", "text")
    return lean.join(found, _same_document(lean), "left").select("doc_id", F.col("v0").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", "similarity")


def remove(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents without a benchmark passage; columns unchanged."""
    found = _verdicts(docs, benchmark, k, threshold, Scratch(docs.sparkSession, "leak-ids"))
    return docs.join(found.select("v0", "v1"), _same_document(docs), "left_anti")
