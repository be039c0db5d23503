"""Sharding by a K-d tree over document metadata (native).

Every row has one 44-bit key per dimension (source, language, size): 20 bits of the value (names by a hash: they have no
order), then 24 bits of a hash of its id, text and, among rows equal in these, its number, so equal values and equal rows can
be parted anywhere. Equal rows are counted map-side and numbered from the count. A node with k shards to
give is split on its widest dimension at the weighted quantile floor(k/2)/k of its bytes. The quantile is
found for all nodes of a level at once by histograms that zoom in: one aggregate of at most
``HISTOGRAM_ROWS`` rows per pass, summed map-side, whatever the number of documents. The
tree (fewer than 2 x shards nodes) is then an expression over a row's keys, so the documents
themselves are never sorted, and no split moves a text.

Error: a split stops within ``TOLERANCE`` of its node's bytes or one key, so shards are near equal
unless single documents are larger than that. Null text has 0 bytes (size 16) and crc 0; null
source, lang or doc_id are values of their own. Reruns agree. A caller's columns named shard or slot are kept:
the new ones then get a trailing underscore. An empty table gives an empty result; fewer documents than shards
leave shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Most histogram rows that one pass brings to the driver (for up to 4,096 nodes; 64 bins a node beyond).
HISTOGRAM_ROWS = 1 << 17
TOLERANCE = 0.0005
VALUE, TIE = 20, 24
SPAN = 1 << (VALUE + TIE)


@dataclass
class Node:
    number: int
    first: int  # its shards are first .. first + shards - 1
    shards: int
    dim: int = 0
    cut: int | None = None  # keys below it go left
    left: int = -1
    right: int = -1


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def dimension_values(docs: DataFrame) -> list[Column]:
    """v0 (source), v1 (lang), v2 (size, logarithmic): 20 bits each."""
    name = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))), 32 - VALUE).cast("long")
    log_size = F.floor(F.least(F.log2(row_size(F.col("text")).cast("double")) / 40.0, F.lit(0.999999)) * (1 << VALUE)).cast("long")
    return [name("source").alias("v0"), name("lang").alias("v1"), log_size.alias("v2")]


KEYS = ["k0", "k1", "k2"]
ROW = ["doc_id", "size", "text_crc32", "same"]  # rows that agree in these (and in source and lang) are told apart by turn


def keyed_rows(docs: DataFrame, same: Column) -> DataFrame:
    """ROW, turn (1 .. the number of equal rows) and KEYS, one row for each row of docs. ``same``: a hash of further columns."""
    read = docs.select("doc_id", row_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), same.alias("same"), *dimension_values(docs))
    counted = read.groupBy(*ROW, "v0", "v1", "v2").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    tie = F.xxhash64("doc_id", "text_crc32", "same", "turn").bitwiseAND(F.lit((1 << TIE) - 1))
    return rows.select(*ROW, "turn", *[F.shiftleft(F.col(f"v{i}"), TIE).bitwiseOR(tie).alias(k) for i, k in enumerate(KEYS)])


def _walk(tree: list[Node], keys: list[Column], at: int = 0) -> Column:
    node = tree[at]
    if node.cut is None:
        return F.lit(node.number)
    return F.when(keys[node.dim] < node.cut, _walk(tree, keys, node.left)).otherwise(_walk(tree, keys, node.right))


def _array_walk(tree: list[Node], keys: list[Column]) -> Column:
    """The same walk over array literals, for trees too large for nested conditions."""
    lit = lambda xs, t: F.array(*[F.lit(x).cast(t) for x in xs])
    dims = lit([n.dim for n in tree], "int")
    cuts = lit([SPAN if n.cut is None else n.cut for n in tree], "long")
    left = lit([n.number if n.cut is None else n.left for n in tree], "int")
    right = lit([n.number if n.cut is None else n.right for n in tree], "int")
    depth = max(1, (len(tree)).bit_length())
    row = F.array(*keys)
    step = lambda node, _: F.when(F.get(row, F.get(dims, node)) < F.get(cuts, node), F.get(left, node)).otherwise(F.get(right, node))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def walk(tree: list[Node], keys: list[Column]) -> Column:
    return _walk(tree, keys) if len(tree) < 512 else _array_walk(tree, keys)


def grow(rows: DataFrame, keys: list[str], shards: int) -> list[Node]:
    """The tree for rows with ``keys`` and ``size``."""
    tree = [Node(0, 0, shards)]
    level = [tree[0]] if shards > 1 else []
    cols = [F.col(k) for k in keys]
    while level:
        ids = {n.number for n in level}
        at = walk(tree, cols).alias("node")
        lean = rows.select(at, "size", *keys).where(F.col("node").isin(list(ids)))
        seen = lean.groupBy("node").agg(F.sum("size").alias("w"), *[f(k).alias(f"{p}{i}") for i, k in enumerate(keys) for p, f in (("lo", F.min), ("hi", F.max))])
        stats = {r["node"]: r for r in seen.collect()}  # one row per node of the level
        todo = {}
        for n in level:
            r = stats.get(n.number)
            if r is None:
                n.cut = SPAN
                continue
            wide = max(range(len(keys)), key=lambda i: ((r[f"hi{i}"] >> TIE) - (r[f"lo{i}"] >> TIE), r[f"hi{i}"] - r[f"lo{i}"]))
            n.dim = wide
            todo[n.number] = {"dim": wide, "lo": r[f"lo{wide}"], "hi": r[f"hi{wide}"] + 1, "below": 0, "aim": r["w"] * (n.shards // 2) / n.shards, "w": r["w"]}
        while todo:
            ids = sorted(todo)
            state = [todo[k] for k in ids]
            bins = max(64, HISTOGRAM_ROWS // len(ids))
            widths = [max(1, -(-(s["hi"] - s["lo"]) // bins)) for s in state]
            places = {k: i for i, k in enumerate(ids)}
            place = F.array(*[F.lit(places.get(k, -1)) for k in range(len(tree))])
            pick = lambda xs, i="i": F.get(F.array(*[F.lit(x).cast("long") for x in xs]), F.col(i))
            part = lean.withColumn("i", F.get(place, F.col("node"))).where("i >= 0")
            part = part.select("i", "size", F.get(F.array(*cols), pick([s["dim"] for s in state]).cast("int")).alias("key"), pick([s["lo"] for s in state]).alias("lo"), pick([s["hi"] for s in state]).alias("hi"), pick(widths).alias("width"))
            got = part.where("key >= lo AND key < hi").groupBy("i", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("size").alias("w")).toArrow()
            i, b, w = (got[c].to_numpy() for c in ("i", "bin", "w"))
            for k, (number, s) in enumerate(zip(ids, state)):
                mine = np.flatnonzero(i == k)
                mine = mine[np.argsort(b[mine])]
                upto = s["below"] + np.cumsum(w[mine])
                at = min(int(np.searchsorted(upto, s["aim"])), len(mine) - 1)
                here, width = int(w[mine[at]]), widths[k]
                before, lo = int(upto[at]) - here, s["lo"] + int(b[mine[at]]) * width
                if width == 1 or here <= TOLERANCE * s["w"]:
                    tree[number].cut = lo if s["aim"] - before < before + here - s["aim"] else lo + width
                    del todo[number]
                else:
                    todo[number] = s | {"lo": lo, "hi": min(lo + width, s["hi"]), "below": before}
        below = []
        for n in level:
            for side, first_shard, count in (("left", n.first, n.shards // 2), ("right", n.first + n.shards // 2, n.shards - n.shards // 2)):
                child = Node(len(tree), first_shard, count)
                tree.append(child)
                setattr(n, side, child.number)
                if count > 1:
                    below.append(child)
        level = below
    return tree


def shard_column(tree: list[Node], keys: list[Column]) -> Column:
    leaf = walk(tree, keys)
    if len(tree) == 1:
        return F.lit(0)
    first = F.array(*[F.lit(n.first) for n in tree])
    return F.get(first, leaf)


def with_slots(rows: DataFrame, scratch: Scratch, order: list[str], per_group: int = 50_000) -> DataFrame:
    """Adds slot, gapless from 0 within shard, from counts of (shard, group) and ranks inside a group by ``order``, which tells all rows apart.

    Groups hold about ``per_group`` rows, so no task sorts a whole shard however large it is.
    """
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    groups = max(8, -(-largest // per_group))
    grouped = rows.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    held = grouped.groupBy("shard", "__group").agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.cut(held.select("shard", "__group", F.coalesce(F.sum("__n").over(up), F.lit(0)).alias("__start")), "starts")
    rank = F.row_number().over(Window.partitionBy("shard", "__group").orderBy(*order))
    return grouped.withColumn("__rank", rank - 1).join(starts, ["shard", "__group"]).withColumn("slot", (F.col("__start") + F.col("__rank")).cast("long")).drop("__group", "__rank", "__start")


def plan_tree(rows: DataFrame, keys: list[str], shards: int | None, target_bytes: int | None) -> list[Node]:
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    return grow(rows, keys, int(shards))


def _placed(docs: DataFrame, same: Column, shards: int | None, target_bytes: int | None, scratch: Scratch) -> DataFrame:
    """ROW, turn, shard and slot, one row for each row of docs."""
    rows = scratch.cut(keyed_rows(docs, same), "rows")
    tree = plan_tree(rows, KEYS, shards, target_bytes)
    placed = scratch.cut(rows.select(*ROW, "turn", shard_column(tree, [F.col(k) for k in KEYS]).cast("int").alias("shard")), "placed")
    return with_slots(placed, scratch, [*ROW, "turn"])


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    got = _placed(docs, F.lit(0).cast("long"), shards, None, Scratch(docs.sparkSession, "shards"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with shard and slot. Both are found on narrow rows; texts move once, to meet their places.

    Rows that are equal throughout collapse map-side and take as many places as they are.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    mine = docs.columns
    same = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    places = _placed(docs, same, shards, target_bytes, scratch).select("same", "size", "text_crc32", "shard", "slot")
    key = [same.alias("same"), row_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")]
    whole = docs.select(*key, F.struct(*mine).alias("row")).groupBy("same", "size", "text_crc32").agg(F.first("row").alias("row"))
    free = lambda name: free(name + "_") if name in mine else name
    return whole.join(places, ["same", "size", "text_crc32"]).select("row.*", F.col("shard").alias(free("shard")), F.col("slot").alias(free("slot")))
