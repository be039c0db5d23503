"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. One scan hashes each document's shingle set and its 128-hash signature. Documents with equal sets
   collapse into one class, so copies never multiply candidates.
2. ``TREES`` trees order the classes by different runs of the signature. A tree is one
   range-partitioned sort by (tree, first four hashes, next four, id): a region with many members
   is spread over tasks, since the id is part of the order.
3. In each order a class meets the ``reach`` next classes that share its first four hashes. Sorted
   order puts the longest common prefix first, so in a dense region only deep agreement makes
   neighbours while in a sparse one four hashes do: depth adapts to the region. Neighbours across
   task borders meet in a second pass over the border rows.
4. Links are confirmed on full shingle sets, re-read from the texts. The first round uses four trees
   and next neighbours only; the second uses all trees, but only pairs whose ends are not yet
   connected. So a group of n near copies costs O(n) pairs.
5. A region (the classes that share a tree's first four hashes) of more than ``reach`` + 1 members in
   more than one component is then searched whole: its members are dealt into blocks of about ``BLOCK``,
   and each pair of blocks is one group of rows that counts all its intersections on full sets. A component
   with more members than that has blocks of its own, which never meet each other. Smaller regions were
   met whole in step 3. Only links that join two components leave a group.
6. Components by large-star/small-star, then every document gets its class's component.

A pair at similarity s shares a tree's first four hashes with probability s^4, so at s = 0.8 all 32
trees miss it with probability 5e-8; every pair that shares them in some tree is either connected or
compared. An exact link decision always comes from the full sets.

Null, empty and white-space-only texts have no shingles and link with nothing. A null doc_id links
with nothing and has a null component. Texts are read whole. Rows that repeat a doc_id are one node: if their
texts differ, the classes of these are tied together. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, one_row_each, pieces, shingle_sets, text_buffer
from .components import components

HASHES, DEPTH, TREES = 128, 4, 32
SLOTS = 1 << 20
BLOCK = 384
_rng = np.random.Generator(np.random.PCG64(77))
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash of one set under ``HASHES`` multiply-add permutations; long sets go in blocks."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * _A + _B).min(axis=0), out=low)
    return low


def _sets(batch: pa.RecordBatch, k: int):
    raw, offsets = text_buffer(batch.column("text"))
    for first, last in pieces(offsets):
        part = offsets[first : last + 1]
        yield first, shingle_sets(raw[part[0] : part[-1]], part - part[0], k)


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(0x1234567))).astype(np.int64))


def _sign(k: int):
    def run(batches):
        for batch in batches:
            for first, sets in _sets(batch, k):
                ids = [_identity(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x for x, _ in ids], pa.int64()),
                        pa.array([x for _, x in ids], pa.int64()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )

    return run


def _labels(sig: np.ndarray, trees: range) -> tuple[np.ndarray, np.ndarray]:
    """For each row and tree: the first four hashes as one number, the next four packed in order."""
    keys, rest = [], []
    for t in trees:
        own = [(t * DEPTH + j) % HASHES for j in range(2 * DEPTH)]
        key = np.zeros(len(sig), np.uint64)
        for j in own[:DEPTH]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j].astype(np.uint64))
        deep = np.zeros(len(sig), np.uint64)
        for j in own[DEPTH:]:
            deep = (deep << np.uint64(16)) | (sig[:, j].astype(np.uint64) >> np.uint64(16))
        keys.append(key)
        rest.append(deep)
    return np.stack(keys, 1), np.stack(rest, 1)


def _plant(trees: range):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            key, deep = _labels(sig, trees)
            n = len(trees)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.array(trees, np.int32), len(sig))),
                    pa.array(key.reshape(-1).view(np.int64)),
                    pa.array(deep.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(batch.column("id").to_numpy(), n)),
                    pa.array(np.repeat(batch.column("comp").to_numpy(), n)),
                    pa.array(np.repeat(batch.column("n_shingles").to_numpy(), n)),
                ],
                ["tree", "key", "deep", "id", "comp", "n"],
            )

    return run


_LINK = "a long, b long, border boolean, tree int, key long, deep long, n long, comp long, part int"


def _neighbours(reach: int, threshold: int, border: bool):
    """Pairs of rows at most ``reach`` apart with one key, different components and lengths that allow a link."""

    def emit(tree, key, deep, ids, comp, n, fresh):
        a, b = [], []
        for d in range(1, reach + 1):
            if len(ids) <= d:
                break
            ok = (key[:-d] == key[d:]) & (tree[:-d] == tree[d:]) & (comp[:-d] != comp[d:])
            ok &= 100 * np.minimum(n[:-d], n[d:]) >= threshold * np.maximum(n[:-d], n[d:])
            ok[: max(0, fresh - d)] = False  # both rows were in the tail: met before
            at = np.flatnonzero(ok)
            a.append(ids[at])
            b.append(ids[at + d])
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pair

    def pairs(pair):
        m = len(pair)
        none = lambda t: pa.nulls(m, t)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.zeros(m, bool)), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int32())], [x.split()[0] for x in _LINK.split(", ")])

    def edge(rows):
        m = len(rows[0])
        tree, key, deep, ids, comp, n = rows
        none = pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids), none, pa.array(np.ones(m, bool)), pa.array(tree), pa.array(key), pa.array(deep), pa.array(n), pa.array(comp), pa.nulls(m, pa.int32())], [x.split()[0] for x in _LINK.split(", ")])

    def run(batches):
        tail, head_left = None, reach
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("tree", "key", "deep", "id", "comp", "n")]
            if border and head_left:
                yield edge([c[:head_left] for c in cols])
                head_left -= min(head_left, batch.num_rows)
            fresh = 0 if tail is None else len(tail[0])
            if tail is not None:
                cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
            pair = emit(*cols, fresh)
            if pair is not None and len(pair):
                yield pairs(pair)
            tail = [c[-reach:] for c in cols]
        if border and tail is not None:
            yield edge(tail)

    return run


def _candidates(classes: DataFrame, trees: range, reach: int, threshold: int, scratch: Scratch, name: str) -> DataFrame:
    """Distinct (a, b), a < b, of neighbours in the trees' orders."""
    entries = classes.mapInArrow(_plant(trees), "tree int, key long, deep long, id long, comp long, n long")
    order = ["tree", "key", "deep", "id"]
    found = entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(reach, threshold, True), _LINK)
    found = scratch.cut(found, f"{name}-found")
    edges = found.where("border").select("tree", "key", "deep", F.col("a").alias("id"), "comp", "n").distinct()
    # At most 2 x reach rows a task: one sorted run over the borders.
    seam = edges.repartition(1).sortWithinPartitions(*order).mapInArrow(_neighbours(reach, threshold, False), _LINK)
    return found.where("not border").select("a", "b").unionByName(seam.select("a", "b")).distinct()


def _collect_sets(k: int):
    def run(batches):
        for batch in batches:
            for first, sets in _sets(batch, k):
                ids = [_identity(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(sets)), pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "set_a", "set_b", "shingles"],
                )

    return run


def _confirm(threshold: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def _looks_alike(threshold: int):
    """Drops pairs whose 128-hash estimate is more than five deviations under the threshold."""
    p = threshold / 100
    least = HASHES * p - 5.5 * (HASHES * p * (1 - p)) ** 0.5

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("ga", "gb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return run


def _full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(id, shingles) of the classes in ``ids`` (distinct), from the texts of their least documents."""
    wanted = scratch.cut(ids.join(classes.select("id", F.col("least").alias("doc_id"), "set_a", "set_b"), "id"), f"{name}-wanted")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    slots = scratch.cut(wanted.select(slot.alias("slot")).distinct(), f"{name}-slots")  # at most SLOTS rows
    texts = docs.select("doc_id", "text").join(F.broadcast(slots), slot == F.col("slot"), "left_semi")
    sets = texts.mapInArrow(_collect_sets(k), "doc_id long, set_a long, set_b long, shingles binary")
    sets = sets.join(wanted, ["doc_id", "set_a", "set_b"]).groupBy("id").agg(F.first("shingles").alias("shingles"))  # all of one id are equal
    return scratch.cut(sets, f"{name}-sets")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, threshold: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, linked) for each pair that the signatures don't rule out."""
    g = classes.select("id", "sig")
    near = pairs.join(g.select(F.col("id").alias("a"), F.col("sig").alias("ga")), "a").join(g.select(F.col("id").alias("b"), F.col("sig").alias("gb")), "b")
    near = scratch.cut(near.select("a", "b", "ga", "gb").mapInArrow(_looks_alike(threshold), "a long, b long"), f"{name}-near")
    wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    sets = _full_sets(wanted, classes, docs, k, scratch, name)
    full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    out = scratch.cut(full.select("a", "b", "sa", "sb").mapInArrow(_confirm(threshold), "a long, b long, linked boolean"), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-near", f"{name}-wanted", f"{name}-slots", f"{name}-found")
    return out


def _open_regions(known: DataFrame, reach: int, scratch: Scratch) -> DataFrame:
    """(region, id, comp) of regions that hold pairs which no order has brought together.

    Regions with the same members stand for the same pairs: one of them stays.
    """
    planted = known.mapInArrow(_plant(range(TREES)), "tree int, key long, deep long, id long, comp long, n long")
    entries = planted.select(F.xxhash64("tree", "key").alias("region"), "id", "comp")
    who = [F.sum(F.shiftright(F.xxhash64(F.lit(x), F.col("id")), 20)).alias(f"who{x}") for x in (0, 1)]
    sizes = entries.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *who)
    wide = sizes.where((F.col("m") > reach + 1) & (F.col("lo") < F.col("hi"))).groupBy("m", "who0", "who1").agg(F.min("region").alias("region"))
    return scratch.cut(entries.join(scratch.cut(wide.select("region"), "regions"), "region"), "members")


def _units(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit, side, id, comp): each pair of blocks of a region is a unit; a block that meets itself has side 0 only."""
    per = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c"))
    rest = per.where(F.col("c") <= BLOCK).groupBy("region").agg(F.sum("c").alias("rest"))
    own = F.col("c") > BLOCK
    parts = F.ceil(F.when(own, F.col("c")).otherwise(F.col("rest")) / BLOCK)
    block = F.struct(own.alias("own"), F.when(own, F.col("comp")).otherwise(F.lit(0)).alias("owner"), F.pmod(F.xxhash64("id"), parts).alias("part"))
    rows = members.join(per, ["region", "comp"]).join(rest, "region", "left").select("region", block.alias("block"), "id", "comp")
    rows = scratch.cut(rows, "blocks")
    blocks = rows.select("region", "block").distinct()
    x, y = blocks.withColumnRenamed("block", "x"), blocks.withColumnRenamed("block", "y")
    one = F.col("x.own") & F.col("y.own") & (F.col("x.owner") == F.col("y.owner"))
    units = scratch.cut(x.join(y, "region").where((F.col("x") <= F.col("y")) & ~one).withColumn("unit", F.monotonically_increasing_id()), "units")
    right = units.where("x <> y").select("region", F.col("y").alias("block"), "unit", F.lit(1).alias("side"))
    sides = units.select("region", F.col("x").alias("block"), "unit", F.lit(0).alias("side")).unionByName(right)
    return sides.join(rows, ["region", "block"]).select("unit", "side", "id", "comp")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    sets, n = [*left, *right], len(left)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = times[col] > 1
    row, col = row[again], (np.cumsum(times > 1) - 1)[col[again]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, len(right)), np.int64)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [first, first + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[a:b], col[a:b] - first] = 1
        both += np.rint(has[:n] @ has[n:].T).astype(np.int64)
    return both


def _joins(threshold: int):
    """Links of a unit that join components, as few as connect them."""

    def run(unit: pa.Table) -> pa.Table:
        side, ids, comp = (unit.column(c).to_numpy() for c in ("side", "id", "comp"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in unit.column("shingles")]
        n = np.array([len(s) for s in sets])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        a, b = [], []
        if len(left):
            both = _common([sets[i] for i in left], [sets[j] for j in right])
            linked = (100 * both >= threshold * (n[left][:, None] + n[right] - both)) & (comp[left][:, None] != comp[right])
            root: dict[int, int] = {}

            def find(x):
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                return x

            for i, j in np.argwhere(linked):
                i, j = left[i], right[j]
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[x] = y
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _missed(known: DataFrame, classes: DataFrame, docs: DataFrame, k: int, threshold: int, reach: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between components in regions wider than the orders' reach, enough to connect what is linked there."""
    members = _open_regions(known, reach, scratch)
    sets = _full_sets(members.select("id").distinct(), classes, docs, k, scratch, "wide")
    rows = _units(members, scratch).join(sets, "id").select("unit", "side", "id", "comp", "shingles")
    return scratch.cut(rows.groupBy("unit").applyInArrow(_joins(threshold), "a long, b long").distinct(), "missed")


def near_groups(docs: DataFrame, k: int = 4, threshold: int = 80, reach: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. Similarity is Jaccard on k-word shingles, in per cent."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "forest")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.cut(lean.mapInArrow(_sign(k), "doc_id long, n_shingles long, set_a long, set_b long, sig binary"), "signed")
    group = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"), F.min("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = scratch.cut(group.withColumn("id", F.monotonically_increasing_id()), "classes")
    named = scratch.cut(signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes.select("set_a", "set_b", "id", "least"), ["set_a", "set_b"], "left").select("doc_id", "n_shingles", "id", "least"), "named")
    # A doc_id that is repeated with different texts ties its classes together.
    several = named.where("doc_id IS NOT NULL AND id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("hi")).where("a < hi").select("doc_id", "a")
    ties = scratch.cut(named.join(scratch.cut(several, "several"), "doc_id").where("id > a").select("a", F.col("id").alias("b")).distinct(), "ties")
    comps, tried = None, None
    edges = None if ties.isEmpty() else ties
    known = classes.withColumn("comp", F.col("id"))
    for turn, (trees, far) in enumerate([(range(0, 4), 1), (range(TREES), reach)]):
        pairs = _candidates(known, trees, far, threshold, scratch, f"round{turn}")
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        done = _links(pairs, classes, lean, k, threshold, scratch, f"round{turn}")
        tried = done if tried is None else tried.unionByName(done)
        new = done.where("linked").select("a", "b")
        if not new.isEmpty():
            edges = new if edges is None else edges.unionByName(new)
        if edges is not None:
            comps = scratch.cut(components(edges, scratch, f"cc{turn}"), f"components{turn}")
            known = classes.join(comps.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    new = _missed(known, classes, lean, k, threshold, reach, scratch)
    if not new.isEmpty():
        edges = new if edges is None else edges.unionByName(new)
        comps = scratch.cut(components(edges, scratch, "cc-missed"), "components-missed")
    scratch.drop("regions", "members", "blocks", "units", "wide-sets", "wide-wanted", "wide-slots")
    out, label = named, F.col("least")
    if comps is not None:
        least = comps.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("label"))
        labels = scratch.cut(comps.join(scratch.cut(least, "least"), "component").select("id", "label"), "labels")
        out, label = named.join(labels, "id", "left"), F.coalesce("label", "least")
    comp = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, label).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 4, threshold: int = 80) -> DataFrame:
    """The documents that stay: of each group one row, with the least doc_id. Columns unchanged.

    Rows that repeat a doc_id stay or go together; of those with the same text one row stays, so no text is lost.
    Rows without doc_id all stay.
    """
    scratch = Scratch(docs.sparkSession, "near-ids")
    got = near_groups(docs, k, threshold).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    odd = scratch.cut(got.where("not kept OR times > 1").select(F.col("doc_id").alias("__id"), "kept"), "odd")
    plain = docs.join(odd, docs["doc_id"] == F.col("__id"), "left_anti")
    several = docs.join(odd.where("kept").select("__id"), docs["doc_id"] == F.col("__id"), "left_semi")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return plain.unionByName(one_row_each(several.withColumn("__text", digest), ["doc_id", "__text"]).drop("__text"))
