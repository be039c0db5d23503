"""Line deduplication by a segment-partition edit join (native).

Lines (split at newline) are linked if their edit distance is at most t of the shorter one's length: 0 below
10 code points, 1 below 20, else 2, however long the line. Equal lines collapse first, by two 64-bit hashes.

Segments are cut for classes of lengths, so two lines that can be linked agree on their bounds without a probe for
each length: class L..L+W-1 has a prefix and a suffix of g = L/W units each, the suffix counted from the line's end,
and for t = 2 a middle between them. One edit can't touch both prefix and suffix; two can't touch all three. If
prefix and suffix are both touched, the middle stands unchanged, moved by at most one place; it ends one code point before the
suffix may start, so the places 0 and +1, looked up from either line, find all moves. A line whose length is
less than t above its class's least one also has segments of the class below. So a line has 3 entries and one more
probe, whatever its length, and each pair is met at its first common segment only.

Entries are hashes, line numbers and the line's counts of 16 letters: an edit changes these by two at most, so lines that
share a segment but differ by words, as those of near copies do, part in the join itself. Pairs that remain are
verified on their texts by the edit distance in a band of t diagonals. The band is Spark's built-in levenshtein with a
limit: SQL has no loop over machine words, so it replaces a bit-parallel one and gives the same distances.

Classes are the components of the links. A null or empty text has no lines; lines of white space only are
left out. The first line of a class by (doc_id, position), null doc_ids last, stays. Rows that repeat a doc_id (or have none)
are read as one document, in which lines at one position with the same text count as many times as they stand there.
Columns beyond doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

SHORT, MIDDLE, LONG = 10, 20, 60
SLOTS = 1 << 20
LETTERS = "etaoinsrhldcumpg"
SEGMENTS = ("prefix", "suffix", "middle", "moved")
NAME = ("h0", "h1")


def limit_of(length: Column) -> Column:
    return F.when(length < SHORT, 0).when(length < MIDDLE, 1).otherwise(2)


def _unit(length: Column) -> Column:
    """W: lengths in a class."""
    return F.when(length < MIDDLE, 2).when(length < LONG, 6).otherwise(12)


def _segments(line: Column, n: Column, at: Column, when: Column, tag: str) -> list[Column]:
    """Keys of a line's segments in the class of length ``at`` (its own, or the last of the class below)."""
    unit, t = _unit(at), limit_of(at)
    g = F.floor(at / unit).cast("int")
    size = F.when(t == 1, g).when(unit == 6, 2 * g).otherwise(4 * g)
    key = lambda i, part: F.xxhash64(g * unit, F.lit(i), part)
    keys = [
        F.when(when, key(0, F.substring(line, F.lit(1), size))), F.when(when, key(1, F.substring(line, n - size + 1, size))),
        F.when(when & (t == 2), key(2, F.substring(line, size + 1, size - 1))), F.when(when & (t == 2), key(2, F.substring(line, size + 2, size - 1))),
    ]
    return [k.alias(f"{s}{tag}") for k, s in zip(keys, SEGMENTS)]


def line_keys(line: Column, n: Column) -> list[Column]:
    """Segment keys in the line's class (prefix0 ..) and, for lines near its least length, in the one below (prefix1 ..)."""
    unit = _unit(n)
    least = F.floor(n / unit).cast("int") * unit
    low = n - least < F.when(n <= MIDDLE, 1).otherwise(2)
    low = F.when(n == MIDDLE, F.lit(True)).otherwise(low & (n > SHORT))
    below = F.when(n == MIDDLE, n - 1).otherwise(least - 1)
    return [*_segments(line, n, n, n >= SHORT, "0"), *_segments(line, n, below, low, "1")]


def letter_counts(line: Column) -> Column:
    """Counts, modulo 16, of sixteen letters in one number."""
    held = [F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(15)).cast("long"), 4 * j) for j, c in enumerate(LETTERS)]
    return reduce(lambda a, b: a.bitwiseOR(b), held)


def letters_apart(a: Column, b: Column) -> Column:
    """At most the difference of two letter counts, summed: an edit changes it by two at most."""
    one = lambda x, j: F.shiftrightunsigned(x, 4 * j).bitwiseAND(F.lit(15).cast("long"))
    gap = lambda j: F.abs(one(a, j) - one(b, j))
    return reduce(lambda x, y: x + y, [F.least(gap(j), 16 - gap(j)) for j in range(16)])


def _name(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h0"), F.xxhash64(F.lit(11), line, F.length(line)).alias("h1")]


def read_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line; lines of white space only are left out."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def describe(occ: DataFrame) -> DataFrame:
    """Rows with ``line`` -> their other columns, and the line's two hashes, length, letters and segment keys."""
    n = F.length("line")
    rest = [c for c in occ.columns if c != "line"]
    return occ.select(*rest, *_name(F.col("line")), n.alias("n"), letter_counts(F.col("line")).alias("letters"), *line_keys(F.col("line"), n))


def distinct_lines(described: DataFrame) -> DataFrame:
    """One row per distinct line: h0, h1, times, some_doc (a doc_id that holds it, or null), n, letters, segment keys."""
    keys = [f"{s}{tag}" for tag in "01" for s in SEGMENTS]
    return described.groupBy(*NAME).agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("some_doc"), F.first("n").alias("n"), F.first("letters").alias("letters"), *[F.first(k).alias(k) for k in keys])


def candidates(lines: DataFrame) -> DataFrame:
    """(a, b), a < b: lines that share a segment and whose lengths and letters allow a link. ``lines``: id, n, letters and segment keys."""
    rows = lines.select("id", "n", "letters", *[F.col(f"{s}0").alias(s) for s in SEGMENTS]).unionByName(lines.where("prefix1 IS NOT NULL").select("id", "n", "letters", *[F.col(f"{s}1").alias(s) for s in SEGMENTS]))
    near = (F.abs(F.col("x.n") - F.col("y.n")) <= 2) & (letters_apart(F.col("x.letters"), F.col("y.letters")) <= 4)
    apart = lambda *segments: reduce(lambda a, b: a & b, [~F.col(f"x.{s}").eqNullSafe(F.col(f"y.{s}")) for s in segments], F.lit(True))

    def meet(left: str, right: str, both: tuple[str, ...]) -> DataFrame:
        cols = ["id", "n", "letters", *both]
        x, y = (rows.where(F.col(k).isNotNull()).select(F.col(k).alias("key"), *cols) for k in (left, right))
        once = F.col("x.id") < F.col("y.id") if left == right else F.col("x.id") != F.col("y.id")
        return x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & once & near & apart(*both)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    found = [meet("prefix", "prefix", ()), meet("suffix", "suffix", ("prefix",)), meet("middle", "middle", ("prefix", "suffix")), meet("middle", "moved", ("prefix", "suffix"))]
    return reduce(DataFrame.unionByName, found).distinct()


def line_links(lines: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: ids of distinct lines within their edit limit. ``lines``: as ``distinct_lines`` gives, with id."""
    pairs = scratch.cut(candidates(lines), "pairs")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = scratch.cut(lines.select("id", *NAME, "some_doc").join(ends, "id"), "wanted")
    # At most SLOTS rows are broadcast; texts of documents that hold none of the wanted lines stay where they are.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    doc_slots = scratch.cut(wanted.select(slot("some_doc").alias("doc_slot")).distinct(), "doc-slots")
    line_slots = scratch.cut(wanted.select(slot("h0").alias("line_slot")).distinct(), "line-slots")
    some = docs.select("doc_id", "text").join(F.broadcast(doc_slots), slot("doc_id") == F.col("doc_slot"), "left_semi")
    text = read_lines(some).select(*_name(F.col("line")), "line").join(F.broadcast(line_slots), slot("h0") == F.col("line_slot"), "left_semi")
    text = text.join(wanted.select("id", *NAME), [*NAME]).groupBy("id").agg(F.first("line").alias("line"))  # all of one id are equal
    text = scratch.cut(text.select("id", "line", F.length("line").alias("n")), "texts")
    both = pairs.join(text.toDF("a", "la", "na"), "a").join(text.toDF("b", "lb", "nb"), "b")
    t = limit_of(F.least("na", "nb"))
    return both.where((F.abs(F.col("na") - F.col("nb")) <= t) & (F.levenshtein("la", "lb", 2).between(0, t))).select("a", "b")


def classify(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines (doc_id, pos, h0, h1); the distinct ones that repeat or have links (h0, h1, class, degree); the links (a, b)."""
    occ = scratch.cut(describe(read_lines(docs)), "occ")
    lines = scratch.cut(distinct_lines(occ).withColumn("id", F.monotonically_increasing_id()), "lines")
    links = scratch.cut(line_links(lines, docs, scratch), "links")
    comps = scratch.cut(components(links, scratch), "comps")
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    linked = scratch.cut(comps.join(ends, "id", "left"), "linked")
    named = lines.select("id", *NAME, "times").join(linked, "id", "left").where("times > 1 OR component IS NOT NULL")
    named = scratch.cut(named.select(*NAME, F.coalesce("component", "id").alias("class"), F.coalesce("degree", F.lit(0)).alias("degree")), "named")
    return occ.select("doc_id", "pos", *NAME), named, links


def _judged(occ: DataFrame, named: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, pos, degree, dropped) of the lines that repeat or have links."""
    slots = scratch.cut(named.select(F.pmod("h0", F.lit(SLOTS)).alias("slot")).distinct(), "line-slots-2")
    rows = occ.join(F.broadcast(slots), F.pmod("h0", F.lit(SLOTS)) == F.col("slot"), "left_semi").join(named, [*NAME])
    rows = scratch.cut(rows.select("doc_id", "pos", "class", "degree"), "rows")
    first = scratch.cut(rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "pos")).alias("first")), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))
    return rows.join(first, "class").select("doc_id", "pos", "degree", (~stays).alias("dropped"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, dropped_lines (their class stands earlier), near_links (links of its lines), for every row's doc_id."""
    scratch = Scratch(docs.sparkSession, "lines")
    occ, named, _ = classify(docs, scratch)
    judged = _judged(occ, named, scratch).groupBy("doc_id").agg(F.sum(F.col("dropped").cast("long")).alias("dropped_lines"), F.sum("degree").alias("near_links"))
    counted = occ.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    per = scratch.cut(counted.alias("c").join(judged.alias("j"), F.col("c.doc_id").eqNullSafe(F.col("j.doc_id")), "left").select(F.col("c.doc_id").alias("__id"), "n_lines", "dropped_lines", "near_links"), "per")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", zero("n_lines"), zero("dropped_lines"), zero("near_links"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents without the lines whose class stands earlier; a document keeps its row, at worst with ''."""
    scratch = Scratch(docs.sparkSession, "lines")
    occ, named, _ = classify(docs, scratch)
    gone = _judged(occ, named, scratch).where("dropped").groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    gone = scratch.cut(gone, "gone").withColumnRenamed("doc_id", "__id")
    lines = F.split("text", "\n")
    stay = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return docs.select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", F.array_join(stay, "\n").alias("text"))
