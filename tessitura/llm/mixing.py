"""Mixing sources to target weights (native).

Tokens are summed per source, weights become word targets under a repetition ceiling, and each
document is taken floor(rate) times plus one Bernoulli copy, seeded by a hash of its id, with the
fraction as its probability. Only a narrow (id, source, size) table is ever shuffled; source
totals are pre-aggregated map-side, so a source holding a third of all rows costs no more than
any other. The table of sources is joined by Spark's own size check (it is read back from a
written table, so its size is known), never by a forced broadcast.

Null text has size 0; null source is a source of its own, sorted last. Rows that repeat a doc_id
share one draw; rows without doc_id draw by their text. Other columns are kept by ``mix`` and ignored by the report. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, unit


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Targets share ``share`` times all words by weight; one stops at ``ceiling`` times its source's
    words and the rest is shared again until none is above. That fixed point is a water level:
    with sources sorted by ceiling over weight, the first k are full and the others get level * weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", w.cast("long").alias("weight"))
    ratio = (F.lit(ceiling) * F.col("source_size")) / F.col("weight").cast("double")
    up = Window.orderBy(F.col("ratio").asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    cum = ranked.withColumn("ratio", ratio).select(
        "*",
        F.sum(F.lit(ceiling) * F.col("source_size")).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("full"),
        F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("gone"),
        F.sum("source_size").over(whole).alias("all_size"),
        F.sum("weight").over(whole).alias("all_weight"),
    )
    level = (F.lit(share) * F.col("all_size") - F.coalesce("full", F.lit(0))) / (F.col("all_weight") - F.coalesce("gone", F.lit(0))).cast("double")
    lev = cum.withColumn("level", level)
    # Level k rises while source k is below it (full) and falls from the first that isn't: the peak is the answer.
    least = lev.withColumn("water", F.max("level").over(whole))
    cap = (F.lit(ceiling) * F.col("source_size")).cast("double")
    return least.select("source", "source_size", F.least(cap, F.col("water") * F.col("weight")).alias("target"))


def chance(seed: str) -> Column:
    """A document's draw: from its id, or where it has none from its text."""
    return unit(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit(""))))))


def decide(docs: DataFrame, scratch: Scratch, seed: str = "mix", **law) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for every row of documents."""
    sizes = scratch.cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), chance(seed).alias("chance")), "sizes")
    goal = scratch.cut(targets(sizes, **law), "targets").withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        sizes.join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left")
        .drop("goal_source")
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (F.col("chance") < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    )


def mix_report(docs: DataFrame, **law) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes."""
    got = decide(docs, Scratch(docs.sparkSession, "mix"), **law)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, seed: str = "mix", **law) -> DataFrame:
    """The mixed corpus: every document of ``docs`` as many times as the mix takes it, columns unchanged.

    The copy count is a function of the row and its source's rate, so texts are not shuffled: only
    the table of sources is joined to them.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.cut(docs.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    goal = scratch.cut(targets(sizes, **law), "targets")
    goal = goal.select(F.col("source").alias("__source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"))
    copies = F.floor("__rate") + (chance(seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    joined = docs.join(goal, F.col("source").eqNullSafe(F.col("__source")), "left")
    times = F.sequence(F.lit(1), copies.cast("int"))
    return joined.withColumn("__copy", F.explode(F.when(copies >= 1, times))).select(*[docs[c] for c in docs.columns])


REPORT_SQL = """
WITH s AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS draw, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM b),
q AS (SELECT *, (2 * source_size)::DOUBLE / weight::DOUBLE AS ratio FROM r),
c AS (SELECT *,
  coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
  coalesce(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS gone,
  (sum(source_size) OVER ())::DOUBLE AS all_size, (sum(weight) OVER ())::DOUBLE AS all_weight FROM q),
l AS (SELECT *, (1.5::DOUBLE * all_size - filled) / (all_weight - gone) AS level FROM c),
w AS (SELECT *, max(level) OVER () AS water FROM l),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, water * weight) AS target FROM w),
j AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
  ('0x' || md5('mix|' || draw)[1:13])::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM j)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM k
"""
