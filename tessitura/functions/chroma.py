"""Chroma vectors (arrays of 12) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import template

EPS = 1.1920929e-07


def bound(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalize(a: Column) -> Column:
    """Divided by the sum where that is positive."""
    return bound(a, lambda v: bound(total(v), lambda s: F.when(s > EPS, F.transform(v, lambda x: x / s)).otherwise(v)))


def whiten(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, F.sqrt(x)).otherwise(x))


def at(a: Column, i: Column) -> Column:
    return F.get(a, F.pmod(i, F.lit(12)).cast("int"))


def peak_offsets(a: Column) -> Column:
    """Sums (offset * height, height) over the peaks of one circular chroma."""

    def peak(i: Column) -> Column:
        left, mid, right = at(a, i - 1), at(a, i), at(a, i + 1)
        den = 2.0 * mid - left - right
        on = (mid > left) & (mid > right) & (mid > EPS) & (den > EPS)
        return F.struct(F.when(on, 0.5 * (right - left) / den * mid).otherwise(0.0).alias("o"), F.when(on, mid).otherwise(0.0).alias("w"))

    found = F.transform(F.sequence(F.lit(0), F.lit(11)), peak)
    return F.struct(total(F.transform(found, lambda p: p["o"])).alias("o"), total(F.transform(found, lambda p: p["w"])).alias("w"))


def shift(a: Column, offset: Column) -> Column:
    """Moved by a part of a bin, circularly, between neighbours in proportion."""

    def bin_at(i: Column) -> Column:
        low = F.floor(i - offset)
        part = i - offset - low
        return at(a, low) * (1.0 - part) + at(a, low + 1) * part

    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: bin_at(i.cast("double")))


def key_scores(a: Column) -> Column:
    """24 scores: mean of four profile correlations, as one dot product with the template."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in template()])

    def scored(v: Column) -> Column:
        mean = total(v) / 12.0
        centred = F.transform(v, lambda x: x - mean)
        return bound(centred, lambda c: bound(F.sqrt(total(F.transform(c, lambda x: x * x))), lambda n: F.transform(rows, lambda r: total(F.zip_with(r, c, lambda p, q: p * q)) / F.greatest(n, F.lit(EPS)))))

    return bound(a, scored)


def top_two(scores: Column) -> Column:
    """array of struct(score, key): ranked by score; ties go to the root first, major before minor."""
    order = lambda k: F.pmod(k, F.lit(12)) * 2 + F.floor(k / 12)
    ranked = F.array_sort(F.transform(scores, lambda s, k: F.struct((-s).alias("less"), order(k).cast("int").alias("turn"), k.cast("int").alias("key"))))
    return F.transform(F.slice(ranked, 1, 2), lambda r: F.struct((-r["less"]).alias("score"), r["key"].alias("key")))


def choose_key(a: Column, top: Column) -> Column:
    """Best key, or the second if it is the relative, close in score and stronger on its tonic."""
    best, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    b, s = best["key"], second["key"]
    relative = F.when((b < 12) & (s >= 12), F.pmod(b + 9, F.lit(12)) == s - 12).when((b >= 12) & (s < 12), F.pmod(b - 12 + 3, F.lit(12)) == s).otherwise(False)
    swap = relative & (best["score"] - second["score"] <= 0.05) & (at(a, s) > at(a, b) * 1.2)
    return F.when(swap, s).otherwise(b)


def confidence(top: Column) -> Column:
    best, second = F.get(top, F.lit(0))["score"], F.get(top, F.lit(1))["score"]
    return F.when(F.abs(best) > EPS, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (best - second) / F.abs(best)))).otherwise(0.0)
