"""Musical keys and tempo relations as column expressions.

A key is an index: tonic 0..11 from C upward, plus 12 for minor.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARP_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
ENUM_NAMES = tuple(n.replace("#", "Sharp") for n in SHARP_NAMES)
_FLATS = {"db": 1, "eb": 3, "fb": 4, "gb": 6, "ab": 8, "bb": 10, "cb": 11, "e#": 5}
TONICS = {n.lower(): i for i, n in enumerate(SHARP_NAMES)} | _FLATS


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())]), key)


def key_of(tonic: Column, minor: Column) -> Column:
    return (tonic + F.when(minor, 12).otherwise(0)).cast("int")


def camelot_to_key(label: Column) -> Column:
    """'8A' is A minor, '8B' C major; null for anything else."""
    text = F.upper(F.trim(label))
    n = F.regexp_extract(text, r"^(\d{1,2})[AB]$", 1)
    number = F.when(n != "", n.cast("int"))
    minor = F.endswith(text, F.lit("A"))
    tonic = F.pmod(F.when(minor, 8).otherwise(11) + 7 * (number - 1), F.lit(12))
    return F.when(number.between(1, 12), key_of(tonic, minor))


def parse_key(label: Column) -> Column:
    """Index of 'C# major', 'Eb minor', 'Abm', 'F#', ...; null if it can't be read.

    Two words are tonic and mode in any case; one word is a tonic with the suffix 'm' or 'min' for minor,
    'maj' or nothing for major, in lower case.
    """
    text = F.regexp_replace(F.translate(F.trim(label), "♯♭", "#b"), r"\s+", " ")
    parts = F.split(text, " ")
    one = F.size(parts) == 1
    head = F.when(one, F.regexp_replace(text, r"^(.+?)(?:maj|min|m)$", "$1")).otherwise(F.get(parts, F.lit(0)))
    tail = F.when(one, F.regexp_extract(text, r"^.+?(maj|min|m)$", 1)).otherwise(F.lower(F.get(parts, F.lit(1))))
    minor = tail.isin("m", "min", "minor")
    known = F.when(one, tail.isin("", "m", "min", "maj")).otherwise((F.size(parts) == 2) & (minor | tail.isin("maj", "major")))
    return F.when(known, key_of(_lookup(TONICS, F.lower(head)), minor))


def parse_camelot_or_key(label: Column) -> Column:
    return F.coalesce(camelot_to_key(label), parse_key(label))


def key_name(key: Column) -> Column:
    """Display form, as 'C# major'."""
    return F.concat_ws(" ", F.get(F.array(*[F.lit(n) for n in SHARP_NAMES]), F.pmod(key, F.lit(12))), F.when(key >= 12, "minor").when(key >= 0, "major"))


def key_struct(key: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(F.get(F.array(*[F.lit(n) for n in ENUM_NAMES]), F.pmod(key, F.lit(12))).alias("tonic"), F.when(key >= 12, "Minor").otherwise("Major").alias("mode")))


def key_relation(expected: Column, detected: Column) -> Column:
    """exact, fifth, relative, parallel, tritone or other; null if either is."""
    step = F.pmod(detected - expected, F.lit(12))
    same_mode = (expected >= 12) == (detected >= 12)
    relative = F.when(expected < 12, step == 9).otherwise(step == 3)
    told = (
        F.when(expected == detected, "exact")
        .when(same_mode & step.isin(5, 7), "fifth")
        .when(~same_mode & relative, "relative")
        .when(~same_mode & (step == 0), "parallel")
        .when(same_mode & (step == 6), "tritone")
        .otherwise("other")
    )
    return F.when(expected.isNotNull() & detected.isNotNull(), told)


def mirex_score(expected: Column, detected: Column) -> Column:
    return score_of(key_relation(expected, detected))


def score_of(r: Column) -> Column:
    """The weight of a key relation; null for none."""
    return F.when(r.isNotNull(), F.when(r == "exact", 1.0).when(r == "fifth", 0.5).when(r == "relative", 0.3).when(r == "parallel", 0.2).otherwise(0.0)).cast("double")


TEMPO_RATIOS = (
    ("exact", 1.0), ("double", 2.0), ("half", 1 / 2), ("triple", 3.0), ("third", 1 / 3),
    ("three_to_two", 3 / 2), ("two_to_three", 2 / 3), ("four_to_three", 4 / 3), ("three_to_four", 3 / 4),
)


def tempo_relation(expected: Column, detected: Column, tolerance: float = 0.04) -> Column:
    """The first ratio that detected / expected is near to, within ``tolerance`` of that ratio; else other."""
    fine = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0)
    ratio = F.when(fine(expected) & fine(detected), detected / expected)
    told = F.when(ratio.isNull(), "other")
    for name, r in TEMPO_RATIOS:
        told = told.when(F.abs(ratio - r) <= tolerance * r, name)
    return F.when(expected.isNotNull() & detected.isNotNull(), told.otherwise("other"))


def octave_aware_error(expected: Column, detected: Column) -> Column:
    return F.least(*[F.abs(detected * m - expected) for m in (1.0, 2.0, 0.5)])


def bpm_matches(left: Column, right: Column, ratio: float) -> Column:
    return F.abs(left - right) / F.greatest(F.abs(left), F.abs(right), F.lit(1.1920929e-07)) <= ratio
