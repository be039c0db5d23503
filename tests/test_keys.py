import pytest
from pyspark.sql import functions as F

from tessitura.functions import keys as K


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("label,key", [("Eb minor", 15), ("Abm", 20), ("F#", 6), ("C♯ maj", 1), ("b♭min", 22), ("H", None), ("C dorian", None), ("", None), ("Fb", 4), ("B#", None)])
def test_labels(spark, label, key):
    assert one(spark, K.parse_key(F.col("v")), v=label) == key


@pytest.mark.parametrize("label,key", [("8A", 21), ("8B", 0), ("1a", 20), ("13A", None), ("0B", None), ("foo", None)])
def test_camelot(spark, label, key):
    assert one(spark, K.camelot_to_key(F.col("v")), v=label) == key


@pytest.mark.parametrize("detected,relation,score", [(0, "exact", 1.0), (7, "fifth", 0.5), (5, "fifth", 0.5), (21, "relative", 0.3), (12, "parallel", 0.2), (2, "other", 0.0), (6, "tritone", 0.0)])
def test_relations_from_c_major(spark, detected, relation, score):
    assert one(spark, K.key_relation(F.lit(0), F.col("v")), v=detected) == relation
    assert one(spark, K.mirex_score(F.lit(0), F.col("v")), v=detected) == score


def test_relation_with_a_null_is_null(spark):
    assert one(spark, K.key_relation(F.lit(0), F.col("v").cast("int")), v=None) is None


@pytest.mark.parametrize("e,d,relation", [(120.0, 121.0, "exact"), (120.0, 60.0, "half"), (120.0, 180.0, "three_to_two"), (120.0, 0.0, "other"), (100.0, 133.0, "four_to_three")])
def test_tempo_relation(spark, e, d, relation):
    assert one(spark, K.tempo_relation(F.col("e"), F.col("d")), e=e, d=d) == relation


def test_octave_error(spark):
    assert one(spark, K.octave_aware_error(F.lit(128.0), F.lit(64.0))) == 0
