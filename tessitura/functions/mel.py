"""Mel scale as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)
