"""Measures as column expressions: energy means, gain, tempo octaves, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Target loudness, ceiling, grades by cutoff in kHz.
TARGET, CEILING = -14.0, -1.0
GRADES = ((19.5, "high"), (17.5, "good"), (15.5, "fair"))


def energy_mean(level: Column, weight: Column) -> Column:
    """10 log10 of the weighted mean energy; null without weight."""
    total = F.sum(F.pow(F.lit(10.0), level / 10) * weight)
    return F.when((total > 0) & (F.sum(weight) > 0), 10 * F.log10(total / F.sum(weight)))


def gain(level: Column, peak: Column) -> Column:
    """Gain to the target, capped so that the peak stays under the ceiling."""
    return F.when(level.isNull(), None).otherwise(F.least(F.lit(TARGET) - level, F.when(peak > 0, F.lit(CEILING) - 20 * F.log10(peak)).otherwise(F.lit(999.0))))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits as C rounds a double: times ten to the digits, halves away from zero, divided again. Spark's round() goes by the decimal form, so that 0.39135, a little less than it reads, becomes 0.3914."""
    y = F.abs(x * 10.0**digits)
    whole = F.floor(y)
    return F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits


def octave(low: Column, floor: float = 65.0) -> Column:
    """The smallest doubling of a tempo that isn't under the floor."""
    return F.round(low * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.lit(floor) / low)).cast("double"))), 1)


def grade(khz: Column) -> Column:
    out = F.lit("low")
    for edge, name in reversed(GRADES):
        out = F.when(khz >= edge, name).otherwise(out)
    return F.when(khz.isNull(), "unknown").otherwise(out)
