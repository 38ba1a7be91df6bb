"""Number and text formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Shortest decimal text of a double: 38 for 38.0, no exponent."""
    s = c.cast("string")
    plain = F.when(F.abs(c) < 1e15, F.regexp_replace(s, r"\.0$", "")).otherwise(s)
    exp = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", c), r"0+$", ""), r"\.$", "")
    return F.when(s.contains("E"), F.when(F.abs(c) >= 1, F.format_string("%.0f", c)).otherwise(exp)).otherwise(plain)


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def distortion_color(pct: Column) -> Column:
    # fixed values: map colours by distortion
    return F.when(pct < 2, "#22c55e").when(pct < 5, "#eab308").when(pct < 10, "#f97316").otherwise("#ef4444")


def distortion_severity(pct: Column) -> Column:
    return F.when(pct >= 25, "error").when(pct >= 10, "warning").otherwise("info")


def letter_grade(score: Column) -> Column:
    """A from 90, B from 75, C from 60, D from 40; F below, and above 100 where weights sum to more than 1."""
    return F.when(score.between(90, 100), "A").when(score.between(75, 89), "B").when(score.between(60, 74), "C").when(score.between(40, 59), "D").otherwise("F")
