"""Counts written for people, as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([\d.,]+)\s*([KkMm]?)"


def parsed_count(text: Column) -> Column:
    """The first number with an optional K or M, rounded half up; null if there is none or it is malformed."""
    digits = F.replace(F.regexp_extract(text, NUMBER, 1), F.lit(","), F.lit(""))
    number = F.when(F.regexp_extract(text, NUMBER, 1).rlike("^,+$"), F.lit(0.0)).otherwise(digits.try_cast("double"))
    scale = F.upper(F.regexp_extract(text, NUMBER, 2))
    times = F.when(scale == "K", 1_000).when(scale == "M", 1_000_000).otherwise(1)
    return F.floor(number * times + 0.5).cast("long")


def reaction_total(label: Column, people: Column, button: Column, tallies: Column) -> Column:
    """The first stated total; else the sum of single tallies, which is a least value."""
    stated = F.coalesce(parsed_count(label), parsed_count(people), parsed_count(button))
    known = F.filter(F.transform(tallies, parsed_count), lambda x: x.isNotNull())
    return F.coalesce(stated, F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x)))
