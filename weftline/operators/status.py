"""Run clocks and status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phase_seconds(start: Column, end: Column) -> Column:
    return F.when(end >= start, (F.unix_micros(end) - F.unix_micros(start)) / 1e6)


def starts_new_clock(reset: Column, started: Column, finished: Column) -> Column:
    return F.coalesce(reset, F.lit(False)) | started.isNull() | finished.isNotNull()


# The clock of a run, begin and end of each of its phases, in milliseconds.
CLOCK = ("collectStartedAt", "collectEndedAt", "drainStartedAt", "drainEndedAt", "storeStartedAt", "storeEndedAt")


def stamp_ms(value: Column) -> Column:
    """A finite number or null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def restored_clock(saved: Column) -> Column:
    """The six stamps of a clock saved as JSON; what is missing or no finite number (text that looks like one, too) is null."""
    read = F.try_parse_json(saved)

    def stamp(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(read, f"$.{name}", "variant"))
        number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(read, f"$.{name}", "double"))
        return stamp_ms(number).alias(name)

    return F.struct(*map(stamp, CLOCK))


def phase_ms(start: Column, end: Column) -> Column:
    return F.when(end >= start, end - start)


def timing_totals(clock: Column, finished: Column) -> Column:
    """{collect, drain, store, total} in milliseconds; null as a whole unless the run has finished and all three phases are complete."""
    parts = [phase_ms(clock[f"{p}StartedAt"], clock[f"{p}EndedAt"]).alias(p) for p in ("collect", "drain", "store")]
    total = parts[0] + parts[1] + parts[2]
    return F.when(finished & total.isNotNull(), F.struct(*parts, total.alias("total")))
