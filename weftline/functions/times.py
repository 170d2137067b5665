"""Readings of time labels. `now` is always an input; the session's zone is the zone of local labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_chrome_line, normalized_space, trimmed

# Units and their seconds; a month is 30.4375 days, a year 365.25.
UNIT_SECONDS = {
    "s": 1,
    "m": 60,
    "min": 60,
    "mins": 60,
    "minute": 60,
    "minutes": 60,
    "h": 3600,
    "hr": 3600,
    "hrs": 3600,
    "hour": 3600,
    "hours": 3600,
    "d": 86400,
    "day": 86400,
    "days": 86400,
    "w": 604800,
    "week": 604800,
    "weeks": 604800,
    "mo": 2629800,
    "month": 2629800,
    "months": 2629800,
    "y": 31557600,
    "year": 31557600,
    "years": 31557600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_UNIT = "|".join(UNIT_SECONDS)
_HEDGE = r"(?:(?:about|around|almost|over|nearly)\s+)?"
RELATIVE = rf"{_HEDGE}(\d+|an?)\s*({_UNIT})(?:\s+ago)?"
TRAILING = rf"(?i)[\s·•]+({_HEDGE}(?:\d+\s*(?:{_UNIT})(?:\s+ago)?|an?\s+(?:{_UNIT})\s+ago)|just now|yesterday|today)$"
_MONTH_NAME = "|".join(m + "[a-z]*" for m in MONTHS)
MONTH_DATE = rf"(?i)\b(?:(?:{_MONTH_NAME})\s+\d{{1,2}}|\d{{1,2}}\s+(?:{_MONTH_NAME}))(?:,?\s*(?:20\d{{2}}))?(?:\s+at\s+\d{{1,2}}:\d{{2}}\s*(?:am|pm)?)?"
MONTH_WORD = rf"(?i)\b({_MONTH_NAME})\b"
LABEL_EDGE = r"^[·•\-–—]+\s*|\s*[·•\-–—]+\s*$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_seconds(unit: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])[F.lower(unit)].cast("long")


def label_of(text: Column) -> Column:
    """A label without dots and dashes at its ends."""
    plain = bound(text, lambda t: F.when(t.rlike(r"[\n\t\u00a0]|  |^\s|\s$") | t.isNull(), normalized_space(t)).otherwise(t))
    return bound(plain, lambda x: F.when(x.rlike(r"^[·•\-–—]|[·•\-–—]$"), trimmed(F.regexp_replace(x, LABEL_EDGE, ""))).otherwise(x))


def _inner_candidates(text: Column) -> list[Column]:
    return [F.regexp_extract(text, pattern, group) for pattern, group in ((TRAILING, 1), (r"(?i)\bon\s+(.+)$", 1), (MONTH_DATE, 0))]


def label_candidates(label: Column) -> Column:
    """What of a label may be a time, in order: all of it, an age at its end, what follows the first ` on `, a month with its day."""
    return bound(label_of(label), lambda text: F.array_distinct(F.filter(F.array(text, *_inner_candidates(text)), lambda x: x != "")))


def _first_read(label: Column, read: Callable[[Column], Column]) -> Column:
    """The first candidate that reads; the inner ones are looked for only where the whole label does not."""
    def either(text: Column) -> Column:
        inner = F.filter(F.array(*_inner_candidates(text)), lambda x: (x != "") & (x != text))
        # one read in the tree: the whole label in the first turn, its inner parts only if that gives nothing
        turns = F.array(F.lit(0), F.lit(1))
        step = lambda done, turn: F.when(done.isNotNull(), done).otherwise(F.try_element_at(F.filter(F.transform(F.when(turn == 0, F.array(text)).otherwise(inner), read), lambda x: x.isNotNull()), F.lit(1)))
        return F.aggregate(turns, F.lit(None).cast("timestamp"), step)

    return bound(label_of(label), either)


def looks_like_time(label: Column) -> Column:
    """Whether a short label reads as an age or a date. Ages count as furniture elsewhere, here they don't."""
    def said(text: Column) -> Column:
        age = text.rlike(f"(?i)^{RELATIVE}$") | text.rlike(TRAILING)
        date = text.rlike(MONTH_DATE) | text.rlike(r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b") | text.rlike(r"\b20\d{2}-\d{2}-\d{2}\b")
        clock = text.rlike(r"(?i)^yesterday\b") & text.rlike(r"\d{1,2}:\d{2}")
        plain = F.when(is_chrome_line(text), text.rlike("(?i)^(just now|yesterday|today)$") | age).otherwise(age | date | clock)
        return (text != "") & (F.length(text) <= 80) & plain

    return bound(label_of(label), said)


def time_of_day(label: Column) -> Column:
    """Seconds since midnight of h:mm with am or pm; 0 without."""
    return F.coalesce(stated_time_of_day(label), F.lit(0))


def stated_time_of_day(label: Column) -> Column:
    """Seconds since midnight of h:mm with am or pm; null without."""
    pattern = r"(?i)\b(\d{1,2}):(\d{2})\s*([ap]m)?"
    parts = F.struct(*(F.regexp_extract(label, pattern, i).alias(name) for i, name in ((1, "h"), (2, "m"), (3, "half"))))

    def seconds(x: Column) -> Column:
        hour, half = x["h"].try_cast("int"), F.lower(x["half"])
        hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
        return hour * 3_600 + x["m"].try_cast("int") * 60

    return bound(parts, seconds)


def plus_seconds(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + seconds.cast("long") * 1_000_000)


def yesterday_time(label: Column, now: Column) -> Column:
    """A label that begins with `yesterday`: a day ago, at its time of day if it has one."""
    clock = stated_time_of_day(label)
    day = plus_seconds(F.date_sub(now.cast("date"), 1).cast("timestamp"), F.coalesce(clock, F.lit(0)))
    return F.when(label.rlike(r"(?i)^yesterday\b"), F.when(clock.isNotNull(), day).otherwise(plus_seconds(now, F.lit(-86_400))))


def relative_time(label: Column, now: Column) -> Column:
    """`3h`, `an hour ago`, `about 2 days ago`, `just now`, `today`, `yesterday at 5:03 PM`; an age may stand inside a label.

    `just now` and `today` count only as the whole of a candidate.
    """
    def read(text: Column) -> Column:
        whole, inside = (F.struct(*(F.regexp_extract(text, p, i).alias(n) for i, n in ((1, "many"), (2, "unit")))) for p in (f"(?i)^{RELATIVE}$", rf"(?i)\b{RELATIVE}\b"))
        age = bound(F.when(whole["unit"] != "", whole).otherwise(inside), lambda x: -F.coalesce(x["many"].try_cast("long"), F.lit(1)) * unit_seconds(F.nullif(x["unit"], F.lit(""))))
        low = F.lower(text)
        return F.when(low.isin("just now", "today"), now).when(low.startswith("yesterday"), F.coalesce(yesterday_time(text, now), plus_seconds(now, F.lit(-86_400)))).otherwise(plus_seconds(now, age))

    return _first_read(label, read)


def month_time(label: Column, now: Column) -> Column:
    """`September 8`, `8 September 2025 at 5:03 PM`; any word that begins like a month counts as one."""
    after = F.regexp_extract(label, rf"(?i)\b(?:{_MONTH_NAME})\b\s*,?\s*(\d{{1,2}})\b", 1).try_cast("int")
    before = F.regexp_extract(label, rf"(?i)(\d{{1,2}})\s*\b(?:{_MONTH_NAME})\b", 1).try_cast("int")
    day = bound(after, lambda x: F.when(x.between(1, 31), x).otherwise(before))
    year = F.coalesce(F.regexp_extract(label, r"\b(20\d\d)\b", 1).try_cast("int"), F.year(now))

    def read(name: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(name, F.lit(3))))
        parts = F.struct(month.alias("month"), day.alias("day"), year.alias("year"))
        return F.when(name != "", bound(parts, lambda x: _day(x["year"], x["month"], x["day"], label)))

    return bound(F.regexp_extract(label, MONTH_WORD, 1), read)


def numeric_time(label: Column, now: Column) -> Column:
    """`M/D[/Y]`; swapped if only that can be. Days past a month's end run on into the next."""
    pattern = r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b"
    parts = F.struct(*(F.regexp_extract(label, pattern, i).try_cast("int").alias(n) for i, n in ((1, "a"), (2, "b"), (3, "year"))))

    def day(x: Column) -> Column:
        swap = (x["a"] > 12) & (x["b"] <= 12)
        year = F.coalesce(F.when(x["year"] < 100, x["year"] + 2_000).otherwise(x["year"]), F.year(now))
        month = F.when(swap, x["b"]).otherwise(x["a"])
        return F.when(month.between(1, 12), _day(year, month, F.when(swap, x["a"]).otherwise(x["b"]), label))

    return F.when(F.contains(label, F.lit("/")), bound(parts, day))


def _day(year: Column, month: Column, day: Column, label: Column) -> Column:
    fits = month.between(1, 12) & day.between(1, 31)
    start = F.make_date(F.when(fits, year), F.when(fits, month).cast("int"), F.lit(1))
    return plus_seconds(F.date_add(start, day - 1).cast("timestamp"), time_of_day(label))


def iso_time(label: Column) -> Column:
    """The first ISO date or date-time; dates alone are UTC, date-times without a zone local."""
    found = F.regexp_extract(label, r"(\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?)?)", 1)

    def read(x: Column) -> Column:
        return F.when(x != "", F.try_to_timestamp(F.when(F.length(x) == 10, F.concat(x, F.lit("T00:00:00Z"))).otherwise(x)))

    return bound(found, read)


def absolute_time(label: Column, now: Column) -> Column:
    """Of a label's candidates with a digit the first that reads as a date: ISO, month and day, numbers, yesterday."""
    def read(text: Column) -> Column:
        return F.when(text.rlike(r"\d"), F.coalesce(iso_time(text), month_time(text, now), numeric_time(text, now), yesterday_time(text, now)))

    return _first_read(label, read)


def not_in_future(at: Column, now: Column, slack_seconds: int = 21_600) -> Column:
    return F.when(at <= plus_seconds(now, F.lit(slack_seconds)), at)


def resolved_time(labels: Column, now: Column) -> Column:
    """The first label that reads as absolute and is not in the future, else the first relative one; and which it was."""
    exact = F.filter(F.transform(labels, lambda x: not_in_future(absolute_time(x, now), now)), lambda x: x.isNotNull())
    rough = F.filter(F.transform(labels, lambda x: relative_time(x, now)), lambda x: x.isNotNull())
    at = F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(rough, F.lit(1)))
    return F.struct(at.alias("at"), (F.size(exact) == 0).alias("approximated"))


def duration_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3_600), F.floor(seconds % 3_600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def iso_or_null(text: Column) -> Column:
    """A time as ISO text in UTC with milliseconds; null where the text is none."""
    at = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def with_absolute_times(rows: DataFrame, labels: dict[str, str], now: Column) -> DataFrame:
    """Adds to rows, for each new column the time of a label column, as `absolute_time` reads it.

    Labels repeat, and reading one is dear: each distinct one is read once and joined back. Spark broadcasts the labels
    where they are few and merges where they are not; null labels stay null.
    """
    every = reduce(DataFrame.unionByName, [rows.select(F.col(c).alias("weftline_label")) for c in labels.values()])
    known = every.where("weftline_label is not null").distinct()
    read = known.select("weftline_label", absolute_time(F.col("weftline_label"), now).alias("weftline_at"))
    for name, label in labels.items():
        one = read.select(F.col("weftline_label").alias(f"weftline_{name}"), F.col("weftline_at").alias(name))
        rows = rows.join(one, rows[label] == one[f"weftline_{name}"], "left").drop(f"weftline_{name}")
    return rows
