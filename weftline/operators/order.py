"""Orders of feeds and threads: what the page shows, what was asked for, and rows in the order asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import normalized_space

# The names of orders, each with the labels that stand for it.
COMMENT_ORDERS = {
    "newest": (r"^newest\b", r"^most recent\b", r"^all comments\b"),
    "all": (r"^all comments\b", r"^newest\b"),
    "relevant": (r"^most relevant\b", r"^top comments\b"),
}
FEED_ORDERS = {
    "new": (r"^new posts$", r"^new listings$"),
    "activity": (r"^recent activity$", r"^new activity$", r"^recent listing activity$"),
    "relevant": (r"^most relevant$", r"^top listings$"),
}
UNSORTED = "comments:unsorted"


def order_label(text: Column) -> Column:
    """The words of a control that names an order: one line without white space around or runs of it."""
    return F.nullif(F.regexp_replace(normalized_space(text), r"\s+", " "), F.lit(""))


def shows_order(label: Column, asked: str, orders: dict[str, tuple[str, ...]]) -> Column:
    """Whether the label is one of those of the order asked for; null, where no control was found, is not."""
    fits = F.lit(False)
    for pattern in orders[asked]:
        fits = fits | label.rlike(f"(?i){pattern}")
    return F.coalesce(fits, F.lit(False))


def order_state(shown: Column, asked: str, orders: dict[str, tuple[str, ...]]) -> Column:
    """{order, verified, reason} of a snapshot: the label found, whether it is the order asked for, and else why not."""
    label = order_label(shown)
    if asked not in orders:
        return F.struct(F.lit(None).cast("string").alias("order"), F.lit(False).alias("verified"), F.lit("unknown_order").alias("reason"))
    fits = shows_order(label, asked, orders)
    reason = F.when(label.isNull(), "control_not_found").when(~fits, "not_verified")
    return F.struct(label.alias("order"), fits.alias("verified"), reason.alias("reason"))


def marked_unsorted(warnings: Column, verified: Column) -> Column:
    """The warnings, and one more where the order of the comments could not be verified."""
    return F.when(verified, F.coalesce(warnings, F.array().cast("array<string>"))).otherwise(F.array_union(F.coalesce(warnings, F.array().cast("array<string>")), F.array(F.lit(UNSORTED))))


def in_document_order(units: DataFrame, page: str, position: str) -> DataFrame:
    """Adds `place`: from 1 within a page, by where a unit starts. Units of one start, which a page does not have, share it."""
    return units.withColumn("place", F.rank().over(Window.partitionBy(page).orderBy(position)))


def newest_first(rows: DataFrame, thread: str, at: str, key: str, most: int | None = None) -> DataFrame:
    """Adds `place`: from 1 within a thread, newest first; rows without a time come last, ties go to the smaller key.

    With `most`, only the first so many of each thread; Spark drops the others before the shuffle.
    """
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(thread).orderBy(F.col(at).desc_nulls_last(), key)))
    return placed if most is None else placed.where(F.col("place") <= most)
