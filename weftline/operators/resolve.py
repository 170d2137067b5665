"""Joins that resolve identities; what is ambiguous is no match."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import folded_skeleton, skeleton
from weftline.sources.html import spread


def heads_of(stories: DataFrame, id_col: str, text_col: str, least: int = 20, size: int = 40) -> DataFrame:
    """head, id: the first `size` letters of each story's skeleton; heads of several ids are left out."""
    bare = stories.select(F.col(id_col).alias("id"), skeleton(F.col(text_col)).alias("bare")).where(F.length("bare") >= least)
    one = bare.groupBy(F.left("bare", F.lit(size)).alias("head")).agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return one.where("id = other").drop("other")


GRAM, LEAST_HEAD = 8, 20  # letters; a head's first LEAST_HEAD letters name it


def _minimisers(text: str) -> np.ndarray:
    """The distinct least hashes of GRAM letters over all stretches of LEAST_HEAD letters; none if the text is shorter."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(letters) < LEAST_HEAD:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(letters) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + letters[k : k + len(hashes)]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
    least, width = hashes, 1
    while width < LEAST_HEAD - GRAM + 1:
        step = min(width, LEAST_HEAD - GRAM + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return np.unique(least).view(np.int64)


def _by_minimiser(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, minimiser: each of a text once."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_minimisers(x) for x in batch.column(1).to_pylist()]
            if sum(map(len, found)):
                where = np.repeat(np.arange(len(found)), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array(np.concatenate(found))], names=[key, "minimiser"])

    return rows.where(F.length(text) >= LEAST_HEAD).select(key, text).mapInArrow(run, f"{key} {kind}, minimiser long")


CROWDED = 16  # needles with one minimiser, from which on more of their letters is compared


HELD_LETTERS = 500_000  # of texts that are hashed together, if more than one


def _stretch_hashes(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each stretch of `length` letters that lies in one of the texts; each once a text."""
    sizes = np.array([len(x) for x in texts])
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(letters) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(letters) - length + 1, np.uint64)
        for k in range(length):
            hashes = hashes * np.uint64(0x9FB21C651E98DF25) + letters[k : k + len(hashes)]
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
    home = np.repeat(np.arange(len(texts)), sizes)
    inside = home[: len(hashes)] == home[length - 1 :]
    found = np.unique(np.stack([home[: len(hashes)][inside], hashes.view(np.int64)[inside]]), axis=1)
    return found[0], found[1]


def _by_stretch(rows: DataFrame, key: str, text: str, lengths: list[int]) -> DataFrame:
    """key, size, stretch: the hash of each stretch of a text that has one of the lengths, once."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.cumsum([len(x) for x in texts])
            groups = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // HELD_LETTERS)) + 1)
            for rows_of in groups:
                for length in lengths if len(rows_of) else ():
                    home, found = _stretch_hashes([texts[i] for i in rows_of], length)
                    names = batch.column(0).take(pa.array(rows_of[home]))
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(found), length, np.int32)), pa.array(found)], names=[key, "size", "stretch"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, size int, stretch long")


def _contained(bare: DataFrame, needles: DataFrame) -> DataFrame:
    """unit and the columns of needles (needle, ...): each needle of LEAST_HEAD letters or more that stands in a unit's bare text."""
    pairs = bare.join(_met(bare, needles).hint("merge"), "unit").where(F.contains("bare", "needle")).drop("bare")
    return pairs.join(needles.hint("merge"), "needle")


def _met(bare: DataFrame, needles: DataFrame) -> DataFrame:
    """unit, needle: all pairs of which the one may stand in the other, to be verified.

    No search of all pairs: where a needle stands, its first letters are a stretch of the unit, and both have the same
    minimiser. A unit sends its minimisers only, about one for seven letters. Where more than CROWDED needles have one minimiser, which
    then tells little, units that have it too send the hashes of all stretches as long as those needles.
    Needles and units may be as many as the input has rows: a side that seems small where it is packed is not broadcast through the driver.
    """
    named = needles.withColumn("start", F.left("needle", F.lit(LEAST_HEAD)))
    keys = _by_minimiser(named.select("start").distinct(), "start", "start")
    known = named.select("start", "needle").distinct().join(keys.hint("merge"), "start")
    full = known.groupBy("minimiser").agg((F.count("*") > CROWDED).alias("crowded"))
    known = known.join(full.hint("merge"), "minimiser")
    own = _by_minimiser(bare, "unit", "bare")
    met = own.join(known.where("not crowded").drop("crowded", "start").hint("merge"), "minimiser").select("unit", "needle")
    # A start has one minimiser: needles are crowded or not, as a whole.
    many = known.where("crowded").select("needle").distinct()
    lengths = sorted(r[0] for r in many.select(F.length("needle")).distinct().collect())  # at most as many as a head has letters
    if lengths:
        asked = bare.join(own.join(full.where("crowded").hint("merge"), "minimiser").select("unit").distinct().hint("merge"), "unit", "left_semi")
        whole = _by_stretch(many, "needle", "needle", lengths).where(F.col("size") == F.length("needle"))
        met = met.union(_by_stretch(asked, "unit", "bare", lengths).join(whole.hint("merge"), ["size", "stretch"]).select("unit", "needle"))
    return met.distinct()


def contained_heads(units: DataFrame, id_col: str, text_col: str, heads: DataFrame, size: int = 40) -> DataFrame:
    """unit, id: the one story whose head stands somewhere in the unit's skeleton. Units that contain heads of several have no match.

    Null texts have no match; heads are 20 letters long or longer, as `heads_of` makes them, and count up to `size` letters.
    """
    bare = units.select(F.col(id_col).alias("unit"), skeleton(F.col(text_col)).alias("bare"))
    found = _contained(bare, heads.select(F.left("head", F.lit(size)).alias("needle"), "id")).groupBy("unit").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return found.where("id = other").drop("other")


SOURCES = ("text", "text", "reshare", "reshare", "author")  # by strength


def matched_stories(units: DataFrame, id_col: str, text_col: str, author_col: str, stories: DataFrame, size: int = 40) -> DataFrame:
    """unit, id, source: the story of a payload that a unit shows. stories: as `story_rows` has them.

    First the heads of stories' own texts that the unit's letters contain, then their tails, then heads and tails of what stories share;
    the first of these kinds that matches decides, and if it names several stories there is none. A unit that no text matches goes
    to the one story without text that its author has. Of equal heads the first story keeps it. Texts count from 20 letters on.
    """
    whole = stories.where("kind <> 'author'").select("kind", "story", "ord", folded_skeleton(F.col("text")).alias("bare")).where(F.length("bare") >= LEAST_HEAD)
    first = whole.groupBy("kind", F.left("bare", F.lit(size)).alias("head")).agg(F.min_by(F.struct("story", F.right("bare", F.lit(size)).alias("tail")), "ord").alias("x"))
    rank = F.when(F.col("kind") == "own", 0).otherwise(2)
    ends = F.explode(F.array(F.struct(rank.alias("rank"), F.col("head").alias("needle")), F.struct((rank + 1).alias("rank"), F.col("x.tail").alias("needle"))))
    needles = first.select(F.col("x.story").alias("id"), ends.alias("y")).select("id", "y.rank", "y.needle").groupBy("rank", "needle").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    bare = spread(units.select(F.col(id_col).alias("unit"), F.col(text_col).alias("said"))).select("unit", folded_skeleton(F.col("said")).alias("bare"))
    by_text = _contained(bare, needles).groupBy("unit", "rank").agg(F.min("id").alias("id"), F.max("other").alias("other"))
    written = unique_by(stories.where("kind = 'author'"), "author", "story").select(F.col("author").alias("of"), F.col("story").alias("id"))
    asked = units.select(F.col(id_col).alias("unit"), F.col(author_col).cast("string").alias("of")).where("of is not null")
    by_author = asked.join(written.hint("merge"), "of").select("unit", F.lit(4).alias("rank"), "id", F.col("id").alias("other"))
    best = by_text.unionByName(by_author).groupBy("unit").agg(F.min_by(F.struct("id", "other"), "rank").alias("x"), F.min("rank").alias("rank"))
    return best.where("x.id = x.other").select("unit", "x.id", F.get(F.array(*map(F.lit, SOURCES)), "rank").alias("source"))


def unique_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: of keys that have exactly one distinct value."""
    known = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("other")).where(F.col(value) == F.col("other")).drop("other")


def priority_lookup(left: DataFrame, id_col: str, keys: Sequence[Column], right: DataFrame, right_key: str, right_value: str) -> DataFrame:
    """id, value: the match by the first of the keys that has one; of several the least value."""
    pairs = F.posexplode(F.array(*[k.cast("string") for k in keys]))
    exploded = left.select(F.col(id_col), pairs.alias("priority", "key")).where("key is not null")
    single = right.groupBy(F.col(right_key).cast("string").alias("key")).agg(F.min(right_value).alias("value"))
    met = exploded.join(single, "key")
    return met.groupBy(id_col).agg(F.min_by("value", "priority").alias("value"), F.min("priority").alias("priority"))


def claimed_once(rows: DataFrame, claim: str, seq: str) -> DataFrame:
    """The earliest row of each claimed id; later claimants are refused. An aggregate, no window over a hot id."""
    return rows.groupBy(claim).agg(F.min_by(F.struct(*rows.columns), seq).alias("row")).select("row.*")


def outermost(ranges: DataFrame, page: str, start: str, end: str) -> DataFrame:
    """Ranges that no other range of the page, begun before, contains: one window, no self-join."""
    earlier = Window.partitionBy(page).orderBy(start).rangeBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("reach", F.max(end).over(earlier)).where(F.col("reach").isNull() | (F.col("reach") < F.col(end))).drop("reach")


def innermost(ranges: DataFrame, page: str, start: str, end: str) -> DataFrame:
    """Ranges that contain no other range of the page, begun later."""
    later = Window.partitionBy(page).orderBy(start).rangeBetween(1, Window.unboundedFollowing)
    return ranges.withColumn("least", F.min(end).over(later)).where(F.col("least").isNull() | (F.col("least") > F.col(end))).drop("least")
