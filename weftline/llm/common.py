"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: maximal runs of bytes other than space, tab, line feed, vertical tab, form feed, carriage return.
#: bytes.split() without arguments splits on exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The id that stands for a null document id inside the operators: larger than any real id.
NULL_ID = (1 << 63) - 1


#: Spark's own setting: the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[int, str] = {}  # by number, the tables that are there
_numbers = itertools.count(1)
_own: ContextVar[list[int] | None] = ContextVar("own", default=None)  # those that the call of `settled` around has made so far


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a temporary one in a single process; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df once as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.weftline_table = next(_numbers)
    _made[out.weftline_table] = path
    if (own := _own.get()) is not None:
        own.append(out.weftline_table)
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that `materialise` wrote and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, _made.pop(table.weftline_table))


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Materialises what `make` returns and deletes what it materialised on the way, and nothing that others did meanwhile."""
    own: list[int] = []
    before = _own.set(own)
    try:
        made = make()
    finally:
        _own.reset(before)
    out = materialise(made, name)
    for number in own:
        if number in _made:
            _delete(out.sparkSession, _made.pop(number))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: str | None = None) -> DataFrame:
    """The two columns an operator reads, renamed, so that no other column can clash with its own; and a long one it carries."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *([F.col(carry).cast("long")] if carry else []),
    )


def with_key(docs: DataFrame) -> DataFrame:
    """Adds a row key of id and text: repeated ids with other texts stay apart, whole repeated rows agree."""
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit values (xor-shift-multiply rounds), so that orders by it are random but alike everywhere."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
HASHED_BYTES = 500_000  # of text that is hashed together, if more than one


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; one table a base and worker."""
    if len(kept.get(base, ())) < n:
        table = np.full(n + n // 4, base, np.uint64)
        table[0] = 1
        kept[base] = np.multiply.accumulate(table)
    return kept[base][:n]


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts laid end to end, and how many each text has; A-Z lower-cased if asked for.

    A word's hash is a difference of prefix sums of its bytes times powers of a base, moved to one place.
    """
    joined = b" ".join([b"", *texts, b""])
    if lower:
        joined = joined.translate(_LOWER)
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1  # the first and last byte are spaces
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)))
        hashes = (sums[ends - 1] - sums[starts - 1]) * _powers(_INVERSE, len(raw))[starts]
        hashes = mix64(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
    bounds = np.cumsum([1, *(len(x) + 1 for x in texts)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def hash_words(words: list[bytes]) -> np.ndarray:
    return hashed_words(words)[0]


def text_slices(texts: pa.Array, lower: bool = False):
    """(first row, hashes of the words, words in each row) of some rows after others, about HASHED_BYTES at a time."""
    held, size, first = [], 0, 0
    for row, text in enumerate(texts):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        held.append(data)
        size += len(data)
        if size > HASHED_BYTES:
            yield first, *hashed_words(held, lower)
            held, size, first = [], 0, row + 1
    if held:
        yield first, *hashed_words(held, lower)


def sequence_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive elements, in order; empty if there are fewer."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        out, done = None, 0  # out[i]: of the first `done` elements from i on
        block, width, mult = ids, 1, base
        left = n
        while left:
            if left & 1:
                if out is None:
                    out, done = block.copy(), width
                else:
                    m = min(len(out), len(block) - done)
                    out = out[:m] * mult + block[done : done + m]
                    done += width
            left >>= 1
            if left:
                m = len(block) - width
                block = block[:m] * mult + block[width : width + m] if m > 0 else np.empty(0, np.uint64)
                width, mult = width * 2, mult * mult
        return mix64(out[: len(ids) - n + 1])


def arrow_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
