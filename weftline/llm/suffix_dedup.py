"""Suffix-array dedup: byte strings of a given length that start anywhere else, found in shard arrays.

1. Each text's bytes are cut into super-k-mers (consecutive windows that share a minimiser); a row of each has
   its minimiser and a hash of its bytes.
2. By minimiser: a super-k-mer that is met twice is a repeat as a whole; one that is alone, with its minimiser
   in it once, is none; nor is one that shares none of its cores, what all its windows with the minimiser in
   one range of places hold, with another. The rest travels, each different one once, to the shard of its minimiser.
3. A shard's suffix array is built by induced sorting, its common prefixes are permuted ones; windows with a
   neighbour that shares the whole length are repeats. Where many different strings share a minimiser,
   they are cut into stretches of windows in which it stands at about the same place; these go by that place
   and the bytes around it that all their windows hold. A stretch that is met twice is a repeat as a whole,
   and one copy of it travels, for windows that others share with it. A string has one row for each different
   stretch, with all places of it: a line that goes on repeating has as many minimisers as lines, but few stretches.
4. Runs of repeated windows go back to the documents by string; the bytes they cover are removed.

Edge cases: null and empty texts have no bytes; shorter texts than a window lose nothing; repeated rows repeat
each other; ids, null or repeated, play no part; very long texts are read whole; the bytes left may cut a
character and are therefore binary; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, free, keyed, materialise, sequence_hashes, with_key
from weftline.llm.suffix_array import repeats
from weftline.llm.super_kmers import content_hash, content_hashes, cores, covered, flag_runs, runs, stretches

WINDOW, GRAM = 400, 24
SHARD_BYTES = 1_000_000  # of text in one suffix array, when more than one minimiser is in it
BUCKET_STRINGS = 500  # different super-k-mers of one minimiser that go to one shard
PLACES = 4  # ranges of a minimiser's place in a window
CORES = [f"core_{k}" for k in range(PLACES)]  # what all windows of a range hold; equal windows have an equal one
BREAK = b"\xff"  # never in UTF-8


def _grams(data: bytes, window: int) -> np.ndarray:
    return sequence_hashes(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), min(GRAM, window))


def _pieces(docs: DataFrame, window: int) -> DataFrame:
    """row_key, start, windows, minimiser, string (hash), often (its minimiser stands in it more than once), hashes of its cores."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * PLACES)
        schema = pa.schema(list(zip(("row_key", "start", "windows", "minimiser", "string", "often", *CORES), kinds, strict=True)))
        gram = min(GRAM, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out, digests, often, held = [[] for _ in range(4)], [], [], [[] for _ in CORES]
                for key, data in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                    if len(data) < window:
                        continue
                    items = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
                    hashes = sequence_hashes(items, gram)
                    starts, counts, least = runs(items, window, gram, hashes)
                    for s, n, m in zip(starts.tolist(), counts.tolist(), least, strict=True):
                        e = s + n + window - 1
                        where = (hashes[s : e - gram + 1] == m).nonzero()[0]
                        digests.append(xxh3_64_intdigest(data[s:e]))
                        often.append(len(where) > 1)
                        for column, (a, b) in zip(held, cores(s + int(where[0]), window, gram, PLACES), strict=True):
                            column.append(xxh3_64_intdigest(data[a:b]) & 0x7FFFFFFF if s <= a and b <= e else None)
                    for column, values in zip(out, (np.full(len(starts), key), starts, counts, least.view(np.int64)), strict=True):
                        column.append(values)
                if digests:
                    yield arrow_rows(schema, [*map(np.concatenate, out), content_hashes(digests), often, *held])

    columns = "row_key long, start int, windows int, minimiser long, string long, often boolean"
    return docs.select("row_key", "text").mapInArrow(cut, ", ".join([columns, *(f"{c} int" for c in CORES)]))


def _joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, count) in order, those that touch as one."""
    out = found[:1]
    for first, count in found[1:]:
        if first == sum(out[-1]):
            out[-1] = (out[-1][0], out[-1][1] + count)
        else:
            out.append((first, count))
    return out


def _shard_repeats(strings: DataFrame, window: int, parts: int) -> DataFrame:
    """bucket, part, at, windows: runs of repeated windows inside the travelling stretches (bucket, part, bytes, windows)."""

    def solve(rows: list[tuple]) -> tuple[list, list, list, list]:
        flags = repeats(BREAK.join(r[2] for r in rows) + BREAK, window)
        found, at = ([], [], [], []), 0
        for bucket, part, data, windows in rows:
            for s, n in zip(*flag_runs(flags[at : at + windows]), strict=True):
                for column, value in zip(found, (bucket, part, int(s), int(n)), strict=True):
                    column.append(value)
            at += len(data) + 1
        return found

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("at", pa.int32()), ("windows", pa.int32())])
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD_BYTES and row[0] != held[-1][0]:
                    yield arrow_rows(schema, list(solve(held)))
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield arrow_rows(schema, list(solve(held)))

    dealt = strings.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "part", "bytes", "windows").mapInArrow(sort, "bucket long, part long, at int, windows int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """row_key, start, windows of `docs` (row_key, text as binary): windows that also start anywhere else."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialise(_pieces(docs, window), "pieces")
    strings = materialise(
        pieces.groupBy("minimiser", "string").agg(F.count("*").alias("times"), F.min("row_key").alias("row_key"), F.first("often").alias("often"), *(F.first(c).alias(c) for c in CORES)), "strings"
    )
    groups = strings.groupBy("minimiser").agg(F.sum("times").alias("met"), F.count("*").alias("different"), F.max("often").alias("any_often"))
    known = materialise(strings.join(groups.where("met > 1 or any_often"), "minimiser"), "groups")
    free(strings)
    twice = known.where("times > 1").select("minimiser", "string")
    # A window that two of these strings hold has its minimiser at one place in both, so that they share a core.
    single = known.where("different > 1 and not any_often").drop("any_often", "often")
    places = single.select("minimiser", "string", F.posexplode(F.array(*CORES)).alias("place", "core")).where("core is not null")
    shared = places.groupBy("minimiser", "place", "core").agg(F.min("string").alias("least"), F.max("string").alias("most")).where("least < most")
    sharing = places.join(shared, ["minimiser", "place", "core"], "left_semi").select("minimiser", "string").distinct()
    chosen = ["minimiser", "string", "row_key", "times", "different"]
    travels = known.where("any_often and (different > 1 or times = 1 and often)").select(chosen)
    travels = materialise(travels.unionByName(single.select(chosen).join(sharing, ["minimiser", "string"], "left_semi").select(chosen)), "travels")

    carriers = pieces.join(travels.select("row_key", "minimiser", "string", "different"), ["row_key", "minimiser", "string"])
    lists = carriers.groupBy("row_key").agg(F.collect_set(F.struct("start", "windows", "minimiser", "string", "different")).alias("wanted"))
    sources = docs.dropDuplicates(["row_key"]).join(lists, "row_key").select("text", "wanted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = pa.list_(pa.struct([("at", pa.int32()), ("windows", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), places)
        schema = pa.schema(list(zip(("bucket", "minimiser", "string", "bytes", "windows", "times", "places"), kinds, strict=True)))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for data, asked in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    for w in {(w["minimiser"], w["string"]): w for w in asked}.values():
                        packed = data[w["start"] : w["start"] + w["windows"] + window - 1]
                        if w["different"] <= bucket_strings:
                            rows.append((w["minimiser"], w["minimiser"], w["string"], packed, w["windows"], 1, [(0, w["windows"])]))
                            continue
                        minimiser, alike = np.int64(w["minimiser"]).view(np.uint64), {}
                        for k, n, reach, core in stretches(_grams(packed, window), minimiser, w["windows"], window):
                            bucket = content_hash(b"%d %d " % (w["minimiser"], reach) + packed[core])
                            alike.setdefault((bucket, packed[k : k + n + window - 1]), []).append((k, n))
                        for (bucket, stretch), found in alike.items():
                            rows.append((bucket, w["minimiser"], w["string"], stretch, found[0][1], len(found), _joined(found)))
                if rows:
                    yield arrow_rows(schema, list(zip(*rows, strict=True)))

    kind = "bucket long, minimiser long, string long, bytes binary, windows int, times int, places array<struct<at: int, windows: int>>"
    packed = sources.mapInArrow(pack, kind)
    packed = materialise(packed.withColumn("part", F.xxhash64("bytes")), "packed")
    met = materialise(packed.groupBy("bucket", "part").agg(F.sum("times").alias("met")), "met")
    shards = packed.select("bucket", "part", "bytes", "windows").dropDuplicates(["bucket", "part"])
    inside = materialise(_shard_repeats(shards, window, parts), "inside")
    named = packed.select("bucket", "part", "minimiser", "string", "places").join(met, ["bucket", "part"])
    again = named.where("met > 1").select("minimiser", "string", F.inline("places"))
    flagged = named.where("met = 1").join(inside, ["bucket", "part"])
    flagged = flagged.select("minimiser", "string", (F.col("places")[0]["at"] + F.col("at")).cast("int").alias("at"), "windows")
    repeated = materialise(again.unionByName(flagged), "repeated")
    free(packed, met, inside)
    whole = pieces.join(twice, ["minimiser", "string"]).select("row_key", "start", "windows")
    once = pieces.join(travels.where("times = 1").select("minimiser", "string"), ["minimiser", "string"]).select("row_key", "start", "minimiser", "string")
    partly = once.join(repeated, ["minimiser", "string"]).select("row_key", (F.col("start") + F.col("at")).cast("int").alias("start"), repeated["windows"])
    out = materialise(whole.unionByName(partly), "windows")
    free(pieces, known, travels, repeated)
    return out


def remove_byte_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bucket_strings: int = BUCKET_STRINGS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, bytes) of what is removed, kept (binary)."""
    source = with_key(keyed(docs, id_col, text_col)).withColumn("text", F.col("text").cast("binary"))
    spans = repeated_windows(source, window, bucket_strings).groupBy("row_key").agg(F.collect_set(F.struct("start", "windows")).alias("found"))
    # Sorted and merged at every size, so that a small table tells how a large one goes.
    joined = source.join(spans.hint("merge"), "row_key", "left").select("doc_id", "text", "found")
    span = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for doc_id, data, found in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    gone, kept = [], data
                    if found:
                        flags = covered(np.array([x["start"] for x in found]), np.array([x["windows"] for x in found]), window, len(data))
                        gone = [{"start": int(s), "bytes": int(n)} for s, n in zip(*flag_runs(flags), strict=True)]
                        kept = b"".join(data[s : s + n] for s, n in zip(*flag_runs(~flags), strict=True))
                    rows.append((doc_id, len(data), len(data) - len(kept), gone, kept))
                yield arrow_rows(schema, list(zip(*rows, strict=True)))

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, bytes: long>>, kept binary")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_byte_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
