"""Substring dedup: windows of words that also start in an earlier document, found by super-k-mer partitioning.

1. Each text is cut into super-k-mers: consecutive windows that share a minimiser. A row of each has the
   minimiser and a hash of its words.
2. By minimiser: those of one document only are done with. Where all super-k-mers of a minimiser are equal,
   each but those of the first document is a repeat as a whole.
3. Of the others, each different super-k-mer travels once, as one packed string, to its minimiser's bucket;
   there its windows are sorted and the runs of equal windows give each window's first document. Where many
   different strings share a minimiser, they are cut into stretches of windows in which it stands at about the
   same place; these go by that place and the words around it that all their windows hold, so that a frequent
   passage spreads over tasks.
4. Runs of repeated windows go back to the documents by string; their words are removed.

Edge cases: null and empty texts have no words; documents of fewer words than a window lose nothing; a null
id counts as larger than all others, and rows of equal ids never remove each other's words; very long texts
are read whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import NULL_ID, arrow_rows, free, hash_words, materialise, sequence_hashes, text_slices, with_key, words_of
from weftline.llm.super_kmers import content_hash, covered, flag_runs, runs, stretches

WINDOW, GRAM = 50, 6
BUCKET_STRINGS = 500  # different super-k-mers of one minimiser that are sorted together


def _pieces(docs: DataFrame, window: int) -> DataFrame:
    """row_key, doc_id, start, windows, minimiser, string (hash) of each super-k-mer."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("row_key", "doc_id", "start", "windows", "minimiser", "string")
        schema = pa.schema([(n, pa.int32() if n in ("start", "windows") else pa.int64()) for n in names])
        for batch in batches:
            out = [[] for _ in names]
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = ((first + k, x) for first, words, many in text_slices(batch.column(2)) for k, x in enumerate(np.split(words, np.cumsum(many)[:-1])))
            for row, items in parts:
                key, doc_id = keys[row], ids[row]
                starts, counts, least = runs(items, window, min(GRAM, window))
                if len(starts):
                    data = items.tobytes()
                    strings = [content_hash(data[8 * s : 8 * (s + n + window - 1)]) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                    for column, values in zip(out, (np.full(len(starts), key), np.full(len(starts), doc_id), starts, counts, least.view(np.int64), np.array(strings, np.int64)), strict=True):
                        column.append(values)
            if out[0]:
                yield arrow_rows(schema, [np.concatenate(c) for c in out])

    return docs.select("row_key", "doc_id", "text").mapInArrow(cut, "row_key long, doc_id long, start int, windows int, minimiser long, string long")


def _first_documents(strings: DataFrame, window: int, parts: int) -> DataFrame:
    """string, at, windows, first: stretches of a string's windows and the first document that has them.

    strings: bucket, string, words (packed; from window `base` of the string on), first (the string's least id). Windows are sorted by hash;
    neighbours of one hash are equal only if their words are.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("string", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("first", pa.int64())])
        held, size = [], 0

        def solve(rows: list[tuple]) -> pa.RecordBatch | None:
            codes: dict[bytes, int] = {}
            words = [np.fromiter((codes.setdefault(w, len(codes)) for w in r[2].split(b" ")), np.int64, -1) for r in rows]
            joined = np.concatenate(words)
            offsets = np.cumsum([0, *map(len, words)])
            sizes = [r[5] for r in rows]
            wanted = np.concatenate([np.arange(o, o + n) for o, n in zip(offsets, sizes, strict=False)])
            owner = np.repeat(np.arange(len(rows)), sizes)
            first = np.array([r[3] for r in rows])[owner]
            group = np.repeat(np.unique([r[0] for r in rows], return_inverse=True)[1], sizes)
            hashed = sequence_hashes(joined.astype(np.uint64) + np.uint64(1), window)[wanted]
            order = np.lexsort((first, hashed, group))
            a, b = order[:-1], order[1:]
            same = (hashed[a] == hashed[b]) & (group[a] == group[b])
            for k in range(window):  # the words themselves
                at = np.flatnonzero(same)
                same[at] = joined[wanted[a[at]] + k] == joined[wanted[b[at]] + k]
            heads = np.flatnonzero(np.r_[True, ~same])
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(first[order][heads], np.diff(np.r_[heads, len(order)]))
            local = wanted - offsets[owner] + np.array([r[4] for r in rows])[owner]
            gain = least < first  # windows of others with an earlier document
            cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (local[1:] != local[:-1] + 1) | (least[1:] != least[:-1])])
            counts = np.diff(np.r_[cut, len(owner)])
            keep = gain[cut]
            if not keep.any():
                return None
            names = np.array([r[1] for r in rows])
            return arrow_rows(schema, [names[owner[cut]][keep], local[cut][keep].astype(np.int32), counts[keep].astype(np.int32), least[cut][keep]])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size > 2_000_000 and row[0] != held[-1][0]:
                    if (done := solve(held)) is not None:
                        yield done
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held and (done := solve(held)) is not None:
            yield done

    dealt = strings.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "string", "words", "first", "base", "windows").mapInArrow(sort, "string long, at int, windows int, first long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """row_key, spans (start, windows): the windows of each row of `docs` that also start in a document of a smaller id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialise(_pieces(docs, window), "pieces")
    seen = pieces.groupBy("minimiser", "string").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("row_key", "doc_id").alias("owner"))
    strings = materialise(seen, "strings")
    groups = strings.groupBy("minimiser").agg(F.min("first").alias("least"), F.max("last").alias("most"), F.count("*").alias("different")).where("least < most")
    met = materialise(strings.join(groups, "minimiser"), "groups")
    free(strings)
    alike = met.where("different = 1").select("minimiser", "string", "first")
    mixed = met.where("different > 1")

    # One document of each string that must travel; it sends the words.
    wanted = mixed.select(F.col("owner").alias("row_key"), "minimiser", "string", "first", "different")
    carriers = pieces.join(wanted, ["row_key", "minimiser", "string"])
    lists = carriers.groupBy("row_key").agg(F.collect_list(F.struct("start", "windows", "minimiser", "string", "first", "different")).alias("wanted"))
    sources = docs.join(lists, "row_key").select("text", "wanted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("string", pa.int64()), ("words", pa.binary()), ("first", pa.int64()), ("base", pa.int32()), ("windows", pa.int32())])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for text, asked in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    words = words_of(text)
                    for w in {(w["minimiser"], w["string"]): w for w in asked}.values():
                        packed = words[w["start"] : w["start"] + w["windows"] + window - 1]
                        if w["different"] <= bucket_strings:
                            rows.append((w["minimiser"], w["string"], b" ".join(packed), w["first"], 0, w["windows"]))
                            continue
                        grams = sequence_hashes(hash_words(packed), min(GRAM, window))
                        minimiser = np.int64(w["minimiser"]).view(np.uint64)
                        for k, n, reach, core in stretches(grams, minimiser, w["windows"], window):
                            bucket = content_hash(b"%d %d " % (w["minimiser"], reach) + b" ".join(packed[core]))
                            rows.append((bucket, w["string"], b" ".join(packed[k : k + n + window - 1]), w["first"], k, n))
                if rows:
                    yield arrow_rows(schema, list(zip(*rows, strict=True)))

    packed = sources.mapInArrow(pack, "bucket long, string long, words binary, first long, base int, windows int")
    # Equal stretches of different strings are sorted once, as of their first document.
    packed = materialise(packed.withColumn("part", F.xxhash64("words")), "packed")
    parts_once = packed.groupBy("bucket", "part").agg(F.min("first").alias("least"), F.first("words").alias("words"), F.first("windows").alias("windows"))
    parts_once = materialise(parts_once, "parts")
    known = packed.drop("words").join(parts_once.select("bucket", "part", "least"), ["bucket", "part"])
    repeated = known.where("least < first").select("string", F.col("base").alias("at"), "windows", F.col("least").alias("first"))
    stretch = F.xxhash64("bucket", "part")
    sorted_parts = parts_once.select("bucket", stretch.alias("string"), "words", F.col("least").alias("first"), F.lit(0).alias("base"), "windows")
    inside = _first_documents(sorted_parts, window, parts).withColumnRenamed("string", "stretch")
    firsts_of = known.where("least = first").select("string", "base", stretch.alias("stretch")).join(inside, "stretch")
    firsts_of = firsts_of.select("string", (F.col("base") + F.col("at")).cast("int").alias("at"), "windows", "first")
    firsts = materialise(repeated.unionByName(firsts_of), "firsts")
    free(packed, parts_once)

    span = F.array(F.struct("start", "windows")).alias("spans")
    whole = pieces.join(alike, ["minimiser", "string"]).where("doc_id > first").select("row_key", span)
    own = pieces.join(mixed.select("minimiser", "string", "first"), ["minimiser", "string"])
    later = own.where("doc_id > first").select("row_key", span)
    # A string's stretches, no more than it has windows, are gathered before they meet its documents.
    gathered = firsts.groupBy("string").agg(F.collect_list(F.struct("at", "windows", F.col("first").alias("least"))).alias("found"))
    inner = own.where("doc_id = first").select("row_key", "start", "string", "doc_id").join(gathered, "string")
    earlier = F.filter("found", lambda x: x["least"] < F.col("doc_id"))
    moved = F.transform(earlier, lambda x: F.struct((F.col("start") + x["at"]).cast("int").alias("start"), x["windows"].alias("windows")))
    parts_of = inner.select("row_key", moved.alias("spans")).where(F.size("spans") > 0)
    out = materialise(whole.unionByName(later).unionByName(parts_of), "spans")
    free(pieces, met, firsts)
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bucket_strings: int = BUCKET_STRINGS,
    carry: str | None = None,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left, joined by one space; and the column `carry`, if named."""
    more = [F.col(carry)] if carry else []
    own = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(id_col).cast("long").isNotNull().alias("id_known"), *more,
    )
    source = with_key(own)
    spans = repeated_spans(source, window, bucket_strings).groupBy("row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # Sorted and merged at every size, so that a small table tells how a large one goes.
    joined = source.join(spans.hint("merge"), "row_key", "left").select("doc_id", "text", "spans", "id_known", *more)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows, part = [], batch.slice(at, 500)
                for doc_id, text, found, known in zip(*(c.to_pylist() for c in part.columns[:4]), strict=True):
                    words = words_of(text)
                    n = len(words)
                    if found:
                        starts = np.array([x["start"] for x in found])
                        gone = covered(starts, np.array([x["windows"] for x in found]), window, n)
                        words = [words[i] for s, k in zip(*flag_runs(~gone), strict=True) for i in range(s, s + k)]
                    rows.append((doc_id if known else None, n, n - len(words), b" ".join(words).decode()))
                said = arrow_rows(schema, list(zip(*rows, strict=True)))
                yield pa.RecordBatch.from_arrays([*said.columns, *part.columns[4:]], names=[*schema.names, *([carry] if carry else [])])

    kind = "doc_id long, n_words long, n_removed long, kept string"
    if carry:
        kind += f", `{carry}` {joined.schema[carry].dataType.simpleString()}"
    return joined.mapInArrow(remove, kind)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
