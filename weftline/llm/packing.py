"""Best-fit packing of token pieces into sequences of a fixed capacity.

The pieces' lengths make a histogram of at most `capacity` bars, whatever their number. Over it a
configuration linear program is solved by multiplicative weights: lengths fall into classes, each round a
knapsack dynamic program prices the dearest configuration, and the weights of what it covers shrink. The
rounded-down solution opens that many sequences of each configuration; what is left over goes, longest
first, to the fullest sequence with room (best fit), on groups of like sequences instead of single ones. A
group's slots are ranges of ranks, so that tasks look up a piece's place by its rank among its length.

Edge cases: a null or empty text has only the end id, one piece of length 1; longer documents than the
capacity are cut, never dropped; repeated rows are packed each for itself; an empty table gives an empty
table; extra columns stay out of the way, the operator's own columns are named in `pack_pieces`.
"""

from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, keyed, materialise
from weftline.llm.word_merges import WordMerges, fits

CAPACITY, END_ID = 4096, 1
CLASSES, ROUNDS, RATE = 64, 150, 0.5
UNITS = 400_000  # remembered units a worker; more empty the store


class UnitIds(dict):
    """Token ids of what stands between spaces, as little-endian 32-bit bytes. No token crosses a space.

    A new unit is split into the tokenizer's words, whose ids are remembered as well; new words are merged many at a time
    (`word_merges`). That is done for Latin letters only, where lower case, composed letters and classes of characters
    are beyond doubt; other units go to the tokenizer whole, and so do words if its file asks for more than plain merges.
    """

    LAST = "\u024f"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        file = json.loads(self.tokenizer.to_str())
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split).findall
        #: Marks that the pattern splits off the end of a word of letters; such units need no pattern.
        plain = self.split("abcÀéÿ") == ["abcÀéÿ"]
        self.marks = {c for c in ".,;:!?" if plain and self.split(f"abc{c}") == ["abc", c]}
        self.words: dict[str, bytes] = {}
        bytewise = file["pre_tokenizer"]["pretokenizers"][-1]["type"] == "ByteLevel"
        self.merged = WordMerges(file["model"]).encode if bytewise and fits(file["model"]) else self._whole

    def _whole(self, units: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in coded]

    def learn(self, units: set[str]) -> None:
        latin, parts, other, marks, last = [], [], [], self.marks, self.LAST
        for unit in units:
            if unit in self:
                continue
            if not (unit.isascii() or max(unit) <= last) or not unit:
                other.append(unit)
                continue
            low = unit.lower()
            latin.append(unit)
            if marks and low.isalpha():
                parts.append((low,))
            elif low[-1] in marks and low[:-1].isalpha():
                parts.append((low[:-1], low[-1]))
            else:
                parts.append(self.split(low))
        if len(self.words) > UNITS:
            self.words.clear()
        words = self.words
        unknown = list({w for p in parts for w in p if w not in words})
        words.update(zip(unknown, self.merged(unknown), strict=True))
        for unit, part in zip(latin, parts, strict=True):
            self[unit] = words[part[0]] if len(part) == 1 else b"".join([words[w] for w in part])
        self.update(zip(other, self._whole(other), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > UNITS:
            self.clear()
        split = [t.split(" ") for t in texts]
        self.learn(set().union(*split))
        end = array("I", [END_ID]).tobytes()
        return [b"".join(map(self.__getitem__, units)) + end for units in split]


_units: dict[str, UnitIds] = {}


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of each whole text with its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _units.get(tokenizer_path) or _units.setdefault(tokenizer_path, UnitIds(tokenizer_path))
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(cut) // 4, cut))
                yield arrow_rows(schema, list(zip(*rows, strict=True)))

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def dearest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how many of each size the dearest configuration holds."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, room, "right"))
        best[room], took[room] = best[room - 1], -1
        if fit:
            values = best[room - sizes[:fit]] + worth[:fit]
            k = int(values.argmax())
            if values[k] > best[room]:
                best[room], took[room] = values[k], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(sizes[took[room]])
    return counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[np.ndarray, float]]:
    """Fractional configurations that cover the demand, by multiplicative weights."""
    covered, weights, found = np.zeros(len(sizes)), np.ones(len(sizes)), {}
    for _ in range(rounds):
        config = dearest(sizes, weights / demand, capacity)
        held = config > 0
        step = float((demand[held] / config[held]).min()) * rate
        key = config.tobytes()
        found[key] = (config, found.get(key, (config, 0.0))[1] + step)
        covered += config * step
        weights *= np.exp(-rate * config * step / demand)
        weights /= weights.max()
    over = np.maximum(covered / demand, 1.0)  # what is covered more than once is scaled back
    return [(config, amount / float(over[config > 0].max())) for config, amount in found.values()]


def classes_of(lengths: np.ndarray, counts: np.ndarray, parts: int) -> list[np.ndarray]:
    """Index ranges of neighbouring lengths of about equal token mass; each class counts as its longest."""
    mass = np.cumsum(lengths * counts) / float((lengths * counts).sum())
    return [c for c in np.split(np.arange(len(lengths)), np.searchsorted(mass, np.arange(1, parts) / parts)) if len(c)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, lengths in each) for every length of the histogram, each piece exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is longer than the capacity, or empty")
    groups: list[tuple[int, tuple[int, ...]]] = []
    if capacity in left:
        groups.append((left.pop(capacity), (capacity,)))
    opened: list[tuple[int, int, tuple[int, ...]]] = []  # (room, how many, lengths), in order of room
    if left:
        lengths = np.array(sorted(left))
        counts = np.array([left[int(n)] for n in lengths])
        classes = classes_of(lengths, counts, CLASSES)
        sizes, demand = lengths[[c[-1] for c in classes]], np.array([counts[c].sum() for c in classes], np.float64)
        pools = [[[int(lengths[i]), int(counts[i])] for i in c] for c in classes]  # longest last
        for config, amount in solve(sizes, demand, capacity):
            slots = [k for k in np.repeat(np.arange(len(sizes)), config)]
            wanted = int(amount)
            while wanted and all(pools[k] for k in slots):
                lens = {}
                for k in slots:  # each slot of a class takes that class's longest
                    lens[k] = lens.get(k, 0) + 1
                times = min([wanted, *(pools[k][-1][1] // n for k, n in lens.items())])
                if not times:  # too few of some longest: those go to the rest
                    for k, n in lens.items():
                        if pools[k][-1][1] < n:
                            size, count = pools[k].pop()
                            left[size] = count
                    continue
                inside = tuple(pools[k][-1][0] for k in slots)
                for k, n in lens.items():
                    pools[k][-1][1] -= n * times
                    if not pools[k][-1][1]:
                        left[pools[k].pop()[0]] = 0
                insort(opened, (capacity - sum(inside), times, inside))
                wanted -= times
        for pool in pools:
            for size, count in pool:
                left[size] = count
    for size in sorted(left, reverse=True):
        count = left[size]
        while count:
            at = bisect_left(opened, (size,))
            if at == len(opened):  # none has room: open new ones, as many pieces in each as fit
                each = min(capacity // size, count)
                insort(opened, (capacity - each * size, count // each, (size,) * each))
                count -= count // each * each
                continue
            room, times, inside = opened.pop(at)
            each = min(room // size, max(1, count // times))
            used = min(times, count // each)
            if used < times:
                insort(opened, (room, times - used, inside))
            insort(opened, (room - each * size, used, inside + (size,) * each))
            count -= used * each
    return groups + [(times, inside) for _, times, inside in opened]


def slots(groups: list[tuple[int, tuple[int, ...]]], capacity: int) -> dict[str, np.ndarray]:
    """Ranges of ranks: from (length, first rank) on, ranks go to sequences from `sequence` on, at `offset`."""
    filled: dict[int, int] = {}
    rows, sequence = [], 0
    for times, inside in groups:
        offset = 0
        for length in inside:
            first = filled.get(length, 0)
            rows.append((length, first, sequence, offset))
            filled[length] = first + times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T, strict=True))


def pack_pieces(pieces: DataFrame, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. Reads `pieces` three times: give a written table.

    What comes to the driver is the histogram, at most `capacity` rows; what goes to the tasks is the plan,
    whose size follows the number of distinct lengths. Columns named sequence_id, offset or starting with
    `pack_` are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r[0]: r[1] for r in pieces.groupBy(F.col(length_col).cast("long")).count().collect()}
    table = slots(plan(histogram, capacity), capacity)
    blocks = max(8, sum(histogram.values()) // 100_000)
    own = [c for c in pieces.columns if not c.startswith("pack_")]
    blocked = pieces.select(
        *own,
        F.col(length_col).cast("long").alias("pack_length"),
        F.pmod(F.xxhash64(*order_cols), F.lit(blocks)).alias("pack_block"),
    )
    counts = blocked.groupBy("pack_length", "pack_block").agg(F.count("*").alias("pack_n"))
    before = Window.partitionBy("pack_length").orderBy("pack_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("pack_length", "pack_block", F.coalesce(F.sum("pack_n").over(before), F.lit(0)).alias("pack_first"))
    inside = Window.partitionBy("pack_length", "pack_block").orderBy(*order_cols)
    ranked = (
        blocked.withColumn("pack_row", F.row_number().over(inside) - 1)
        .join(firsts, ["pack_length", "pack_block"])
        .select(*own, "pack_length", (F.col("pack_first") + F.col("pack_row")).alias("pack_rank"))
    )
    scale = np.int64(1) << np.int64(48)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table["length"] * scale + table["first"]
        for batch in batches:
            length = batch.column(batch.num_columns - 2).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(keys, length * scale + rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["first"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(sequence), pa.array(table["offset"][at])], names=[*own, "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in own)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """op2's rows of a table of documents."""
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    written = materialise(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    # Repeated ids are told apart by content, so that a task run again puts each piece where it was.
    return pack_pieces(written, order_cols=("doc_id", "piece", "ids_crc32"))
