"""Byte-level BPE: merges as a lazily determinised transducer; decoding through an incremental UTF-8 machine.

The transducer reads a pre-token byte by byte. A state is the last token it has settled and the bytes read
since. Of each prefix of those bytes the last token of its encoding is unique: the suffix that is a token and
stands the merges next to the token before it. Positions where a longer token may still begin stay open;
tokens on which all open positions agree are emitted. Transitions are built when first taken and then kept.
The short pre-tokens that a batch of texts brings anew go through it in lockstep, byte by byte: what a transition
works out, the last token of one more prefix, is worked out for all of them at once.

Edge cases: a null text is empty and has no tokens; very long texts are encoded whole; equal texts have equal
ids; an empty table gives an empty table; extra columns are ignored. Ids that decode to broken UTF-8 give
U+FFFD for each maximal broken part.
"""

from __future__ import annotations

import base64
import gc
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, keyed

LOCKSTEP_BYTES = 64  # longer pre-tokens go through the transducer one by one
STATES = 100_000  # kept transducer states and pairs of tokens; more empty the store, results stay the same
PIECES, UNITS = 400_000, 500_000  # remembered pre-tokens, and stretches between spaces; likewise


_BYTES = [bytes([i]) for i in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State:
    __slots__ = ("before", "ends", "moves", "pending", "seams")

    def __init__(self, before: bytes | None, pending: bytes, ends: tuple[bytes, ...], seams: tuple[int, ...]):
        #: The settled token before; the bytes since; of each prefix of these its last token, and its token ends as bits.
        self.before, self.pending, self.ends, self.seams = before, pending, ends, seams
        self.moves: dict[int, tuple[State, tuple[int, ...]]] = {}


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.never = len(ranks) + max(ranks.values()) + 1
        self.longest = max(map(len, ranks))
        self.starts = {t[:k] for t in ranks for k in range(1, len(t))}
        self.parts: dict[bytes, tuple[bytes, ...]] = {}
        self.lefts: dict[bytes, list[tuple[bytes, int]]] = {}
        self.rights: dict[bytes, list[tuple[bytes, int]]] = {}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        for state in getattr(self, "states", {}).values():  # states may lead back to each other
            state.moves.clear()
        self.states: dict[tuple[bytes | None, bytes], State] = {}
        self.start = self._state(None, b"", (), ())

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """The definition: join the leftmost adjacent pair of the lowest rank, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, self.never), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == self.never:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, token: bytes) -> tuple[bytes, ...]:
        """The two parts of a token's last merge, a byte itself, or nothing if the merges don't make it."""
        if (found := self.parts.get(token)) is None:
            found = tuple(self.merge(token, 2))
            if len(found) > 2 or len(found) == 2 and max(map(self.ranks.__getitem__, found)) >= self.ranks[token]:
                found = ()
            self.parts[token] = found
        return found

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at one edge of a token while it is merged, each with the rank at which it is joined on."""
        store = self.rights if side else self.lefts
        if (found := store.get(token)) is None:
            found, at, until = [], token, self.never
            while True:
                found.append((at, until))
                if len(at) == 1:
                    break
                at, until = self._parts(at)[-side], self.ranks[at]
            store[token] = found
        return found

    def _stands(self, before: bytes | None, token: bytes) -> bool:
        """Whether the merges make this token, and keep both apart, when it follows `before`.

        Parts that meet at the seam join if that merge ranks below those that join either onto its own side;
        at one rank the left one goes first. Going back in time, the part that was made last is taken apart first.
        """
        if not self._parts(token):
            return False
        if before is None:
            return True
        if (apart := self.beside.get((before, token))) is None:
            if len(self.beside) >= STATES:
                self.beside.clear()
            get, apart = self.ranks.get, True
            lefts, rights = self._edge(before, 1), self._edge(token, 0)
            i, j, most_left, most_right = 0, 0, len(lefts) - 1, len(rights) - 1
            while True:
                left, left_until = lefts[i]
                right, right_until = rights[j]
                rank = get(left + right)
                if rank is not None and rank < left_until and rank <= right_until:
                    apart = False
                    break
                if i < most_left and (j == most_right or lefts[i + 1][1] > rights[j + 1][1]):
                    i += 1
                elif j < most_right:
                    j += 1
                else:
                    break
            self.beside[before, token] = apart
        return apart

    def _state(self, before: bytes | None, pending: bytes, ends: tuple[bytes, ...], seams: tuple[int, ...]) -> State:
        if (found := self.states.get((before, pending))) is None:
            found = self.states[before, pending] = State(before, pending, ends, seams)
        return found

    def _tokens(self, ends: tuple[bytes, ...], at: int) -> list[int]:
        path = []
        while at:
            path.append(self.ranks[ends[at - 1]])
            at -= len(ends[at - 1])
        return path[::-1]

    def _move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        data = state.pending + _BYTES[byte]
        size, before = len(data), state.before
        ends, seams = state.ends, state.seams
        ranks, starts = self.ranks, self.starts
        agreed, found = -1, False
        for at in range(max(0, size - self.longest), size):
            token = data[at:]
            if not found and token in ranks and self._stands(ends[at - 1] if at else before, token):
                found = True
                ends += (token,)
                seams += ((seams[at - 1] if at else 1) | 1 << size,)
                agreed &= seams[-1]
            if token in starts:
                agreed &= seams[at - 1] if at else 1
        if cut := agreed.bit_length() - 1:
            emitted = tuple(self._tokens(ends, cut))
            target = self._state(ends[cut - 1], data[cut:], ends[cut:], tuple([x >> cut for x in seams[cut:]]))
        else:
            emitted, target = (), self._state(before, data, ends, seams)
        move = state.moves[byte] = target, emitted
        return move

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) >= STATES:
            self.reset()
        state, out = self.start, []
        for byte in piece:
            state, emitted = state.moves.get(byte) or self._move(state, byte)
            if emitted:
                out += emitted
        return out + self._tokens(state.ends, len(state.ends))


class Lockstep:
    """The transducer run on many pre-tokens at once, on numpy arrays; tokens are numbered by rank here.

    Of each prefix of each pre-token it finds the last token, prefixes of one length together: the longest token
    that ends there and stands next to the last token of what is before it.
    """

    def __init__(self, transducer: MergeTransducer):
        tokens = sorted(transducer.ranks, key=transducer.ranks.__getitem__)
        number = {t: i for i, t in enumerate(tokens)}
        self.ids = np.array([transducer.ranks[t] for t in tokens], np.uint32)
        self.sizes = np.array(list(map(len, tokens)), np.int32)
        #: The two parts of each token's last merge; -1: it is a byte. Whether the merges make it.
        parts = [transducer._parts(t) for t in tokens]
        self.left = np.array([number[x[0]] if len(x) == 2 else -1 for x in parts], np.int64)
        self.right = np.array([number[x[1]] if len(x) == 2 else -1 for x in parts], np.int64)
        self.made = np.array([bool(x) for x in parts])
        #: A tree of the tokens' bytes: a row for each node that goes on, 0 where there is no such byte.
        nodes = {b"": 0} | {x: i for i, x in enumerate(transducer.starts, 1)}
        self.rows = len(nodes)
        for token in tokens:
            nodes.setdefault(token, len(nodes))
        self.next = np.zeros((self.rows, 256), np.int32)
        names = list(nodes)[1:]
        self.next[[nodes[x[:-1]] for x in names], [x[-1] for x in names]] = list(map(nodes.__getitem__, names))
        self.token = np.full(len(nodes), -1, np.int32)
        self.token[[nodes[t] for t in tokens]] = np.arange(len(tokens))
        #: Pairs of tokens that are a token together, and its number, in a table with open addresses.
        joined = [(number[t[:k]] * len(tokens) + number[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
        self.shift = np.uint64(64 - max(4, len(joined).bit_length() + 1))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.zeros(len(self.keys), np.int32)
        keys, values = np.array(joined, np.int64).reshape(-1, 2).T
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) % len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of the token that both are together, or one above all."""
        keys = left * len(self.ids) + right
        slots = self._slots(keys)
        met = self.keys[slots]
        out = np.where(met == keys, self.values[slots], len(self.ids))
        open_ = np.flatnonzero((met != keys) & (met >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % len(self.keys)
            met = self.keys[slots[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out

    def _stand(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`MergeTransducer._stands` of many pairs; before: -1 at the start."""
        apart = self.made[token]
        at = np.flatnonzero(apart & (before >= 0))
        left, right = before[at], token[at]
        left_until = right_until = np.full(len(at), len(self.ids))
        while len(at):
            rank = self._joined(left, right)
            joins = (rank < left_until) & (rank <= right_until) & (rank < len(self.ids))
            apart[at[joins]] = False
            a, b = self.left[left] >= 0, self.left[right] >= 0
            go = np.flatnonzero(~joins & (a | b))
            at, left, right, left_until, right_until, a, b = (x[go] for x in (at, left, right, left_until, right_until, a, b))
            back = a & (~b | (left > right))  # the part made last is taken apart first
            left_until, right_until = np.where(back, left, left_until), np.where(back, right_until, right)
            left, right = np.where(back, self.right[left], left), np.where(back, right, self.left[right])
        return apart

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each, none empty, as unsigned 32-bit numbers of this machine's byte order."""
        pieces_at = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))  # those of some length or more come first
        data = np.frombuffer(b"".join([pieces[i] for i in pieces_at]), np.uint8)
        sizes = np.array([len(pieces[i]) for i in pieces_at], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        #: By length - 1: the token of that length that begins at each byte, or -1.
        tokens, limit, at, node = [], np.repeat(ends, sizes), np.arange(len(data)), self.next[0, data]
        while len(at):
            here = np.full(len(data), -1, np.int32)
            here[at] = self.token[node]
            tokens.append(here)
            size = len(tokens)
            on = (node < self.rows) & (at + size < limit[at])
            at, node = at[on], node[on]
            node = self.next[node, data[at + size]]
            at, node = at[node > 0], node[node > 0]
        last = np.full(len(data) + 1, -1, np.int64)  # by the end of a prefix
        for size in range(1, int(sizes[0]) + 1):
            open_ = starts[: int(np.searchsorted(-sizes, -size, "right"))] + size
            for length in range(min(size, len(tokens)), 0, -1):
                token = tokens[length - 1][open_ - length]
                some = np.flatnonzero(token >= 0)
                if not len(some):
                    continue
                token, to = token[some].astype(np.int64), open_[some]
                good = self._stand(last[to - length] if length < size else np.full(len(to), -1), token)
                last[to[good]] = token[good]
                if good.all() and len(some) == len(open_):
                    break
                stay = np.ones(len(open_), bool)
                stay[some[good]] = False
                open_ = open_[stay]
        path, which, at = [], np.arange(len(pieces)), ends
        while len(which):
            token = last[at]
            path.append((which, token))
            at = at - self.sizes[token]
            on = at > starts[which]
            which, at = which[on], at[on]
        counts = np.zeros(len(pieces), np.int64)
        for which, _ in path:
            counts[which] += 1
        stops = np.cumsum(counts)
        ids = np.empty(int(stops[-1]), np.uint32)
        for back, (which, token) in enumerate(path, 1):
            ids[stops[which] - back] = self.ids[token]
        packed, out = ids.tobytes(), [b""] * len(pieces)
        for i, a, b in zip(pieces_at, (4 * (stops - counts)).tolist(), (4 * stops).tolist(), strict=True):
            out[i] = packed[a:b]
        return out


class Utf8Decoder:
    """Decodes tokens as they come. A state is the begun bytes of a character; moves by token are kept."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}

    @staticmethod
    def _room(begun: bytes) -> tuple[int, int, int]:
        """Of begun bytes: how many the character has, and the range of its next byte."""
        lead = begun[0]
        size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        low, high = 0x80, 0xBF
        if len(begun) == 1:
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
        return size, low, high

    def advance(self, begun: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for byte in data:
            if begun:
                size, low, high = self._room(begun)
                if low <= byte <= high:
                    begun += bytes([byte])
                    if len(begun) == size:
                        out.append(begun.decode())
                        begun = b""
                    continue
                out.append("�")
                begun = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif self._room(bytes([byte]))[0]:
                begun = bytes([byte])
            else:
                out.append("�")
        return "".join(out), begun

    def decode(self, ids: Iterable[int]) -> str:
        out, begun = [], b""
        moves = self.moves.setdefault(begun, {})
        for i in ids:
            if (move := moves.get(i)) is None:
                move = moves[i] = self.advance(begun, self.tokens[i])
            out.append(move[0])
            if move[1] != begun:
                begun = move[1]
                moves = self.moves.setdefault(begun, {})
        if begun:
            out.append("�")
        return "".join(out)


class Encoder:
    """Encodes whole texts: splits them by the pattern, each match through the transducer.

    A text is first cut before each space that is followed by something other than white space; the pattern
    never matches across such a cut, so that the ids of these units can be remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.transducer = MergeTransducer(ranks)
        self.lockstep = Lockstep(self.transducer) if all(x in ranks for x in _BYTES) else None
        self.decoder = Utf8Decoder({i: t for t, i in ranks.items()})
        #: Ids as packed 32-bit numbers: small, and no objects that Python's collector walks.
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            ids = array("I", self.transducer.encode(piece.encode())).tobytes()
            if len(piece) < 64:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _all(self, text: str) -> bytes:
        return b"".join([self._piece(piece) for piece in self.find(text)])

    def _learn(self, split: list[list[str]], texts: list[str]) -> None:
        """Remembers the units and pre-tokens that these texts bring anew."""
        units, anew, whole = self.units, {}, []
        for text, (first, *rest) in zip(texts, split, strict=True):
            new = [u for u in rest if u not in units]
            if any(not u or u[0].isspace() for u in new):
                whole.append(text)
            else:
                anew.update(dict.fromkeys([u for u in new if len(u) < 64]))
                whole.append(first)
        # Each unit's first pre-token begins with its space and no other one does.
        found = self.find("".join([" " + u for u in anew]))
        pieces = dict.fromkeys(found)
        for text in whole:
            pieces.update(dict.fromkeys(self.find(text)))
        known = self.pieces
        new = [p for p in pieces if p not in known and len(p) < 64]
        if len(known) + len(new) > PIECES:
            known.clear()
            new = [p for p in pieces if len(p) < 64]
        coded, ranks, ids = list(map(str.encode, new)), self.transducer.ranks, {}
        for p, data in zip(new, coded, strict=True):
            if (rank := ranks.get(data)) is not None:
                ids[p] = rank.to_bytes(4, sys.byteorder)
        many = [(p, data) for p, data in zip(new, coded, strict=True) if p not in ids and len(data) <= LOCKSTEP_BYTES]
        if many and self.lockstep:
            ids.update(zip([p for p, _ in many], self.lockstep.encode([data for _, data in many]), strict=True))
        known.update(ids)
        if len(units) + len(anew) > UNITS:
            units.clear()
        at, joined = [i for i, p in enumerate(found) if p[0] == " "], list(map(self._piece, found))
        for unit, a, b in zip(anew, at, [*at[1:], len(found)][: len(at)], strict=True):
            units[unit] = joined[a] if b == a + 1 else b"".join(joined[a:b])

    def _packed(self, words: list[str], text: str) -> bytes:
        rest = words[1:]
        out = list(map(self.units.get, rest))
        if None in out:
            for i, unit in enumerate(rest):
                if out[i] is None:
                    if not unit or unit[0].isspace():  # a run of white space: no cut there
                        return self._all(text)
                    out[i] = self._all(" " + unit)
        return self._all(words[0]) + b"".join(out)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers of this machine's byte order."""
        split = [text.split(" ") for text in texts]
        self._learn(split, texts)
        return list(map(self._packed, split, texts))

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed([text])[0]).tolist()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One a Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


SLICE = 200  # rows taken out of a batch at a time


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of each whole text; ids are little-endian unsigned 32-bit numbers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = encoder(ranks_path, pattern), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                coded = [np.frombuffer(x, np.uint32).astype("<u4").tobytes() for x in own.packed(part.column(1).to_pylist())]
                yield arrow_rows(schema, [part.column(0), coded])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text: the ids decoded. Null ids decode to the empty text; unknown ids raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(ranks_path, pattern).decoder.decode
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = pa.array([decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "ids", "text"])

    source = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return source.mapInArrow(run, "doc_id long, ids binary, text string")


def transcode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each whole text, and text: these ids decoded again; both in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        decode = own.decoder.decode
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])
        gc.disable()  # it would walk all states again and again; `reset` leaves no cycles behind
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    coded = [np.frombuffer(x, np.int32) for x in own.packed(part.column(1).to_pylist())]
                    offsets = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *coded])))
                    texts = pa.array([decode(x.tolist()) for x in coded], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], schema=schema)
        finally:
            gc.enable()

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    at = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = transcode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *at)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
