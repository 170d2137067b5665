"""Byte-level pair merges of many words at a time, by the vocabulary and merges of a tokenizer file.

Words lie end to end with a mark between them. Each round merges in every word the pair of the least rank, the leftmost
of equals, and looks up again only the pairs beside it; words without a pair to merge leave. The ids are those the library
gives for a word by itself; what its file asks for beyond plain merges is left to the library (`fits`).
"""

from __future__ import annotations

import numpy as np

SLOT_BITS = 20


def fits(model: dict) -> bool:
    """Whether the model is plain merges: none left out at random, no prefix inside words, no bytes or whole words by other rules."""
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return model.get("type") == "BPE" and plain


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class WordMerges:
    """Needs every byte in the vocabulary, alone and at a word's end; else a KeyError says which is not."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.mark = max(vocab.values()) + 1
        self.none = len(pairs)
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        # Of a pair listed twice the first rank counts.
        self.keys, self.rank = np.unique(left * (self.mark + 1) + right, return_index=True)
        self.by, self.slots = self._slots()

    def _slots(self) -> tuple[list[np.uint64], list[np.ndarray]]:
        """Two tables from a hash of a pair to its place; what the first has no room for is in the second."""
        every = np.arange(len(self.keys))
        for turn in range(1, 1_000, 2):
            by = [np.uint64(x * turn & 0xFFFFFFFFFFFFFFFF) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            first, second = np.zeros((2, 1 << SLOT_BITS), np.int32)
            first[self._slot(self.keys, by[0])] = every
            left = np.flatnonzero(first[self._slot(self.keys, by[0])] != every)
            places = self._slot(self.keys[left], by[1])
            second[places] = left
            if (second[places] == left).all():
                return by, [first, second]
        raise ValueError("the merges do not fit two tables")

    @staticmethod
    def _slot(keys: np.ndarray, by: np.uint64) -> np.ndarray:
        return (keys.view(np.uint64) * by) >> np.uint64(64 - SLOT_BITS)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * (self.mark + 1) + right
        at = self.slots[0][self._slot(keys, self.by[0])]
        ranks = np.where(self.keys[at] == keys, self.rank[at], self.none)
        other = np.flatnonzero(ranks == self.none)
        keys = keys[other]
        at = self.slots[1][self._slot(keys, self.by[1])]
        ranks[other] = np.where(self.keys[at] == keys, self.rank[at], self.none)
        return ranks

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit values; words are not empty."""
        if not words:
            return []
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        raw = np.frombuffer(b"".join(d + b"\n" for d in data), np.uint8)
        sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
        ends = np.cumsum(sizes) - 1
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        ids[ends] = self.mark
        ranks = np.append(self._ranks(ids[:-1], ids[1:]), self.none)
        names, done = np.arange(len(data)), []
        while True:
            best = np.minimum.reduceat((ranks << 32) | np.arange(len(ranks)), np.cumsum(sizes) - sizes)
            more = (best >> 32) < self.none
            if not more.all():
                stay = np.repeat(more, sizes)
                gone = ids[~stay]
                done.append((names[~more], sizes[~more] - 1, gone[gone != self.mark]))
                if not more.any():
                    break
                best = best[more] - np.cumsum(~stay)[best[more] & 0xFFFFFFFF]
                names, sizes, ids, ranks = names[more], sizes[more], ids[stay], ranks[stay]
            at = best & 0xFFFFFFFF
            ids[at] = self.made[best >> 32]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, ranks, sizes = ids[stay], ranks[stay], sizes - 1
            at = at - np.arange(len(at))  # each word before has lost one
            ranks[at] = self._ranks(ids[at], ids[at + 1])
            before = at[at > 0] - 1
            ranks[before] = self._ranks(ids[before], ids[before + 1])
        out, start = [b""] * len(data), 0
        flat = np.concatenate([x[2] for x in done]).astype("<u4").tobytes()
        for name, end in zip(np.concatenate([x[0] for x in done]).tolist(), (4 * np.cumsum(np.concatenate([x[1] for x in done]))).tolist(), strict=True):
            out[name], start = flat[start:end], end
        return out
