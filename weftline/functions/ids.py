"""Stable ids of records: four seeded 32-bit hashes of a text's UTF-16 units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEEDS = (0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)  # fixed values
_1, _2, _3, _4 = 0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35  # the public constants of the 32-bit hash


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def unit_hashes(texts: list[str], seed: int) -> np.ndarray:
    """Murmur3 of 32 bits with one block for each UTF-16 unit and their number as length, for many texts at once."""
    data = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    units = np.frombuffer(b"".join(data), "<u2").astype(np.uint32)
    sizes = np.array(list(map(len, data)), np.int64) // 2
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    h = np.full(len(texts), seed, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(int(sizes.max(initial=0))):
            live = order[: int(np.searchsorted(-sizes[order], -at, "left"))]
            k = _turn(units[starts[live] + at] * np.uint32(_1), 15) * np.uint32(_2)
            h[live] = _turn(h[live] ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= sizes.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(_3)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(_4)
        return h ^ (h >> np.uint32(16))


def record_ids(texts: list[str], seeds: tuple[int, ...] = SEEDS) -> list[str]:
    """Four hashes as 32 hex digits in the form of a version 8 id."""
    parts = [unit_hashes(texts, s) for s in seeds]
    out = []
    for row in zip(*(p.tolist() for p in parts), strict=True):
        x = "".join(f"{v:08x}" for v in row)
        x = f"{x[:12]}8{x[13:16]}{int(x[16], 16) & 3 | 8:x}{x[17:]}"
        out.append("-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:])))
    return out


@F.pandas_udf(T.StringType())
def record_id(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """An Arrow function; null gives null."""
    for part in texts:
        there = part.notna()
        out = pd.Series([None] * len(part), index=part.index, dtype=object)
        out[there] = record_ids(part[there].tolist())
        yield out
