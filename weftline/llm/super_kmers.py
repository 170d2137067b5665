"""Super-k-mers: runs of consecutive windows that share a minimiser, as rows.

A window's minimiser is the least hash of the short grams inside it. Equal windows have equal minimisers, so
that a window can only occur again in a run with the same minimiser.
"""

from __future__ import annotations

import numpy as np

from weftline.llm.common import mix64, sequence_hashes


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def runs(items: np.ndarray, window: int, gram: int, grams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer of a sequence of item hashes; grams: their hashes, if known."""
    n = len(items) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    least = window_minima(sequence_hashes(items, gram) if grams is None else grams, window - gram + 1)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return starts, np.diff(np.r_[starts, n]), least[starts]


def stretches(grams: np.ndarray, minimiser: np.uint64, windows: int, window: int) -> list[tuple[int, int, int, slice]]:
    """(first window, windows, range of places, core) of a super-k-mer, cut where a window's first minimiser changes its range of places.

    All windows with that place range hold the core, items at the same distance from the minimiser, so that
    equal windows lie in stretches of equal range and core. A core is an eighth shorter than a window.
    """
    width = max(1, window // 8)
    where = np.flatnonzero(grams == minimiser)
    each = np.arange(windows)
    instance = np.searchsorted(where, each)
    reach = (where[instance] - each) // width
    cut = np.flatnonzero(np.r_[True, (instance[1:] != instance[:-1]) | (reach[1:] != reach[:-1])])
    out = []
    for first, count in zip(cut.tolist(), np.diff(np.r_[cut, windows]).tolist(), strict=True):
        start = int(where[instance[first]]) - int(reach[first]) * width
        out.append((first, count, int(reach[first]), slice(start, start - width + 1 + window)))
    return out


def cores(at: int, window: int, gram: int, places: int) -> list[tuple[int, int]]:
    """(start, end) of what all windows hold that have their minimiser, which begins `at`, in each of so many ranges of places.

    Equal windows with one minimiser each hold an equal core of the same range.
    """
    width = -(-(window - gram + 1) // places)
    return [(at - k * width, at - (k + 1) * width + 1 + window) for k in range(places)]


def covered(starts: np.ndarray, counts: np.ndarray, window: int, size: int) -> np.ndarray:
    """Which of `size` items some flagged window covers; flagged: `counts` windows from `starts` on."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def content_hashes(digests: list[int]) -> np.ndarray:
    """The `content_hash` of strings, of each of which the digest xxh3_64_intdigest is given."""
    return mix64(np.array(digests, np.uint64), 5).view(np.int64)


def content_hash(data: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return int(content_hashes([xxh3_64_intdigest(data)])[0])
