"""Plain in-memory versions of the operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return (text or "").encode().split()


def remainder(doc_id, n):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def base_scores(rows):
    """rows: (doc_id, text). (doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each."""
    tokens = [words(lower(t or "")) + [None] for _, t in rows]
    counts = Counter()
    for (doc_id, _), own in zip(rows, tokens, strict=True):
        if doc_id is not None and remainder(doc_id, 7) != 2:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    out = []
    for (doc_id, _), own in zip(rows, tokens, strict=True):
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        out.append((doc_id, remainder(doc_id, 7) == 2, len(own), sum(counts[w] > 0 for w in own), n, score))
    return out


def shingle_set(text, k):
    own = words(lower(text or ""))
    if not own:
        return frozenset()
    if len(own) < k:
        return frozenset([tuple(own)])
    return frozenset(tuple(own[i : i + k]) for i in range(len(own) - k + 1))


def jaccard_components(rows, k=4, percent=85):
    """{row number: (n_shingles, least id)} over all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    posting = defaultdict(set)
    for i, s in enumerate(sets):
        near = Counter(j for x in s for j in posting[x])
        for j, shared in near.items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
        for x in s:
            posting[x].add(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)]


def kept_words(rows, window=50):
    first = {}
    for doc_id, text in rows:
        own = words(text)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        out.append((doc_id, len(own), len(own) - len(kept), b" ".join(kept)))
    return out


def kept_bytes(rows, window=400):
    counts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        counts.update(data[i : i + window] for i in range(len(data) - window + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if counts[data[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), len(data) - len(kept), spans, kept))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()
