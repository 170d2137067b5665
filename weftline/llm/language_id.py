"""Language ID of words and documents by a linear-chain conditional random field.

A word's score for a label is the sum of the weights of its hashed features: the word itself (lexicon), its
affixes of up to three characters and its character n-grams of up to three. Learned transition weights link
neighbouring words; forward-backward gives each word's label probabilities, and a document's are their mean.

The model is fitted on the driver on a bounded sample of labelled rows: about `per_label` rows of each label,
of each at most `segments` stretches of `segment_words` words spread over the whole text. Stretches of
different labels are chained into training sequences, so that the transitions learn switches. Everything else
covers whole texts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; null labels are not learned from;
without labelled rows every text is ``und``; a null id is not held out; equal texts are labelled alike; ties
go to the label that sorts first; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, mix64

UNDETERMINED = "und"
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
PER_LABEL, SEGMENTS, SEGMENT_WORDS = 400, 8, 24
WORDS = 300_000  # remembered words a worker
CELLS = 500_000  # words that are solved together
LEAST_SURE, LEAST_KNOWN = 0.5, 0.5  # of a word's probability, of words


def letters(word: str) -> str:
    return "".join(filter(str.isalpha, word)).lower()


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(x, kind) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all features of words; none of words without a letter."""
    cores = [letters(w) for w in words]
    sizes = np.fromiter(map(len, cores), np.int64, len(cores))
    there = np.flatnonzero(sizes)
    codes = np.frombuffer("".join(f"<{cores[i]}>" for i in there).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = sizes[there] + 2
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(there)), size)
    left = np.repeat(starts + size, size) - np.arange(len(codes))  # characters from here to the word's end
    whole = np.zeros(len(there), np.uint64)
    out, number = [], [there]
    with np.errstate(over="ignore"):
        powers = np.uint64(0x9E6C63D0876A9A47) ** (np.arange(len(codes)) - np.repeat(starts, size)).astype(np.uint64)
        if len(there):
            whole = np.add.reduceat(codes * powers, starts)
        out.append(_mixed(whole, 0))
        grams = codes
        for k in (1, 2, 3):
            if k > 1:
                grams = np.r_[grams[: max(0, len(codes) - k + 1)] << np.uint64(21) | codes[k - 1 :], np.zeros(k - 1, np.uint64)]
            fits = np.flatnonzero(left >= k)
            out.append(_mixed(grams[fits], k))
            number.append(there[owner[fits]])
            long = np.flatnonzero(size - 2 >= k)
            for at, kind in ((starts + 1, 3 + k), (starts + size - 1 - k, 6 + k)):
                out.append(_mixed(grams[at[long]], kind))
                number.append(there[long])
    return np.concatenate(number), np.concatenate(out)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, (time, sequence, label), and the summed expected transitions.

    scores: emissions as positive factors, (time, sequence, label); moves: transitions as positive factors.
    """
    steps, _, labels = scores.shape
    ahead, back = np.empty_like(scores), np.ones_like(scores)
    ahead[0] = scores[0] / scores[0].sum(-1, keepdims=True)
    for t in range(1, steps):
        now = (ahead[t - 1] @ moves) * scores[t]
        ahead[t] = now / now.sum(-1, keepdims=True)
    inside = lengths[None, :] > np.arange(1, steps + 1)[:, None]  # whether a word follows
    for t in range(steps - 2, -1, -1):
        now = (scores[t + 1] * back[t + 1]) @ moves.T
        back[t] = np.where(inside[t][:, None], now / now.sum(-1, keepdims=True), 1.0)
    both = ahead * back
    both /= both.sum(-1, keepdims=True)
    pairs = np.zeros((labels, labels), scores.dtype)
    if steps > 1:
        right = scores[1:] * back[1:]
        joint = ahead[:-1, :, :, None] * moves * right[:, :, None, :]
        joint /= joint.sum((-1, -2), keepdims=True)
        pairs = (joint * inside[:-1, :, None, None]).sum((0, 1))
    return both, pairs


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    alphabet: frozenset[str] = frozenset()  # letters of the words learned from

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word, and which words have features."""
        number, buckets = features(words)
        scores = [np.bincount(number, w[buckets], len(words)) for w in self.weights.T]
        return np.stack(scores, 1), np.bincount(number, minlength=len(words)) > 0


def fit(segments: list[tuple[str, list[str]]], labels: list[str], epochs: int = 3, rate: float = 0.2, seed: int = 7) -> Model:
    """Adaptive gradient ascent on the likelihood of chained segments (label, words)."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    weights, moves = np.zeros((BUCKETS, n)), np.zeros((n, n))
    grown, moved = np.full((BUCKETS, n), 1e-3), np.full((n, n), 1e-3)
    known: dict[str, int] = {}
    for _, words in segments:
        for w in words:
            known.setdefault(w, len(known))
    number, buckets = features(list(known))
    buckets = buckets[np.argsort(number, kind="stable")]
    many = np.bincount(number, minlength=len(known))
    lists = np.split(buckets, np.cumsum(many)[:-1]) if len(known) else []
    data = []
    for label, words in segments:
        ids = [i for w in words if many[i := known[w]]]
        if ids:
            data.append((labels.index(label), np.array(ids)))
    chain, batch = 3, 48
    for _ in range(epochs if n > 1 else 0):
        order = rng.permutation(len(data))
        for at in range(0, len(order), chain * batch):
            part = [data[i] for i in order[at : at + chain * batch]]
            rows = [part[i : i + chain] for i in range(0, len(part), chain)]
            lengths = np.array([sum(len(x) for _, x in r) for r in rows])
            words, inverse = np.unique(np.concatenate([x for r in rows for _, x in r]), return_inverse=True)
            flat = np.concatenate([lists[w] for w in words])
            starts = np.cumsum([0, *(len(lists[w]) for w in words[:-1])])
            emitted = np.add.reduceat(weights[flat], starts, axis=0)
            here = np.arange(lengths.max())[:, None] < lengths
            scores = np.ones((lengths.max(), len(rows), n))
            truth = np.concatenate([np.full(len(x), y) for r in rows for y, x in r])
            time, row = np.concatenate([np.arange(k) for k in lengths]), np.repeat(np.arange(len(rows)), lengths)
            raw = emitted[inverse]
            scores[time, row] = np.exp(raw - raw.max(1, keepdims=True))
            likely, pairs = forward_backward(np.maximum(scores, 1e-30), lengths, np.exp(moves))
            error = -likely[time, row]
            error[np.arange(len(truth)), truth] += 1
            by_word = np.zeros((len(words), n))
            np.add.at(by_word, inverse, error)
            each = np.repeat(by_word, np.diff([*starts, len(flat)]), axis=0)
            touched, where = np.unique(flat, return_inverse=True)
            slope = np.stack([np.bincount(where, each[:, k], len(touched)) for k in range(n)], 1)
            grown[touched] += slope**2
            weights[touched] += rate * slope / np.sqrt(grown[touched])
            stay = np.full(here.shape, -1)
            stay[time, row] = truth
            seen = np.zeros((n, n))
            a, b = stay[:-1], stay[1:]
            np.add.at(seen, (a[b >= 0], b[b >= 0]), 1)
            change = seen - pairs
            moved += change**2
            moves += rate * change / np.sqrt(moved)
    return Model(labels, weights.astype(np.float32), np.exp(moves - moves.max()).astype(np.float64), frozenset("".join(map(letters, known))))


def train(
    docs: DataFrame, label_col: str, text_col: str, order_hash, per_label: int = PER_LABEL,
    segments: int = SEGMENTS, segment_words: int = SEGMENT_WORDS,
) -> Model:
    """Fits on a sample of the rows: `order_hash` is a 64-bit hash column by which rows are drawn."""
    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), order_hash.alias("draw"))
    rows = rows.where("label is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    labels = sorted(counts)
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    scale = 1_000_000
    share = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(scale, -(-scale * per_label // counts[k]))))])
    drawn = rows.where(F.pmod("draw", F.lit(scale)) < share[F.col("label")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.string()), ("words", pa.list_(pa.string()))])
        for batch in batches:
            found = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                starts = range(0, len(words), segment_words)
                spread = starts if len(starts) <= segments else [starts[i * len(starts) // segments] for i in range(segments)]
                found += [(label, words[s : s + segment_words]) for s in spread]
            if found:
                yield arrow_rows(schema, list(zip(*found, strict=True)))

    sample = drawn.mapInArrow(cut, "label string, words array<string>").collect()
    return fit(sorted((r[0], list(r[1])) for r in sample), labels)


class Tagger:
    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.size = 0
        self.table = np.ones((1024, len(self.model.labels)))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        raw, there = self.model.emissions(new)
        raw = raw[there]
        size = self.size + len(raw)
        if size > len(self.table):
            self.table = np.vstack([self.table[: self.size], np.ones((max(size, 1024), raw.shape[1]))])
        self.table[self.size : size] = np.maximum(np.exp(raw - raw.max(1, keepdims=True)), 1e-30)
        numbers = np.where(there, self.size + np.cumsum(there) - 1, -1)
        self.rows.update(zip(new, numbers.tolist(), strict=True))
        self.size = size

    def tag(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Label probabilities of the words with letters of each text, (word, label), in order."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append((text or "").split())
            size += len(held[-1])
            if size > CELLS:
                yield from self._solve(held)
                held, size = [], 0
        yield from self._solve(held)

    def _solve(self, texts: list[list[str]]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.rows) > WORDS:
            self.reset()
        self._learn(set().union(*texts))
        get = self.rows.__getitem__
        ids = [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]
        ids = [x[x >= 0] for x in ids]
        likely = posteriors(self.table[np.concatenate(ids)], np.array(list(map(len, ids))), self.model.moves)
        return np.split(likely, np.cumsum(list(map(len, ids)))[:-1])


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, stretch: int = 64) -> np.ndarray:
    """Forward-backward over many sequences laid end to end, with short loops however long a sequence is.

    Sequences are cut into stretches. The product of a stretch's steps is a small matrix; with these, the
    messages that enter each stretch from either side follow, and then those inside all stretches at once.
    """
    labels = scores.shape[1]
    if not len(scores):
        return scores
    parts = -(-lengths // stretch)
    firsts = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(owner)) - firsts[owner]
    start = (np.cumsum(lengths) - lengths)[owner] + number * stretch
    size = np.minimum(lengths[owner] - number * stretch, stretch)
    order = np.argsort(-size, kind="stable")  # longest stretches first: those with a t-th word are a prefix
    live = np.searchsorted(-size[order], -np.arange(1, stretch + 1), "right")
    begin, opens = start[order], number[order] == 0

    def even(x: np.ndarray, axis: int | tuple[int, ...] = -1) -> np.ndarray:
        return x / x.sum(axis, keepdims=True)

    product = np.where(opens[:, None, None], 1.0, moves) * scores[begin][:, None, :]
    for t in range(1, stretch):
        k = live[t]
        if not k:
            break
        product[:k] = even((product[:k] @ moves) * scores[begin[:k] + t][:, None, :], (-1, -2))
    whole = np.empty_like(product)
    whole[order] = product
    left, right = np.full((len(owner), labels), 1.0 / labels), np.full((len(owner), labels), 1.0 / labels)
    last = firsts + parts - 1
    for k in range(1, int(parts.max())):
        at = (firsts + k)[parts > k]
        left[at] = even((left[at - 1][:, None, :] @ whole[at - 1])[:, 0])
        at = (last - k)[parts > k]
        right[at] = even((whole[at + 1] @ right[at + 1][:, :, None])[:, :, 0])
    out = np.empty_like(scores)
    now = np.where(opens[:, None], 1.0, left[order] @ moves)
    for t in range(stretch):
        k = live[t]
        if not k:
            break
        now = even((now[:k] if t == 0 else now[:k] @ moves) * scores[begin[:k] + t])
        out[begin[:k] + t] = now
    now = right[order]
    for t in range(stretch - 1, -1, -1):
        k = live[t]
        if k:
            at = begin[:k] + t
            out[at] *= now[:k]
            now[:k] = even((now[:k] * scores[at]) @ moves.T)
    return even(out)


def spans_of(likely: np.ndarray, labels: list[str]) -> list[dict]:
    """Maximal runs of the likeliest label: first word, words, label."""
    if not len(likely):
        return []
    best = likely.argmax(1)
    starts = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    sizes = np.diff(np.r_[starts, len(best)])
    return [{"start": int(s), "words": int(n), "label": labels[best[s]]} for s, n in zip(starts, sizes, strict=True)]


def in_known_language(text: str | None, likely: np.ndarray, model: Model) -> bool:
    """Whether the words are in some of the model's languages, however mixed: a word has half for one label in the mean,
    or half of the words have only letters that were learned from."""
    if not len(likely):
        return False
    if likely.max(1).mean() >= LEAST_SURE:
        return True
    cores = [c for w in (text or "").split() if (c := letters(w))]
    return sum(model.alphabet.issuperset(c) for c in cores) >= LEAST_KNOWN * len(cores)


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, known: bool = False
) -> DataFrame:
    """id_col's value as doc_id, lang_pred, score and, if asked for, the spans of words of one label and `in_known_language`."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "lang_pred string, score double" + ", spans array<struct<start: long, words: long, label: string>>" * spans + ", known boolean" * known
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), *[("spans", span)] * spans, *[("known", pa.bool_())] * known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, scores, runs, sure = [], [], [], []
                texts = part.column(1).to_pylist()
                for text, likely in zip(texts, tagger.tag(texts) if model.labels else [np.empty((0, 0))] * len(part), strict=True):
                    mean = likely.mean(0) if len(likely) else None
                    names.append(UNDETERMINED if mean is None else model.labels[int(mean.argmax())])
                    scores.append(0.0 if mean is None else float(min(1.0, mean.max())))
                    runs.append(spans_of(likely, model.labels) if spans else None)
                    sure.append(in_known_language(text, likely, model) if known else None)
                said = arrow_rows(schema, [names, scores, *[runs] * spans, *[sure] * known])
                yield pa.RecordBatch.from_arrays([part.column(0), *said.columns], names=["doc_id", *schema.names])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {kinds}")


def remainder(column: str, n: int):
    """crc32 of an id as text, modulo n; -1 for null ids."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def trained(docs: DataFrame) -> Model:
    """The model of op6: learned from documents whose remainder modulo 5 is not 0."""
    return train(docs.where(remainder("doc_id", 5) > 0), "lang", "text", F.xxhash64("doc_id", F.lit("draw")))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = identify(docs, trained(docs))
    return said.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
