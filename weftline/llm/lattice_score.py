"""LM scoring by subword lattices: an existing vocabulary's scores weight all segmentations of a text.

A text is its words, each opened by a space, and an end. In the lattice of a word every piece of the
vocabulary that stands somewhere in it is an edge, single bytes always are, and so is the word itself if the
training texts have it. Pieces start with weights from the vocabulary's own scores (Zipf's law over their
order), which one or more expectation steps over all training words re-estimate; the lexicon's edges are
discounted counts. The forward recursion sums over all segmentations in log space. Weights make one proper
distribution: a token has probability max(c - D, 0) / N + D * V / N * (its lattice over pieces), times
A / (A + i) as the i-th token of its text; with the rest i / (A + i) it repeats one of the tokens before it. The
strength A is the one of `STRENGTHS` under which the training texts are likeliest.

Texts are read once into chunks (about `CHUNK_BYTES` of text). A chunk sends each of its words once; the
words are counted and scored as a table; a chunk gets its words' figures back and sums them by text.

Edge cases: null and empty texts have one token, the end; a null id is neither held out nor learned from;
without training texts the lattice alone gives the score; very long texts and words are scored whole;
repeated rows are scored, and learned from, each for itself; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, free, materialise

CHUNK_BYTES = 16_000_000
END = b""  # no word is empty
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only
STEPS = 2  # expectation steps
BASE = np.uint64(0x9FB21C651E98DF25)
BLOOM_BITS = 20
STRENGTHS = (1e2, 3e2, 1e3, 3e3, 1e4, 1e5, 1e7)
CELLS = 3_000_000  # (word, position) cells of one group that are solved together


def existing_pieces(path: str) -> list[tuple[bytes, float]]:
    """Pieces that may stand in a word, as bytes with a space for the word mark, and the vocabulary's scores.

    Byte pieces have a score below all others.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found, low = [], min(model.get_score(i) for i in range(model.get_piece_size())) - 1
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            found.append((piece, model.get_score(i)))
    known = {p for p, _ in found}
    return found + [(bytes([b]), low) for b in range(256) if bytes([b]) not in known]


@dataclass
class Lattice:
    """Log weights of pieces, found in texts by rolling hashes. Slot 0 is no piece; `end` the end's weight."""

    pieces: list[bytes]
    log_weights: np.ndarray
    end: float

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("pieces of equal hash")
        self.bloom = np.zeros(1 << BLOOM_BITS, bool)
        self.bloom[(self.hashes >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, text: np.ndarray) -> list[np.ndarray]:
        """text: (words, size) bytes. By piece length k: the piece at each start, (starts, words), -1 for none."""
        rows = np.ascontiguousarray(text.T).astype(np.uint64) + np.uint64(1)
        size, out, h = len(rows), [], None
        for k in range(1, min(self.longest, size) + 1):
            h = rows if h is None else h[:-1] * BASE + rows[k - 1 :]
            where = np.flatnonzero(self.bloom[(h >> np.uint64(64 - BLOOM_BITS)).ravel().view(np.int64)])
            asked = h.ravel()[where]
            at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
            good = self.hashes[at] == asked
            found = np.full(h.size, -1, np.int32)
            found[where[good]] = self.order[at[good]]
            out.append(found.reshape(h.shape))
        return out

    def forward(self, edges: list[np.ndarray], size: int, count: int) -> np.ndarray:
        """Log weights of all segmentations of what stands before each position, (position, word)."""
        table = np.append(self.log_weights, -np.inf)  # -1: none
        ahead = np.zeros((size + 1, count))
        for end in range(1, size + 1):
            ways = np.array([ahead[end - k] + table[edges[k - 1][end - k]] for k in range(1, min(end, len(edges)) + 1)])
            top = ways.max(0)
            ahead[end] = top + np.log(np.exp(ways - top).sum(0))
        return ahead

    def backward(self, edges: list[np.ndarray], size: int, count: int) -> np.ndarray:
        table = np.append(self.log_weights, -np.inf)
        back = np.zeros((size + 1, count))
        for start in range(size - 1, -1, -1):
            ways = np.array([back[start + k] + table[edges[k - 1][start]] for k in range(1, min(size - start, len(edges)) + 1)])
            top = ways.max(0)
            back[start] = top + np.log(np.exp(ways - top).sum(0))
        return back

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, bytes) of words of one length, the opening space included; the end is in none."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            step = max(1, CELLS // int(size * min(size, self.longest)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                text = np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), size + 1)
                yield part, text

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the words' marginal probabilities."""
        out = np.full(len(words), self.end)
        for rows, text in self._groups(words):
            edges = self.edges(text)
            out[rows] = self.forward(edges, text.shape[1], len(rows))[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the counted words."""
        table, total = np.append(self.log_weights, -np.inf), np.zeros(len(self.pieces) + 1)
        for rows, text in self._groups(words):
            size, edges = text.shape[1], self.edges(text)
            ahead, back = self.forward(edges, size, len(rows)), self.backward(edges, size, len(rows))
            for k, found in enumerate(edges, 1):
                there = np.flatnonzero(found.ravel() >= 0)
                ids, column = found.ravel()[there], there % len(rows)
                start = there // len(rows)
                share = np.exp(ahead[start, column] + table[ids] + back[start + k, column] - ahead[size, column])
                total += np.bincount(ids, share * counts[rows[column]], len(total))
        return total[:-1]

    def reweighted(self, uses: np.ndarray, ends: float) -> Lattice:
        """New weights from expected uses, one added to each."""
        return weighted(self.pieces, uses + 1.0, ends + 1.0)


def weighted(pieces: list[bytes], uses: np.ndarray, ends: float) -> Lattice:
    """A piece's weight is its share; after the last piece of a word another word, or the end, must begin.

    Pieces are drawn one after the other. Words begin with a piece that begins with a space, so that the
    shares of these and of the end make the probability to stop a word; a word's weight is then the sum over
    segmentations of the product of shares, and those of all words and the end add up to 1.
    """
    total = uses.sum() + ends
    opens = np.array([p[:1] == b" " for p in pieces])
    return Lattice(pieces, np.log(uses / total), float(np.log(ends / (uses[opens].sum() + ends))))


def from_existing(path: str) -> Lattice:
    """Before any text is seen: Zipf's law over the order of the vocabulary's scores."""
    pieces = existing_pieces(path)
    scores = np.array([s for _, s in pieces])
    uses = 1.0 / (np.argsort(np.argsort(-scores, kind="stable"), kind="stable") + 2.7)
    return weighted([p for p, _ in pieces], uses, float(uses.sum() / 100))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithms of the gamma function for x > 0: Stirling's series, eight steps up."""
    y = x + 8.0
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def with_repeats(tokens: np.ndarray, sizes: np.ndarray, log_p: np.ndarray, strengths: tuple[float, ...]) -> np.ndarray:
    """Log probabilities of texts laid end to end, (strength, text), when tokens also repeat earlier ones.

    The order of a text's tokens plays no part: a token of n uses has weight A p (A p + 1) ... (A p + n - 1).
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    key, uses = np.unique(owner * np.int64(len(log_p)) + tokens, return_counts=True)
    text, token = np.divmod(key, len(log_p))
    once = np.bincount(text, log_p[token], len(sizes))
    kinds = np.bincount(text, minlength=len(sizes))
    again = np.flatnonzero(uses > 1)
    p, n, owner = np.exp(log_p[token[again]]), uses[again], text[again]
    out = []
    for a in strengths:
        rest = log_gamma(a * p + n) - log_gamma(a * p + 1)
        whole = log_gamma(np.full(1, a)) - log_gamma(a + sizes.astype(np.float64))
        out.append(whole + once + kinds * np.log(a) + np.bincount(owner, rest, len(sizes)))
    return np.stack(out)


def _packed(ids: np.ndarray) -> bytes:
    """Small numbers by byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def chunks_of(docs: DataFrame, id_col: str, text_col: str, learns: Column) -> DataFrame:
    """chunk, doc_ids, has_ids, learned, sizes (tokens), tokens (packed numbers of its words), words (joined by space), counts (in texts to learn from).

    The end is number 0 and the empty first word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), *[(n, pa.binary()) for n in ("doc_ids", "has_ids", "learned", "sizes", "tokens", "words", "counts")]])
        task, number = TaskContext.get().partitionId(), 0

        def done() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            sizes = np.array(list(map(len, held)), np.int64)
            counts = np.bincount(tokens[np.repeat(learned, sizes)], minlength=len(numbers)).astype("<i8")
            row = (
                task << 32 | number, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(),
                np.array(learned, np.uint8).tobytes(), sizes.astype("<i8").tobytes(), _packed(tokens), b" ".join(numbers), counts.tobytes(),
            )
            return arrow_rows(schema, [[x] for x in row])

        numbers: dict[bytes, int] = {END: 0}
        ids, held, learned, size = [], [], [], 0
        for batch in batches:
            for doc_id, text, learn in zip(*batch.columns, strict=True):
                words = (text.as_py() or b"").translate(LOWER).split()
                words.append(END)
                own = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int32, len(words))
                ids.append(doc_id.as_py())
                held.append(own)
                learned.append(bool(learn.as_py()))
                size += 6 * len(own)
                if size > CHUNK_BYTES:
                    yield done()
                    numbers, ids, held, learned, size = {END: 0}, [], [], [], 0
                    number += 1
        if ids:
            yield done()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(learns, F.lit(False)).alias("learn"))
    return source.mapInArrow(run, "chunk long, doc_ids binary, has_ids binary, learned binary, sizes binary, tokens binary, words binary, counts binary")


STEP = 50_000  # words that are handled together


def _listed(chunks: DataFrame) -> DataFrame:
    """word, chunk, at, n: each word of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("chunk", pa.int64()), ("at", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            for chunk, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, n = words.split(b" "), np.frombuffer(counts, "<i8")
                for at in range(0, len(parts), STEP):
                    some = parts[at : at + STEP]
                    yield arrow_rows(schema, [some, np.full(len(some), chunk), np.arange(at, at + len(some), dtype=np.int32), n[at : at + STEP]])

    return chunks.select("chunk", "words", "counts").mapInArrow(run, "word binary, chunk long, at int, n long")


def _by_words(lexicon: DataFrame, solve: Callable[[list[bytes], np.ndarray], pa.RecordBatch], kind: str) -> DataFrame:
    """Applies `solve` to about STEP words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return solve(table.column(0).to_pylist(), table.column(1).to_numpy())

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= STEP:
                yield done()
                held = []
        if held:
            yield done()

    return lexicon.select("word", "c").mapInArrow(run, kind)


def estimate(lexicon: DataFrame, lattice: Lattice, steps: int = STEPS) -> Lattice:
    """Expectation steps over all counted words; what comes to the driver has one row a piece."""
    for _ in range(steps):
        now = lattice
        ends = lexicon.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0

        def solve(words: list[bytes], counts: np.ndarray, now: Lattice = now) -> pa.RecordBatch:
            uses = now.expected(words, counts)
            ids = np.flatnonzero(uses)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(uses[ids])], names=["piece", "uses"])

        rows = _by_words(lexicon.where("c > 0 and length(word) > 0"), solve, "piece long, uses double")
        # sums in one order, whatever the order of rows: as whole millionths
        sums = rows.groupBy("piece").agg(F.sum(F.round(F.col("uses") * 1e6).cast("decimal(38,0)")).alias("uses")).collect()
        uses = np.zeros(len(now.pieces))
        for r in sums:
            uses[r["piece"]] = float(r["uses"]) / 1e6
        lattice = now.reweighted(uses, float(ends))
    return lattice


def score_texts(
    docs: DataFrame, vocabulary_path: str, learns: Column, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, vocabulary, strength, base_score, score, lattice_score: log10 probabilities of each whole text.

    lattice_score: that of its words' lattices alone, without the lexicon of known words and repeats of the text's own words.

    learns: which rows are learned from.
    """
    chunks = materialise(chunks_of(docs, id_col, text_col, learns), "chunks")
    lexicon = materialise(_listed(chunks).groupBy("word").agg(F.sum("n").alias("c")), "lexicon")
    sums = lexicon.agg(
        F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    ).first()
    total, kinds, ones, twos = (int(x or 0) for x in sums)
    discount = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
    lattice = estimate(lexicon, from_existing(vocabulary_path), steps if total else 0)

    def solve(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        parts = pieces = lattice.log_probabilities(words)
        if total:
            rest = parts + np.log(discount * kinds / total)
            own = np.log(np.maximum(counts - discount, 1e-300) / total)
            parts = np.where(counts > 0, np.logaddexp(own, rest), rest)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts), pa.array(parts), pa.array(pieces)], names=["word", "c", "p", "q"])

    known = _by_words(lexicon, solve, "word binary, c long, p double, q double")
    asked = _listed(chunks).select("word", "chunk", "at")
    answers = asked.join(known, "word").groupBy("chunk").agg(F.collect_list(F.struct("at", "c", "p", "q")).alias("answers"))
    joined = chunks.select("chunk", "doc_ids", "has_ids", "learned", "sizes", "tokens").join(answers, "chunk").drop("chunk")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("base_score", pa.float64()), ("lattice_score", pa.float64()), ("scores", pa.list_(pa.float64())),
        ])
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, has, learned, sizes, tokens = (batch.column(j)[k].as_py() for j in range(5))
                given = batch.column(5)[k].values
                at = given.field("at").to_numpy()
                c, p, q = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at))
                c[at], p[at], q[at] = given.field("c").to_numpy(), given.field("p").to_numpy(), given.field("q").to_numpy()
                ids, size = _unpacked(tokens).astype(np.int64), np.frombuffer(sizes, "<i8")
                firsts = np.cumsum(size) - size
                base = np.add.reduceat(np.log10(c + 1.0)[ids], firsts) - size * np.log10(total + kinds + 1.0)
                scores = with_repeats(ids, size, p, STRENGTHS).T / np.log(10)
                pieces = np.add.reduceat(q[ids], firsts) / np.log(10)
                seen = np.add.reduceat((c > 0).astype(np.int64)[ids], firsts)
                names = [i if there else None for i, there in zip(np.frombuffer(doc_ids, "<i8").tolist(), has, strict=True)]
                yield arrow_rows(schema, [names, np.frombuffer(learned, np.uint8).astype(bool), size, seen, base, pieces, list(scores)])

    kind = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, lattice_score double, scores array<double>"
    scored = materialise(joined.mapInArrow(sum_up, kind), "scored")
    free(chunks, lexicon)
    sums = scored.where("learned").agg(*(F.sum(F.round(F.col("scores")[k], 3).cast("decimal(38,3)")) for k in range(len(STRENGTHS)))).first()
    best = max(range(len(STRENGTHS)), key=lambda k: (sums[k] if sums[k] is not None else 0, k))
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.lit(kinds).cast("long").alias("vocabulary"),
        F.lit(STRENGTHS[best]).alias("strength"), "base_score", F.col("scores")[best].alias("score"), "lattice_score",
    )


def op1_lattice_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    out = score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), rest != 2)
    return out.select(
        "doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"
    )
