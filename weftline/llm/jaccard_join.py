"""N-gram Jaccard join with multiple global orders: who is similar enough must share prefixes in all of them.

Sets are the 64-bit hashes of a text's distinct word shingles; equal sets are one node from the start.

1. Words are counted over all documents. Of those counted most (a bounded number goes to the tasks) the
   counts order the shingles, rarest first: order 1 by the rarest word in it, order 2 by all its words.
2. Two sets that overlap enough share l tokens of their prefixes when these are l - 1 longer than needed for
   one. A node whose prefix of order 1 has too few tokens that any other node's prefix has, has no partner.
   Tokens are counted packed: each chunk of nodes sends a token once.
   Of the nodes left, the same is asked for all their tokens: a pair shares no more than either has in common
   with any node.
3. The nodes left meet in posting lists of order 1. Each is compared with a pivot of two of its lists, and
   links make components; nodes outside a list's main component are compared with one of its nodes as well.
   Only then are nodes of unlike components paired: those that share a list of order 1, without pairs inside
   the component that most of a list's nodes are in. So a large group of near copies costs links in proportion
   to its size, and yet no link between components is lost.
4. A pair is a candidate only if its sets' parity bitmaps differ in no more bits than similar sets can differ in
   tokens (each bit that differs is at least one token that one of them lacks), and if it shares prefix tokens
   in order 2 and in order 3 (by hash alone, independent of the others) as well. Candidates are verified on all tokens.

Edge cases: null or empty texts have no shingles and stay alone; texts of fewer words than a shingle are one
shingle, equal only to the same words; repeated rows and repeated ids share a node by their text; a null id
is larger than all others and comes back as null, as does a component of null ids alone; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, free, keyed, materialise, mix64, sequence_hashes, text_slices
from weftline.llm.components import components

ORDER_WORDS = 100_000  # words whose counts go to the tasks
BITMAP = 16  # 64-bit words of a parity bitmap


@dataclass
class Threshold:
    """similar: percent * union <= 100 * intersection."""

    shingle: int
    percent: int

    def overlap(self, n: np.ndarray) -> np.ndarray:
        """The least overlap of a set of n with any similar set: ceil(percent * n / 100)."""
        return -(-self.percent * n // 100)

    def extra(self, n: np.ndarray) -> np.ndarray:
        return n // 10 + 1

    def long_prefix(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, n - self.overlap(n) + self.extra(n))

    def shared(self, n: np.ndarray) -> np.ndarray:
        """How many tokens of its long prefix a set of n shares with that of any similar set, at least."""
        return self.extra(self.overlap(n))

    def prefix(self, n: int) -> int:
        return int(n - self.overlap(n) + 1)


class WordOrder:
    """Ranks of words by how often they were counted, in quarter powers of two; 0 for those not listed."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ranks = np.round(np.log2(np.maximum(counts[order], 1)) * 4).astype(np.uint64) + np.uint64(1)

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.ranks[at], np.uint64(0))


def shingle_sets(words: np.ndarray, sizes: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text, laid end to end: distinct shingle hashes, ascending; where each first starts; the text's first word."""
    every = sequence_hashes(words, k)
    for first, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        if not size:
            yield np.empty(0, np.uint64), np.empty(0, np.int64), first
        elif size < k:
            yield mix64(sequence_hashes(words[first : first + size], size), size), np.zeros(1, np.int64), first
        else:
            yield *np.unique(every[first : first + size - k + 1], return_index=True), first


def shingle_ranks(words: np.ndarray, order: WordOrder, k: int) -> list[np.ndarray]:
    """By first word of a shingle: its rank in order 1 (rarest word), 2 (all words) and 3 (none: its hash alone decides)."""
    ranks = np.r_[order.of(words), np.full(k - 1, 1 << 10, np.uint64)]
    parts = [ranks[i : i + len(words)] for i in range(k)]
    return [np.minimum.reduce(parts), np.add.reduce(parts), np.zeros(len(words), np.uint64)]


def prefix(tokens: np.ndarray, ranks: np.ndarray, which: int, size: int) -> np.ndarray:
    """The first tokens in global order 1, 2 or 3, in that order."""
    key = (ranks << np.uint64(49)) | (mix64(tokens, which) >> np.uint64(15))
    if size < len(key):
        near = np.argpartition(key, size - 1)[:size]
        return tokens[near[np.argsort(key[near])]]
    return tokens[np.argsort(key)]


def node_of(tokens: np.ndarray) -> int:
    """The key of a set: equal sets have equal keys; 0 for the empty one."""
    return int(mix64(np.array([_fold(tokens)], np.uint64), len(tokens)).view(np.int64)[0]) if len(tokens) else 0


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls on each bit. Bitmaps of two sets differ in at most as many bits as the sets in tokens."""
    odd = np.bincount((tokens % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def word_order(docs: DataFrame, limit: int = ORDER_WORDS) -> WordOrder:
    """Counts all words of all texts; the most frequent come to the driver, at most `limit` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            parts = [np.unique(words, return_counts=True) for _, words, _ in text_slices(batch.column(0), True)]
            found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([p[1] for p in parts]), len(found)).astype(np.int64)
            yield arrow_rows(schema, [found.view(np.int64), sums])

    counts = materialise(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 4)
    levels = {int(r[0]): r[1] for r in counts.groupBy(level).count().collect()}
    least, total = max(levels, default=0) + 1, 0
    for at in sorted(levels, reverse=True):
        total += levels[at]
        if total > limit:
            break
        least = at
    rows = counts.where(level >= least).toPandas()
    free(counts)
    return WordOrder(rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def _live(nodes: DataFrame, buckets: int) -> DataFrame:
    """node, live: how many of its `tokens` another node has as well. nodes: node, tokens, in an order that a second run keeps.

    A chunk of nodes sends each bucket its tokens once and gets one answer back, in which nodes go by their number in the chunk.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("to", pa.int64()), ("chunk", pa.int64()), ("numbers", pa.binary()), ("values", pa.binary())])
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not sets:
                continue
            nodes = batch.column(0).to_numpy()
            chunk = int(mix64(np.array([_fold(nodes)], np.uint64), 7).view(np.int64)[0])
            tokens = np.concatenate(sets)
            owner = np.repeat(np.arange(len(nodes), dtype=np.int32), list(map(len, sets)))
            _, first, where, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
            here = np.bincount(owner[times[where] > 1], minlength=len(nodes)).astype(np.int64)
            first = np.sort(first)  # in the order of nodes, which packs well
            alone = times[where[first]] == 1
            to = (tokens[first] % np.uint64(buckets)).astype(np.int64)
            rows = [(-1, chunk, nodes.tobytes(), here.tobytes())]
            for bucket in range(buckets):
                mine = to == bucket
                if mine.any():
                    # a token that two nodes of this chunk have needs no answer: no number
                    numbers = np.where(alone[mine], owner[first[mine]], np.int32(-1))
                    rows.append((bucket, chunk, numbers.tobytes(), tokens[first[mine]].tobytes()))
            yield arrow_rows(schema, list(zip(*rows, strict=True)))

    said = pa.schema([("chunk", pa.int64()), ("nodes", pa.binary()), ("numbers", pa.binary()), ("live", pa.binary())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for bucket, chunk, numbers, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket < 0:
                    yield arrow_rows(said, [[chunk], [numbers], [None], [values]])
                else:
                    kept.setdefault(bucket, []).append((chunk, np.frombuffer(numbers, np.int32), np.frombuffer(values, np.uint64)))
        for rows in kept.values():
            numbers = np.concatenate([r[1] for r in rows])
            _, where, times = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
            settled = times > 1
            settled[where[numbers < 0]] = True
            live, at, out = settled[where] & (numbers >= 0), 0, []
            for chunk, own, _ in rows:
                found, n = np.unique(own[live[at : at + len(own)]], return_counts=True)
                at += len(own)
                if len(found):
                    out.append((chunk, None, found.tobytes(), n.astype(np.int64).tobytes()))
            if out:
                yield arrow_rows(said, list(zip(*out, strict=True)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, nodes, numbers, live in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(live, np.int64)
                if nodes is not None:
                    names[chunk] = np.frombuffer(nodes, np.int64)
                where = np.arange(len(n)) if numbers is None else np.frombuffer(numbers, np.int32)
                size = int(where[-1]) + 1
                if len(own := sums.get(chunk, np.zeros(0, np.int64))) < size:
                    own = sums[chunk] = np.r_[own, np.zeros(size - len(own), np.int64)]
                own[where] += n
        for chunk, own in sums.items():
            yield arrow_rows(pa.schema([("node", pa.int64()), ("live", pa.int64())]), [names[chunk], own])

    sent = nodes.select("node", "tokens").mapInArrow(send, "to long, chunk long, numbers binary, values binary")
    dealt = sent.repartition(buckets, F.when(F.col("to") < 0, F.xxhash64("chunk")).otherwise(F.col("to")))
    answered = dealt.mapInArrow(answer, "chunk long, nodes binary, numbers binary, live binary")
    return answered.repartition(buckets, "chunk").mapInArrow(gather, "node long, live long")


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Those of the pairs (a, b) of nodes that share prefix tokens in orders 2 and 3 and whose sets are similar."""

    def shared(x: bytes, y: bytes) -> int:
        both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
        both.sort()
        return int((both[1:] == both[:-1]).sum())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                fine = shared(x["second"], y["second"]) and shared(x["third"], y["third"])
                both = shared(x["tokens"], y["tokens"]) if fine else 0
                good.append(100 * both >= limit.percent * ((len(x["tokens"]) + len(y["tokens"])) // 8 - both))
            keep = pa.array(good, pa.bool_())
            yield arrow_rows(schema, [batch.column(0).filter(keep), batch.column(1).filter(keep)])

    whole = F.struct("second", "third", "tokens")
    left = sets.select(F.col("node").alias("a"), whole.alias("left"))
    right = sets.select(F.col("node").alias("b"), whole.alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85, order_words: int = ORDER_WORDS,
    carry: str | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id that each document reaches over links; and the long column `carry`, if named."""
    spark, limit = docs.sparkSession, Threshold(shingle, percent)
    source = keyed(docs, id_col, text_col, carry)
    carried = [F.col(carry)] if carry else []
    order = spark.sparkContext.broadcast(word_order(source, order_words))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("prefix", pa.binary()), *[(carry, pa.int64())] * bool(carry)])
        for batch in batches:
            rows = []
            for _, words, many in text_slices(batch.column(1), True):
                ranks = shingle_ranks(words, order.value, shingle)[0]
                for tokens, starts, first in shingle_sets(words, many, shingle):
                    n = len(tokens)
                    rows.append((n, node_of(tokens), prefix(tokens, ranks[first + starts], 1, limit.long_prefix(n)).tobytes() if n else b""))
            if rows:
                yield arrow_rows(schema, [batch.column(0), *zip(*rows, strict=True), *batch.columns[2:]])

    built = materialise(source.mapInArrow(build, "doc_id long, n long, node long, prefix binary" + (f", `{carry}` long" if carry else "")), "sets")
    nodes = built.where("n > 0").groupBy("node").agg(F.first("prefix").alias("tokens")).sortWithinPartitions("node")
    named = built.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    least = F.floor(F.ceil(F.col("n") * percent / 100) / 10) + 1
    left = materialise(named.join(_live(nodes, buckets), "node").where(F.col("live") >= least).select("node", "doc_id"), "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("first", pa.list_(pa.int64())), ("second", pa.binary()), ("third", pa.binary()), ("bits", pa.list_(pa.int64()))])
        for batch in batches:
            rows = []
            for _, words, many in text_slices(batch.column(0), True):
                ranks = shingle_ranks(words, order.value, shingle)
                for tokens, starts, first in shingle_sets(words, many, shingle):
                    if n := len(tokens):
                        one, two, three = (prefix(tokens, ranks[k - 1][first + starts], k, limit.prefix(n)) for k in (1, 2, 3))
                        rows.append((node_of(tokens), n, tokens.tobytes(), one.view(np.int64), two.tobytes(), three.tobytes(), parity_bitmap(tokens)))
            if rows:
                yield arrow_rows(schema, list(zip(*rows, strict=True)))

    # Sorted and merged at every size, so that a small table tells how a large one goes.
    texts = source.join(left.select(F.col("doc_id").alias("own")).distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select("text")
    rebuilt = texts.mapInArrow(rebuild, "node long, n long, tokens binary, first array<long>, second binary, third binary, bits array<long>")
    near = materialise(rebuilt.join(left.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "near")
    free(left)
    # Of all its tokens, how many another node has: no pair can share more.
    sets = materialise(near.join(_live(near, buckets), "node").where(F.col("live") * 100 >= F.col("n") * percent), "kept")
    free(near)

    # Of a group of near copies those that share most of their tokens are nearest to all others.
    def whole(name: str):
        return F.struct(F.floor(F.col("live") * 20 / F.col("n")), F.xxhash64("node", "token", F.lit(name)))

    # Posting lists of at least two nodes.
    rows = sets.select("node", "n", "live", F.posexplode("first").alias("at", "token"))
    met = rows.groupBy("token").agg(F.count("*").alias("times"), F.max_by("node", whole("pivot")).alias("pivot")).where("times > 1")
    # Before the first token that a pair has in common stand only tokens that it does not share.
    before = F.row_number().over(Window.partitionBy("node").orderBy("at")) - 1
    first = materialise(rows.join(met, "token").withColumn("before", before), "first")
    turn = Window.partitionBy("node").orderBy("at")
    stars = first.where("node != pivot").withColumn("turn", F.row_number().over(turn)).where("turn <= 2")
    star_pairs = stars.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    star_links = materialise(_verified(star_pairs, sets, limit), "links")
    labels = materialise(components(star_links), "labels")

    def labelled(labels: DataFrame) -> DataFrame:
        """The lists with nodes of unlike components, and of which component most of a list's nodes are."""
        known = first.select("token", "node", "n", "live", "at", "before").join(labels, "node", "left")
        known = known.select("token", "node", "n", "live", "at", "before", F.coalesce("label", "node").alias("label"))
        sizes = known.groupBy("token", "label").agg(F.count("*").alias("c"))
        most = sizes.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels"))
        return known.join(most.where("labels > 1"), "token")

    # Nodes outside the component that a list's nodes are mostly in meet one node of that component.
    other = labelled(labels)
    hubs = other.where("label = most").groupBy("token").agg(F.max_by("node", whole("hub")).alias("hub"))
    again = other.where("label != most").join(hubs, "token").withColumn("turn", F.row_number().over(turn)).where("turn <= 3")
    more_pairs = again.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialise(star_links.unionByName(_verified(more_pairs, sets, limit)), "links")
    free(star_links, labels)
    labels = materialise(components(links), "labels")
    free(links)

    # Pairs of a list whose nodes are of unlike components, near enough in size and in their bitmaps.
    rows = materialise(labelled(labels).join(sets.select("node", "bits"), "node"), "unlike")
    free(first)
    ahead = F.col("live") - F.col("before")
    one = rows.where("label != most").select("token", F.col("node").alias("x"), F.col("n").alias("xn"), ahead.alias("xlive"), F.col("at").alias("xat"), F.col("label").alias("xl"), F.col("bits").alias("xbits"))
    other = rows.select("token", F.col("node").alias("y"), F.col("n").alias("yn"), ahead.alias("ylive"), F.col("at").alias("yat"), F.col("label").alias("yl"), F.col("most").alias("ym"), F.col("bits").alias("ybits"))
    close = (F.col("xn") * 100 >= F.col("yn") * percent) & (F.col("yn") * 100 >= F.col("xn") * percent)
    reach = F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat"), "xlive", "ylive")  # if this is their first token in common
    enough = reach * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent
    apart = sum((F.bit_count(F.col("xbits")[i].bitwiseXOR(F.col("ybits")[i])) for i in range(BITMAP)), F.lit(0))
    alike = apart * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent)
    once = (F.col("yl") == F.col("ym")) | (F.col("x") < F.col("y"))
    pairs = one.join(other, "token").where((F.col("xl") != F.col("yl")) & close & enough & once & alike)
    candidates = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = materialise(_verified(candidates, sets, limit), "links")
    free(rows, sets)
    final = materialise(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)), "labels")
    free(labels, more)
    # By node first: a component of many nodes costs one row a node here, and no document of it is moved by its label.
    own = built.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(final, "node")
    leasts = materialise(own.groupBy("label").agg(F.min("doc_id").alias("least")), "leasts")
    groups = materialise(final.join(leasts, "label"), "groups")
    free(final, leasts)
    alone = built.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("own"))
    found = materialise(alone.join(groups, "node", "left").select("node", F.coalesce("least", "own").alias("least")), "nodes")
    free(groups)
    out = built.select("doc_id", "n", "node", *carried).join(found, "node", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *carried)


def _fold(tokens: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(tokens.tobytes())


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
