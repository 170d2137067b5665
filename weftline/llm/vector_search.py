"""Nearest neighbours by largest inner product: inverted lists of product-quantised residuals, reranked exactly.

1. On the driver, coarse centroids and the codebooks of the residuals' parts are fitted by k-means on a bounded
   sample (at most about `sample_rows` vectors, drawn by hash). There are about as many lists as the root of the
   number of rows, `lists` at least and one for eight vectors of the sample at most.
2. Every vector goes to the list of its nearest centroid, as one byte a part. Lists whose centroids are near share a shelf of up
   to `block_rows` rows; a longer list has one alone, which is dealt into blocks of about that size by hash. Each block meets a
   copy of the queries that probe lists of its shelf, so that a hot list spreads over tasks and short ones are not met one by one.
   Up to `checked` queries are compared with every row, which gives their true neighbours: as many lists are probed as
   hold `target` of these. Where the rows form no lists that tell them apart, that may be all lists.
3. A query goes to its lists of largest inner product with the centroid, as many as measured and at least as
   many as hold k rows. In a block it scores what the codes of its lists' rows stand for. A row's score by its codes counts with SPREAD
   times the error that is usual at its distance from what its codes stand for, so that rows that codes describe badly (long ones
   above all) are not passed over. The best `rerank` of the block are scored again on the original vectors in double precision, many
   queries at a time, and so are all others that may be as near as the k-th of these. The best k of all blocks are its answer.

Edge cases: vectors that are null, zero, of another length than most or hold null or non-finite values take no
part, neither as queries nor as candidates; a null id takes no part; repeated rows of one id count once (the least
vector by its hash); ties go to the smaller id; with k candidates or fewer all are returned; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, materialise

SAMPLE_ROWS, LISTS, PARTS, CODES = 8_000, 64, 16, 256
BLOCK_ROWS, RERANK, TARGET, CHECKED, SPREAD = 4_000, 200, 0.97, 256, 2.0


def kmeans(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of at most k clusters; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    kinds = np.unique(rows, axis=0)
    if len(kinds) <= k:
        return kinds
    centroids = kinds[rng.choice(len(kinds), k, replace=False)]
    for _ in range(rounds):
        near = nearest(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]  # of each part of a residual
    cuts: np.ndarray  # where the parts start

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each row."""
        lists = nearest(rows, self.centroids)
        rest = rows - self.centroids[lists]
        codes = [nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        return lists, np.stack(codes, 1).astype(np.uint8)

    def built(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What lists and codes stand for; a query's inner product with it is that with the centroid and with each part's code."""
        return self.centroids[home] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)


def fit(sample: np.ndarray, lists: int = LISTS, parts: int = PARTS) -> Index:
    centroids = kmeans(sample, min(lists, max(1, len(sample) // 8)))
    rest = sample - centroids[nearest(sample, centroids)]
    cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
    return Index(centroids, [kmeans(rest[:, a:b], CODES) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)


def shelves(held: np.ndarray, centroids: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shelf of each list, blocks of each shelf). Lists go, each followed by the nearest one left, to a shelf until it is full."""
    left = np.ones(len(held), bool)
    shelf, rows, here = np.zeros(len(held), np.int64), [0], 0
    for _ in range(len(held)):
        left[here] = False
        if rows[-1] and rows[-1] + held[here] > block_rows:
            rows.append(0)
        shelf[here] = len(rows) - 1
        rows[-1] += int(held[here])
        here = int(np.where(left, ((centroids - centroids[here]) ** 2).sum(1), np.inf).argmin())
    return shelf, np.maximum(1, -(-np.array(rows) // block_rows))


def best_of_block(
    vectors: np.ndarray, built: np.ndarray, ids: np.ndarray, home: np.ndarray, queries: np.ndarray, names: np.ndarray, probed: np.ndarray, k: int, rerank: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of the best k rows of each query. The rows stand list by list; probed: (query, list), of the lists met, in order."""
    slack = SPREAD * np.sqrt(((vectors - built) ** 2).mean(1))
    edges = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True])
    near = np.full((len(names), len(ids)), -np.inf)
    for at, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        who = np.flatnonzero(probed[:, at])
        near[who, a:b] = queries[who] @ built[a:b].T + np.sqrt((queries[who] ** 2).sum(1))[:, None] * slack[a:b]
    by_id = np.argsort(ids)
    own = by_id[np.minimum(np.searchsorted(ids, names, sorter=by_id), len(ids) - 1)]
    met = ids[own] == names
    near[met, own[met]] = -np.inf
    chosen = np.broadcast_to(np.arange(len(ids)), near.shape)
    if len(ids) > rerank:
        chosen = np.argpartition(-near, rerank - 1, axis=1)[:, :rerank]
    # einsum adds each row's products in one order, wherever it stands, so that equal vectors have equal scores
    score = np.einsum("qrd,qd->qr", vectors[chosen], queries)
    held = np.take_along_axis(near, chosen, 1)
    score[held == -np.inf] = -np.inf
    best = np.lexsort((ids[chosen], -score), axis=-1)[:, :k]
    score = np.take_along_axis(score, best, 1)
    more = np.empty(0, np.int64)
    if len(ids) > rerank:  # where others may be as near as the last one found, or their codes score as the last one chosen
        least = np.minimum(held.min(1), score[:, -1])
        more = np.flatnonzero(((near >= least[:, None]) & (near > -np.inf)).sum(1) > rerank)
        score[more] = -np.inf
    row, rank = np.nonzero(score > -np.inf)
    out = [(names[row], ids[np.take_along_axis(chosen, best, 1)[row, rank]], score[row, rank])]
    for q in more:
        some = np.flatnonzero((near[q] >= least[q]) & (near[q] > -np.inf))
        exact = np.einsum("rd,d->r", vectors[some], queries[q])
        best = np.lexsort((ids[some], -exact))[:k]
        out.append((np.full(len(best), names[q]), ids[some][best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def measured_probes(index: Index, indexed: DataFrame, is_query, sample: np.ndarray, k: int, target: float, checked: int) -> int:
    """The least number of lists, nearest first, that hold `target` of the true neighbours of some queries; copies are asked once, as
    they find each other in any case and would hide what others need."""
    asked = indexed.where(is_query).orderBy(F.xxhash64("vec_id", F.lit("check"))).limit(checked).select("vec_id", "v").collect()
    asked = list({bytes(r["v"]): r["vec_id"] for r in asked}.items())
    if not asked:
        return 1
    queries, own = np.stack([np.frombuffer(v) for v, _ in asked]), np.array([i for _, i in asked])
    least = np.full(len(asked), -np.inf)  # no neighbour scores less: k rows besides the query itself reach it
    if len(sample) > k:
        least = -np.partition(-(queries @ sample.T), k, axis=1)[:, k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q", pa.int32()), ("vec_id", pa.int64()), ("list", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            ids, home = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(len(ids), -1)
            scores = queries @ vectors.T
            for q in range(len(own)):
                hits = np.flatnonzero((scores[q] >= least[q] - 1e-9 * abs(least[q]) if np.isfinite(least[q]) else scores[q] > -np.inf) & (ids != own[q]))
                hits = hits[np.lexsort((ids[hits], -scores[q, hits]))[:k]]
                if len(hits):
                    yield arrow_rows(schema, [np.full(len(hits), q, np.int32), ids[hits], home[hits], scores[q, hits]])

    turn = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    hits = indexed.select("vec_id", "list", "v").mapInArrow(run, "q int, vec_id long, list int, score double")
    best = hits.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("q", "list").collect()  # k rows a query
    place = np.argsort(np.argsort(-(queries @ index.centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort([place[r["q"], r["list"]] for r in best])
    return 1 + int(needed[min(len(needed) - 1, int(target * len(needed)))]) if len(needed) else 1


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: the rows that take part, one an id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), fine.alias("fine")).where("vec_id is not null and fine").drop("fine")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(
    table: DataFrame, id_col: str, vector_col: str, is_query, k: int = 20, sample_rows: int = SAMPLE_ROWS,
    lists: int = LISTS, parts: int = PARTS, block_rows: int = BLOCK_ROWS, rerank: int = RERANK, target: float = TARGET, checked: int = CHECKED,
) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: of the id column (named vec_id), which rows are queries."""
    rows = _vectors(table, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    kind = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return table.sparkSession.createDataFrame([], kind)
    total = sizes[0]["count"]
    rows = rows.where(F.size("v") == sizes[0]["n"])
    share = min(1_000_000, -(-1_000_000 * sample_rows // total))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < share).select("v").toArrow()
    sample = _matrix(drawn.column("v").combine_chunks()) if drawn.num_rows else np.zeros((0, sizes[0]["n"]))
    if not len(sample):
        sample = np.zeros((1, sizes[0]["n"]))
    index = fit(sample[np.lexsort(sample.T[:2])], max(lists, round(total**0.5)), parts)
    count = len(index.centroids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("list", pa.int32()), ("v", pa.binary()), ("codes", pa.binary())])
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(1))
                home, codes = index.encode(values)
                yield arrow_rows(schema, [batch.column(0), home.astype(np.int32), [x.tobytes() for x in values], [x.tobytes() for x in codes]])

    coded = rows.mapInArrow(encode, "vec_id long, list int, v binary, codes binary")
    indexed = materialise(coded.groupBy("vec_id").agg(F.min_by(F.struct("list", "v", "codes"), F.xxhash64("v")).alias("x")).select("vec_id", "x.*"), "index")
    held = np.zeros(count, np.int64)
    for r in indexed.groupBy("list").count().collect():  # one row a list
        held[r["list"]] = r["count"]
    shelf_of, blocks = shelves(held, index.centroids, block_rows)
    probes = measured_probes(index, indexed, is_query, sample, k, target, checked)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("shelf", pa.int32()), ("q", pa.binary()), ("lists", pa.list_(pa.int32()))])
        for batch in batches:
            out = []
            for query_id, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                order = np.argsort(-(index.centroids @ np.frombuffer(q)), kind="stable")
                enough = int(np.searchsorted(np.cumsum(held[order]), k + 1)) + 1
                probed = order[: max(probes, enough)]
                probed = probed[held[probed] > 0]
                of = shelf_of[probed]
                out += [(query_id, int(shelf), q, probed[of == shelf]) for shelf in np.unique(of)]
            if out:
                yield arrow_rows(schema, list(zip(*out, strict=True)))

    asked = indexed.where(is_query).select("vec_id", "v").mapInArrow(probe, "query_id long, shelf int, q binary, lists array<int>")
    shelf = F.get(F.lit(shelf_of.tolist()), F.col("list")).cast("int")
    parts_of = F.get(F.lit(blocks.tolist()), F.col("shelf"))
    # Blocks of rows are packed once; each gets a copy of its shelf's queries.
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), parts_of).cast("int")
    packed = indexed.withColumn("shelf", shelf).withColumn("block", block)
    packed = packed.groupBy("shelf", "block").agg(F.collect_list(F.struct("vec_id", "list", "v", "codes")).alias("rows"))
    turns = F.pmod(F.xxhash64("query_id"), F.lit(max(1, total // 20_000)))
    sets = asked.withColumn("turn", turns).groupBy("shelf", "turn").agg(F.collect_list(F.struct("query_id", "q", "lists")).alias("queries"))
    copies = sets.withColumn("block", F.explode(F.sequence(F.lit(0), parts_of.cast("int") - 1)))
    met = packed.join(copies.hint("shuffle_hash"), ["shelf", "block"]).select("rows", "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for j in range(batch.num_rows):
                own, asking = batch.column(0)[j].values, batch.column(1)[j].values
                ids, home = own.field("vec_id").to_numpy(), own.field("list").to_numpy()
                order = np.lexsort((ids, home))
                ids, home = ids[order], home[order]
                vectors = np.frombuffer(b"".join(own.field("v").to_pylist())).reshape(len(ids), -1)[order]
                codes = np.frombuffer(b"".join(own.field("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                built = index.built(home, codes)
                names = asking.field("query_id").to_numpy()
                queries = np.frombuffer(b"".join(asking.field("q").to_pylist())).reshape(len(names), -1)
                lists = asking.field("lists")
                place = np.full(count, -1)
                place[np.unique(home)] = np.arange(len(np.unique(home)))  # a block may hold no row of a list of its shelf
                here = place[lists.flatten().to_numpy()]
                who = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy())
                probed = np.zeros((len(names), place.max() + 1), bool)
                probed[who[here >= 0], here[here >= 0]] = True
                step = max(1, min(256, 8_000_000 // (min(rerank, len(ids)) * vectors.shape[1] + len(ids))))
                for at in range(0, len(names), step):
                    some = slice(at, at + step)
                    yield arrow_rows(schema, list(best_of_block(vectors, built, ids, home, queries[some], names[some], probed[some], k, rerank)))

    found = met.mapInArrow(meet, "query_id long, vec_id long, score double")
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_vector_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
