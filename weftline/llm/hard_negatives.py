"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector y gets one more component, the root of M - |y|^2, so that all have the norm M of the longest. From an anchor a, whose
added component is 0, the squared distance is then |a|^2 + M - 2 a·y: the nearest has the largest inner product, and a window
of scores is an annulus of distances.

1. Rows become whole-number vectors. Of copies with one label only as many as an answer can name stay to be found (the
   smallest ids); all stay anchors.
2. On the driver a tree over a bounded sample (`sample_rows`, drawn by hash) is grown whose leaves deal all rows; what distances
   each leaf holds along its path is then measured on all rows. Leaves are cut into blocks of about `block_rows` by hash.
3. A block grows its own tree. For a question leaves are opened nearest first inside its annuli, until no leaf can hold a better
   one than the k-th found; distances along the paths bound what a leaf can hold.
4. Each question first goes to the one leaf of the upper tree that is nearest, then, with the k-th score found there, to
   the other leaves that can still hold better ones. So all answers are exact; bounds have room for rounding.
5. Positives are asked for first: the first of the anchor's label. Their scores make the windows of the second search, among other
   labels; the windows of an anchor travel together.

Edge cases: rows with a null id, label or vector, an empty vector or a null or non-finite component take no part, nor do vectors
of another length than most (of equally many the shorter); rows alike in id, label and vector count once; rows of one id that
differ are rows of their own, but a row is never compared with one of its id; anchors without other rows of their label, and
windows that hold nothing, have no row; a negative positive score has an empty window. Scores are whole numbers of 64 bits; one that
does not fit is an error. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, free, materialise

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
SAMPLE_ROWS, BLOCK_ROWS, LEAF_ROWS, SET_ROWS = 8_000, 8_000, 128, 2_000
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Tree:
    """Inner nodes by number, each with its vantage point; leaves by number, each with the nodes above it."""

    points: np.ndarray  # augmented vantage points
    radius: list[float] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)  # a node, or ~leaf
    outside: list[int] = field(default_factory=list)
    paths: list[list[int]] = field(default_factory=list)  # of each leaf
    low: np.ndarray | None = None  # (leaf, step of its path): least and most distance of its rows
    high: np.ndarray | None = None

    def deal(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances along its path, NaN behind its end) of augmented rows."""
        leaf, steps = np.zeros(len(rows), np.int64), np.full((len(rows), max(1, *map(len, self.paths))), np.nan)
        stack = [(0 if self.radius else ~0, np.arange(len(rows)), 0)]
        while stack:
            node, some, depth = stack.pop()
            if node < 0:
                leaf[some] = ~node
                continue
            away = distances(rows[some], self.points[node])
            steps[some, depth] = away
            near = away <= self.radius[node]
            stack += [(self.inside[node], some[near], depth + 1), (self.outside[node], some[~near], depth + 1)]
        return leaf, steps

    def scores(self, asked: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each question (row) can have in each leaf (column), with room for rounding."""
        reach = (asked**2).sum(1) + norm
        near, far = np.zeros((len(asked), len(self.paths))), np.full((len(asked), len(self.paths)), np.inf)
        if self.radius:
            away = np.sqrt(np.maximum(reach[:, None] - 2 * (asked @ self.points[:, :-1].T), 0))
            for leaf, path in enumerate(self.paths):
                for step, node in enumerate(path):
                    d, low, high = away[:, node], self.low[leaf, step], self.high[leaf, step]
                    np.maximum(near[:, leaf], np.maximum(d - high, low - d), out=near[:, leaf])
                    np.minimum(far[:, leaf], d + high, out=far[:, leaf])
        room = 1e-9 * reach[:, None] + 1e-3
        return (reach[:, None] - far**2) / 2 - room, (reach[:, None] - near**2) / 2 + room


def augmented(rows: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([rows, np.sqrt(np.maximum(norm - (rows**2).sum(1), 0))[:, None]], 1)


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(1))


def grown(rows: np.ndarray, leaf_rows: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree over augmented rows, and the rows of each leaf. Of some candidates the one with the widest spread of distances
    becomes the vantage point; half of the rows lie inside its radius. Rows that are all equally far stay one leaf."""
    tree, points, leaves = Tree(np.zeros((0, rows.shape[1]))), [], []
    stack: list[tuple[np.ndarray, list[int], tuple[list[int], int] | None]] = [(np.arange(len(rows)), [], None)]
    while stack:
        some, path, slot = stack.pop()
        best = None
        if len(some) > leaf_rows:
            seen = rows[some[:: max(1, len(some) // 64)]]
            for at in some[:: max(1, len(some) // 8)]:
                spread = distances(seen, rows[at]).std()
                if best is None or spread > best[0]:
                    best = spread, at
            away = distances(rows[some], rows[best[1]])
            radius = float(np.median(away))
            near = away <= radius
            if near.all():  # the median is the greatest: what is nearer goes inside
                near = away < radius
                radius = float(away[near].max()) if near.any() else radius
            if near.all() or not near.any():
                best = None
        if best is None:
            number = ~len(leaves)
            leaves.append(some)
            tree.paths.append(path)
        else:
            number = len(points)
            points.append(rows[best[1]])
            tree.radius.append(radius)
            tree.inside.append(0)
            tree.outside.append(0)
            stack += [(some[near], [*path, number], (tree.inside, number)), (some[~near], [*path, number], (tree.outside, number))]
        if slot:
            slot[0][slot[1]] = number
    if points:
        tree.points = np.array(points)
    return tree, leaves


def measured(tree: Tree, rows: np.ndarray, leaves: list[np.ndarray]) -> None:
    """Sets the distances that each leaf's rows have along its path."""
    deepest = max(1, *map(len, tree.paths))
    tree.low, tree.high = np.zeros((len(leaves), deepest)), np.zeros((len(leaves), deepest))
    for leaf, some in enumerate(leaves):
        for step, node in enumerate(tree.paths[leaf]):
            away = distances(rows[some], tree.points[node])
            tree.low[leaf, step], tree.high[leaf, step] = away.min(), away.max()


def products(a: np.ndarray, b: np.ndarray, norm: float) -> np.ndarray:
    """Whole-number inner products. Below 2 ** 53 no partial sum is rounded; beyond they are Python's integers."""
    if norm < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, b))
    found = next(whole) @ next(whole).T
    return np.array([[int(x) for x in r] for r in found], np.int64).reshape(len(a), len(b))


@dataclass
class Questions:
    ids: np.ndarray  # of the rows asked for, which are no answers
    labels: np.ndarray
    vectors: np.ndarray
    of: np.ndarray  # of each window, its question
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray  # k-th score known before


def answers(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, asked: Questions, k: int, same: bool, norm: float, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the best k rows of a block for each window, greatest first, ties by id; NONE fills up."""
    order = np.argsort(ids, kind="stable")
    ids, labels, rows = ids[order], labels[order], rows[order]
    wide = augmented(rows, norm)
    tree, leaves = grown(wide, leaf_rows)
    measured(tree, wide, leaves)
    leaves = [np.sort(x) for x in leaves]
    lowest, highest = tree.scores(asked.vectors, norm)
    nearest_first = np.argsort(-highest, axis=1, kind="stable")
    scores, found = np.full((len(asked.of), k), NONE), np.full((len(asked.of), k), MOST)
    live = np.arange(len(asked.of))
    for step in range(len(leaves)):
        leaf = nearest_first[asked.of[live], step]
        bar = np.maximum(asked.least[live], scores[live, k - 1])
        top = highest[asked.of[live], leaf]
        going = top >= np.maximum(bar, asked.low[live])  # no later leaf holds more
        live, leaf = live[going], leaf[going]
        if not len(live):
            break
        opened = lowest[asked.of[live], leaf] <= asked.high[live]
        for one in np.unique(leaf[opened]):
            here, windows = leaves[one], live[opened & (leaf == one)]
            some, back = np.unique(asked.of[windows], return_inverse=True)
            score = products(asked.vectors[some], rows[here], norm)
            apt = ((labels[here] == asked.labels[some, None]) == same) & (ids[here] != asked.ids[some, None])
            score = np.where(apt, score, NONE)[back]
            bar = np.maximum(np.maximum(asked.least[windows], scores[windows, k - 1]), np.maximum(asked.low[windows], NONE + 1))
            fits = (score >= bar[:, None]) & (score <= asked.high[windows, None])
            better = fits.any(1)
            if better.any():
                at = windows[better]
                every = np.concatenate([scores[at], np.where(fits[better], score[better], NONE)], 1)
                names = np.concatenate([found[at], np.broadcast_to(ids[here], (len(at), len(here)))], 1)
                turn = np.lexsort((names, -np.maximum(every, NONE + 1)), axis=1)[:, :k]
                scores[at], found[at] = np.take_along_axis(every, turn, 1), np.take_along_axis(names, turn, 1)
    return scores, found


def _bytes(rows: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as 32-bit integers where all of a row fit, else as doubles."""
    narrow = (np.abs(rows) < 2.0**31).all(1)
    return [(r.astype("<i4") if n else r.astype("<f8")).tobytes() for r, n in zip(rows, narrow, strict=True)]


def _rows(column: list[bytes], dims: int) -> np.ndarray:
    return np.array([np.frombuffer(x, "<i4" if len(x) == 4 * dims else "<f8") for x in column], np.float64).reshape(len(column), dims)


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, dims, norm, v: each row that takes part once, its components floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = table.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.when(fine, v).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("norm", pa.float64()), ("v", pa.binary())])
        for batch in batches:
            column = batch.column(2)
            dims = np.diff(column.offsets.to_numpy())
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale)) + 0.0  # no negative zero
            starts = np.concatenate([[0], np.cumsum(dims)])
            for n in np.unique(dims):
                at = np.flatnonzero(dims == n)
                rows = flat[starts[at][:, None] + np.arange(n)]
                yield arrow_rows(schema, [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), np.full(len(at), n, np.int32), (rows**2).sum(1), _bytes(rows)])

    found = known.where("vec_id is not null and label is not null and v is not null").mapInArrow(run, "vec_id long, label string, dims int, norm double, v binary")
    return found.distinct()


def _top(rows: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("ask", "no").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: of the id column, named vec_id."""
    spark = table.sparkSession
    vectors = materialise(whole_vectors(table, id_col, vector_col, label, scale), "vectors")
    usual = vectors.groupBy("dims").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims, norm = usual[0]["dims"], usual[0]["norm"] * (1 + 1e-12) + 1
    alike = vectors.where(F.col("dims") == dims)
    anchors = materialise(alike.where(is_anchor).select(F.monotonically_increasing_id().alias("ask"), "vec_id", "label", "v"), "anchors")
    # An answer names at most so many rows of one vector and label, besides the anchor itself.
    copy = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    needed = alike.withColumn("copy", copy).where(F.col("copy") <= max(positives, negatives) + 1).select("vec_id", "label", "v")

    share = min(1_000_000, -(-1_000_000 * sample_rows // usual[0]["n"]))
    drawn = alike.where(F.pmod(F.xxhash64("v", F.lit("sample")), F.lit(1_000_000)) < share).select("v").distinct().orderBy("v").limit(2 * sample_rows).toArrow()
    sample = _rows(drawn.column("v").to_pylist(), dims) if drawn.num_rows else np.zeros((1, dims))
    leaf_count = max(1, min(-(-usual[0]["n"] // block_rows), len(sample) // 8))
    upper, _ = grown(augmented(sample, norm), max(1, -(-len(sample) // leaf_count)))
    deepest = max(1, *map(len, upper.paths))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.binary()), ("leaf", pa.int32()), ("steps", pa.list_(pa.float64()))])
        for batch in batches:
            if batch.num_rows:
                leaf, steps = upper.deal(augmented(_rows(batch.column(2).to_pylist(), dims), norm))
                yield arrow_rows(schema, [*batch.columns, leaf.astype(np.int32), list(steps)])

    dealt = materialise(needed.mapInArrow(deal, "vec_id long, label string, v binary, leaf int, steps array<double>"), "dealt")
    held = np.zeros(len(upper.paths), np.int64)
    upper.low, upper.high = np.full((len(held), deepest), np.inf), np.full((len(held), deepest), -np.inf)
    step = [F.nanvl(F.get("steps", F.lit(i)), F.lit(None)).alias(f"s{i}") for i in range(deepest)]
    ends = [f(f"s{i}").alias(f"{n}{i}") for i in range(deepest) for f, n in ((F.min, "low"), (F.max, "high"))]
    for r in dealt.select("leaf", *step).groupBy("leaf").agg(F.count("*").alias("n"), *ends).collect():  # one row a leaf
        held[r["leaf"]] = r["n"]
        for i in range(len(upper.paths[r["leaf"]])):
            upper.low[r["leaf"], i], upper.high[r["leaf"], i] = r[f"low{i}"], r[f"high{i}"]
    parts = F.get(F.lit(np.maximum(1, -(-held // block_rows)).tolist()), F.col("leaf"))
    part = F.pmod(F.xxhash64("vec_id", "v", F.lit("block")), parts).cast("int")
    blocks = dealt.withColumn("part", part).groupBy("leaf", "part").agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("rows"))
    blocks = materialise(blocks, "blocks")
    free(dealt)
    sets = max(1, anchors.count() // SET_ROWS)
    window = "array<struct<no:int,low:long,high:long,least:long>>"

    def read_questions(ids: list, labels: list, vectors_: list, windows: list) -> Questions:
        flat = [(i, w["low"], w["high"], w["least"]) for i, many in enumerate(windows) for w in many]
        of, lows, highs, least = (np.array([d if x is None else x for x in c], np.int64) for c, d in zip(zip(*flat, strict=True), (0, NONE, MOST, NONE), strict=True))
        return Questions(np.array(ids, np.int64), np.array(labels, object), _rows(vectors_, dims), of, lows, highs, least)

    def sent(first: bool):
        """To which leaves each question goes: the nearest one first; then the others that can hold better ones."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = read_questions(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())
                lowest, highest = upper.scores(q.vectors, norm)
                lowest[:, held == 0], highest[:, held == 0] = np.inf, -np.inf
                nearest, need = highest.argmax(1), np.zeros(highest.shape, bool)
                bar = np.maximum(q.low, q.least)
                for w, one in enumerate(q.of):
                    need[one] |= (highest[one] >= bar[w]) & (lowest[one] <= q.high[w])
                alone = np.arange(highest.shape[1]) == nearest[:, None]
                asks, leaf = np.nonzero(need & alone if first else need & ~alone)
                if len(asks):
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(asks)) for c in batch.columns), pa.array(leaf.astype(np.int32))], names=["ask", "vec_id", "label", "v", "windows", "leaf"])

        return run

    def meeting(k: int, same: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("ask", pa.int64()), ("no", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
            for batch in batches:
                for j in range(batch.num_rows):
                    own, asking = batch.column(0)[j].values, batch.column(1)[j].values
                    windows = asking.field("windows").to_pylist()
                    q = read_questions(*(asking.field(c).to_pylist() for c in ("vec_id", "label", "v")), windows)
                    held_labels = np.array(own.field("label").to_pylist(), object)
                    scores, ids = answers(own.field("vec_id").to_numpy(), held_labels, _rows(own.field("v").to_pylist(), dims), q, k, same, norm, leaf_rows)
                    at, place = np.nonzero(scores != NONE)
                    asks, no = asking.field("ask").to_numpy(), np.array([w["no"] for many in windows for w in many], np.int32)
                    yield arrow_rows(schema, [asks[q.of[at]], no[at], scores[at, place], ids[at, place]])

        return run

    def visited(wanted: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        asked = wanted.groupBy("ask").agg(F.collect_list(F.struct("no", "low", "high", "least")).cast(window).alias("windows"))
        asked = asked.join(anchors, "ask").select("ask", "vec_id", "label", "v", "windows")
        away = asked.mapInArrow(sent(first), f"ask long, vec_id long, label string, v binary, windows {window}, leaf int")
        turn = F.pmod(F.xxhash64("ask"), F.lit(sets))
        packed = away.withColumn("turn", turn).groupBy("leaf", "turn").agg(F.collect_list(F.struct("ask", "vec_id", "label", "v", "windows")).alias("questions"))
        copies = packed.withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
        met = blocks.join(copies.hint("shuffle_hash"), ["leaf", "part"]).select("rows", "questions")
        return met.mapInArrow(meeting(k, same), "ask long, no int, score long, vec_id long")

    def found(wanted: DataFrame, k: int, same: bool) -> DataFrame:
        """ask, no, score, vec_id, rank: the k best of each window."""
        wanted = materialise(wanted, "wanted")
        one = materialise(_top(visited(wanted.withColumn("least", F.lit(None).cast("long")), k, same, True), k), "nearest")
        bar = one.where(F.col("rank") == k).select("ask", "no", F.col("score").alias("least"))
        two = visited(wanted.join(bar, ["ask", "no"], "left"), k, same, False)
        out = materialise(_top(one.drop("rank").unionByName(two), k), "best")
        free(wanted, one)
        return out

    unbounded = F.lit(None).cast("long")
    own = found(anchors.select("ask", F.lit(0).alias("no"), unbounded.alias("low"), unbounded.alias("high")), positives, True)
    known = own.select("ask", F.col("rank").alias("no"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    wide = "cast(positive_score as decimal(20,0))"
    ends = known.where("positive_score >= 0").select("ask", "no", F.expr(f"({wide} * {low} + 99) div 100").alias("low"), F.expr(f"({wide} * {high}) div 100").alias("high"))
    others = found(ends.where("low <= high"), negatives, False).select("ask", "no", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = others.join(known, ["ask", "no"]).join(anchors.select("ask", F.col("vec_id").alias("anchor_id")), "ask")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table, "vec_id", "embedding", label, F.col("vec_id") % 50 == 0)


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
