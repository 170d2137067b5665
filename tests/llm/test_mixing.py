import random
from collections import Counter

from weftline.llm.mixing import apportioned, mixed, targets


def fair(votes, seats):
    """Seats one by one to the highest quotient, the first of equals."""
    won = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def refilled(sizes, weights=(5, 2, 1), limit=3):
    """Targets by resharing what is over, again and again."""
    total, target, live = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while live:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in live)
        level = left / sum(weights[i % 3] for i in live)
        over = {i for i in live if level * weights[i % 3] > limit * sizes[i]}
        for i in over or live:
            target[i] = limit * sizes[i] if over else level * weights[i % 3]
        live -= over or live
    return target


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 6) for r in rows], "doc_id long, text string, source string, name string, size int, quota int")


def test_quotas_like_one_by_one(spark):
    rng = random.Random(4)
    groups = [([rng.choice((0, 1, 5, 5, 40, 700)) for _ in range(rng.randint(1, 9))], rng.choice((0, 1, 3, 17, 200))) for _ in range(40)]
    rows = [(g, i, v, s) for g, (votes, s) in enumerate(groups) for i, v in enumerate(votes)]
    got = {(r["g"], r["i"]): r["quota"] for r in apportioned(spark.createDataFrame(rows, "g int, i int, v long, s long"), "v", "s", ("g",), ("i",)).collect()}
    assert got == {(g, i): n for g, (votes, s) in enumerate(groups) for i, n in enumerate(fair(votes, s))}


def test_targets_like_resharing(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = [rng.choice((0, 1, 10, 300, 5_000)) for _ in range(rng.randint(1, 12))]
        rows = [(f"={k:03}", n, 1) for k, n in enumerate(sizes[:-1])] + [("", sizes[-1], 1)]
        got = sorted(targets(spark.createDataFrame(rows, "name string, source_size long, docs long")).collect(), key=lambda r: (r["name"] == "", r["name"]))
        assert all(abs(r["target"] - t) < 1e-6 for r, t in zip(got, refilled(sizes), strict=True))


def documents():
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(("a", "b", "b", "b", "b", "c", "Z", "é", None))) for i in range(900)]
    return rows + [(5_000, "long " * 30_000, "b"), (5_001, None, "a"), (5_002, "", "only empty"), (None, "a b c", "c"), (None, "d e", None)] + [(7, "same row", "c")] * 5


def test_taken_near_targets_and_bounded(spark):
    rows = documents()
    for shard_docs in (1_000, 50):
        got = mixed(table(spark, rows), shard_docs=shard_docs).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        sizes, source = Counter(), {i: s for i, _, s in rows if i not in (None, 7)}
        for _, t, s in rows:
            sizes[s] += len((t or "").split())
        names = sorted((s for s in sizes if s is not None)) + [None]
        want = dict(zip(names, refilled([sizes[s] for s in names]), strict=True))
        taken = Counter()
        for r in got:
            if r["doc_id"] in source:
                s = source[r["doc_id"]]
                assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        for target, total in {(r["target"], r["source_size"]) for r in got}:
            taken[target] = sum(r["taken"] for r in got if (r["target"], r["source_size"]) == (target, total))
            assert abs(taken[target] - target) <= 0.01 * target + 2
        assert abs(sum(taken.values()) - sum(sizes.values())) <= 0.005 * sum(sizes.values())


def test_reruns_agree_however_rows_lie(spark):
    rows = documents()
    one, other = (Counter(map(tuple, mixed(table(spark, r).repartition(n)).collect())) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert one == other


def test_empty_and_wordless(spark):
    assert mixed(table(spark, [])).collect() == []
    got = mixed(table(spark, [(1, None, "a"), (2, " \t", None)])).collect()
    assert {(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
