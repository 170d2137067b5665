import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.operators import cutoff, identity, merge


def test_streaks_in_parts_like_one_window(spark):
    rng = random.Random(3)
    start, bound = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5)
    rows = []
    for run in (*range(25), None):
        odds = rng.random()
        for p in range(rng.randint(0, 60)):
            day = rng.choice([0, 0, 0, 1]) if rng.random() < odds else rng.choice([6, None])
            rows.append((run, p * rng.choice([1, 1, 1, 1]), None if day is None else start + dt.timedelta(days=day), "x"))
    table = spark.createDataFrame(rows, "run int, position long, at timestamp, island string").repartition(3)
    for streak in (1, 3, 8):
        want = cutoff.until_streak(table.drop("island"), "run", "position", "at", F.lit(bound), streak)
        want = sorted(map(str, want.collect()))
        for width in (1, 4, 7, 1_000):
            got = cutoff.until_streak_in_parts(table, "run", "position", "at", F.lit(bound), streak, width).drop("island")
            assert sorted(map(str, got.collect())) == want


def test_one_long_run_goes_to_many_tasks(spark):
    rows = spark.range(200_000).selectExpr("1 run", "id position", "timestamp '2024-01-06' - make_interval(0, 0, 0, if(id % 8 = 7 and id < 190000, 0, 3)) at")
    got = cutoff.until_streak_in_parts(rows, "run", "position", "at", F.lit(dt.datetime(2024, 1, 5)), 8, width=5_000)
    assert got.count() == 190_000 // 8


def folded(readings):
    """Thread after thread, reading after reading, as lists of dicts."""
    kept = None
    for new in readings:
        if kept is None:
            kept = list(new)
            continue
        lead, rest = (new, kept) if len(new) >= len(kept) else (kept, new)
        out = []
        for c in lead + rest:
            if any((o["author"] or "", o["text"] or "") == (c["author"] or "", c["text"] or "") for o in out):
                continue
            prior = next((k for k in reversed(kept) if (k["author"] or "", k["text"] or "") == (c["author"] or "", c["text"] or "")), None)
            if prior is not None and prior is not c:
                likes = c["likes"] if prior["likes"] is None else max(c["likes"] or 0, prior["likes"])
                c = {**c, "likes": likes, "at": c["at"] if prior["at"] is None else prior["at"]}
            out.append(c)
        kept = out
    return kept


def test_threads_like_a_fold(spark):
    rng = random.Random(9)
    threads = {
        t: [[{"author": rng.choice(["a", "b", None]), "text": rng.choice(["x", "y", "z", ""]), "likes": rng.choice([None, 1, 5, 9]), "at": rng.choice([None, "1h", "2h"])} for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 5))]
        for t in range(80)
    }
    rows = [(t, s, p, c["author"], c["text"], c["likes"], c["at"]) for t, readings in threads.items() for s, reading in enumerate(readings) for p, c in enumerate(reading)]
    rng.shuffle(rows)
    table = spark.createDataFrame([*rows, (None, 0, 0, "a", "x", 1, None)], "post int, seq int, position int, author string, text string, likes long, at string").repartition(5)
    got = {}
    for r in sorted(merge.folded_threads(table, "post", "seq", "position").collect(), key=lambda r: (r["post"], r["place"])):
        got.setdefault(r["post"], []).append({k: r[k] for k in ("author", "text", "likes", "at")})
    assert got == {t: folded(readings) for t, readings in threads.items()}
    assert merge.folded_threads(table.limit(0), "post", "seq", "position").collect() == []


def test_lost_likes_of_a_shorter_reading(spark):
    rows = [(1, 1, p, "a", str(p), 1, None) for p in range(3)] + [(1, 2, 0, "a", "0", 5, None)]
    got = merge.folded_threads(spark.createDataFrame(rows, "post int, seq int, position int, author string, text string, likes long, at string"), "post", "seq", "position")
    assert {(r["text"], r["likes"]) for r in got.collect()} == {("0", 1), ("1", 1), ("2", 1)}


def test_records_over_chains_of_keys(spark):
    rng = random.Random(4)
    entries = [(i, [rng.choice(["", None, *map(str, range(400))]) for _ in range(rng.randint(0, 3))]) for i in range(300)]
    entries += [(1_000 + i, [f"chain{i}", f"chain{i + 1}"]) for i in range(90)] + [(2_000 + i, ["hub", f"own{i}"]) for i in range(300)] + [(3_000, None), (3_001, []), (5, ["again"]), (6, ["again"])]
    least = {i: i for i, _ in entries}
    while True:
        of_key = {}
        for i, keys in entries:
            for k in keys or []:
                if k:
                    of_key[k] = min(of_key.get(k, i), least[i])
        now = {i: min([least[i], *(of_key[k] for j, keys in entries if j == i for k in keys or [] if k)]) for i in least}
        if now == least:
            break
        least = now
    got = identity.same_record(spark.createDataFrame(entries, "entry int, keys array<string>"), "entry", "keys").collect()
    assert len(got) == len(least) and {r["entry"]: r["record"] for r in got} == least
