from collections import defaultdict

import corpus_pipeline as pipeline
from tests.llm import brute
from weftline.llm.language_id import identify, trained

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    functions = dict(pipeline.STAGES)
    first = functions["language"](spark, docs, SF)
    said = {r["doc_id"]: r for r in identify(docs, trained(docs)).collect()}
    kept = rows_of(first)
    assert first.columns == columns
    assert set(kept) == {i for i, r in said.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    second = functions["near_duplicates"](spark, first, SF)
    groups = brute.jaccard_components([(i, r["text"]) for i, r in kept.items()], 5, 80)
    left = rows_of(second)
    assert second.columns == columns and set(left) == {i for i, _, least in groups if i == least}
    third = functions["repeats"](spark, second, SF)
    want = {}
    for i, n, gone, words in brute.kept_words([(i, r["text"]) for i, r in left.items()]):
        if gone == 0:
            want[i] = left[i]["text"]
        elif gone < n:
            want[i] = words.decode()
    found = rows_of(third)
    assert third.columns == columns and third.schema == docs.schema
    assert {i: r["text"] for i, r in found.items()} == want
    assert all(r["n_chars"] == len(want[i]) for i, r in found.items() if want[i] != left[i]["text"])
    places = defaultdict(list)
    packed = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == set(want)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096


def test_hard_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "the one and the other of it", "en", None, 1), (3, None, "en", "s", 0)], docs.schema)
    for table in (empty, odd):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns
            out.collect()
    assert len(pipeline.language(spark, odd, SF).collect()) == 1


def test_one_row_of_each_group_whatever_its_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copied, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    near = lambda text: f"{text} end"
    clean = [f"only {i} " + " ".join(f"u{i}w{j}" for j in range(20)) for i in range(4)]
    rows = [(1, copied), (None, near(copied)), (None, clean[0]), (None, clean[1])]  # a numbered text with a copy of null id
    rows += [(None, other), (None, near(other)), (None, other)]  # null ids only
    rows += [(7, near(copied)), (7, clean[2]), (7, clean[3])]  # a repeated id, one text of which is a copy
    rows += [(9, third), (9, near(third)), (9, third), (8, near(third)), (8, near(third))]  # copies under one id
    rows += [(None, None), (None, None), (5, ""), (5, "")]  # no words: no copies
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    for parts in (1, 3):
        got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, table.repartition(parts), SF).collect()]
        others = [x for x in got if x[1] not in (other, near(other))]
        want = [(1, copied), (None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (8, near(third)), (None, None), (None, None), (5, ""), (5, "")]
        assert sorted(others, key=str) == sorted(want, key=str)
        assert len(got) == len(others) + 1 and [i for i, t in got if t in (other, near(other))] == [None]


def test_mixed_and_one_word_texts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = {k: [f"{k}{x}{y}" for x in "aeiou" for y in "lmnrst"] for k in ("de", "en", "es", "fr")}
    learned = [(i, " ".join([*own[k][i % 15 :], "mi"]), k) for i in range(80) for k in own]
    mixed = lambda *parts: " ".join(w for k, n in parts for w in own[k][:n])
    clean = [mixed(("de", 18), ("en", 16), ("fr", 6)), mixed(("de", 15), ("en", 15), ("es", 3)), mixed(*((k, 10) for k in own)), "mi", "mi mi"]
    other = ["\u65e5\u672c\u8a9e \u306e \u6587\u7ae0", "12 !!", None]
    rows = [*learned, *((1_000 + i, t, None) for i, t in enumerate([*clean, *other]))]
    table = spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in rows], docs.schema)
    said = {r["doc_id"]: r["score"] for r in identify(table.where("doc_id >= 1000"), trained(table)).collect()}
    assert all(said[1_000 + i] < 0.5 for i in range(4))
    kept = [r["text"] for r in pipeline.language(spark, table, SF).collect() if r["doc_id"] >= 1_000]
    assert sorted(kept) == sorted(clean)
