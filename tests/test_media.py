from weftline.plans import QUERIES


def test_largest_media_has_its_size(spark):
    got = QUERIES["largest_media"](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == ["p_brand", "p_partkey", "size"]
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    want = {}
    for r in sorted(part, key=lambda r: (-r["p_size"], r["p_partkey"])):
        if r["p_size"] >= 10:
            want.setdefault(r["p_brand"], (r["p_partkey"], r["p_size"]))
    assert {r["p_brand"]: (r["p_partkey"], r["size"]) for r in got.collect()} == want
