import io
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.cases import documents, frame
from weftline.llm.media import area_resize, decode, difference_hash, encode_pgm, media_features, store_payloads

GREY = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20


def bmp(image, depth=24):
    height, width = image.shape[:2]
    stride = (width * depth + 31) // 32 * 4
    body = b"".join(image[y, :, ::-1].tobytes().ljust(stride, b"\0") for y in range(height - 1, -1, -1))
    return struct.pack("<2sIHHI IiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, width, height, 1, depth, 0, len(body), 0, 0, 0, 0) + body


def test_netpbm_and_bmp():
    assert (decode(encode_pgm(GREY)) == GREY).all()
    assert (decode(b"P2 # c\n4 3\n255\n" + b" ".join(b"%d" % v for v in GREY.ravel())) == GREY).all()
    assert decode(b"P1\n3 2\n101\n010\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    colour = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (decode(b"P6\n7 5\n255\n" + colour.tobytes()) == colour).all()
    assert (decode(bmp(colour)) == colour).all()
    assert decode(b"P5\n2 1\n65535\n\xff\xff\x00\x00").tolist() == [[255, 0]]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 6), st.integers(1, 6))
def test_area_resize(h, w, a, b):
    image = np.random.default_rng(h * 10 + w).integers(0, 256, (h, w)).astype(np.uint8)
    big = np.repeat(np.repeat(image, a, 0), b, 1).astype(float)  # every small cell is a whole number of these
    want = big.reshape(a, h, b, w).mean((1, 3))
    assert np.allclose(area_resize(image, a, b), want)


def test_features(spark):
    rows = [(1, encode_pgm(GREY)), (2, None), (3, b"P5\n9 9\n255\nx"), (4, b"zz"), (5, b"P5\n0 3\n255\n"), (6, encode_pgm(GREY))]
    got = {r["media_id"]: r for r in media_features(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    assert (got[1]["height"], got[1]["width"], got[1]["planes"]) == (3, 4, 1)
    assert np.load(io.BytesIO(bytes(got[1]["tile"]))).shape == (16, 16)
    assert got[1]["dhash"] == got[6]["dhash"] == difference_hash(GREY)
    assert got[2]["error"] == "null" and all(got[i]["error"] and got[i]["tile"] is None for i in (3, 4, 5))


def test_payloads_round_trip(spark):
    rows = documents() + [(900, "x" * 64), (901, "y" * 65)]
    stored = {r["media_id"]: r for r in store_payloads(frame(spark, rows)).collect()}
    for doc_id, text in rows:
        data = (text or "").encode()
        want = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert decode(bytes(stored[doc_id]["media"])).tobytes() == want
        assert stored[doc_id]["n_bytes"] == len(data)


def test_query_rows(spark, tmp_path):
    from weftline.llm.media import op10_media

    rows = documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op10_media(spark, str(tmp_path)).collect()}
    features = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        want = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(want), brute.sha(want), zlib.crc32(want[-64:]))
        assert features.setdefault(text or "", r["feature"]) == r["feature"]
