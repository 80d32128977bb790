"""Names, texts, bits, documents and pixels, case by case."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import bits, documents, localtime, names, pixels, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_media_names(spark):
    v = ["IMG_1234(2).JPG", "Photo (1).jpg", "photo(1)(2).png", "(3).jpg", "no ext", "10.00 AM", ".hidden", "a.jpeg", "", None]
    assert column(spark, v, names.base) == ["IMG_1234", "Photo (1)", "photo(1)", "(3)", "no ext", "10.00 AM", ".hidden", "a", "", None]
    assert column(spark, v, names.copy_number) == [2, None, 2, None, None, None, None, None, None, None]
    assert column(spark, v, names.ext_of) == ["jpg", "jpg", "png", "jpg", "", "", "", "jpeg", "", None]


def test_edited_names(spark):
    long = "A" * 42 + "-edi.jpg"
    assert column(spark, ["a-edited.jpg", "a-EDITED(1).jpg", "b-modifié.png", "a-edit.jpg", long, "edited.jpg"], names.is_edited) == [True, True, True, False, True, False]


def test_export_ids(spark):
    v = ["takeout-20260901T120000Z-001.zip", "x/y/takeout-1-1234.ZIP", "mine.zip", ".zip", "a\\b-001.zip"]
    assert column(spark, v, names.export_id) == ["takeout-20260901T120000Z", "takeout-1", "mine", "default", "b"]


def test_apps_screens_and_bursts(spark):
    v = ["IMG-20200101-WA0001.jpg", "received_123456.jpeg", "xIMG-20200101-WA0001.jpg", "Screenshot_2020.png", "Screenshots.png", "IMG_1_BURST001_COVER.jpg", "00000IMG_00000_BURST20191104123456789_COVER.jpg", "PXL_20230101_123456789.RAW-01.MP.COVER.jpg", "PXL_20230101_123456789.jpg"]
    assert column(spark, v, names.messaging_app) == ["whatsapp", "messenger", *[None] * 7]
    assert column(spark, v, names.is_screenshot_name) == [False, False, False, True, *[False] * 5]
    assert column(spark, v, names.burst_key) == [None] * 5 + ["IMG_1", "BURST20191104123456789", "PXL_20230101_123456789", None]
    assert column(spark, v, names.is_burst_cover)[5:8] == [True, True, True]


@pytest.mark.parametrize(
    ("name", "kind", "reason"),
    [
        ("Takeout/Google Photos/Photos from 2019/a.jpg", "image", None),
        ("Takeout\\Google Photos\\Photos from 2019\\a.jpg", "image", None),
        ("Takeout/Google Photos/Trip/a.jpg", "skip", "album_media"),
        ("Takeout/Google Photos/Trip/a.jpg.json", "sidecar", None),
        ("Takeout/Google Photos/Trip/metadata.json", "skip", "non_sidecar_json"),
        ("Takeout/Google Photos/Trip/", "skip", "directory"),
        ("Takeout/Drive/a.jpg", "skip", "outside_photos"),
        ("a.jpg", "skip", "outside_photos"),
        ("Takeout/Google Photos/x.json", "skip", "non_sidecar_json"),
        ("Takeout/Google Photos/x.txt", "skip", "other"),
        ("Takeout/Google Photos/Bin/a.jpg", "skip", "trash"),
        ("Takeout/Google Photos/Photos from 2019/a-edited.jpg", "skip", "edited"),
        ("Takeout/Google Photos/Photos from 2019/a.dng", "skip", "raw"),
        ("Takeout/Google Photos/Photos from 2019/a.tif", "skip", "other_image"),
        ("Takeout/Google Photos/Photos from 2019/a.mp4", "video", None),
        ("Takeout/Google Photos/Trip/a.mp4", "skip", "album_video"),
        ("Takeout/Google Photos/Trip/sub/a.jpg", "skip", "other"),
    ],
)
def test_members(spark, name, kind, reason):
    r = spark.createDataFrame([(name, 1)], "m string, s long").select(names.classify(F.col("m"), F.col("s")).alias("c")).first()["c"]
    assert (r["kind"], r["reason"]) == (kind, reason)


def test_texts(spark):
    assert column(spark, ["Straße", "É", None, ""], text.casefold) == ["strasse", "é", None, ""]
    assert column(spark, ["a" * 9 + "é", "ab", None, "é" * 9], lambda c: text.truncate_utf8(c, 10)) == ["a" * 9, "ab", None, "é" * 5]
    assert column(spark, ["=1", "+a", "x", None, "\tx", "-"], text.csv_cell) == ["'=1", "'+a", "x", "", "'\tx", "'-"]
    assert column(spark, ["a​b ‮ c", " x\n y ", None], text.strip_unsafe) == ["ab c", "x y", None]
    assert column(spark, ["ok", "yes please", "x" * 400], text.reason) == [None, "yes please", None]
    assert column(spark, ["a|b", "abcdefghij"], lambda c: text.clean_text(c, 6)) == ["a/b", "abcde…"]
    assert column(spark, ["a b/c"], text.url_quote) == ["a%20b%2Fc"]
    good = "https://photos.google.com/photo/AF1QipABCDEFGH"
    assert column(spark, [good, good + "/?x#y", "http" + good[5:], good + " x", "https://photos.google.com/photo/short", "x" * 3000, None], text.photo_url) == [good, good, *[None] * 5]
    assert column(spark, ["My Client 2!", "", None], text.slug) == ["my-client-2", "client", "client"]


def test_bits(spark):
    assert [bits.chunk_bounds(3), bits.chunk_bounds(5)[-1]] == [[(1, 16), (17, 16), (33, 16), (49, 15)], (54, 10)]
    df = spark.createDataFrame([(-1, 0), (5, 5), (-(2**63), 0), (None, 1)], "a long, b long")
    assert [r[0] for r in df.select(bits.hamming(F.col("a"), F.col("b"))).collect()] == [64, 0, 1, None]
    rng = np.random.default_rng(1)
    v = rng.normal(size=64).astype(np.float32)
    want = sum(1 << i for i in range(64) if float(v[i]) > float(np.median(v.astype(float))))
    h = spark.createDataFrame([(v.tolist(),)], "e array<float>").select(bits.vector_hash(F.col("e"), bits.median64(F.col("e")))).first()[0]
    assert h & (2**64 - 1) == want


@pytest.mark.parametrize(
    ("a", "b", "sa", "sb", "window", "ok"),
    [(0, 1, None, None, 60, False), (0, 60, None, None, 60, False), (0, 61, None, None, 60, True), (0, 0, None, None, 60, True), (0, 3600, None, None, 60, True), (None, 5, None, None, 60, True), (0, 0, 0.1, 0.4, 60, False), (0, 0, 0.1, None, 60, True), (0, 3600, None, None, 7200, True), (0, 3000, None, None, 7200, False)],
)
def test_capture_times(spark, a, b, sa, sb, window, ok):
    df = spark.createDataFrame([(a, b, sa, sb)], "a long, b long, sa double, sb double")
    assert df.select(bits.capture_ok(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"), window)).first()[0] is ok


def test_aspects(spark):
    df = spark.createDataFrame([(3000, 2000, 2000, 1333), (4, 3, 3, 4), (0, 1, 1, 1), (None, 1, 1, 1)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(bits.aspect_ok(*map(F.col, "abcd"))).collect()] == [True, False, False, False]


def test_sidecar_documents(spark):
    docs = ['{"title": "a.jpg", "photoTakenTime": {"timestamp": "1566350851"}, "geoData": {"latitude": 1.5, "longitude": 2}, "favorited": true, "people": [{"name": " A "}, {"name": ""}, {"x": 1}], "url": "https://photos.google.com/photo/AF1QipABCDEFGH", "googlePhotosOrigin": {"fromPartnerSharing": {}}}', '﻿{"title": 5, "photoTakenTime": {"timestamp": "0"}, "geoData": {"latitude": 0, "longitude": 0}}', "not json", "[1]", None, "", '{"title": "' + "é" * 3000 + '"}']
    rows = documents.sidecar_fields(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")).orderBy("i").collect()
    r = rows[0]
    assert (r.title, r.taken_ts, r.geo.lat, r.favorited, r.people, r.from_partner, r.from_shared_album, r.err) == ("a.jpg", 1566350851, 1.5, 1, '[" A "]', 1, 0, None)
    assert (rows[1].title, rows[1].taken_ts, rows[1].geo, rows[1].err) == (None, None, None, None)
    assert [x.err for x in rows] == [None, None, "BadJson", "BadJson", "Missing", "BadJson", None]
    assert len(rows[6].title.encode()) == 1024
    assert (rows[0].raw, rows[2].raw) == (docs[0], None)


@pytest.mark.parametrize(("value", "want"), [('"12.5"', None), ('"+5"', None), ('" -1 "', -1), ("12.9", 12), ("-1.5", -1), ('"0"', None), ("0", None), ("true", None), ('"1234567890123"', None), ("1e12", None), ("null", None), ("[1]", None)])
def test_unix_times_of_documents(spark, value, want):
    doc = spark.createDataFrame([(f'{{"photoTakenTime": {{"timestamp": {value}}}}}',)], "doc string")
    assert documents.sidecar_fields(doc).first().taken_ts == want


def test_document_altitude_and_byte_limits(spark):
    text_ = '{"geoData": {"latitude": 1, "longitude": 2, "altitude": 3.5}, "geoDataExif": {"latitude": 0, "longitude": 0, "altitude": 9}, "people": [{"name": "' + "é" * 150 + '"}]}'
    r = documents.sidecar_fields(spark.createDataFrame([(text_,)], "doc string")).first()
    assert (r.geo.alt, r.geo_exif, r.people) == (3.5, None, '["' + "é" * 100 + '"]')
    got = spark.createDataFrame([("aé€😀" * 3,)], "s string").select(*[text.truncate_utf8(F.col("s"), n).alias(str(n)) for n in range(1, 31)]).first()
    assert [got[str(n)] for n in range(1, 31)] == [("aé€😀" * 3).encode()[:n].decode(errors="ignore") for n in range(1, 31)]


def test_local_fields(spark):
    rows = [
        (1, "2020:01:02 03:04:05", None, None, 1566350851, "x"),
        (2, None, "+02:00", None, 1566350851, "x"),
        (3, None, None, None, 1566350851, "x"),
        (4, None, None, "2020-01-02T03:04:05", None, "x"),
        (5, "1985:01:01 00:00:00", None, None, None, "Photos from 1985"),
        (6, None, None, None, 10**18, "x"),
        (7, "2020:02:30 00:00:00", "+15:00", "junk", None, "x"),
    ]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string, s long, f string")
    got = {r.id: (r.taken_src, r.local_date, r.local_time, r.day_uncertain, r.year) for r in localtime.with_local_fields(df, "a", "b", "c", "s", "f", F.lit("America/New_York"), 2027).collect()}
    assert got[1] == ("sidecar", "2020-01-02", "03:04:05", 0, 2020)
    assert got[2] == ("sidecar", "2019-08-21", "03:27:31", 0, 2019)
    assert got[3] == ("sidecar", "2019-08-20", "21:27:31", 1, 2019)
    assert got[4] == ("exif_any", "2020-01-02", "03:04:05", 1, 2020)
    assert got[5] == ("none", None, None, 1, 1985)
    assert got[6][1:] == (None, None, 1, None)
    assert got[7] == ("none", None, None, 1, None)


def test_pixels(spark):
    rng = np.random.default_rng(0)
    luma = rng.integers(0, 256, (32, 32))
    d = pixels.dct_matrix()
    assert np.allclose(d @ d.T, np.eye(32))
    h = pixels.phash(luma)
    assert -(2**63) <= h < 2**63 and pixels.phash(luma + 0) == h
    assert pixels.phash(np.full((32, 32), 9)) & 1 == 1  # the mean is bit 0
    wave = np.cos(np.pi * (2 * np.arange(32) + 1) * 3 / 64)[None, :].repeat(32, 0)
    assert pixels.phash(100 + 50 * wave) & 0xF == 0b1001  # row 0, column 3 is bit 3
    assert np.allclose(pixels.area_means(np.arange(12).reshape(3, 4), 1, 2), [[4.5, 6.5]])
    assert np.allclose(pixels.area_weights(5, 2).sum(1), 1) and np.allclose(pixels.lanczos_weights(1000, 7).sum(1), 1)
    checked = np.indices((1024, 1024)).sum(0) % 2 * 255
    f = pixels.features(np.stack([checked] * 3, axis=-1).astype(np.uint8))
    assert f["luma_std"] == 0 and f["lap_var"] < 1  # at the working sizes the pattern is one grey
    image = rng.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    sig = pixels.signature(image)
    assert len(sig) == pixels.SIG_BYTES
    flat = np.full((40, 50, 3), 7, np.uint8)
    f = pixels.features(flat)
    assert (f["lap_var"], f["luma_std"], f["flat_frac"], f["frac_dark"], f["colorfulness"]) == (0, 0, 1, 1, 0)
    rows = [(bytearray(image.tobytes()), 50, 40), (bytearray(b"xx"), 50, 40), (None, 1, 1)]
    out = spark.createDataFrame(rows, "d binary, w int, h int").select(pixels.fingerprint("d", "w", "h").alias("f"), pixels.sig_luma_std(F.lit(bytearray(sig))).alias("s")).collect()
    assert out[0].f.sig == sig and out[0].f.err is None and out[1].f.err == "ValueError" and out[2].f.phash64 is None
    pair = spark.createDataFrame([(bytearray(sig), bytearray(sig)), (bytearray(sig), None)], "a binary, b binary").select(pixels.sig_metrics("a", "b").alias("m")).collect()
    assert tuple(pair[0].m) == (0, 0, 0) and tuple(pair[1].m) == (None, None, None)


def test_exact_rounding(spark):
    assert column(spark, [0.25, 2.675, None], lambda c: text.fixed(c, 1), "double") == ["0.2", "2.7", None]
    assert column(spark, [0.125, 0.615], text.percent, "double") == ["12%", "62%"]
    assert column(spark, [2.675], lambda c: text.round_binary(c, 2), "double") == [2.67]
    assert str(column(spark, ["2024-01-31 10:00:00"], text.recoverable_until)[0]) == "2024-03-01"


def test_embedders(spark):
    from lumenfold.functions.embedding import StubEmbedder, embed_images, query_vector

    class Picky(StubEmbedder):
        def images(self, data):
            if b"bad" in data:
                raise ValueError
            return super().images(data)

    rows = [(bytearray(b"a"),), (bytearray(b"bad"),), (None,), (bytearray(b"a"),)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").coalesce(1).select(embed_images(F.col("c"), lambda: Picky(8))).collect()]
    assert got[0] == got[3] and got[1] is None and got[2] is None and len(got[0]) == 8
    q = query_vector(StubEmbedder(8), "boat")
    assert abs(sum(x * x for x in q) - 1) < 1e-6
