"""Archives scanned, built and looked at, end to end over a made library; rows as people see them."""

import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold import cli
from lumenfold.plans import pipeline, shaping
from lumenfold.sources import scan, snapshots
from lumenfold.streaming import decisions as D

YEAR = "Takeout/Google Photos/Photos from 2020"


def picture(seed, bump=0):
    """A file of the fixture's own format: a size and raw RGB."""
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 200, (8, 8, 3))
    a = np.kron(coarse, np.ones((10, 12, 1), int)) + bump
    return b"RGB0" + struct.pack("<HH", a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def decoder():
    def decode(data):
        import struct as s

        import numpy as n

        if data[:4] != b"RGB0":
            raise OSError("no picture")
        w, h = s.unpack("<HH", data[4:8])
        return n.frombuffer(data[8:], n.uint8).reshape(h, w, 3)

    return decode


def sidecar(title, ts, ident, **more):
    return json.dumps({"title": title, "photoTakenTime": {"timestamp": str(ts)}, "url": f"https://photos.google.com/photo/{ident:0>12}", "geoData": {"latitude": 0, "longitude": 0}, "geoDataExif": {"latitude": 1.5, "longitude": 2.5}, **more})


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """Two archives: a pair of near copies, a byte copy, a broken file, an edited copy, a video, a raw file, a trashed photo and an album copy."""
    root = tmp_path_factory.mktemp("library")
    first = {
        "a.jpg": picture(1), "a.jpg.json": sidecar("a.jpg", 1577934245, 1, favorited=True), "a2.jpg": picture(1, 2), "a2.jpg.json": sidecar("a2.jpg", 1577934245, 2),
        "b.jpg": picture(2), "b.jpg.json": sidecar("b.jpg", 1578934245, 3), "broken.jpg": b"junk", "broken.jpg.json": sidecar("broken.jpg", 1579934245, 4), "a-edited.jpg": picture(1, 40),
        "v.mp4": b"vvvv", "r.dng": b"rr", "gone.jpg": picture(3), "gone.jpg.json": sidecar("gone.jpg", 1577934245, 5, trashed=True), "bad.json": "{",
    }
    second = {"copy.jpg": picture(2), "copy.jpg.json": sidecar("copy.jpg", 1578934245, 6)}
    for name, files, extra in (("takeout-x-001.zip", first, {f"{YEAR}/metadata.json": "{}"}), ("takeout-x-002.zip", second, {"Takeout/Google Photos/Trip/a.jpg": picture(1)})):
        with zipfile.ZipFile(root / name, "w", zipfile.ZIP_DEFLATED) as z:
            for n, data in files.items():
                z.writestr(f"{YEAR}/{n}", data)
            for n, data in extra.items():
                z.writestr(n, data)
    return root


def test_scan_build_and_look(spark, library, tmp_path):
    shards, root = f"file://{tmp_path}/shards", f"file://{tmp_path}/index"
    info = scan.scan(spark, str(library), shards, "cfg1", photos_per_shard=2, decode=decoder())
    rows = info.collect()
    assert sum(r.n_items for r in rows) == 6 and sum(r.n_videos for r in rows) == 1 and len({(r.zipkey, r.shard) for r in rows}) == len(rows) >= 3
    assert scan.scan(spark, str(library), shards, "cfg1", photos_per_shard=2, decode=decoder()).count() == 0
    items = spark.read.parquet(f"{shards}/items_raw")
    got = {r.filename: r for r in items.collect()}
    assert got["broken.jpg"].err == "OSError" and got["broken.jpg"].sha256 is not None and got["a.jpg"].width == 96 and got["a.jpg"].err is None
    assert (got["a.jpg"].phash64 ^ got["a2.jpg"].phash64).bit_count() <= 3 and got["b.jpg"].sha256 == got["copy.jpg"].sha256
    assert {(r.json_name, r.err) for r in spark.read.parquet(f"{shards}/sidecars_raw").where("err is not null").collect()} == {("bad.json", "BadJson")}
    assert {r.reason for r in spark.read.parquet(f"{shards}/skipped_raw").collect()} == {"edited", "raw", "non_sidecar_json", "album_media"}

    pipeline.build(spark, scan.deliveries(spark, shards, "America/New_York"), root, "one")
    read = lambda t: snapshots.read_table(spark, root, "one", t)
    index = {r.filename: r for r in read("items").collect()}
    assert set(index) == {"a.jpg", "a2.jpg", "b.jpg", "copy.jpg"}
    assert (index["a.jpg"].favorited, index["a.jpg"].lat, index["a.jpg"].local_date, index["a.jpg"].taken_src) == (1, 1.5, "2020-01-01", "sidecar")
    members = read("dup_members").join(read("items").select("item_id", "filename"), "item_id").collect()
    groups = {}
    for r in members:
        groups.setdefault(r.group_id, []).append((r.filename, r.is_keeper))
    assert sorted(map(sorted, groups.values())) == [[("a.jpg", 1), ("a2.jpg", 0)], [("b.jpg", 1), ("copy.jpg", 0)]]
    assert {r.kind for r in read("dup_groups").collect()} == {"exact", "near"}
    assert {r.reason for r in read("scores").where("category = 'dup_extra'").collect()} <= {f"duplicate of #{r.item_id}" for r in index.values()}
    stats = {r.key: r.value for r in read("stats").collect()}
    assert stats["unreadable"] == 1 and stats["unindexed"] == 1 and stats["items"] == 4
    snapshots.set_current(spark, root, "one")
    for command in (["stats", root], ["groups", root], ["export", root, f"{tmp_path}/csv"], ["check", root, "one"]):
        assert cli.main(command) == 0


def test_checkpoints(spark):
    plan = spark.createDataFrame([("z", i, i != 9) for i in (0, 1, 2, 3, 4, 5, 9)], "zipkey string, shard long, present boolean")
    info = spark.createDataFrame([("z", i, "c" if i != 1 else "other", f"p{i}", 10, "AA" if i != 2 else None, "m" if i == 4 else None) for i in (0, 1, 2, 3, 4)], "zipkey string, shard long, cfg string, pack_name string, pack_size long, pack_sha256 string, pack_md5 string")
    packs = spark.createDataFrame([("p0", 10, "aa", None), ("p1", 10, None, None), ("p2", 10, None, None), ("p4", 10, "aa", "x")], "pack_name string, size long, sha256 string, md5 string")
    problems = scan.checkpoint_problems(plan, info, packs, "c")
    assert {r.shard: r.problem for r in problems.collect()} == {0: None, 1: "unreadable or of another configuration", 2: "unreadable or of another configuration", 3: "pack missing", 4: "pack differs", 5: "not scanned"}
    assert tuple(scan.merge_state(problems).first()) == (6, 1, 5, 1)
    assert tuple(scan.merge_state(problems.limit(0)).first()) == (0, 0, 0, 0)


def test_tags_and_flags(spark):
    rows = [(1, 3, True, 1, 1, 1), (2, 3, False, 0, None, None), (3, None, None, None, 4, 0), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, dup_group long, uncertain_group boolean, is_keeper int, burst long, is_best int")
    assert [r[0] for r in df.orderBy("i").select(shaping.group_tag()).collect()] == ["dup3?:keeper,burst1:best", "dup3", "burst4", "-"]
    assert spark.createDataFrame([(0.0,), (0.5,), (0.955,), (1.0,)], "s double").select(shaping.two_digits(F.col("s")).alias("t")).toPandas().t.tolist() == ["0.00", "0.50", "0.96", "1.00"]
    item = spark.createDataFrame([(1, None, None, None), (0, 1, 1, "u")], "shared int, partner int, favorited int, url string")
    assert [r[0] for r in item.select(shaping.attr_flags()).collect()] == [["shared", "nolink"], ["partner", "fav"]]


def test_links_of_uncertain_pairings(spark):
    df = spark.createDataFrame([("https://photos.google.com/photo/x", "a.jpg", "high"), ("https://photos.google.com/photo/x", "a.jpg", "low"), ("https://photos.google.com/photo/x", "a.jpg", None), (None, "a b*~.jpg", "high"), (None, None, None)], "url string, filename string, match_conf string")
    assert [tuple(r.x) for r in df.select(shaping.link_of().alias("x")).collect()] == [("https://photos.google.com/photo/x", "high"), ("https://photos.google.com/photo/x", "low"), ("https://photos.google.com/photo/x", "low"), ("https://photos.google.com/search/a%20b%2A~", "low"), (None, "none")]


def test_transitions_and_batches(spark):
    events = [("a", 1, "propose", "bot", "x"), ("b", 2, "propose", "bot", "x"), ("a", 3, "approve", "user", None), (None, 4, "reject_batch", "user", "x"), ("c", 5, "propose", "bot", "x"), ("a", 6, "approve", None, None), ("d", None, "add", None, None)]
    df = spark.createDataFrame(events, "item_uid string, seq long, action string, actor string, batch_id string")
    spread = D.with_batches_spread(df, df.where("action = 'propose'"))
    got = {(r.item_uid, r.seq, r.was, r.status, r.rev) for r in D.transitions(spread).collect()}
    assert got == {("a", 1, None, "proposed", 1), ("b", 2, None, "proposed", 1), ("a", 3, "proposed", "approved", 2), ("b", 4, "proposed", "rejected", 2), ("a", 4, "approved", "rejected", 3), ("c", 5, None, "proposed", 1), ("a", 6, "rejected", "approved", 4)}
    assert D.transitions(df.limit(0)).count() == 0
