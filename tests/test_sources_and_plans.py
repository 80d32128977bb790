"""Archives, snapshots, shards, search, lookups, decisions and the whole pipeline on small tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenfold.metrics import line, numeric_only
from lumenfold.operators.groups import GroupParams
from lumenfold.plans import lookups, pipeline
from lumenfold.plans import search as Q
from lumenfold.sources import archive, shards, snapshots
from lumenfold.sources.csvfile import export_text
from lumenfold.streaming import decisions as D
from lumenfold.streaming.sessions import sessions


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "takeout-1-001.zip", "w") as z:
        z.writestr("Takeout/Google Photos/Photos from 2019/a.jpg", b"x" * 100)
        z.writestr("Takeout/Google Photos/Photos from 2019/a.jpg.json", json.dumps({"title": "a.jpg"}))
        z.writestr("Takeout/Google Photos/Photos from 2019/v.mp4", b"y" * 1000)
        z.writestr("Takeout/", b"")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    df = archive.read_archives(spark, str(tmp_path), "json,jpg", 2)
    rows = {r.member.rsplit("/", 1)[-1]: r for r in df.collect()}
    assert len(rows) == 4 and rows["a.jpg"].content == b"x" * 100 and rows["v.mp4"].content is None and rows[""].is_dir
    assert rows["a.jpg"].sha256 is not None and len({r.zipkey for r in rows.values()}) == 1
    m = spark.createDataFrame([("z", i, "jpg" if i % 2 else "json") for i in range(10)], "zipkey string, member_idx long, ext string")
    got = [r.shard for r in archive.plan_shards(m, 2).orderBy("member_idx").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    with pytest.raises(Exception, match="manifest|exist"):
        snapshots.read_manifest(spark, root, "one")
    m = snapshots.write_snapshot(spark, root, "one", {"t": df, "empty": df.limit(0)}, {"a": 1})
    assert [t["rows"] for t in m["tables"]] == [1, 0] and len(m["cfg"]) == 10
    assert snapshots.check_snapshot(spark, root, "one").count() == 0
    snapshots.set_current(spark, root, "one")
    assert snapshots.current(spark, root) == "one" and snapshots.read_table(spark, root, "one", "t").collect() == [(1, "a")]
    part = next((tmp_path / "one" / "t.parquet").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (tmp_path / "one" / "t.parquet" / f".{part.name}.crc").unlink(missing_ok=True)
    assert [r.problem for r in snapshots.check_snapshot(spark, root, "one").collect()] == ["size"]


@pytest.mark.parametrize("bad", ["", "/a", "a/../b", "a//b", "c:/x", "a\\b", ".", "a\x00"])
def test_unsafe_paths(bad):
    with pytest.raises(ValueError, match="unsafe"):
        snapshots.safe_path(bad)


def test_shards(spark, scratch):
    info = spark.createDataFrame([("z", "a.zip", 0, "c"), ("z", "b.zip", 0, "c"), ("y", "c.zip", 1, "d"), (None, "x", 1, "c")], "zipkey string, zip_name string, shard int, cfg string")
    assert {r.problem for r in shards.shard_problems(info).collect()} == {"missing key", "duplicate shard", "two names", "mixed configurations"}
    plan = spark.createDataFrame([(0, "a", 0, True), (1, "b", 0, True)], "shard_id int, zipkey string, shard int, present boolean")
    new = shards.extend_plan(plan, spark.createDataFrame([("b", 0), ("c", 0)], "zipkey string, shard int"), scratch)
    assert sorted((r.shard_id, r.zipkey, r.present) for r in new.collect()) == [(0, "a", False), (1, "b", True), (2, "c", True)]
    done = spark.createDataFrame([(1, 0), (2, 5)], "shard_id int, size long")
    assert [r.shard_id for r in shards.pending(new, done).collect()] == [1]
    names = spark.createDataFrame([("a",), ("a",), ("b",)], "n string")
    assert shards.without_repeated_names(names, "n").collect() == [("b",)]


INDEX = "item_id long, item_uid string, local_date string, local_time string, year int, filename string, origin_folder string, lat double, lon double, emb_row long, day_uncertain int, folder string, url string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, f"u{i}", None if i == 5 else f"2020-01-0{i}", "00:00:00", 2020, f"IMG_{i}%.jpg" if i % 2 else "Straße.png", None, 1.0 if i == 2 else None, 1.0, i, int(i == 3), "Photos from 2020", None) for i in range(1, 6)]
    return spark.createDataFrame(rows, INDEX)


def ids(df):
    return [r.item_id for r in df.collect()]


def test_search(spark, index):
    scores = spark.createDataFrame([(1, "blur", 0.9), (2, "blur", 0.4), (3, "tiny", 0.6)], "item_id long, category string, score double")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in (1, 2, 3)], "emb_row long, emb array<float>")
    find = lambda **kw: ids(Q.search(index, Q.SearchParams(**kw), scores, vectors)[0])
    assert find() == [1, 2, 3, 4, 5]
    assert find(filename_contains="%") == [1, 3, 5] and find(filename_contains="STRASSE") == [2, 4] and find(filename_contains="_") == [1, 3, 5]
    assert find(category="blur") == [1] and find(category="any", min_score=0.4) == [1, 3, 2] and find(min_score=0.6) == [1, 3]
    assert find(date_from="2020-01-02", date_to="2020-01-03") == [2, 3] and find(has_gps=True) == [2] and find(has_gps=False) == [1, 3, 4, 5]
    assert find(vector=[1.0, 1.0]) == [3, 2, 1] and find(vector=[1.0, -1.0]) == []
    page, total = Q.search(index, Q.SearchParams(limit=2, offset=4), scores)
    assert ids(page) == [5] and tuple(total.first()) == (5, None)
    hidden = spark.createDataFrame([("u1",), ("u2",)], "item_uid string")
    assert ids(Q.search(index, Q.SearchParams(), scores, queued=hidden)[0]) == [3, 4, 5]
    assert ids(Q.within_budget(index.withColumn("c", F.lit(5)), "c", 12, Q.calendar_order())) == [1, 2]
    assert ids(Q.within_budget(index.withColumn("c", F.lit(50)), "c", 12, Q.calendar_order())) == [1]


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": True}, {"offset": -1}, {"category": "x"}, {"min_score": 2}, {"date_from": "2021-02-30"}, {"date_to": "x"}, {"year": 1}, {"group": "dup:x"}, {"sort": "similarity"}, {"filename_contains": "x" * 201}])
def test_bad_searches(bad):
    with pytest.raises(ValueError):
        Q.SearchParams(**bad).validate()


def test_days(spark, index):
    approved = spark.createDataFrame([("u1", None), ("u3", None), ("x9", "2021-05-05")], "item_uid string, local_date string")
    days = spark.createDataFrame([("2020-01-01",), (None,)], "day string")
    dated = index.where("local_date is not null")
    got = {r.local_date: (r.n, r.n_approved, r.blockers, r.safe) for r in lookups.day_safety(dated, days.dropna(), approved).collect()}
    assert got == {"2020-01-01": (1, 1, "not_indexed_that_day", 0), "2020-01-03": (1, 1, "day_uncertain", 0), "2021-05-05": (0, 0, "no_indexed_photos", 0)}
    got = {r.local_date: r.blockers for r in lookups.day_safety(index, days, approved).collect()}
    assert got == {"2020-01-01": "not_indexed_that_day,undated_in_year,unindexed_undated", "2020-01-03": "day_uncertain,undated_in_year,unindexed_undated", "2021-05-05": "no_indexed_photos,unindexed_undated"}
    unknown = index.withColumns({"year": F.when(F.col("local_date").isNotNull(), F.col("year")), "folder": F.lit("Trip")})
    got = {r.local_date: r.blockers for r in lookups.day_safety(unknown, days.limit(0), approved.where("item_uid = 'u1'")).collect()}
    assert got == {"2020-01-01": "undated_unknown_year"}
    two = index.withColumn("local_date", F.lit("2020-01-01")).withColumn("day_uncertain", F.lit(0))
    got = [(r.blockers, r.safe) for n in (2, 5) for r in lookups.day_safety(two, days.limit(0), index.select("item_uid").where(f"item_id <= {n}")).collect()]
    assert got == [("not_all_approved", 0), ("", 1)]
    assert lookups.day_safety(index, days, approved.limit(0)).count() == 0
    assert lookups.undated_counts(index).collect() == [(2020, 1)]


def test_csv(spark):
    df = spark.createDataFrame([(1, "=x", None)], "item_id long, filename string, folder string")
    assert export_text(df, ("item_id", "filename", "folder", "url")) == "﻿item_id,filename,folder,url\r\n1,'=x,,\r\n"


def test_decisions_in_batch_and_as_a_stream(spark, tmp_path):
    events = [("a", 1, "propose", "bot"), ("a", 2, "approve", None), ("a", 3, "mark", None), ("a", 4, "reject", None), ("b", 5, "add", None), ("b", 6, "reset", None), ("c", 7, "propose", "bot"), ("c", 8, "withdraw", "other"), ("d", 9, "approve", None), ("e", 10, "propose", "bot"), ("e", 11, "reject", None), ("e", 12, "propose", "bot")]
    df = spark.createDataFrame(events, "item_uid string, seq long, action string, actor string")
    want = {("a", "deleted"), ("c", "proposed"), ("e", "rejected")}
    assert {(r.item_uid, r.status) for r in D.fold(df).collect()} == want
    (tmp_path / "in").mkdir()
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "p"))
    seen = []
    q = D.run_guarded(D.fold_stream(stream), lambda b, n: seen.extend(b.collect()), None, str(tmp_path / "state"))
    q.awaitTermination()
    assert {(r.item_uid, r.status) for r in seen if r.status} == want

    def refuse(batch):
        raise RuntimeError("guarded")

    q = D.run_guarded(D.fold_stream(stream), lambda b, n: seen.clear(), refuse, str(tmp_path / "state2"))
    with pytest.raises(Exception, match="guarded"):
        q.awaitTermination()
    assert seen
    assert {r["group_key"]: r["action"] for r in D.latest_decision(spark.createDataFrame([("g", 1, "keeper", "x"), ("g", 2, "dismissed", None), ("h", 1, "keeper", "x"), ("h", 2, "clear", None)], "group_key string, seq long, action string, keeper_uid string")).collect()} == {"g": "dismissed"}


def test_sessions(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 3, 7, 100)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.n for r in sessions(df, ["k"], "ts", "3 seconds").collect()) == [1, 1, 2]


def test_metrics():
    assert numeric_only({"a": 1, "b": "x", "c": [1.5, "y", {"d": True, "e": float("nan")}]}) == {"a": 1, "c": [1.5, {"d": True}]}
    assert line("done", n=1) == '{"event": "done", "n": 1}'
    with pytest.raises(TypeError):
        line("done", name="x")


def test_build_and_regroup(spark, tmp_path):
    data, root = "/root/testdata/sf0.001", f"file://{tmp_path}"
    m = pipeline.build(spark, data, root, "one")
    rows = {t["table"]: t["rows"] for t in m["tables"]}
    assert rows["items"] > 100 and rows["scores"] > 0 and rows["dup_groups"] > 0
    items = snapshots.read_table(spark, root, "one", "items")
    assert items.select("item_id").distinct().count() == rows["items"] == items.agg(F.max("item_id")).first()[0]
    assert items.select("item_uid").distinct().count() == rows["items"]
    stats = {r.key: r.value for r in snapshots.read_table(spark, root, "one", "stats").collect()}
    assert stats["items"] == rows["items"] and stats["pairing:R1"] > 0 and stats["unindexed"] + stats["undated_unindexed"] == stats["unreadable"]
    assert snapshots.read_table(spark, root, "one", "scores").where("reason is null").count() == 0
    again = pipeline.regroup(spark, root, "one", "two", GroupParams())
    assert {t["table"]: t["rows"] for t in again["tables"]} == rows
    for t in ("scores", "dup_members"):
        a, b = (snapshots.read_table(spark, root, n, t) for n in ("one", "two"))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


DATA = "/root/testdata/sf0.001"


def deliveries(spark, tmp_path, **changed):
    """A data directory with the smallest tables, some of them changed."""
    for t in ("items_raw", "sidecars_raw", "exports", "zips"):
        changed.get(t, spark.read.parquet(f"{DATA}/{t}.parquet")).write.parquet(f"{tmp_path}/data/{t}.parquet")
    return f"{tmp_path}/data"


def planted(spark, n, sig=None, **fields):
    """n photos of one hash but for a bit, each with bytes and a name of its own; fields override those of a delivered photo."""
    raw = spark.read.parquet(f"{DATA}/items_raw.parquet")
    one = raw.where("err is null and phash64 <> 0 and width > 0 and height > 0").orderBy("item_id").limit(1)
    i = F.col("i")
    d = one.join(spark.range(n).withColumnRenamed("id", "i")).withColumns({"item_id": 10_000_000 + i, "member_idx": 10_000_000 + i, "filename": F.concat(F.lit("planted"), i, F.lit(".jpg")), "sha256": F.unhex(F.sha2(F.concat(F.lit("planted"), i.cast("string")), 256)), "phash64": F.lit(0x0123456789ABCDEF).bitwiseXOR(F.when(i == n - 1, 1).otherwise(0).cast("long"))})
    for c, v in {"exif_dt": None, "exif_dt_any": None, "flat_frac": 0.0, "width": 4000, "height": 3000, "format": "JPEG", "has_camera_exif": 1, **fields}.items():
        d = d.withColumn(c, F.lit(v).cast(raw.schema[c].dataType))
    d = d.select(*raw.columns, *([sig(i).alias("sig")] if sig is not None else []))
    return raw.unionByName(d, allowMissingColumns=True)


def test_build_finds_near_groups_without_signatures(spark, tmp_path):
    root = f"file://{tmp_path}"
    pipeline.build(spark, deliveries(spark, tmp_path, items_raw=planted(spark, 3)), root, "one")
    groups, members, items = (snapshots.read_table(spark, root, "one", t) for t in ("dup_groups", "dup_members", "items"))
    near = groups.where("kind = 'near'").join(members, "group_id").join(items, "item_id")
    assert [r["n"] for r in near.where("filename like 'planted%'").groupBy("group_id").agg(F.count("*").alias("n")).collect()] == [3]
    assert members.where("sig_mad is not null").count() == 0 and "sig" not in items.columns


def test_build_carries_signatures(spark, tmp_path):
    root, sig = f"file://{tmp_path}", lambda i: F.when(i == 0, F.lit(bytearray([200]) * 576 + bytearray(576))).otherwise(F.lit(bytearray(576) + bytearray([200]) * 576))  # not flat: a featureless one would be graphic
    pipeline.build(spark, deliveries(spark, tmp_path, items_raw=planted(spark, 3, sig)), root, "one")
    pipeline.regroup(spark, root, "one", "two", GroupParams())
    for name in ("one", "two"):
        groups, members, items = (snapshots.read_table(spark, root, name, t) for t in ("dup_groups", "dup_members", "items"))
        near = groups.where("kind = 'near'").join(members, "group_id").join(items, "item_id")
        assert sorted(r.filename for r in near.collect()) == ["planted1.jpg", "planted2.jpg"]
        assert near.where("sig_mad = 0").count() == 2


def test_build_pairs_sidecars_that_came_unpaired(spark, tmp_path, scratch):
    """A sidecar without item_id gives its photo its fields by name; one that names can't pair stays with its delivered photo."""
    side = spark.read.parquet(f"{DATA}/sidecars_raw.parquet")
    photo = planted(spark, 1).where("item_id = 10000000").first()
    d = side.where("err is null and coalesce(trashed, 0) = 0").orderBy("sidecar_id").limit(1)
    fields = {"sidecar_id": 20_000_000, "item_id": None, "export_id": photo.export_id, "folder": photo.folder, "folder_kind": photo.folder_kind, "json_name": "planted0.jpg.json", "title": "planted0.jpg", "taken_ts": "1500000000", "lat": 10.0, "lon": 20.0, "url": "https://photos.example/photo/planted000000", "favorited": 1, "trashed": 0}
    for c, v in fields.items():
        d = d.withColumn(c, F.lit(v).cast(side.schema[c].dataType))
    data = deliveries(spark, tmp_path, items_raw=planted(spark, 1), sidecars_raw=side.unionByName(d.select(*side.columns)))
    root = f"file://{tmp_path}"
    pipeline.build(spark, data, root, "one")
    got = snapshots.read_table(spark, root, "one", "items").where("filename = 'planted0.jpg'").first()
    assert (got.taken_ts, got.lat, got.lon, got.favorited, got.url) == (1500000000, 10.0, 20.0, 1, fields["url"])
    photos = spark.createDataFrame([(1, "e", "f", "a.jpg", None), (2, "e", "f", "b.jpg", None), (3, "e", "f", "c.jpg", None)], "item_id long, export_id string, folder string, filename string, exif_dt string")
    cars = spark.createDataFrame([(7, 2, "e", "f", "zz.json", "q", None), (6, 1, "e", "f", "zz.json", "q", None), (5, 3, "e", "f", "a.jpg.json", "a.jpg", None)], "sidecar_id long, item_id long, export_id string, folder string, json_name string, title string, taken_ts string")
    assert sorted(map(tuple, pipeline.owned_sidecars(photos, cars, scratch).select("item_id", "sidecar_id").collect())) == [(1, 5), (2, 7)]
