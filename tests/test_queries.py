"""Every query that has SQL gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenfold.oracles import ORACLES

DATA = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        if isinstance(v, bool):
            return str(int(v))
        return f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


RAW = ("items_raw", "sidecars_raw", "exports")


def test_seed_groups_keeper_by_sidecar_and_without_bytes(spark, tmp_path):
    """Of copies that tie in pixels and camera the located, favorited, or album one is kept; photos without sha256 take part."""
    t = {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in RAW}
    one = t["items_raw"].where("folder_kind = 'year'").limit(1)
    side = t["sidecars_raw"].limit(1)
    sha = lambda x: bytearray(x.encode() * 32)
    same = {"width": 100, "height": 50, "has_camera_exif": 1, "exif_dt": None, "exif_subsec": None, "exif_lat": None, "exif_lon": None, "file_size": 9, "exif_dt_any": None}

    def rows(base, changes, fixed):
        out = None
        for c in changes:
            d = base
            for k, v in {**fixed, **c}.items():
                d = d.withColumn(k, F.lit(v).cast(base.schema[k].dataType))
            out = d if out is None else out.unionByName(d)
        return out

    photos = [{"item_id": i, "sha256": sha(x), "phash64": h} for i, x, h in [(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "b", 0), (5, "c", 0), (6, "c", 0), (9, "d", 0), (10, "d", 0)]] + [{"item_id": i, "sha256": None, "phash64": 12345} for i in (7, 8)]
    cars = [{"sidecar_id": 1, "item_id": 2, "favorited": 1}, {"sidecar_id": 2, "item_id": 4, "lat": 1.0, "lon": 2.0}, {"sidecar_id": 3, "item_id": 3, "lat": 0.0, "lon": 0.0}, {"sidecar_id": 4, "item_id": 6, "url": "u6"}, {"sidecar_id": 5, "item_id": None, "url": "u6", "folder": "Trip", "folder_kind": "album"}, {"sidecar_id": 6, "item_id": 10, "taken_ts": "1500000000"}]
    rows(one, photos, same).write.parquet(f"{tmp_path}/items_raw.parquet")
    rows(side, cars, {"lat": None, "lon": None, "url": None, "favorited": 0, "trashed": 0, "taken_ts": None, "folder_kind": "year"}).write.parquet(f"{tmp_path}/sidecars_raw.parquet")
    t["exports"].write.parquet(f"{tmp_path}/exports.parquet")
    got = entry.queries()["seed_groups"](spark, str(tmp_path)).where("is_keeper = 1").collect()
    assert sorted(r.item_id for r in got) == [2, 4, 6, 7, 10]


def test_memberships_have_bursts_of_any_size(spark):
    rows = entry.queries()["memberships"](spark, DATA)
    assert rows.where("burst is not null").groupBy("burst").count().where("count > 1").count() > 0


def test_cells_are_whole(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").select("doc_id", "text")
    rows = entry.queries()["text_clean"](spark, DATA).join(texts, "doc_id")
    assert rows.where("length(cell) > 40").count() > 0 == rows.where("not endswith(cell, text)").count()
