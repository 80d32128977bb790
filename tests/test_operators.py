"""Grouping, collapse, bursts, scores and pairing against brute force and the defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import bursts as B
from lumenfold.operators import candidates as C
from lumenfold.operators import collapse as L
from lumenfold.operators import groups as G
from lumenfold.operators import scores as S
from lumenfold.operators.components import connected
from lumenfold.operators.pairing import pair, pairing_stats, unpaired

ITEM = "item_id long, item_uid string, sha256 binary, phash64 long, sig binary, width int, height int, is_graphic boolean, capture_s long, subsec double, url string, has_camera_exif int, lat double, lon double, favorited int, albums_n int, file_size long, taken_ts long"
SIG = bytearray(1152)


def item(i, sha=None, h=None, sig=SIG, w=100, graphic=False, url=None, capture=None, size=10):
    return (i, f"u{i:03d}", bytearray(sha.encode()) if sha else None, h, sig, w, 100, graphic, capture, None, url, 0, None, None, 0, 0, size, None)


def groups_of(spark, scratch, rows, **kw):
    found = G.find_groups(spark.createDataFrame(rows, ITEM), scratch, G.GroupParams(**kw))
    out = {}
    for r in found["members"].orderBy("place").collect():
        out.setdefault(r.seed_item_id, []).append(r.item_id)
    return sorted(out.values()), found


@pytest.mark.parametrize("distance", [2, 3, 5])
def test_pigeonhole_equals_brute_force(spark, distance):
    rng = random.Random(distance)
    hashes = [rng.getrandbits(64) for _ in range(150)]
    for h in list(hashes):
        for _ in range(2):
            for b in rng.sample(range(64), rng.randint(0, 6)):
                h ^= 1 << b
            hashes.append(h)
    df = spark.createDataFrame([(i, h - 2**64 if h >> 63 else h) for i, h in enumerate(hashes)] + [(None, 1), (9999, None)], "item_id long, phash64 long")
    assert sorted(map(tuple, C.near_candidates(df, distance).collect())) == sorted(map(tuple, C.brute_candidates(df.dropna(), distance).collect()))


def test_bucket_caps(spark):
    df = spark.createDataFrame([(i, 77) for i in range(12)], "item_id long, phash64 long")
    assert C.near_candidates(df, 3, 10).count() == 0
    assert tuple(C.bucket_skips(df, 3, 10).first()) == (4, 48, 264)
    assert C.near_candidates(df, 3, 12).count() == 66


@pytest.mark.parametrize("hot", [3, 2000])
def test_exact_candidates_equal_brute_force(spark, scratch, hot):
    rng = random.Random(hot)
    near = [1 << b for b in range(40)] + [0b11 << b for b in range(0, 60, 7)]
    rows = [(i, h) for i, h in enumerate([5] * 20 + near + [rng.getrandbits(62) for _ in range(50)])]
    df = spark.createDataFrame(rows + [(None, 5), (9999, None)], "item_id long, phash64 long")
    got = sorted(map(tuple, C.exact_candidates(df, scratch, 3, hot=hot).collect()))
    assert got == sorted(map(tuple, C.brute_candidates(df.dropna(), 3).collect()))


def test_crowded_hashes_keep_their_near_ones(spark, scratch):
    """By default nothing is skipped: 600 copies and one near hash are one group; a cap is an option and tells what it skips."""
    rows = [item(i, "x", 7) for i in range(600)] + [item(600, "y", 6)]
    got, found = groups_of(spark, scratch, rows)
    assert [len(g) for g in got] == [601] and "skips" not in found
    got, found = groups_of(spark, scratch, rows, bucket_cap=500)
    assert [len(g) for g in got] == [600] and found["skips"].first()["skipped_buckets"] == 4


def test_components_equal_union_find(spark, scratch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {(v, find(v)) for v in parent}
    assert connected(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_no_chains(spark, scratch):
    a, b, c = 0b0, 0b111000, 0b111111000
    rows = [item(1, h=a, size=300), item(2, h=b, size=200), item(3, h=c, size=100)]
    assert groups_of(spark, scratch, rows)[0] == [[1, 2]]
    rows = [item(1, h=a, size=200), item(2, h=b, size=300), item(3, h=c, size=100)]
    assert groups_of(spark, scratch, rows)[0] == [[2, 1, 3]]


def test_graphic_items_match_by_bytes_only(spark, scratch):
    rows = [item(1, "x", 5, graphic=True), item(2, "x", 5, graphic=True), item(3, "y", 5, graphic=True), item(4, None, None)]
    got, found = groups_of(spark, scratch, rows)
    assert got == [[1, 2]] and found["groups"].first()["kind"] == "exact"


def test_twins_of_absorbed_members_join(spark, scratch):
    rows = [item(1, "a", 5, size=300), item(2, "b", 6, size=200), item(3, "b", 6, size=100, graphic=True)]
    got, found = groups_of(spark, scratch, rows)
    assert got == [[1, 2, 3]] and found["groups"].first()["kind"] == "near"


def test_a_graphic_seed_stands_for_its_copies(spark, scratch):
    seed = item(1, "a", 5, size=300, graphic=True)
    assert groups_of(spark, scratch, [seed, item(2, "a", 5, size=200), item(3, "b", 6)])[0] == [[1, 2, 3]]
    assert groups_of(spark, scratch, [seed, item(3, "b", 6)])[0] == []


def test_deletable_and_checks(spark, scratch):
    found = groups_of(spark, scratch, [item(1, "a", 1, url="p"), item(2, "a", 1, url="p"), item(3, "a", 1)])[1]
    assert found["groups"].first()["deletable"] == 0
    found = groups_of(spark, scratch, [item(1, h=1, capture=10), item(2, h=1, capture=11), item(3, h=1, w=300), item(4, h=1, sig=bytearray([9]) * 1152)])[1]
    assert {(r.a, r.b): r.rejected for r in found["edges"].collect()} == {(1, 2): "capture", (1, 3): "aspect", (1, 4): "sig", (2, 3): "aspect", (2, 4): "sig", (3, 4): "aspect"}
    assert groups_of(spark, scratch, [])[0] == []
    with pytest.raises(ValueError, match="distance"):
        G.GroupParams(distance=6)


def near_rows(a, b, p):
    """Whether two rows match by hash, sizes and capture; all signatures of the fixture are equal."""
    if a[7] or b[7] or a[3] is None or b[3] is None or min(a[5], a[6], b[5], b[6]) <= 0 or (a[3] ^ b[3]).bit_count() > p.distance:
        return False
    ra, rb = a[5] / a[6], b[5] / b[6]
    if abs(ra - rb) / max(ra, rb) > p.aspect:
        return False
    return a[8] is None or b[8] is None or a[8] == b[8] or abs(a[8] - b[8]) > p.capture_window


def brute_groups(rows, p):
    """Groups by the definition, item by item: the best of what is left, all that its copies match, and the copies of those."""
    left, out = sorted(rows, key=lambda r: (-(r[5] * r[6]), -r[16], r[1])), []
    while left:
        same = lambda a, b: a is b or (a[2] is not None and a[2] == b[2])
        copies = [r for r in left if same(r, left[0])]
        near = [r for r in left if r in copies or any(near_rows(r, c, p) for c in copies)]
        group = [r for r in left if any(same(r, g) for g in near)]
        out += [[r[0] for r in group]] if len(group) > 1 else []
        left = [r for r in left if r not in group]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_give_the_groups_of_single_items(spark, scratch, seed):
    rng = random.Random(seed)
    rows = [item(i, rng.choice([None, None, *"abcdef"]), rng.choice([None, 1, 2, 3, 0b11111, 0b11111000]), w=rng.choice([0, 100, 101, 300]), graphic=rng.random() < 0.15, capture=rng.choice([None, None, 100, 110]), size=rng.choice([10, 20])) for i in range(150)]
    got, found = groups_of(spark, scratch, rows)
    assert got == brute_groups(rows, G.GroupParams())
    stats = G.group_stats(spark.createDataFrame(rows, ITEM), found["edges"]).first()
    eligible = [r for r in rows if not r[7] and r[3] is not None]
    pairs = [(a, b) for i, a in enumerate(eligible) for b in eligible[i + 1 :] if (a[3] ^ b[3]).bit_count() <= 3 and (a[2] is None or a[2] != b[2])]
    assert stats["candidate_pairs"] == len(pairs) == stats["near_edges"] + stats["rejected_aspect"] + stats["rejected_sig"] + stats["rejected_capture"]


def test_copies_are_elected_as_one_row(spark, scratch, monkeypatch):
    """A third of a table in one hash or one sha256 reaches the election as single rows and comes out whole, best first."""
    seen, elect = [], G.elect_seeds
    monkeypatch.setattr(G, "elect_seeds", lambda u, links, s: seen.append((u.count(), links.count())) or elect(u, links, s))
    monkeypatch.setattr(G, "KEY_CHUNK", 100)
    rows = [item(i, f"s{i}", 1, size=i) for i in range(800)] + [item(1000 + i, "x", 0xFF << 40) for i in range(800)]
    got, found = groups_of(spark, scratch, rows)
    assert seen == [(2, 0)] and got == [list(range(799, -1, -1)), list(range(1000, 1800))]
    assert found["edges"].count() == 1 and found["groups"].agg(F.count_distinct("group_key")).first()[0] == 2


@pytest.mark.parametrize("n", [2, 7, 40])
def test_seeds_along_a_path_of_falling_rank(spark, scratch, n):
    """The order that takes the most rounds: every second unit is a seed."""
    units = spark.createDataFrame([(i, i) for i in range(n)], "unit long, rank long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    assert sorted(map(tuple, G.elect_seeds(units, links, scratch).collect())) == [(i, i - 1) for i in range(1, n, 2)]


def test_two_dense_clusters(spark, scratch):
    """Two clusters of 400 differing items in which all pairs match: 160,000 links, one round."""
    rows = [item(1000 * c + i, f"{c}-{i}", (0xFFFF << 40 if c else 0) | (1 << i % 20 if i else 0), size=i, capture=1000 * i) for c in (0, 1) for i in range(400)]
    got, found = groups_of(spark, scratch, rows)
    assert [len(g) for g in got] == [400, 400]
    assert G.group_stats(spark.createDataFrame(rows, ITEM), found["edges"]).first()["candidate_pairs"] == 2 * 400 * 399 // 2


def test_group_keys(spark, monkeypatch):
    import hashlib

    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "g long, item_uid string")
    assert {r.g: (r.size, r.group_key) for r in G.group_keys(df, "g").collect()} == {1: (2, hashlib.sha1(b"a\nb").hexdigest()), 2: (1, hashlib.sha1(b"c").hexdigest())}


def test_numbers_that_are_other_names_are_passed_over(spark):
    """a and its repeats are numbered past an item whose own name is a:2."""
    rows = [(i, None, bytearray(b"t"), n, f"m{i}") for i, n in enumerate(["a", "a", "a", "a:2", "a:4"])]
    df = spark.createDataFrame(rows, "i int, url string, sha256 binary, filename string, member string").withColumns({c: F.lit("x") for c in ("local_date", "folder", "export_id", "zip_name")})
    assert sorted(r.item_uid for r in L.with_uids(df).collect()) == ["s:74:a", "s:74:a:2", "s:74:a:3", "s:74:a:4", "s:74:a:5"]


def test_a_hot_key_is_numbered_over_many_tasks(spark, scratch):
    """A third of the rows has no date, a third one value: ids are dense and in order, shares right."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("2020-01-"), F.lpad((F.col("id") % 28).cast("string"), 2, "0"))).alias("local_date"), F.lit(None).cast("string").alias("local_time"), F.lpad(F.col("id").cast("string"), 6, "0").alias("item_uid"))
    got = [(r.local_date or "9", r.item_uid) for r in L.with_item_ids(rows, scratch).orderBy("item_id").collect()]
    assert got == sorted(got) and len(got) == 30_000
    values = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.lit(1.01), F.col("id"))).alias("x"))
    flat = sorted(r.x for r in values.collect())
    for r in S.ecdf(values, "x", scratch).collect():
        assert r.below == sum(v < r.x for v in flat) / 3000 and r.above == sum(v > r.x for v in flat) / 3000


RECORD = "zipkey string, zip_name string, export_id string, member_idx long, member string, folder string, folder_kind string, filename string, sha256 binary, exif_dt string, exif_dt_any string, url string, favorited int"


def record(i, url=None, sha="s", name="a.jpg", kind="year", export="e1", day="2020:01:01 00:00:00", fav=0):
    return (f"z{i}", f"z{i}.zip", export, i, f"m{i}", "Photos from 2020" if kind == "year" else f"Album {i}", kind, name, bytearray(sha.encode()), day, None, url, fav)


def collapsed(spark, rows):
    a = L.assign_items(spark.createDataFrame(rows, RECORD))
    return {r.member_idx: (r.item_key, r.is_primary, r.reason) for r in a.collect()}


def test_collapse(spark):
    got = collapsed(spark, [record(1, "u"), record(2, "u", kind="album"), record(3, "u", export="e2"), record(4, "u", export="e2")])
    assert {i: (p, r) for i, (_, p, r) in got.items()} == {3: (True, None), 4: (False, "same_url"), 1: (False, "double_export"), 2: (False, "album_copy")}
    got = collapsed(spark, [record(1, "u"), record(2, name="A.JPG", export="e0"), record(3, day="2020:01:02 00:00:00"), record(4, sha="t"), record(5, name="b.jpg")])
    assert got[2] == ("u|u", False, "double_export_nourl") and len({k for k, _, _ in got.values()}) == 4
    got = collapsed(spark, [record(1, "u"), record(2, "v"), record(3), record(4)])
    assert len({k for k, _, _ in got.values()}) == 4
    assert collapsed(spark, []) == {}


def test_flags_albums_uids_and_ids(spark, scratch):
    rows = spark.createDataFrame([record(1, "h/p/1"), record(2, "h/p/1", kind="album", fav=1), record(3, sha="t", kind="album"), record(4, sha="t", kind="album", day=None)], RECORD)
    a = L.assign_items(rows)
    m = {r.url: (r.favorited, r.albums, r.albums_n) for r in L.merged(a).collect()}
    assert m["h/p/1"] == (1, ["Album 2"], 1)
    items = L.with_item_ids(L.with_uids(a.where("is_primary").withColumn("local_date", F.lit(None).cast("string")).withColumn("local_time", F.lit(None).cast("string"))), scratch)
    assert sorted(r.item_uid for r in items.collect()) == ["g:1", "s:74:a.jpg", "s:74:a.jpg:2"]
    assert sorted(r.item_id for r in items.collect()) == [1, 2, 3]


SHOT = "item_id long, item_uid string, taken_ts long, exif_subsec string, phash64 long, model string, dup_group long, lap_var double, width int, height int, frac_dark double, frac_bright double"


def shot(i, t, h=1, model="m", sub=None, group=None, lap=1.0, dark=0.0):
    return (i, f"u{i}", t, sub, h, model, group, lap, 10, 10, dark, 0.0)


def time_groups(spark, rows):
    from lumenfold.session import Scratch

    out = {}
    for r in B.time_bursts(spark.createDataFrame(rows, SHOT), Scratch(spark, "bursts")).collect():
        out.setdefault(r.burst, set()).add(r.item_id)
    return sorted(map(sorted, out.values()))


def test_time_bursts(spark):
    assert time_groups(spark, [shot(1, 100), shot(2, 101), shot(3, 102), shot(4, 200), shot(5, 201, h=-1)]) == [[1, 2, 3]]
    assert time_groups(spark, [shot(1, 100, model="a"), shot(2, 101, model="b")]) == []
    assert time_groups(spark, [shot(1, 100, model="a"), shot(2, 101, model=None)]) == [[1, 2]]
    assert time_groups(spark, [shot(1, 100, group=7), shot(2, 101, group=7)]) == []
    assert time_groups(spark, [shot(1, 3599), shot(2, 3600), shot(3, 7200), shot(4, 7203)]) == [[1, 2], [3, 4]]
    assert time_groups(spark, [shot(1, 100), shot(2, None), shot(3, 101, h=None)]) == []
    assert time_groups(spark, []) == []


def test_time_bursts_against_a_scan(spark):
    rng = random.Random(3)
    rows = [shot(i, rng.randrange(0, 20000), h=rng.choice([0, 1, -1]), model=rng.choice(["a", None])) for i in range(3000)]
    seq = sorted(rows, key=lambda r: (r[2], r[1]))
    want, chain = [], []
    for a, b in zip(seq, seq[1:] + [None], strict=False):
        chain = chain or [a[0]]
        if b and b[2] - a[2] <= 3 and ((a[4] ^ b[4]) & (2**64 - 1)).bit_count() <= 10:
            chain.append(b[0])
        else:
            want += [sorted(chain)] if len(chain) > 1 else []
            chain = []
    assert time_groups(spark, rows) == sorted(want)


def test_burst_rank(spark):
    rows = [shot(1, 1, lap=230.0, dark=0.9), shot(2, 1, lap=100.0), shot(3, 2, lap=150.0, sub="500")]
    items = spark.createDataFrame(rows, SHOT)
    members = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "burst long, item_id long")
    rank = B.ranked(members, items)
    assert [r.item_id for r in rank.orderBy("rank").collect()] == [3, 1, 2]
    assert B.burst_summary(members, items).first()["duration_s"] == 1.5
    assert {r.item_id: r.best_item_id for r in B.burst_extras(rank).collect()} == {1: 3, 2: 3}


def test_name_bursts(spark):
    df = spark.createDataFrame([(1, "f", "I_BURST001.jpg"), (2, "f", "I_BURST002.jpg"), (3, "g", "I_BURST003.jpg"), (4, "f", "x.jpg")], "item_id long, folder string, filename string")
    assert sorted(tuple(r) for r in B.filename_bursts(df).collect()) == [(1, 1), (1, 2)]


LOOK = "item_id long, filename string, format string, width int, height int, has_camera_exif int, lap_var double, luma_mean double, luma_std double, frac_dark double, frac_bright double, flat_frac double, origin_folder string"


def test_row_scores(spark):
    rows = [
        (1, "Screenshot_1.png", "PNG", 10, 10, 0, None, None, None, None, None, None, None),
        (2, "a.jpg", "JPEG", 1080, 2340, 0, None, None, None, None, None, 0.5, None),
        (3, "a.jpg", "JPEG", 1080, 1350, 0, None, None, None, None, None, None, "WhatsApp Images"),
        (4, "IMG-20200101-WA0001.jpg", "JPEG", 800, 600, 1, 10.0, 100.0, 50.0, 0.0, 0.0, 0.1, None),
        (5, None, None, None, None, 1, None, 10.0, 5.0, None, None, None, None),
        (6, "b.jpg", "JPEG", 700, 500, 1, 90.0, 90.0, 50.0, 0.0, 0.0, 0.615, None),
    ]
    got = {(r.item_id, r.category): (r.score, r.reason) for r in S.category_scores(spark.createDataFrame(rows, LOOK)).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "screenshot"): 0.95, (1, "tiny"): 1.0, (2, "screenshot"): 0.8, (3, "messaging"): 0.9, (4, "messaging"): 0.9, (4, "pocket"): 0.6, (5, "pocket"): 0.8, (6, "tiny"): 0.6, (6, "pocket"): 0.7}


def test_distribution_scores(spark, scratch):
    rows = [(i, False, 0.0, float(i * 10), 100.0, 0.0, 1) for i in range(1, 31)] + [(99, False, 0.9, 0.0, 0.0, 1.0, 0), (98, False, 0.0, None, None, None, 1)]
    df = spark.createDataFrame(rows, "item_id long, is_graphic boolean, shot double, lap_var double, luma_mean double, frac_bright double, has_camera_exif int")
    got = {(r.item_id, r.category): r.score for r in S.distribution_scores(df, scratch).collect()}
    assert got[1, "blur"] == round(29 / 30, 4) and got[10, "blur"] == round(20 / 30 * 0.3, 4)
    assert not [k for k in got if k[0] in (98, 99)]
    counts = {r.category: r.n for r in S.category_counts(spark.createDataFrame([(1, "blur", 0.7), (2, "blur", 0.3)], "item_id long, category string, score double")).collect()}
    assert counts["blur"] == 1 and counts["tiny"] == 0 and len(counts) == len(S.CATEGORIES)


NONE = (None, "none", "none")
# media (name, time), sidecars (name, title, time), and for each media its sidecar, rule and confidence
PAIRINGS = [
    ([("a.jpg", None)], [("a.jpg.supplemental-metadata.json", "a.jpg", None)], {0: (0, "R1", "high")}),
    ([("a.jpg", None)], [("a.jpg.json", None, None)], {0: (0, "R1", "low")}),
    ([("a.jpg", None)], [("a.jpg.json", "b.jpg", None)], {0: NONE}),
    ([("a(1).jpg", None)], [("a.jpg(1).json", "a.jpg", None)], {0: (0, "R2", "high")}),
    ([("a.jpg", None)], [("a.jpg(1).json", "a.jpg", None)], {0: NONE}),
    ([("A" * 44 + ".jpg", None)], [("A" * 44 + ".jp.json", "A" * 44 + ".jpg", None)], {0: (0, "R3", "high")}),
    ([("a.jpg", None)], [("a.json", "a.jpg", None)], {0: (0, "R4", "high")}),
    ([("a.jpg", None)], [("a.json", None, None)], {0: NONE}),
    ([("a.jpg", None)], [("A.JPG.json", "a.jpg", None)], {0: (0, "R5", "high")}),
    ([("a.jpg", None)], [("zzz.json", "a.jpg", None)], {0: (0, "R6", "high")}),
    ([("é.jpg", None)], [("é.jpg.json", "é.jpg", None)], {0: (0, "R1", "high")}),
    ([("a-edited.jpg", None)], [("a.jpg.json", "a.jpg", None)], {0: NONE}),
    ([("a.jpg", 0)], [("a.jpg.json", "a.jpg", 86400 + 14 * 3600)], {0: (0, "R1", "high")}),
    ([("a.jpg", 0)], [("a.jpg.json", "a.jpg", 86400 + 14 * 3600 + 1)], {0: NONE}),
    ([("a.jpg", None), ("a.jpg", None)], [("a.jpg.json", "a.jpg", None)], {0: NONE, 1: NONE}),
    ([("a.heic", None), ("a.mov", None)], [("a.json", "a.heic", None)], {0: (0, "R4", "high"), 1: NONE}),
    ([("Photo (1).jpg", None), ("Photo.jpg", None)], [("Photo (1).jpg.json", "Photo (1).jpg", None), ("Photo.jpg.json", "Photo.jpg", None)], {0: (0, "R1", "high"), 1: (1, "R1", "high")}),
    ([("a.jpg", None)], [], {0: NONE}),
]


def test_pairing(spark, scratch):
    """Each case in a folder of its own; keys are numbered through."""
    media, sidecars, want = [], [], {}
    for n, (ms, ss, expected) in enumerate(PAIRINGS):
        for i, (name, t) in enumerate(ms):
            media.append((100 * n + i, "e", f"f{n}", name, t))
            key, rule, conf = expected[i]
            want[100 * n + i] = (None if key is None else 100 * n + key, rule, conf)
        sidecars += [(100 * n + i, "e", f"f{n}", name, title, t) for i, (name, title, t) in enumerate(ss)]
    media.append((99_999, None, None, "a.jpg", None))
    want[99_999] = NONE
    sidecars.append((99_999, None, None, "a.jpg.json", "a.jpg", None))
    m = spark.createDataFrame(media, "media_key long, export_id string, folder string, filename string, exif_ts long")
    s = spark.createDataFrame(sidecars, "sidecar_key long, export_id string, folder string, json_name string, title string, taken_ts long")
    pairs = scratch.save(pair(m, s, scratch))
    assert {r.media_key: (r.sidecar_key, r.rule, r.conf) for r in pairs.collect()} == want
    assert unpaired(s, pairs).count() == len(sidecars) - sum(v[0] is not None for v in want.values())
    assert sum(r.n for r in pairing_stats(pairs).collect()) == len(media)
    assert pair(m.limit(0), s.limit(0), scratch).count() == 0


def test_mutual_best_in_rounds(spark, scratch):
    """A chain in which each pair's taking frees the next, a tie on one side, and a hot end."""
    from lumenfold.operators.pairing import mutual_best

    chain = [(i, j, i + j) for i in range(5) for j in (i, i + 1)]
    tie, hot = [(10, 20, 1), (11, 20, 1)], [(30, 40 + i, 5) for i in range(300)] + [(30, 999, 1)]
    df = spark.createDataFrame(chain + tie + hot, "media_key long, sidecar_key long, q int")
    assert sorted(map(tuple, mutual_best(df, scratch).collect())) == [(i, i) for i in range(5)] + [(30, 999)]
    assert mutual_best(df.limit(0), scratch).count() == 0


def test_media_of_all_kinds(spark, scratch):
    """A video or a raw file owns the sidecar that an image could have had; album copies and other reasons don't take part."""
    from lumenfold.operators.pairing import media_of_all_kinds

    images = spark.createDataFrame([(1, "e", "Photos from 2020", "a.jpg", 5, None)], "key long, export_id string, folder string, filename string, file_size long, exif_ts long")
    videos = spark.createDataFrame([(2, "e", "Photos from 2020", "a.mov", 6)], "key long, export_id string, folder string, filename string, file_size long")
    skipped = spark.createDataFrame([(3, "e", "Takeout/Google Photos/Photos from 2020/a.dng", "raw", 7), (4, "e", "Takeout/Google Photos/Trip/b.dng", "raw", 7), (5, "e", "Takeout/Google Photos/Photos from 2020/c.txt", "other", 7)], "key long, export_id string, member string, reason string, file_size long")
    m = media_of_all_kinds(images, videos, skipped)
    assert sorted((r.kind, r.key, r.filename) for r in m.collect()) == [("image", 1, "a.jpg"), ("skipped", 3, "a.dng"), ("video", 2, "a.mov")]
    s = spark.createDataFrame([(1, "e", "Photos from 2020", "a.dng.json", "a.dng", None)], "sidecar_key long, export_id string, folder string, json_name string, title string, taken_ts long")
    got = {r.media_key: r.sidecar_key for r in pair(m.withColumnRenamed("key", "media_key"), s, scratch).collect()}
    assert got == {1: None, 2: None, 3: 1}


def test_burst_reasons(spark):
    rows = [shot(1, 1, lap=230.0), shot(2, 2, lap=100.0, sub="014"), shot(3, 3, lap=0.0)]
    items, members = spark.createDataFrame(rows, SHOT), spark.createDataFrame([(1, i) for i in (1, 2, 3)], "burst long, item_id long")
    rank = B.ranked(members, items)
    got = {r.item_id: r.reason for r in B.extra_reasons(B.burst_extras(rank), B.burst_summary(members, items), rank).collect()}
    assert got == {2: "burst of 3 in 2.0 s; #1 is 2.3x sharper", 3: "burst of 3 in 2.0 s; #1 is sharper"}
