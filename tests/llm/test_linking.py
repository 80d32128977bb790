"""Groups of matching records: hashes against brute force, components against union-find, hot buckets and classes."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.llm.linking import block_masks, components, hamming_pairs, linked_groups, match_edges
from lumenfold.llm.survivorship import keepers, survive


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {(v, find(v)) for v in list(parent)}


def solved(spark, scratch, edges):
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a long, b long, label string")
    return {tuple(r) for r in components(df, scratch).collect()}


def shapes():
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(40)]
    back = [(100 + a, 100 + b) for a, b in zip(random.Random(2).sample(range(30), 30), random.Random(2).sample(range(30), 30)[1:], strict=False)]
    cycle = [(200 + i, 200 + (i + 1) % 17) for i in range(17)]
    star = [(300, 301 + i) for i in range(50)]
    late_star = [(499, 400 + i) for i in range(50)]
    clique = [(500 + i, 500 + j) for i in range(7) for j in range(i)]
    tree = [(600 + i, 600 + (i - 1) // 2) for i in range(1, 60)]
    theta = [(700, 701), (701, 702), (702, 709), (700, 703), (703, 704), (704, 709), (700, 709), (709, 720), (720, 721)]
    noise = [(800 + rng.randrange(80), 800 + rng.randrange(80)) for _ in range(70)]
    return {"path": path, "shuffled path": back, "cycle": cycle, "triangle": [(1, 2), (2, 3), (3, 1)], "star": star, "late star": late_star, "clique": clique, "tree": tree, "theta": theta, "noise": noise, "all": path + back + cycle + star + late_star + clique + tree + theta + noise}


@pytest.mark.parametrize("name", ["shuffled path", "all"])
def test_components(spark, scratch, name):
    edges = shapes()[name]
    assert solved(spark, scratch, edges) == union_find([e for e in edges if e[0] != e[1]])


def test_components_of_odd_tables(spark, scratch):
    assert solved(spark, scratch, []) == set()
    assert solved(spark, scratch, [(1, 1), (None, 2), (2, None)]) == set()
    assert solved(spark, scratch, [(1, 2), (2, 1), (1, 2), (5, 5)]) == {(1, 1), (2, 1)}


def near_hashes(n, seed, shared=0):
    rng = random.Random(seed)
    base = [(shared << 32) | rng.getrandbits(32) if shared else rng.getrandbits(64) for _ in range(n)]
    out = set(base)
    for h in base:
        for _ in range(2):
            x = h
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            out.add(x)
    return [h - 2**64 if h >> 63 else h for h in sorted(out)]


@pytest.mark.parametrize(("shared", "hot"), [(0, 2000), (0, 2), (0xABCDEF12, 20)])
def test_hamming_pairs(spark, scratch, shared, hot):
    hashes = near_hashes(120, 4, shared)
    df = spark.createDataFrame(list(enumerate(hashes)), "rep long, h long")
    want = {frozenset((i, j)) for i, a in enumerate(hashes) for j, b in enumerate(hashes[:i]) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [frozenset(r) for r in hamming_pairs(df, scratch, 3, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_masks_cover_every_pair_of_blocks():
    masks = block_masks(3)
    assert len(masks) == 10 and all(25 <= m.bit_count() <= 26 for m in masks)


PHOTO = "item_id long, sha256 binary, phash64 long, path string"


def test_groups(spark, scratch):
    rows = [(5, b"a", None, ""), (9, b"a", 7, ""), (2, None, 7 ^ 0b111000, ""), (3, None, 0, ""), (4, None, 0, ""), (6, b"b", -1, ""), (8, None, None, ""), (7, b"b", 12345678, ""), (None, b"a", 7, ""), (1, b"", None, ""), (10, b"", None, "")]
    got = {tuple(r) for r in linked_groups(spark.createDataFrame([(i, bytearray(s) if s is not None else None, h, p) for i, s, h, p in rows], PHOTO), scratch).collect()}
    assert got == {(2, 2), (2, 5), (2, 9), (6, 6), (6, 7), (1, 1), (1, 10)}
    assert linked_groups(spark.createDataFrame([], PHOTO), scratch).count() == 0


def test_a_class_of_copies_costs_a_star(spark, scratch):
    df = spark.range(3000).select(F.col("id").alias("item_id"), F.lit(bytearray(b"same")).alias("sha256"), F.lit(99).cast("long").alias("phash64"))
    assert match_edges(df, scratch).count() == 2 * 2999
    assert linked_groups(df, scratch).agg(F.count("*"), F.max("group_item_id")).first()[:] == (3000, 0)


MEMBER = "group_item_id long, item_id long, width int, height int, stored_w int, stored_h int, has_camera_exif int, exif_lat double, exif_lon double, file_size long"


@pytest.mark.parametrize(
    ("a", "b", "liked", "keeper"),
    [
        ((10, 10, 1, 1, 0, None, None, 1), (10, 9, 1, 1, 1, 1.0, 1.0, 9), [], 1),
        ((0, 0, 20, 20, 0, None, None, 1), (10, 10, 1, 1, 0, None, None, 9), [], 1),
        ((10, 10, 1, 1, None, None, None, 9), (10, 10, 1, 1, 1, None, None, 1), [], 2),
        ((10, 10, 1, 1, 1, 0.0, 0.0, 9), (10, 10, 1, 1, 1, 0.0, 5.0, 1), [], 2),
        ((10, 10, 1, 1, 1, None, 3.0, 9), (10, 10, 1, 1, 1, None, None, 1), [2], 2),
        ((10, 10, 1, 1, 1, None, None, None), (10, 10, 1, 1, 1, None, None, 1), [], 2),
        ((10, 10, 1, 1, 1, None, None, -5), (10, 10, 1, 1, 1, None, None, None), [], 1),
        ((60000, 60000, 1, 1, 1, None, None, 1), (60000, 59999, 1, 1, 1, None, None, 1), [1, 1], 1),
    ],
)
def test_keepers(spark, a, b, liked, keeper):
    members = spark.createDataFrame([(1, 1, *a), (1, 2, *b)], MEMBER)
    assert keepers(members, spark.createDataFrame([(i,) for i in liked], "item_id long")).collect() == [(1, keeper)]


def test_survivors(spark):
    rows = [(1, "a", None, 5, 0, 9), (1, "b", "x", 4, 1, 9), (1, None, "y", 9, 0, 9), (None, "z", "z", 1, 1, 9), (2, None, None, None, None, 9)]
    df = spark.createDataFrame(rows, "k int, u string, v string, t int, trust int, value int")
    got = {r.k: (r.u, r.v) for r in survive(df, ["k"], ["u", "v"], "t", F.col("trust")).collect()}
    assert got == {1: ("b", "x"), 2: (None, None)}
    assert {r.k: r.u for r in survive(df, ["k"], ["u"], "t").collect()}[1] == "a"
    assert survive(df.limit(0), ["k"], ["u"]).count() == 0
