"""Neighbours, runs, packs and mixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm.curves import hilbert_keys
from lumenfold.llm.mixing import blocks, draws, mix, permuted, quotas, shares
from lumenfold.llm.neighbours import nearest, neighbour_pairs
from lumenfold.llm.packing import WEIGHTS, attention_cost, best_fit, fills, pack, tile_of
from lumenfold.llm.runs import agglomerate, collapsed, runs
from lumenfold.llm.tokenizer import TOKENIZER, count_tokens, with_token_counts


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_touch(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def exact_neighbours(x, k, least):
    norm = np.linalg.norm(x, axis=1)
    good = norm > 0
    unit = np.where(good[:, None], x / np.where(good, norm, 1)[:, None], 0)
    s = unit @ unit.T
    out = set()
    for i in np.flatnonzero(good):
        s[i, i] = -2
        order = np.lexsort((np.arange(len(x)), -s[i]))[:k]
        out |= {(int(i), int(j)) for j in order if good[j] and s[i, j] >= least}
    return out


def vector_table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "emb_row long, emb array<float>")


def test_neighbours_against_brute_force(spark, scratch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 900)] + rng.normal(size=(900, 16)) * 0.15).astype(np.float32)
    x[5] = 0
    x[700] *= 4
    want = exact_neighbours(x.astype(np.float64), 10, 0.9)
    got = {(r.a, r.b) for r in nearest(vector_table(spark, x), scratch, 10, 0.9).collect()}
    assert len(want & got) / len(want) > 0.97 and len(want & got) / len(got) > 0.97


def test_copies_have_k_neighbours_each(spark, scratch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(3, 8)), [40, 3, 1], axis=0).astype(np.float32)
    x[41] *= 2
    got = defaultdict(set)
    for r in nearest(vector_table(spark, x), scratch, 5, 0.999).collect():
        got[r.a].add(r.b)
    assert got[0] == {1, 2, 3, 4, 5} and got[3] == {0, 1, 2, 4, 5} and got[39] == {0, 1, 2, 3, 4}
    assert got[40] == {41, 42} and got[43] == set()
    assert neighbour_pairs(nearest(vector_table(spark, x), scratch, 5, 0.999)).where("emb_row_a >= emb_row_b").count() == 0


@pytest.mark.parametrize("n", [2, 9, 30])
def test_few_vectors_in_many_partitions(spark, scratch, n):
    """All pairs of a few vectors are found, although there are more partitions than a window has rows."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
        assert {(r.a, r.b) for r in nearest(vector_table(spark, x), scratch, n).collect()} == {(i, j) for i in range(n) for j in range(n) if i != j}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_borders_skip_empty_partitions(spark, scratch, monkeypatch):
    """Vectors in two far groups on one curve, with partitions between them that stay empty."""
    from pyspark.sql import DataFrame

    spread = DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, *cols: spread(self, *cols).repartition(8, (F.col("row") % 2) * 5) if "row" in cols else spread(self, *cols))
    x = np.random.default_rng(1).normal(size=(20, 4)).astype(np.float32)
    got = {(r.a, r.b) for r in nearest(vector_table(spark, x), scratch, 19, curves=1).collect()}
    assert len(got) == 20 * 19


def test_odd_vectors(spark, scratch):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "emb_row long, emb array<float>")
    assert {(r.a, r.b) for r in nearest(df, scratch, 3, 0.9).collect()} == {(1, 2), (2, 1)}
    assert nearest(df.limit(0), scratch).count() == 0


def test_agglomeration_order_free():
    d = np.array([5, 1, 9, 2, 2])
    assert agglomerate(d, np.array([1, 1, 0, 1, 1], bool)).tolist() == [0, 0, 0, 3, 3, 3]
    assert agglomerate(np.empty(0, int), np.empty(0, bool)).tolist() == [0]


EVENT = "zipkey string, model string, epoch_s long, item_id long, phash64 long, pid string, run int"


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_a_scan(spark, scratch, seed):
    rng = random.Random(seed)
    # one camera holds most events, many of them in one second, so that runs cross the borders of partitions
    rows = [(rng.choice("aab"), rng.choice("mmn"), rng.choice([50, 51, rng.randrange(4000)]), i, rng.choice([1, 3, -1]), "p", 1) for i in range(1500)]
    rows += [("a", None, 1, 5001, 1, "", 1), ("a", "m", None, 5002, 1, "", 1), ("a", "m", 1, 5003, None, "", 1), ("a", "m", 1, 5004, 0, "", 1), (None, "m", 1, 5005, 1, "", 1)]
    order = sorted((r for r in rows if None not in r and r[4]), key=lambda r: (r[0], r[1], r[2], r[3]))
    want, run = set(), []
    for a, b in zip(order, order[1:] + [None], strict=False):
        run.append(a)
        if not (b and a[:2] == b[:2] and b[2] - a[2] <= 3 and ((a[4] ^ b[4]) & (2**64 - 1)).bit_count() <= 10):
            want |= {(run[0][3], r[3]) for r in run if len(run) > 1}
            run = []
    df = spark.createDataFrame(rows, EVENT)
    found = runs(df, scratch, ("zipkey", "model"), "epoch_s", "item_id", "phash64")
    assert {(r.first_item_id, r.item_id) for r in found.collect()} == want
    whole = collapsed(found, "item_id").agg(F.sum("n_events"), F.min("duration_s")).first()
    assert whole[0] == len(want) and whole[1] >= 0


def test_runs_of_one_hot_second_and_of_nothing(spark, scratch):
    df = spark.range(5000).select(F.lit("z").alias("zipkey"), F.lit("m").alias("model"), F.lit(7).alias("epoch_s"), F.col("id").alias("item_id"), F.lit(9).alias("phash64"))
    assert runs(df, scratch, ("zipkey", "model"), "epoch_s", "item_id", "phash64").groupBy("first_item_id").count().collect() == [(0, 5000)]
    assert runs(df.limit(0), scratch, ("zipkey", "model"), "epoch_s", "item_id", "phash64").count() == 0


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(measure):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 800)
    most = attention_cost(128, 8) * 0.7
    packs = best_fit(sizes, 128, 5, most, measure)
    load, n = np.bincount(packs, sizes), np.bincount(packs)
    assert load.max() <= 128 and n.max() <= 5 and np.bincount(packs, attention_cost(sizes, 8)).max() <= most
    assert len(load) <= 1.25 * max(sizes.sum() / 128, len(sizes) / 5)


def one_by_one(sizes, capacity, max_docs, measure):
    """Best fit of one piece after the other, by the definition."""
    full, w = np.array([capacity, max_docs, attention_cost(capacity, tile_of(capacity))], float), np.array(WEIGHTS)
    packs, out = [], np.empty(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        need = np.array([sizes[i], 1.0, attention_cost(sizes[i], tile_of(capacity))])
        best = None
        for p, left in enumerate(packs):
            rest = left - need
            if (rest >= -1e-9).all():
                score = (w * (rest / full) ** 2).sum() if measure == "norm" else -(w * need / full * left / full).sum()
                if best is None or score < best[0] - 1e-12:
                    best = (score, p)
        if best is None:
            packs.append(full.copy())
            best = (0, len(packs) - 1)
        packs[best[1]] -= need
        out[i] = best[1]
    return out


@pytest.mark.parametrize("measure", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_one_size_are_placed_as_one_by_one(measure, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([1, 2, 3, 5, 8, 40, 64, 100], 300, p=[0.4, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])
    got, want = best_fit(sizes, 128, 20, None, measure), one_by_one(sizes, 128, 20, measure)
    loads = lambda p: sorted(zip(np.bincount(p, sizes), np.bincount(p), strict=True))
    assert loads(got) == loads(want)


def test_attention_binds_where_tokens_and_documents_are_left():
    """A pack of 2,048 tokens takes 136 tiles: pieces of 5 tokens exhaust these before 256 documents or the tokens."""
    packs = best_fit(np.full(1360, 5), 2048, 256)
    assert np.bincount(packs).tolist() == [136] * 10
    assert best_fit(np.array([], int), 64).tolist() == []


def test_packs(spark, scratch):
    rng = random.Random(4)
    rows = [(i, rng.choice([3, 10, 60, 64, 65, 700])) for i in range(400)] + [(900, 0), (901, None), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    kinds = [("small", 64), ("large", 512)]
    placed = pack(df, kinds, scratch, max_docs=8)
    got = placed.collect()
    for name, c in kinds:
        spans = defaultdict(list)
        for r in got:
            if r["pack"] == name:
                spans[r.doc_id].append((r.from_token, r.n_tokens))
        assert {d: sum(n for _, n in s) for d, s in spans.items()} == {d: n for d, n in rows if d is not None and n}
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
        assert all(len(s) == 1 for d, s in spans.items() if dict(rows)[d] <= c)
    f = fills(placed, kinds).collect()
    assert max(r.fill for r in f) <= 1 and max(r.n_pieces for r in f) <= 8 and max(r.tiles for r in f) <= 136
    assert len({(r["pack"], r.pack_id) for r in got}) == len(f)
    assert pack(df.limit(0), kinds, scratch).count() == 0
    twice = spark.createDataFrame([(1, 64), (1, 64), (1, 10), (1, 10)], "doc_id long, n_tokens long")
    assert sorted(r.n_pieces for r in fills(pack(twice, kinds[:1], scratch), kinds[:1]).collect()) == [1, 1, 2]


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("x y " * 50_000,)], "text string")
    got = [r.n_tokens for r in with_token_counts(df, "text").collect()]
    assert got[:3] == [2, 0, 0] and got[3] == count_tokens("x y " * 50_000, TOKENIZER) > 90_000


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000, 12345])
def test_permutations(size):
    i = np.arange(size)
    p = permuted(i, np.full(size, size), np.full(size, 7))
    assert sorted(p) == list(range(size))
    assert size < 64 or (p != permuted(i, np.full(size, size), np.full(size, 8))).any()


def test_quotas_and_draws():
    q = quotas({"a": 50, "b": 30, "c": 20, "d": 5}, {"a": 100, "b": 10, "c": 100}, {"a": 1, "b": 3, "c": 1, "d": 9})
    assert sum(q.values()) == 100 and q == {"a": 50, "b": 30, "c": 20}
    assert quotas({}, {}, {}) == {} and quotas({"a": 1.0}, {"a": 7}, {"a": 2}, 5) == {"a": 5}
    d = draws(q, 7, 3)
    assert Counter({s: sum(x[2] for x in d if x[1] == s) for s in q}) == Counter(q)
    assert all(sum(x[2] for x in d if x[0] == k) in (14, 15, 16) for k in range(7))


def test_draws_of_many_groups(spark, monkeypatch):
    """Shards drawn by tasks in groups: quotas are met exactly, every draw of a source has its own number, and the counts vary."""
    from lumenfold.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 16)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 4)
    quota = {"a": 500, "b": 300, "c": 33}
    d = mixing.drawn_shards(spark, quota, 5).collect()
    assert {s: sum(r["count"] for r in d if r.source == s) for s in quota} == quota
    for s in quota:
        numbers = sorted(n for r in d if r.source == s for n in range(r.before, r.before + r["count"]))
        assert numbers == list(range(quota[s]))
    for shard in {r.shard for r in d}:
        rows = sorted((r.at, r["count"], r.slots) for r in d if r.shard == shard)
        assert sum(c for _, c, _ in rows) == rows[0][2] and all(a + c == b for (a, c, _), (b, _, _) in zip(rows, rows[1:], strict=False))
    assert len({r.shard for r in d}) == 53 and len({r["count"] for r in d if r.source == "a"}) > 5
    few = mixing.drawn_shards(spark, {"a": 2, "b": 1, "c": 1}, 1).collect()
    assert len({r.shard for r in few}) == 3 and sum(r["count"] for r in few) == 4


def test_mixture(spark, scratch):
    rng = random.Random(6)
    rows = [(i, rng.choices(["big", "mid", "small", None], [70, 20, 8, 2])[0], rng.randint(0, 300), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, block string")
    targets = [("big", 40.0, 1), ("mid", 40.0, 3), ("small", 20.0, 4), ("absent", 10.0, 5)]
    chosen = mix(df, targets, scratch, block_tokens=64)
    got = chosen.collect()
    used = Counter((r.source, r.block, r["pass"]) for r in {(x.source, x.block, x["pass"], x.shard, x.slot): x for x in got}.values())
    assert max(used.values()) == 1
    assert len({(r.shard, r.slot) for r in got}) == len(used)
    repeats = {s: n for s, _, n in targets}
    times = Counter((r.source, r.doc_id, r.from_token) for r in got)
    assert all(n <= repeats[s] for (s, _, _), n in times.items())
    table = {r.source: r for r in shares(chosen, spark.createDataFrame(targets, "source string, weight double, max_repeats int")).collect()}
    assert abs(table["big"].share - 40) < 0.5 and abs(table["small"].share - 20) < 0.5 and table["absent"].share == 0
    assert mix(df.limit(0), targets, scratch).count() == 0


def test_blocks_hold_every_token_once(spark, scratch):
    rows = [(i, "s", n) for i, n in enumerate([10, 64, 1, 200, 0, 5])] + [(50, "t", 7), (51, None, 9)]
    got = blocks(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), scratch, 64).collect()
    sizes = Counter()
    per_doc = Counter()
    for r in got:
        sizes[r.source, r.block] += r.to_token - r.from_token
        per_doc[r.doc_id] += r.to_token - r.from_token
    assert sizes == {("s", 0): 64, ("s", 1): 64, ("s", 2): 64, ("s", 3): 64, ("s", 4): 24, ("t", 0): 7}
    assert per_doc == {d: n for d, s, n in rows if n and s}
