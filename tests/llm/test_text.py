"""Look-alike text and cut-off text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm.lookalike import Reader, bigrams, plain, same_looking, with_spelling
from lumenfold.llm.truncation import fit_censored, rates, truncated

CORPUS = ["Photos from 2019", "Screenshot one", "Осень в парке", "Кошка", "Θάλασσα", "Café Crème", "DSC", "IMG", "Поездка на море", "Ελλάδα"] * 5


@pytest.fixture(scope="module")
def reader():
    return Reader(bigrams(CORPUS))


ALIKE = [("DSC_0001.jpg", "DSС＿０００１．јрg"), ("Café", "Café"), ("a b", "a b"), ("IMG-1", "IMG‐1"), ("Осень", "Oсeнь"), ("x​y﻿", "xy"), ("Photos", "Рhоtоѕ"), ("Noël", "Nоël"), ("soft­hyphen", "softhyphen"), ("ﬁle", "file")]
OTHER = [("Café", "Cafe"), ("img", "IMG"), ("m²", "m2"), ("a", "b"), ("プール", "フール"), ("ab", "abc"), ("O0", "OO"), ("l1", "ll"), ("a-b", "aーb"), ("ß", "ss")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(reader, a, b):
    assert reader.text(a) == reader.text(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(reader, a, b):
    assert reader.text(a) != reader.text(b)


def test_readings_keep_to_a_script(reader):
    assert reader.text("Рhоtоѕ") == "Photos" and reader.text("Oceнь") == "Осень" and reader.text("Koшка") == "Кошка"
    assert reader.text("Θάλασσα") == "Θάλασσα"
    assert reader.text("") == "" and reader.text(None) is None
    assert plain("x" * 100_000 + "​") == "x" * 100_000


def test_idempotent_and_order_free(reader):
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("aеoΟоcсpрxхBВ5 -é") for _ in range(8))
        assert reader.text(reader.text(t)) == reader.text(t)


LEFT, RIGHT = "item_id long, zipkey string, folder string, filename string, extra int", "sidecar_id long, zipkey string, folder string, title string, side int"


def test_pairs(spark, scratch):
    left = [(1, "z", "f", "Photo.jpg", 1), (2, "z", "f", "Рhoto.jpg", 1), (3, "y", "f", "Photo.jpg", 1), (4, "z", None, "Photo.jpg", 1), (5, "z", "f", "", 1), (6, "z", "f", "photo.jpg", 1)]
    right = [(1, "z", "f", "Photo.jpg", 1), (2, "z", "f ", "Photo.jpg", 1), (3, "z", "f", None, 1), (4, "z", "f", "Ρhoto.jpg", 1), (5, "z", "f", "", 1)]
    args = ("zipkey", "item_id", "sidecar_id", ("folder", "filename"), ("folder", "title"))
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    got = {tuple(x) for x in same_looking(l, r, scratch, *args).collect()}
    assert got == {(1, 4), (2, 1), (2, 4)}
    assert same_looking(l.limit(0), r.limit(0), scratch, *args).count() == 0


def test_rows_of_one_spelling_are_not_paired(spark, scratch):
    many = spark.range(2000).select(F.col("id").alias("item_id"), F.lit("z").alias("zipkey"), F.lit("f").alias("folder"), F.lit("a.jpg").alias("filename"))
    other = many.select(F.col("item_id").alias("sidecar_id"), "zipkey", "folder", F.col("filename").alias("title")).unionByName(spark.createDataFrame([(9999, "z", "f", "а.jpg")], "sidecar_id long, zipkey string, folder string, title string"))
    assert same_looking(many, other, scratch, "zipkey", "item_id", "sidecar_id", ("folder", "filename"), ("folder", "title")).count() == 2000


def test_spellings_keep_rows(spark):
    df = spark.createDataFrame([("Рhoto", 1), (None, 2), ("", 3)], "t string, k int")
    assert {r.k: r.s for r in with_spelling(df, {"t": "s"}, bigrams(CORPUS)).collect()} == {1: "Photo", 2: None, 3: ""}


WORDS = ["the old lighthouse", "a forgotten folder", "our garden wall", "every tiny album", "the winter set", "one damaged print", "the station clock", "a second bicycle", "the upper deck", "this late upload"]
VERBS = ["replaces", "covers", "doubles", "restores", "hides", "matches", "crops", "repeats"]
TAILS = ["under a very grey sky", "near the old mill", "before we left the island", "during the long scan", "until the battery died"]


def sentence(rng):
    return f"{rng.choice(WORDS).capitalize()} {rng.choice(VERBS)} {rng.choice(WORDS)} {rng.choice(TAILS)}."


def test_cut_texts(spark, scratch):
    rng = random.Random(9)
    rows, cut = [], set()
    for i in range(2500):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 7)))
        kind = rng.random()
        if kind < 0.15:
            text = rng.choice(["Market day", "Slide box C", "Lunch", "View from room 14"])
        elif kind < 0.25:
            text += "\nFiled under: slides"
        elif kind < 0.30:
            text = text[:-1] + "..."
        if i % 2 and len(text) > 200:
            text = text[:200]
            if not text.rstrip().endswith((".", "slides")):
                cut.add(i)
        elif kind > 0.97 and len(text) > 60:
            text = text[: rng.randint(40, len(text) - 15)]
            if text[-1].isalpha() and text.split()[-1] not in {w.split()[-1] for w in [*WORDS, *TAILS]}:
                cut.add(i)
        rows.append((i, text, rng.choice(["s", "t", None])))
    rows += [(9001, None, "s"), (9002, "", "s"), (9003, "  \n", None)]
    found = truncated(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch)
    got = {r.doc_id for r in found.where("cut").collect()}
    assert len(got & cut) / len(cut) > 0.9 and len(got & cut) / len(got) > 0.85
    per = {r.source: (r.n_docs, r.n_cut) for r in rates(found).collect()}
    assert sum(n for n, _ in per.values()) == 2503 and set(per) == {"s", "t", None}


def test_odd_documents(spark, scratch):
    rows = [(None, "gone", "s"), (1, None, None), (2, "", "s"), (3, "word " * 60_000, "s"), (3, "one.", "s"), (4, "�", "s"), (5, "😀", "s"), (6, "x" * 300_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = truncated(df, scratch).collect()
    assert len(got) == 7 and {r.doc_id for r in got if r.doc_id in (1, 2) and r.cut} == set()
    assert truncated(df.limit(0), scratch).count() == 0


def test_censored_fit_recovers_the_distribution():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(5, 0.8, 20000)).astype(int) + 1
    y = np.minimum(x, 200)
    lengths, counts = np.unique(y, return_counts=True)
    mu, sd = fit_censored(lengths.astype(float), counts.astype(float), (lengths == 200).astype(float), 200)
    assert abs(mu - 5) < 0.03 and abs(sd - 0.8) < 0.03


@pytest.mark.parametrize("limit", [None, 100_000])
def test_limits_beyond_any_bin(spark, scratch, limit):
    """Lengths about 90,000: none is a limit by itself, and a real one is told from its neighbours."""
    from lumenfold.llm.truncation import length_limits

    rng = np.random.default_rng(5)
    lengths = np.exp(rng.normal(np.log(90_000), 0.5, 20_000)).astype(int)
    if limit:
        lengths = np.minimum(lengths, limit)
    df = spark.createDataFrame([("s", "chars", int(n)) for n in lengths], "source string, unit string, length long")
    found = {r.length: r.censored for r in length_limits(df, scratch).collect()}
    assert set(found) == ({limit} if limit else set())
    assert not limit or found[limit] > 0.9
    assert length_limits(df.limit(0), scratch).count() == 0


def test_vector_counts_equal_counts_one_by_one():
    """The keys and counts made for many texts at once are those of the definition."""
    from collections import Counter

    from lumenfold.llm import truncation as T

    texts = ["One day.\nOne day we went on", "x", "— and so on!\nTitle\n7.5 km, 12 cats", "a " * 50, "é" * 60 + " end"]
    got: Counter = Counter()
    for b in T._count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        for k, e, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[k, e] += n
    want: Counter = Counter()
    v = T._VOCABULARY
    for text in texts:
        t = T._tokens(text.rstrip())
        h, begun = [v.hash[0]] * 2 + [v.hash[i] for i in t], 0
        for i, x in enumerate(t):
            e = v.event[t[i + 1]] if i + 1 < len(t) else T.LINE
            for n in (1, 2, 3):
                want[T._key(n, h[i + 3 - n : i + 3]), e] += 1
            word = next(w for w, j in v.number.items() if j == x)
            for j in range(1, len(word) if word[0].isalpha() and len(word) <= T.PREFIX_CHARS else 0):
                want[T._key(T.PREFIX_SEED, map(ord, word[:j])), T.PREFIX] += 1
            if e in (T.LINE, T.STOP):
                unit = t[begun : i + 1]
                while unit and not v.word[unit[0]]:
                    unit = unit[1:]
                if 0 < len(unit) <= T.UNIT_TOKENS:
                    want[T._key(T.UNIT_SEED, [v.hash[x] for x in unit]), T.UNIT] += 1
                begun = i + 1
    assert got == want


def test_ends_are_read_to_their_boundary():
    from lumenfold.llm import truncation as T

    assert T._core("so it goes [ " + " " * 60 + "… ]") == ("so it goes", 2, T.PLAIN)
    assert T._core("so it goes" + "." * 80) == ("so it goes", 1, T.PLAIN)
    long = "word " * 400
    tokens, start = T._last_unit("First line\n" + long.strip())
    assert len(tokens) - start == 400


@pytest.mark.parametrize(("shown", "plain_"), [("Ꮲhоtoѕ", "Photos"), ("ɡɑrdеn", "garden"), ("ᴏcеɑn", "ocean"), ("ѕեаr", None)])
def test_letters_of_more_scripts(shown, plain_):
    reader = Reader(bigrams(["Photos", "garden", "ocean", "star"] * 5))
    assert (reader.text(shown) == plain_) if plain_ else reader.text(shown) != "star"


def test_classes_are_disjoint():
    from lumenfold.llm import lookalike as L

    groups = [g.split() for line in L.LOOKALIKES.strip().splitlines() for g in line.split("|")]
    letters = [c for g in groups for c in g]
    assert len(letters) == len(set(letters)) and all(L.script(c) is not None for c in letters)
