"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.linking import linked_groups
from lumenfold.llm.lookalike import letter_counts, same_looking, with_spelling
from lumenfold.llm.mixing import mix, shares
from lumenfold.llm.neighbours import nearest, neighbour_pairs
from lumenfold.llm.oracles import ORACLES  # noqa: F401
from lumenfold.llm.packing import fills, pack
from lumenfold.llm.runs import collapsed, runs
from lumenfold.llm.survivorship import keepers, survive
from lumenfold.llm.tokenizer import with_token_counts
from lumenfold.llm.truncation import rates, truncated
from lumenfold.operators.capture import photo_instants
from lumenfold.operators.deliveries import latest_values
from lumenfold.session import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
RANKED = ["width", "height", "stored_w", "stored_h", "has_camera_exif", "exif_lat", "exif_lon", "file_size"]
GOLDEN = ["width", "height", "exif_dt", "exif_offset", "make", "model", "exif_lat", "exif_lon", "file_size", "filename"]


def _photos(spark: SparkSession, d: str, scratch: Scratch, fields: list[str]) -> DataFrame:
    """The repaired fields of every photo, by survivorship of its deliveries."""
    return scratch.save(survive(table(spark, d, "items_raw"), ["item_id"], fields, "scanned_at"), "photos")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The keeper of every group of matching photos."""
    scratch = Scratch(spark, "p1")
    photos = _photos(spark, d, scratch, [*RANKED, "sha256", "phash64"])
    groups = linked_groups(photos, scratch)
    sidecars = survive(table(spark, d, "sidecars_raw"), ["sidecar_id"], ["item_id", "favorited"], "scanned_at")
    return keepers(groups.join(photos.select("item_id", *RANKED), "item_id"), sidecars.where("favorited = 1 and item_id is not null"))


def p1_golden(spark: SparkSession, d: str) -> DataFrame:
    """One record per group of matching photos, each field from the most trusted, then latest delivery that has it.

    A photo in a year folder is trusted over one in an album.
    """
    scratch = Scratch(spark, "p1g")
    groups = linked_groups(_photos(spark, d, scratch, ["sha256", "phash64"]), scratch)
    rows = table(spark, d, "items_raw").select("item_id", "scanned_at", "folder_kind", *GOLDEN).join(groups, "item_id")
    return survive(rows, ["group_item_id"], GOLDEN, "scanned_at", F.when(F.col("folder_kind") == "year", 1).otherwise(0))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every photo that matches another, with its group's smallest item_id."""
    scratch = Scratch(spark, "p2")
    return linked_groups(_photos(spark, d, scratch, ["sha256", "phash64"]), scratch)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Photos and sidecars of one archive whose folder and name display alike in different characters."""
    photos = latest_values(table(spark, d, "items_raw"), "item_id", ["zipkey", "folder", "filename"])
    sidecars = latest_values(table(spark, d, "sidecars_raw"), "sidecar_id", ["zipkey", "folder", "title"])
    return same_looking(photos, sidecars, Scratch(spark, "p3"), "zipkey", "item_id", "sidecar_id", ("folder", "filename"), ("folder", "title"))


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    """The one spelling of every photo's folder and name."""
    photos = latest_values(table(spark, d, "items_raw"), "item_id", ["folder", "filename"])
    photos = Scratch(spark, "p3n").save(photos, "names")
    return with_spelling(photos, {"folder": "folder_spelt", "filename": "filename_spelt"}, letter_counts(photos, ["folder", "filename"]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors with a cosine of at least 0.90, one of them among the other's ten most similar."""
    used = table(spark, d, "items").where("emb_row is not null").select("emb_row")
    vectors = table(spark, d, "emb_matrix").join(used, "emb_row", "left_semi")
    return neighbour_pairs(nearest(vectors, Scratch(spark, "p4"), k=10, min_cosine=0.9))


def _bursts(spark: SparkSession, d: str, label: str) -> DataFrame:
    shots = photo_instants(table(spark, d, "items_raw"), table(spark, d, "exports"), ["zipkey", "model", "phash64"])
    return runs(shots, Scratch(spark, label), ("zipkey", "model"), "epoch_s", "item_id", "phash64", max_gap=3, max_bits=10)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every photo of a run of near-identical shots, with the run's first."""
    return _bursts(spark, d, "p5").select("first_item_id", "item_id")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run of shots as one event with its count and duration."""
    return collapsed(_bursts(spark, d, "p5r"), "item_id")


def _sized(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    """Documents with their token counts; texts are encoded once."""
    return scratch.save(with_token_counts(table(spark, d, "documents").select("doc_id", "source", "text"), "text").drop("text"), "sized")


def _packed(spark: SparkSession, d: str, label: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    scratch = Scratch(spark, label)
    kinds = [(r["pack"], r["capacity"]) for r in table(spark, d, "pack_sizes").select("pack", "capacity").collect()]
    return pack(_sized(spark, d, scratch), kinds, scratch), kinds


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    """The pack of every document or piece of one, for each kind of pack."""
    return _packed(spark, d, "p7")[0]


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """The fill of every pack."""
    return fills(*_packed(spark, d, "p7f"))


def _mixed(spark: SparkSession, d: str, label: str) -> DataFrame:
    scratch = Scratch(spark, label)
    targets = [(r["source"], r["weight"], r["max_repeats"]) for r in table(spark, d, "mix_targets").select("source", "weight", "max_repeats").collect()]
    return mix(_sized(spark, d, scratch), targets, scratch)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The blocks selected for every output shard, with the spans of documents in them."""
    return _mixed(spark, d, "p8")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of tokens that each source wanted and reached."""
    selected = Scratch(spark, "p8s").save(_mixed(spark, d, "p8s"), "selected")
    return shares(selected, table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text stops before its end."""
    return truncated(table(spark, d, "documents"), Scratch(spark, "p9")).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return rates(truncated(table(spark, d, "documents"), Scratch(spark, "p9r")))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_golden": p1_golden, "p2_found": p2_found, "p3_found": p3_found, "p3_names": p3_names, "p4_found": p4_found, "p5_found": p5_found, "p5_runs": p5_runs, "p7_packs": p7_packs, "p7_fill": p7_fill, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found, "p9_rates": p9_rates}

