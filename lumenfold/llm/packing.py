"""Fixed-capacity packs filled with texts by vector best-fit.

A pack has three capacities: tokens, documents, and attention cost, counted in the tiles that a block-wise kernel computes: a piece
of t tiles of tokens costs t (t + 1) / 2, so many short pieces can exhaust the attention of a pack that has tokens left. A piece goes to the open
pack that satisfies all three and is left with the smallest weighted residual norm, or has the largest weighted dot-product
with the piece. Spark spreads the pieces over shards of bounded size; the packs that stay under-filled are packed again
together, shard borders drawn anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch

SHARD_PIECES = 10_000
TILES = 16  # attention tiles on a side of a full pack
MAX_DOCS = 256
REFILL_BELOW = 0.98
WEIGHTS = (1.0, 0.05, 0.2)
PLACED = "pack string, pack_id string, doc_id long, piece int, from_token long, n_tokens long, uid long"


def tile_of(capacity: int) -> int:
    """Tokens on a side of a tile."""
    return max(1, capacity // TILES)


def attention_cost(n, tile: int):
    """Tiles of a piece's tokens at or before each of its tiles: whole tiles are computed, however few of their tokens there are."""
    t = np.ceil(np.asarray(n, float) / tile)
    return t * (t + 1) / 2


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int = MAX_DOCS, max_cost: float | None = None, measure: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Pack numbers of pieces, largest first; every piece must fit an empty pack.

    measure 'norm': the pack whose weighted residual after placing is the smallest; 'dot': the pack whose residual has the
    largest weighted dot-product with the piece. Ties go to the pack opened first. Pieces of one size are placed together: by
    'norm' the pack that got the first of them is the best for the next, as its residual only shrank, until it takes no more;
    by 'dot' each is placed for itself.
    """
    tile = tile_of(capacity)
    full = np.array([capacity, max_docs, attention_cost(capacity, tile) if max_cost is None else max_cost], float)
    w = np.array(weights)
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    left = np.empty((0, 3))  # what the open packs have left, in units
    name = np.empty(0, np.int64)
    n_packs, at = 0, 0
    while at < len(order):
        size = sizes[order[at]]
        end = at + int(np.searchsorted(-sizes[order[at:]], -size, side="right")) if measure == "norm" else at + 1
        need = np.array([size, 1.0, float(attention_cost(size, tile))])
        room = np.floor(((left + 1e-9) / need).min(axis=1)).astype(np.int64) if len(left) else np.empty(0, np.int64)
        fits = np.flatnonzero(room > 0)
        rest = (left[fits] - need) / full
        score = (w * rest**2).sum(1) if measure == "norm" else -(w * (need / full) * (left[fits] / full)).sum(1)
        fits = fits[np.argsort(score, kind="stable")]
        take = np.minimum(np.maximum(end - at - np.concatenate([[0], np.cumsum(room[fits])[:-1]]), 0), room[fits]).astype(np.int64) if len(fits) else np.empty(0, np.int64)
        used = int(take.sum())
        out[order[at : at + used]] = np.repeat(name[fits], take)
        left[fits] -= take[:, None] * need
        missing = end - at - used
        if missing:
            each = int(np.floor((full + 1e-9) / need).min())
            n_new = -(-missing // each)
            filled = np.full(n_new, each)
            filled[-1] = missing - each * (n_new - 1)
            new = n_packs + np.arange(n_new)
            out[order[at + used : end]] = np.repeat(new, filled)
            left, name, n_packs = np.concatenate([left, full - filled[:, None] * need]), np.concatenate([name, new]), n_packs + n_new
        at = end
        # Packs that take no piece of the smallest size are closed; the others stay in the order of their opening.
        if at < len(order):
            least = np.array([sizes[order[-1]], 1.0, float(attention_cost(sizes[order[-1]], tile))])
            alive = (left + 1e-9 >= least).all(axis=1)
            left, name = left[alive], name[alive]
    return out


def _packer(stage: str, max_docs: int, measure: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "uid"], kind="stable").reset_index(drop=True)
        packs = best_fit(part.n_tokens.to_numpy(), int(part.capacity.iloc[0]), max_docs, None, measure)
        shard = int(part.shard.iloc[0])
        return part.assign(pack_id=[f"{stage}-{shard}-{p}" for p in packs])[[c.split(" ")[0] for c in PLACED.split(", ")]]

    return run


def _of_pack(packs: list[tuple[str, int]], f: Callable[[int], float]) -> Column:
    """What a row's kind of pack has, by its capacity."""
    return F.create_map(*[F.lit(x) for name, c in packs for x in (name, f(c))])[F.col("pack")]


def pack(documents: DataFrame, packs: list[tuple[str, int]], scratch: Scratch, key: str = "doc_id", tokens: str = "n_tokens", max_docs: int = MAX_DOCS, measure: str = "norm") -> DataFrame:
    """(pack, pack_id, doc_id, piece, from_token, n_tokens): every document laid into packs of each kind.

    packs: kinds and token capacities, a handful. A document is split only if it exceeds the capacity; its whole
    pieces are packs of their own. The attention capacity is the cost of one document that fills the pack. Documents with null or no
    tokens have no piece; repeated keys are packed each on their own; an empty table gives an empty table. Pieces are numbered as they are
    written, so the names of packs don't change if a later task runs again.
    """
    kinds = F.array(*[F.struct(F.lit(name).alias("pack"), F.lit(c).cast("long").alias("capacity")) for name, c in packs])
    docs = documents.where((F.col(tokens) > 0) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(tokens).cast("long").alias("total"), F.explode(kinds).alias("k")).select("doc_id", "total", "k.*")
    starts = F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("capacity"))
    pieces = docs.select("*", F.posexplode(starts).alias("piece", "from_token")).withColumn("n_tokens", F.least("capacity", F.col("total") - F.col("from_token")))
    pieces = scratch.save(pieces.select("pack", "capacity", "doc_id", "piece", "from_token", "n_tokens", F.monotonically_increasing_id().alias("uid")), "pieces")
    cols = [c.split(" ")[0] for c in PLACED.split(", ")]
    whole = pieces.where("n_tokens = capacity").withColumn("pack_id", F.concat_ws("-", F.lit("w"), "doc_id", "piece", "uid")).select(*cols)
    parts = pieces.where("n_tokens < capacity")
    counts = {r["pack"]: r["count"] for r in parts.groupBy("pack").count().collect()}  # a row for each kind

    def sharded(df: DataFrame, sizes: dict[str, int], salt: int) -> DataFrame:
        shards = F.coalesce(F.create_map(*[F.lit(x) for n, c in sizes.items() for x in (n, max(1, -(-c // SHARD_PIECES)))])[F.col("pack")], F.lit(1)) if sizes else F.lit(1)
        return df.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(salt)), shards).cast("int"))

    first = sharded(parts, counts, 1).groupBy("pack", "shard").applyInPandas(_packer("a", max_docs, measure), PLACED)
    first = scratch.save(first, "first")
    capacity, tiles = _of_pack(packs, lambda c: c), F.ceil(F.col("n_tokens") / _of_pack(packs, tile_of))
    loads = first.groupBy("pack", "pack_id").agg(F.sum("n_tokens").alias("load"), F.count("*").alias("n"), F.sum(tiles * (tiles + 1) / 2).alias("cost"))
    most = _of_pack(packs, lambda c: float(attention_cost(c, tile_of(c))))
    under = loads.where((F.col("load") < capacity * REFILL_BELOW) & (F.col("n") < max_docs) & (F.col("cost") < most)).select("pack", "pack_id", F.lit(True).alias("under"))
    marked = scratch.save(first.join(under, ["pack", "pack_id"], "left"), "marked")
    again = marked.where("under")
    left = {r["pack"]: r["count"] for r in again.groupBy("pack").count().collect()}
    second = sharded(again.withColumn("capacity", capacity.cast("long")), left, 2).groupBy("pack", "shard").applyInPandas(_packer("b", max_docs, measure), PLACED)
    done = marked.where("under is null").select(*cols)
    return whole.unionByName(done).unionByName(second).drop("uid")


def fills(placed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """One row per pack: pieces, tokens, capacity, fill, and attention tiles."""
    capacity, tiles = _of_pack(packs, lambda c: c), F.ceil(F.col("n_tokens") / _of_pack(packs, tile_of))
    return placed.groupBy("pack", "pack_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), F.sum(tiles * (tiles + 1) / 2).cast("long").alias("tiles")).withColumn("capacity", capacity).withColumn("fill", F.col("n_tokens") / F.col("capacity"))
