"""Sources mixed to target weights by tokens.

Each source's texts are laid end to end and cut into blocks of a fixed number of tokens. Output shards draw how many blocks
they take of each source from a multinomial over what is left of the sources' quotas; the n-th draw of a source is mapped by
a pseudorandom permutation of its block numbers, one for each pass; and the blocks are joined by number. No table is sorted
or shuffled as a whole, and no draw depends on another row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.session import Scratch

BLOCK_TOKENS = 512
SHARD_BLOCKS = 1024  # about as many blocks go to an output shard
GROUP_SHARDS = 4096  # shards whose draws are one task's
BUCKET_DOCS = 10_000


def _mix64(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser: two rounds of multiply and shift."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 under a key: a Feistel network on the next power of four, walked until inside."""
    index, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.ceil(np.log2(np.maximum(size.astype(float), 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(v: np.ndarray, at: np.ndarray) -> np.ndarray:
        left, right = v >> half[at], v & mask[at]
        for r in range(4):
            with np.errstate(over="ignore"):
                f = _mix64(right + key[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1))
            left, right = right, left ^ (f & mask[at])
        return (left << half[at]) | right

    every = np.arange(len(index))
    out = once(index, every)
    while len(over := np.flatnonzero(out >= size)):
        out[over] = once(out[over], over)
    return out.astype(np.int64)


def blocks(documents: DataFrame, scratch: Scratch, block_tokens: int = BLOCK_TOKENS, key: str = "doc_id", source: str = "source", tokens: str = "n_tokens") -> DataFrame:
    """(source, block, doc_id, from_token, to_token): each source's tokens laid end to end and cut into blocks.

    Offsets are sums over buckets of bounded size plus running sums inside them, so a source with a third of all texts is
    spread over many tasks. Texts without tokens or source are in no block.
    """
    docs = documents.where((F.col(tokens) > 0) & F.col(source).isNotNull()).select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("n"))
    docs, total = scratch.save_counted(docs, "docs")
    n_buckets = max(1, -(-total // BUCKET_DOCS))
    docs = docs.withColumn("order", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("order", F.lit(n_buckets)))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n").alias("sum"))
    ahead = sums.withColumn("ahead", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")) - F.col("sum")).drop("sum")
    inside = F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    laid = docs.withColumn("inside", inside).join(ahead, ["source", "bucket"]).withColumn("start", F.col("ahead") + F.col("inside"))
    size = F.lit(block_tokens).cast("long")
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size)
    cut = laid.select("source", "doc_id", "n", "start", F.explode(F.sequence(first, last)).alias("block"))
    return cut.select("source", "block", "doc_id", F.greatest(F.lit(0).cast("long"), F.col("block") * size - F.col("start")).alias("from_token"), F.least("n", (F.col("block") + 1) * size - F.col("start")).alias("to_token"))


def quotas(weights: dict[str, float], available: dict[str, int], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Blocks to take of each source: exact to one block, none beyond its repeats; as many in all as the scarcest source allows.

    A source without blocks or weight takes none, and the others keep their proportions.
    """
    live = {s: w for s, w in weights.items() if w and w > 0 and available.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not live:
        return {}
    all_ = sum(live.values())
    most = min(int(available[s] * repeats[s] * all_ / w) for s, w in live.items())
    n = most if total is None else min(total, most)
    exact = {s: n * w / all_ for s, w in live.items()}
    out = {s: min(int(x), available[s] * repeats[s]) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(out.values()) < n and out[s] < available[s] * repeats[s]:
            out[s] += 1
    return out


def split(quota: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(parts, sources): the quotas drawn out in parts of the given relative sizes, each part multinomial over what is left.

    The last part takes what is left, so the quotas are met exactly; what a draw takes beyond a quota is drawn again from the others.
    """
    left, out = quota.astype(np.int64), np.zeros((len(sizes), len(quota)), np.int64)
    ahead = np.cumsum(sizes[::-1])[::-1]
    for i, size in enumerate(sizes):
        n = int(left.sum()) * int(size) // int(ahead[i]) if i < len(sizes) - 1 else int(left.sum())
        take = np.zeros_like(left)
        while (short := n - int(take.sum())) > 0:
            room = left - take
            if short == room.sum():
                take = left.copy()
                break
            take = take + np.minimum(rng.multinomial(short, room / room.sum()), room)
        out[i], left = take, left - take
    return out


def draws(quota: dict[str, int], shards: int, seed: int, first: int = 0, used: dict[str, int] | None = None) -> list[tuple[int, str, int, int, int, int]]:
    """(shard, source, count, source's draws before, shard's slots before, shard's slots) of some shards, from `first` on."""
    names, before, out = list(quota), dict(used or dict.fromkeys(quota, 0)), []
    for i, take in enumerate(split(np.array(list(quota.values()), np.int64), np.ones(shards, np.int64), np.random.default_rng([seed, first]))):
        at, slots = 0, int(take.sum())
        for name, c in zip(names, take.tolist(), strict=True):
            if c:
                out.append((first + i, name, c, before[name], at, slots))
                before[name] += c
                at += c
    return out


DRAWN = "shard long, source string, count long, before long, at long, slots long"


def drawn_shards(spark: SparkSession, quota: dict[str, int], seed: int) -> DataFrame:
    """The draws of all output shards: the driver draws for groups of shards, tasks draw for the shards of a group.

    There are at least as many shards as sources and one for every SHARD_BLOCKS blocks, however many that are; the driver holds a row
    for each GROUP_SHARDS of them.
    """
    total = sum(quota.values())
    shards = max(1, min(total, max(len(quota), -(-total // SHARD_BLOCKS))))
    firsts = np.arange(0, shards, GROUP_SHARDS)
    sizes = np.minimum(shards - firsts, GROUP_SHARDS)
    takes = split(np.array(list(quota.values()), np.int64), sizes, np.random.default_rng(seed))
    used = np.cumsum(takes, axis=0) - takes
    names = list(quota)
    rows = [(int(f), int(n), list(map(int, t)), list(map(int, u))) for f, n, t, u in zip(firsts, sizes, takes, used, strict=True)]
    groups = spark.createDataFrame(rows, "first long, n long, take array<long>, used array<long>").repartition(len(rows), "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                out = draws(dict(zip(names, map(int, g.take), strict=True)), int(g.n), seed, int(g.first), dict(zip(names, map(int, g.used), strict=True)))
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in DRAWN.split(", ")])

    return groups.mapInPandas(run, DRAWN)


def mix(documents: DataFrame, targets: list[tuple[str, float, int]], scratch: Scratch, block_tokens: int = BLOCK_TOKENS, total_blocks: int | None = None, seed: int = 1, **names: str) -> DataFrame:
    """(shard, slot, source, pass, block, doc_id, from_token, to_token): the selection, in shards of interleaved sources.

    targets: source, wanted share and how often a text may be used, a handful. A block is used once in each pass and there
    are at most as many passes as repeats. Sources without texts take part with nothing; texts of other sources or of none
    are not selected. With no usable source the result is empty.
    """
    spark = documents.sparkSession
    cut = scratch.save(blocks(documents, scratch, block_tokens, **names), "blocks")
    wanted = {s: w for s, w, _ in targets}
    # One row for each source that is a target.
    have = {r["source"]: r["n"] for r in cut.where(F.col("source").isin(list(wanted))).groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}
    quota = quotas(wanted, have, {s: r for s, _, r in targets}, total_blocks)
    if not quota:
        none = F.lit(0).cast("long")
        return cut.where("false").select(none.alias("shard"), none.alias("slot"), "source", none.alias("pass"), "block", "doc_id", "from_token", "to_token")
    drawn = scratch.save(drawn_shards(spark, quota, seed), "drawn")
    # Permutations differ by source, pass and shard.
    known = F.create_map(*[F.lit(x) for s in quota for x in (s, F.struct(F.lit(have[s]).cast("long").alias("have"), F.lit(xxhash.xxh3_64_intdigest(s) >> 1).alias("code")))])

    @F.pandas_udf("struct<pass: long, block: long, slot: long>")
    def mapped(nth: pd.Series, have_: pd.Series, code: pd.Series, shard: pd.Series, at: pd.Series, slots: pd.Series) -> pd.DataFrame:
        n, h = nth.to_numpy(), have_.to_numpy()
        turn = n // h
        with np.errstate(over="ignore"):
            key = code.to_numpy() + (turn + 1) * 1_000_003 + seed * 31
        return pd.DataFrame({"pass": turn, "block": permuted(n % h, h, key), "slot": permuted(at.to_numpy(), slots.to_numpy(), shard.to_numpy() + 7_919 * seed)})

    d = drawn.withColumn("k", known[F.col("source")])
    # A shard's count of a source is about SHARD_BLOCKS at most.
    slots = d.select("shard", "source", "before", "at", "slots", "k.have", "k.code", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))
    slots = slots.select("shard", "source", mapped(F.col("before") + F.col("i"), "have", "code", "shard", F.col("at") + F.col("i"), "slots").alias("m")).select("shard", "source", "m.*")
    return slots.join(cut, ["source", "block"]).select("shard", "slot", "source", "pass", "block", "doc_id", "from_token", "to_token")


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: the wanted and the reached share in percent, tokens, and how often its texts were used at most.

    The wanted shares are of the sum of weights; a source without texts reaches 0.
    """
    reached = selected.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n_tokens"), (F.max("pass") + 1).alias("passes"))
    joined = targets.join(reached, "source", "left").select("source", "weight", "max_repeats", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.coalesce("passes", F.lit(0).cast("long")).alias("passes"))
    total = joined.agg(F.sum("n_tokens").alias("_all"), F.sum("weight").alias("_weights"))
    # total is one row
    whole = total.first()
    return joined.select("source", (F.col("weight") / F.lit(whole["_weights"]) * 100).alias("wanted_share"), (F.col("n_tokens") / F.lit(max(1, whole["_all"] or 0)) * 100).alias("share"), "n_tokens", "passes", "max_repeats")
