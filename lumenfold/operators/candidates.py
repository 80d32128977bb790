"""Near-duplicate candidates: self-joins of 64-bit hashes on chunks (all items) or on pairs of blocks (distinct hashes)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.bits import chunk, chunk_bounds, hamming
from lumenfold.session import Scratch

BITS = 64
HOT_BUCKET = 2000  # buckets with more distinct hashes are split by further bits


def chunked(hashes: DataFrame, distance: int, id_col: str, hash_col: str) -> DataFrame:
    """(chunk, value, id, h): every hash under each of its distance + 1 chunks."""
    h = F.col(hash_col)
    parts = F.array(*[F.struct(F.lit(i).alias("chunk"), chunk(h, start, width).alias("value")) for i, (start, width) in enumerate(chunk_bounds(distance))])
    return hashes.where(F.col(id_col).isNotNull() & h.isNotNull()).select(F.inline(parts), F.col(id_col).alias("id"), h.alias("h"))


def bucket_sizes(hashes: DataFrame, distance: int, id_col: str, hash_col: str) -> DataFrame:
    return chunked(hashes, distance, id_col, hash_col).groupBy("chunk", "value").agg(F.count("*").alias("n"))


def near_candidates(hashes: DataFrame, distance: int = 3, bucket_cap: int | None = None, id_col: str = "item_id", hash_col: str = "phash64") -> DataFrame:
    """(a, b, dist): pairs a < b of hashes at most `distance` bits apart, each once.

    Without a cap the result is exact. bucket_cap is the reference's setting: buckets with more items are skipped before pairs
    are formed, and `bucket_skips` counts what that leaves unexamined.
    """
    keyed = chunked(hashes, distance, id_col, hash_col)
    if bucket_cap is not None:
        small = keyed.groupBy("chunk", "value").agg(F.count("*").alias("n")).where(F.col("n") <= bucket_cap).drop("n")
        keyed = keyed.join(small, ["chunk", "value"])
    a, b = (keyed.select("chunk", "value", F.col("id").alias(s), F.col("h").alias(f"h{s}")) for s in "ab")
    dist = hamming(F.col("ha"), F.col("hb"))
    return a.join(b, ["chunk", "value"]).where((F.col("a") < F.col("b")) & (dist <= distance)).select("a", "b", dist.alias("dist")).distinct()


def bucket_skips(hashes: DataFrame, distance: int, bucket_cap: int, id_col: str = "item_id", hash_col: str = "phash64") -> DataFrame:
    """One row: buckets skipped under the cap, their items, and the pairs left unexamined, summed over chunks."""
    over = bucket_sizes(hashes, distance, id_col, hash_col).where(F.col("n") > bucket_cap)
    n = F.col("n")
    return over.agg(F.count("*").alias("skipped_buckets"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("skipped_bucket_items"), F.coalesce(F.sum(F.floor(n * (n - 1) / 2)), F.lit(0)).cast("long").alias("unexamined_pairs"))


def brute_candidates(hashes: DataFrame, distance: int, id_col: str = "item_id", hash_col: str = "phash64") -> DataFrame:
    """The same by comparing all pairs; for tests on small tables."""
    rows = hashes.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    a, b = (rows.select(F.col("id").alias(s), F.col("h").alias(f"h{s}")) for s in "ab")
    dist = hamming(F.col("ha"), F.col("hb"))
    return a.join(b, (F.col("a") < F.col("b")) & (dist <= distance)).select("a", "b", dist.alias("dist"))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _split(positions: list[int], parts: int) -> list[int]:
    """Masks of contiguous parts of the bit positions."""
    cuts = [len(positions) * i // parts for i in range(parts + 1)]
    return [sum(1 << p for p in positions[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_masks(distance: int) -> list[int]:
    """Masks of every two of distance + 2 blocks: hashes within the distance agree on at least one of them."""
    blocks = _split(list(range(BITS)), distance + 2)
    return [a | b for a, b in combinations(blocks, 2)]


def _first_agreeing(x: Column, masks: list[int]) -> Column:
    return F.coalesce(*[F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)])


def _finer(masks: list[int], distance: int) -> list[tuple[int, int, int, list[int]]]:
    """(mask, number, finer mask, masks before) of the distance + 1 parts into which the other bits of each mask are split."""
    out = []
    for m in masks:
        parts = _split([p for p in range(BITS) if not m >> p & 1], distance + 1)
        out += [(_signed(m), i, _signed(m | part), [_signed(x) for x in parts[:i]]) for i, part in enumerate(parts)]
    return out


def hamming_pairs(hashes: DataFrame, scratch: Scratch, distance: int = 3, hash_col: str = "h", id_col: str = "rep", hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): the ids of all pairs of distinct hashes at most `distance` bits apart, each pair once.

    hashes: distinct non-null hashes with an id. Exact at any size: candidates agree on two of distance + 2 blocks, and a
    pair is kept in the first table where it agrees. Buckets over `hot` hashes are keyed by each of distance + 1 parts of their other
    bits, of which one must agree again (the first that does keeps the pair), and so on until no bucket is over it, so none is
    joined with itself on few bits.
    """
    masks = block_masks(distance)
    one = hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    rows = one.select("id", "h", F.inline(F.array(*[F.struct(F.lit(i).alias("t"), F.col("h").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])))
    # Deeper rows carry their way there, their mask, and the parts in which a pair must differ as it is kept before.
    on, more, mask, found = ["t", "k"], [], F.get(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("t")), None

    def joined(left: DataFrame) -> DataFrame:
        a, b = (left.select(*on, F.col("id").alias(f"{s}_id"), F.col("h").alias(f"{s}_h"), *(more if s == "a" else [])) for s in "ab")
        x = F.col("a_h").bitwiseXOR(F.col("b_h"))
        near = (F.col("a_h") < F.col("b_h")) & (F.bit_count(x) <= distance) & (_first_agreeing(x, masks) == F.col("t"))
        if more:
            near &= F.forall("avoid", lambda m: x.bitwiseAND(m) != 0)
        return a.join(b, on).where(near).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))

    while True:
        # Where as few bits are left as may differ, a bucket has no more hashes than these can form.
        open_ = rows.where(F.bit_count("m") < BITS - distance) if more else rows
        crowded, n_hot = scratch.save_counted(open_.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*on, F.lit(True).alias("hot")), "hot")
        if not n_hot:
            pairs = joined(rows)
            return pairs if found is None else found.unionByName(pairs)
        marked = rows.join(crowded, on, "left")
        plain = joined(marked.where(F.col("hot").isNull()))
        found = plain if found is None else found.unionByName(plain)
        over = marked.where("hot").select("id", "h", "t", mask.alias("m"), *(["path", "avoid"] if more else [F.col("t").cast("long").alias("path")]))
        # At most (distance + 1)^level masks of each block pair, whatever the number of hashes.
        used = [r["m"] % (1 << BITS) for r in over.select("m").distinct().collect()]
        parts = scratch.spark.createDataFrame(_finer(used, distance), "m long, s int, m2 long, before array<long>")
        avoid = F.concat("avoid", "before") if more else F.col("before")
        finer = over.join(F.broadcast(parts), "m").select("id", "h", "t", (F.col("path") * (distance + 2) + F.col("s") + 1000).alias("path"), F.col("m2").alias("m"), avoid.alias("avoid"))
        rows = scratch.save(finer.withColumn("k", F.col("h").bitwiseAND(F.col("m"))), "finer")
        on, more, mask = ["path", "k"], ["t", "avoid"], F.col("m")


def exact_candidates(hashes: DataFrame, scratch: Scratch, distance: int = 3, id_col: str = "item_id", hash_col: str = "phash64", hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b, dist): the pairs of near_candidates without a cap, found over distinct hashes.

    Copies of a hash meet no bucket of their own, and buckets of many distinct hashes are split by further bits.
    """
    h = F.col(hash_col)
    rows = hashes.where(F.col(id_col).isNotNull() & h.isNotNull()).select(F.col(id_col).alias("id"), h.alias("h"))
    distinct = scratch.save(rows.select("h").distinct(), "hashes")
    pairs = hamming_pairs(distinct, scratch, distance, "h", "h", hot).select(F.col("a").alias("ha"), F.col("b").alias("hb"))
    a, b = (rows.select(F.col("id").alias(s), F.col("h").alias(f"h{s}")) for s in "ab")
    near = pairs.join(a, "ha").join(b, "hb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), hamming(F.col("ha"), F.col("hb")).alias("dist"))
    same = a.join(b.withColumnRenamed("hb", "ha"), "ha").where(F.col("a") < F.col("b")).select("a", "b", F.lit(0).alias("dist"))
    return near.unionByName(same)
