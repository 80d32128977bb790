"""Most similar vectors for every vector, by shifted space-filling curves.

Each curve orders the vectors by the Hilbert key of a random projection with a random shift. Spark range-partitions
(curve, key) and sorts; every vector is compared with the vectors in a window around it, also across the borders of
partitions, and keeps its k best. The curves' candidates are merged and ranked by the cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.curves import Curve
from lumenfold.session import Scratch

CURVES, WINDOW, DIMS, BITS = 12, 32, 12, 5
BLOCK = 128
SPARE = 6  # candidates kept beyond k in a window, against ties of single precision
WINDOWED = "kind int, a long, b long, cos double, pos int, curve int, vec binary"


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of float32 vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, width), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, width)


def _keyed(width: int, curves: int, dims: int, bits: int, seed: int):
    """Batches of (row, vec) to (row, cls, keys, vec): cls is equal for equal unit vectors; useless vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Curve(seed * 1000 + c, width, dims, bits) for c in range(curves)]
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, width)
            with np.errstate(all="ignore"):
                norm = np.linalg.norm(flat.astype(np.float64), axis=1)
            good = np.isfinite(norm) & (norm > 0)
            if not good.any():
                continue
            flat, rows = np.ascontiguousarray(flat[good]), batch.column(0).to_numpy()[good]
            unit = _unit(flat)
            keys = np.stack([c.keys(unit) for c in made], axis=1)
            cls = [hashlib.md5(u.tobytes()).digest() for u in unit + 0.0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(cls, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, curves, dtype=np.int32)), pa.array(keys.ravel())), pa.array([v.tobytes() for v in flat], pa.binary())],
                names=["row", "cls", "keys", "vec"],
            )

    return run


def _best(rows: np.ndarray, curve: np.ndarray, unit: np.ndarray, first: int, last: int, window: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows first..last, the best `k` + SPARE rows within the window: each pair once, as smaller row, larger row and cosine."""
    single = unit.astype(np.float32)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    keep = k + SPARE
    for lo in range(first, last, BLOCK):
        hi = min(lo + BLOCK, last)
        a, b = max(0, lo - window), min(len(rows), hi + window)
        s = single[lo:hi] @ single[a:b].T
        i, j = np.arange(lo, hi)[:, None], np.arange(a, b)[None, :]
        s[(np.abs(i - j) > window) | (i == j) | (curve[lo:hi, None] != curve[None, a:b])] = -2
        hits = s >= least - 1e-5
        crowded = np.flatnonzero(hits.sum(1) > keep)
        if len(crowded):
            part = np.argpartition(-s[crowded], keep - 1, axis=1)[:, :keep]
            chosen = np.zeros((len(crowded), s.shape[1]), bool)
            np.put_along_axis(chosen, part, True, axis=1)
            hits[crowded] &= chosen
        x, y = np.nonzero(hits)
        out.append((x + lo, y + a))
    x, y = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int))
    # Most pairs are found from both ends.
    both = np.unique(np.minimum(x, y) * len(rows) + np.maximum(x, y))
    x, y = both // max(1, len(rows)), both % max(1, len(rows))
    cos = np.einsum("ij,ij->i", unit[x], unit[y])
    good = cos >= least
    a, b = rows[x[good]], rows[y[good]]
    return np.minimum(a, b), np.maximum(a, b), cos[good]


def _windows(width: int, window: int, k: int, least: float):
    """Sorted batches of (curve, row, vec) to candidates (kind 0) and the rows at the end (kind 1) and the beginning (kind 2) of the partition."""

    def made(kind: int, a, b, cos, pos, curve, vec) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(cos, np.float64)), pa.array(np.asarray(pos, np.int32)), pa.array(np.asarray(curve, np.int32)), pa.array(vec if vec is not None else [None] * n, pa.binary())],
            names=["kind", "a", "b", "cos", "pos", "curve", "vec"],
        )

    def ends(kind: int, pid: int, pos, rows, curve, flat) -> pa.RecordBatch:
        n = len(rows)
        return made(kind, rows, np.full(n, pid), np.zeros(n), pos, curve, [v.tobytes() for v in flat])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rows, curve, flat = np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, width), np.float32)
        done, seen = 0, 0  # of the held rows, those that have had their window; rows ever read
        for batch in batches:
            if not batch.num_rows:
                continue
            if seen < window:
                head = min(window - seen, batch.num_rows)
                part = batch.slice(0, head)
                yield ends(2, pid, window + seen + np.arange(head), part.column("row").to_numpy(), part.column("curve").to_numpy(), _vectors(part.column("vec"), width))
            seen += batch.num_rows
            rows = np.concatenate([rows, batch.column("row").to_numpy()])
            curve = np.concatenate([curve, batch.column("curve").to_numpy()])
            flat = np.concatenate([flat, _vectors(batch.column("vec"), width)])
            ready = len(rows) - window
            if ready - done >= BLOCK:
                a, b, cos = _best(rows, curve, _unit(flat), done, ready, window, k, least)
                yield made(0, a, b, cos, np.zeros(len(a)), np.zeros(len(a)), None)
                cut = max(0, ready - window)
                rows, curve, flat, done = rows[cut:], curve[cut:], flat[cut:], ready - cut
        if seen:
            a, b, cos = _best(rows, curve, _unit(flat), done, len(rows), window, k, least)
            yield made(0, a, b, cos, np.zeros(len(a)), np.zeros(len(a)), None)
            n = min(window, len(rows))
            yield ends(1, pid, window - n + np.arange(n), rows[-n:], curve[-n:], flat[-n:])

    return run


def _across(width: int, window: int, least: float):
    """The pairs across one border, of at most two windows of rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        unit, pos, curve, row = _unit(np.frombuffer(b"".join(part.vec), np.float32).reshape(-1, width)), part.pos.to_numpy(), part.curve.to_numpy(), part.a.to_numpy()
        cos = unit @ unit.T
        x, y = np.nonzero((pos[:, None] < window) & (pos[None, :] >= window) & (pos[None, :] - pos[:, None] <= window) & (curve[:, None] == curve[None, :]) & (cos >= least))
        return pd.DataFrame({"a": np.minimum(row[x], row[y]), "b": np.maximum(row[x], row[y]), "cos": cos[x, y]})

    return run


def nearest(vectors: DataFrame, scratch: Scratch, k: int = 10, min_cosine: float = -1.0, row: str = "emb_row", vector: str = "emb", curves: int = CURVES, window: int = WINDOW, dims: int = DIMS, bits: int = BITS, seed: int = 1) -> DataFrame:
    """(a, b, cos): for every vector a its k most similar others b with a cosine of at least min_cosine.

    Approximate: a neighbour is found if it lies within `window` places on one of the curves; found cosines are exact, in
    double precision, and of equal ones the smaller row comes first. Vectors that are null, empty, of zeros or with values
    not finite are similar to nothing; of several widths the most frequent counts; null rows are dropped and rows should be
    unique. Equal vectors are one on the curves and are expanded after, each to its k smallest others, so that a vector
    copied a million times gives k pairs a copy. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(row).isNotNull() & F.col(vector).isNotNull()).select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("width")).count().where("width > 0").orderBy(F.desc("count"), "width").first()
    if sizes is None:
        return spark.createDataFrame([], "a long, b long, cos double")
    width = sizes["width"]
    sound = rows.where((F.size("vec") == width) & ~F.exists("vec", lambda x: x.isNull()))
    keyed, n_keyed = scratch.save_counted(sound.mapInArrow(_keyed(width, curves, dims, bits, seed), "row long, cls binary, keys array<long>, vec binary"), "keyed")

    classes = keyed.groupBy("cls").agg(F.min("row").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.save(keyed.select("row", "cls").join(classes.select("cls", "rep"), "cls").select("row", "rep"), "copies")
    single = keyed.join(copies.where("row <> rep").select("row"), "row", "left_anti")
    # Few rows go to fewer partitions, so that a window is not wider than one.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, n_keyed * curves // (8 * window)))
    ordered = single.select("row", "vec", F.posexplode("keys").alias("curve", "key")).repartitionByRange(parts, "curve", "key", "row").sortWithinPartitions("curve", "key", "row").select("curve", "row", "vec")
    seen = scratch.save(ordered.mapInArrow(_windows(width, window, k, min_cosine), WINDOWED), "windows")
    # A row for each partition that has rows: a border is that between a partition and the last one before it with any.
    border = seen.where("kind = 1").select("b").distinct().select("b", F.lag("b").over(Window.orderBy("b")).alias("before"))
    heads = seen.where("kind = 2").join(F.broadcast(border), "b").where("before is not null").withColumn("b", F.col("before")).select(*seen.columns)
    across = seen.where("kind = 1").unionByName(heads).groupBy("b").applyInPandas(_across(width, window, min_cosine), "a long, b long, cos double")
    pairs = seen.where("kind = 0").select("a", "b", "cos").unionByName(across).groupBy("a", "b").agg(F.max("cos").alias("cos"))
    merged = pairs.select(F.inline(F.array(F.struct("a", "b", "cos"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))))
    by_rank = lambda key: Window.partitionBy(key).orderBy(F.desc("cos"), "b")
    best = scratch.save(merged.withColumn("r", F.row_number().over(by_rank("a"))).where(F.col("r") <= k).drop("r"), "best")

    # Of every copied vector the k + 1 smallest rows stand for all of them.
    few = scratch.save(copies.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("row"))).where(F.col("r") <= k + 1).select("row", "rep"), "few")
    others = best.join(few.select(F.col("rep").alias("b"), F.col("row").alias("copy")), "b", "left").select("a", F.coalesce("copy", "b").alias("b"), "cos")
    own = few.select(F.col("rep").alias("a"), F.col("row").alias("b"), F.lit(1.0).alias("cos"))
    lists = others.unionByName(own).withColumn("r", F.row_number().over(by_rank("a"))).where(F.col("r") <= k + 1)
    lists = scratch.save(lists.join(few.select(F.col("rep").alias("a"), F.lit(True).alias("many")).distinct(), "a", "left"), "lists")
    alone = lists.where(F.col("many").isNull() & (F.col("r") <= k)).select("a", "b", "cos")
    shared = copies.join(lists.where("many").withColumnRenamed("a", "rep"), "rep").where("row <> b").select(F.col("row").alias("a"), "b", "cos")
    shared = shared.withColumn("r", F.row_number().over(by_rank("a"))).where(F.col("r") <= k).drop("r")
    return alone.unionByName(shared)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(emb_row_a, emb_row_b): each pair once, the smaller row first."""
    return found.select(F.least("a", "b").alias("emb_row_a"), F.greatest("a", "b").alias("emb_row_b")).distinct()
