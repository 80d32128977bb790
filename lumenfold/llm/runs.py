"""Repeated consecutive events: runs of near-identical neighbours collapse into one.

Events of an entity in order form a linked list; a priority queue merges the most similar neighbouring runs until none
meets the similarity and gap limits. Two runs are as similar as the events at which they meet, so the list may be cut
anywhere between two neighbours that don't meet the limits: Spark range-partitions (entity, time, id) whatever the size of
an entity, each task agglomerates its part, and the runs that touch a border are joined by a table with two rows for each partition.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import Scratch

RUNS = "pid int, run long, id long, t long, hash long, e1 string, e2 string, place int"
FIRST, LAST = 1, 2  # bits of place: the partition's first and last event


def agglomerate(distance: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Run numbers of n events, from the distance of each to the next and whether the limits allow the merge.

    The priority queue holds the merges that may be made, nearest first, then leftmost; the linked list holds the runs.
    """
    n = len(distance) + 1
    head = np.arange(n)  # of a run's last event its first, kept for run ends only
    tail = np.arange(n)
    queue = [(int(distance[i]), int(i)) for i in np.flatnonzero(allowed)]
    heapq.heapify(queue)
    while queue:
        _, i = heapq.heappop(queue)
        left, right = head[i], tail[i + 1]  # the run that ends at i, and the end of the one that begins at i + 1
        tail[left], head[right] = right, left
    starts = np.zeros(n, np.int64)
    at = 0
    while at < n:
        end = tail[at]
        starts[at : end + 1] = at
        at = end + 1
    return starts


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def _parts(max_gap: int, max_bits: int):
    """Sorted batches to events with their run's number; of each partition the first and last event are marked.

    Events are held until a neighbour breaks the limits, so memory is that of a batch and one unbroken run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, made, first = TaskContext.get().partitionId(), 0, True
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table, done: bool) -> pa.RecordBatch:
            nonlocal made, first
            n = t.num_rows
            time, code = t.column("t").to_numpy(), np.ascontiguousarray(t.column("hash").to_numpy())
            e = [t.column(c).to_numpy(zero_copy_only=False) for c in ("e1", "e2")]
            same = (e[0][1:] == e[0][:-1]) & (e[1][1:] == e[1][:-1])
            distance = _bits(code[1:].copy(), code[:-1].copy())
            starts = agglomerate(distance, same & (time[1:] - time[:-1] <= max_gap) & (distance <= max_bits))
            place = np.zeros(n, np.int32)
            if first:
                place[0] |= FIRST
            if done:
                place[-1] |= LAST
            out = pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), pa.array(starts + made), *[t.column(c).combine_chunks() for c in ("id", "t", "hash", "e1", "e2")], pa.array(place)], names=["pid", "run", "id", "t", "hash", "e1", "e2", "place"])
            made, first = made + n, False
            return out

        def broken(batch: pa.RecordBatch) -> np.ndarray:
            """Places of the batch at which a new run begins, each row looked at once; the row before the batch is the last one held."""
            t = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch])
            time, code = t.column("t").to_numpy(), t.column("hash").to_numpy()
            e = [t.column(c).to_numpy(zero_copy_only=False) for c in ("e1", "e2")]
            at = np.flatnonzero((e[0][1:] != e[0][:-1]) | (e[1][1:] != e[1][:-1]) | (time[1:] - time[:-1] > max_gap) | (_bits(code[1:].copy(), code[:-1].copy()) > max_bits))
            return at if held else at + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            at = broken(batch)
            if not len(at):
                held.append(batch)
                continue
            cut = int(at[-1])
            head = [*held, batch.slice(0, cut)] if cut else held
            yield emit(pa.Table.from_batches(head).combine_chunks(), False)
            held = [batch.slice(cut)]
        if held:
            yield emit(pa.Table.from_batches(held).combine_chunks(), True)

    return run


def runs(events: DataFrame, scratch: Scratch, entity: tuple[str, str], time: str, key: str, code: str, max_gap: int = 3, max_bits: int = 10) -> DataFrame:
    """(first_<key>, <key>, t): every event of a run of two or more, with the run's first event.

    Order is (entity, time, key); neighbours belong together if at most max_gap seconds and max_bits bits apart. Events with a
    null in the entity, time, key or code, or a code of 0, take no part and don't stand between others. Equal times are
    ordered by key; a repeated key counts as another event; an empty table gives an empty table.
    """
    usable = events.select(F.col(entity[0]).cast("string").alias("e1"), F.col(entity[1]).cast("string").alias("e2"), F.col(time).cast("long").alias("t"), F.col(key).cast("long").alias("id"), F.col(code).cast("long").alias("hash")).dropna().where("hash <> 0")
    order = ["e1", "e2", "t", "id"]
    source = scratch.save(usable, "events")
    parts = source.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t", "hash", "e1", "e2").mapInArrow(_parts(max_gap, max_bits), RUNS)
    parts = scratch.save(parts, "parts")

    # At most two rows for each partition: a bounded table, whatever the size of the data.
    ends = parts.where(F.col("place") > 0)
    per = ends.groupBy("pid").agg(*[F.min(F.when(F.col("place").bitwiseAND(F.lit(bit)) > 0, F.struct("run", "t", "hash", "e1", "e2"))).alias(name) for bit, name in ((FIRST, "f"), (LAST, "l"))])
    w = Window.orderBy("pid")
    before = F.lag("l").over(w)
    joined = (before["e1"] == F.col("f.e1")) & (before["e2"] == F.col("f.e2")) & (F.col("f.t") - before["t"] <= max_gap) & (F.bit_count(F.col("f.hash").bitwiseXOR(before["hash"])) <= max_bits)
    per = per.withColumn("joined", F.coalesce(joined, F.lit(False)))
    # A chain of partitions goes on through those that are one run; elsewhere a new chain begins at the last run.
    per = per.withColumn("whole", F.col("f.run") == F.col("l.run")).withColumn("opens", ~(F.col("joined") & F.col("whole")))
    per = per.withColumn("origin", F.last(F.when(F.col("opens"), F.struct("pid", F.col("l.run").alias("run"))), True).over(w))
    per = per.withColumn("source", F.when(F.col("joined"), F.lag("origin").over(w)))
    moved = F.broadcast(per.where("joined").select("pid", F.col("f.run").alias("run"), F.col("source.pid").alias("pid0"), F.col("source.run").alias("run0")))
    every = parts.join(moved, ["pid", "run"], "left").select(F.coalesce("pid0", "pid").alias("pid"), F.coalesce("run0", "run").alias("run"), "id", "t")
    heads = every.groupBy("pid", "run").agg(F.min(F.struct("t", "id"))["id"].alias("first"), F.count("*").alias("n")).where("n > 1")
    return every.join(heads, ["pid", "run"]).select(F.col("first").alias(f"first_{key}"), F.col("id").alias(key), "t")


def collapsed(found: DataFrame, key: str) -> DataFrame:
    """One row per run: its first event, count, first and last second, and duration."""
    return found.groupBy(f"first_{key}").agg(F.count("*").alias("n_events"), F.min("t").alias("start_s"), F.max("t").alias("end_s"), (F.max("t") - F.min("t")).alias("duration_s"))
