"""A log of decisions folded into the latest state of each key, in batch and as a stream with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "item_uid string, status string, actor string, seq long, n_events long"


def next_state(state: tuple | None, action: str, actor: str) -> tuple | None:
    """(status, first actor) of a key after an action, None for no row.

    add by a person approves at once; proposals never overwrite; approve, reject and reset need a row; reset of a person's own row
    deletes it; withdraw deletes the actor's own open proposal; deleted can only be set on approved rows.
    """
    status, first = state if state else (None, None)
    if action == "propose":
        return state or ("proposed", actor)
    if action == "add":
        return (status, first) if status in ("approved", "deleted") else ("approved", first or "user")
    if status is None:
        return None
    if action in ("approve", "reject") and status != "deleted":
        return ("approved" if action == "approve" else "rejected", first)
    if action == "reset" and status != "deleted":
        return None if first == "user" else ("proposed", first)
    if action == "withdraw" and status == "proposed" and first == actor:
        return None
    if action == "mark" and status == "approved":
        return ("deleted", first)
    if action == "unmark" and status == "deleted":
        return ("approved", first)
    return state


def _fold(rows: pd.DataFrame, state: tuple | None = None, n: int = 0) -> tuple[tuple | None, int, int]:
    seq = 0
    for r in rows.sort_values("seq").itertuples():
        after = next_state(state, r.action, r.actor)
        n += after != state
        state, seq = after, int(r.seq)
    return state, seq, n


def fold(events: DataFrame) -> DataFrame:
    """(item_uid, status, actor, seq, n_events) of the keys that have a row, from events item_uid, seq, action, actor.

    The events of one key are folded in order by one task; a key is one item, whose decisions are few.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state, seq, n = _fold(part)
        return pd.DataFrame([(part.item_uid.iloc[0], *(state or (None, None)), seq, n)], columns=["item_uid", "status", "actor", "seq", "n_events"])

    return usable(events).groupBy("item_uid").applyInPandas(run, STATE).where("status is not null")


def fold_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, with the state of each key kept; emits a key's row whenever events arrive, status null for none.

    A key's events must arrive in order of seq: one that comes after a later one, in a later batch, is folded when it comes.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, actor, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(parts))
        now, seq, n = _fold(rows, (status, actor) if status else None, n)
        state.update((*(now or (None, None)), n))
        yield pd.DataFrame([(key[0], *(now or (None, None)), seq, n)], columns=["item_uid", "status", "actor", "seq", "n_events"])

    return usable(events).groupBy("item_uid").applyInPandasWithState(run, STATE, "status string, actor string, n long", "update", GroupStateTimeout.NoTimeout)


LOG = "item_uid string, seq long, action string, actor string, status string, was string, rev long"


def transitions(events: DataFrame) -> DataFrame:
    """(item_uid, seq, action, actor, status, was, rev): the events that changed their key's row, with its status before and after.

    The log of effective changes; rev counts a key's changes, and the number of rows is the revision of the whole queue. status is null
    where the row went.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for uid, seq, action, actor in part.sort_values("seq")[["item_uid", "seq", "action", "actor"]].itertuples(index=False):
            after = next_state(state, action, actor)
            if after != state:
                out.append((uid, seq, action, actor, after[0] if after else None, state[0] if state else None, len(out) + 1))
            state = after
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in LOG.split(", ")])

    return usable(events).groupBy("item_uid").applyInPandas(run, LOG)


def with_batches_spread(events: DataFrame, proposals: DataFrame) -> DataFrame:
    """Events with those on a whole batch ('reject_batch', 'approve_batch') replaced by one on each item proposed in it before.

    events: item_uid, seq, action, actor and batch_id; proposals: batch_id, item_uid, seq. The fold then leaves alone what is no longer open.
    """
    single, whole = events.where("action not like '%_batch'"), events.where("action like '%_batch'")
    first = proposals.groupBy("batch_id", "item_uid").agg(F.min("seq").alias("proposed"))
    spread = whole.drop("item_uid").join(first, "batch_id").where("proposed < seq").withColumn("action", F.regexp_replace("action", "_batch$", ""))
    return single.unionByName(spread.select(*single.columns))


def usable(events: DataFrame) -> DataFrame:
    """Events with a key, a sequence number and an action; a null actor is an empty one."""
    return events.where("item_uid is not null and seq is not null and action is not null").select("item_uid", "seq", "action", F.coalesce("actor", F.lit("")).alias("actor"))


def latest_decision(events: DataFrame, key: str = "group_key") -> DataFrame:
    """Last write wins: the latest action of each key; cleared keys have no row."""
    last = events.groupBy(key).agg(F.max(F.struct("seq", "action", "keeper_uid")).alias("x"))
    return last.where("x.action <> 'clear'").select(key, "x.action", "x.keeper_uid", "x.seq")


def counts(queue: DataFrame) -> DataFrame:
    """One row: rows of each status."""
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("proposed", "approved", "rejected", "deleted")])


def batches(proposals: DataFrame) -> DataFrame:
    """(batch_id, actor, n, first_ts) of proposals, the newest batch first."""
    return proposals.groupBy("batch_id", "actor").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts")).orderBy(F.desc("first_ts"), "batch_id")


def run_guarded(stream: DataFrame, write: Callable[[DataFrame, int], None], guard: Callable[[DataFrame], None] | None, checkpoint: str) -> StreamingQuery:
    """One writer: each micro-batch passes the guard before it is written; what the guard raises stops the query unwritten."""

    def each(batch: DataFrame, number: int) -> None:
        if guard:
            guard(batch)
        write(batch, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
