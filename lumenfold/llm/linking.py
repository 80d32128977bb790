"""Pairwise matches consolidated into groups.

`hamming_pairs` (of the core) finds all pairs of distinct 64-bit hashes within a small distance; `match_edges` adds the stars of
exact copies; `components` gives every linked record one group identifier. The components come by stripping
vertices of degree one and compressing chains of degree-two vertices by list ranking, in turn, until little more
goes; the reduced core is solved by hooking and contraction; then the labels return to the removed vertices by
doubling their pointers to what was removed later. Every step is a join or an aggregation of whole tables; each intermediate table is written to the
shared folder, so a lost executor costs no more than a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.candidates import HOT_BUCKET, block_masks, hamming_pairs  # noqa: F401
from lumenfold.session import Scratch


def match_edges(items: DataFrame, scratch: Scratch, key: str = "item_id", exact: str = "sha256", hashed: str = "phash64", distance: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b) edges that link all matching records: stars of equal `exact`, stars of equal `hashed`, and near hashes.

    A class of copies gives a star around its smallest key, not its pairs, so a class of a third of all rows costs
    as many edges as rows. Null matches nothing; a hash of 0 matches nothing.
    """
    rows = items.select(key, exact, hashed).where(F.col(key).isNotNull())

    def star(col: str, usable: Column) -> tuple[DataFrame, DataFrame]:
        own = rows.where(usable).select(F.col(key).alias("b"), F.col(col).alias("value"))
        classes = own.groupBy("value").agg(F.min("b").alias("a"), F.max("b").alias("last"))
        many = classes.where(F.col("a") < F.col("last")).select("value", "a")
        return own.join(many, "value").where(F.col("a") < F.col("b")).select("a", "b"), classes

    by_exact, _ = star(exact, F.col(exact).isNotNull())
    by_hash, classes = star(hashed, F.col(hashed).isNotNull() & (F.col(hashed) != 0))
    distinct = scratch.save(classes.select(F.col("value").alias("h"), F.col("a").alias("rep")), "hashes")
    return by_exact.unionByName(by_hash).unionByName(hamming_pairs(distinct, scratch, distance, hot=hot))


def _simple(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops or repeats, smaller end first."""
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))))
    return both.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi"))


def _strip(edges: DataFrame, deg: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Vertices of degree one go; (v, p) says where each hung. Of an edge that stands alone the larger end goes."""
    leaves = deg.where("n = 1").select("v", F.col("lo").alias("p"))
    other = leaves.select(F.col("v").alias("p"), F.lit(True).alias("pair"))
    gone = scratch.save(leaves.join(other, "p", "left").where(F.col("pair").isNull() | (F.col("v") > F.col("p"))).select("v", "p"), "stripped")
    kept = edges.join(gone.select(F.col("v").alias("a")), "a", "left_anti").join(gone.select(F.col("v").alias("b")), "b", "left_anti")
    return kept.select("a", "b"), gone


# A vertex inside a chain: of degree two, and not smaller than both neighbours, so that every cycle keeps an end.
INNER = "n = 2 and not (v < lo and v < hi)"


def _compress(edges: DataFrame, deg: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Chains of degree-two vertices become edges between their ends, by list ranking.

    An arc (v, came) leaves v on the other side than it came from; pointers double until all point past a chain's end, and
    rank counts the steps.
    """
    inner = deg.where(INNER).select("v", "lo", "hi")
    arcs = inner.select("v", F.inline(F.array(F.struct(F.col("lo").alias("came"), F.col("hi").alias("to")), F.struct(F.col("hi").alias("came"), F.col("lo").alias("to")))))
    chain = inner.select(F.col("v").alias("to"), F.lit(True).alias("on"))
    # at, via: the arc pointed to; open while `at` is itself inside a chain.
    arcs = arcs.join(chain, "to", "left").select("v", "came", F.col("to").alias("at"), F.col("v").alias("via"), F.col("on").isNotNull().alias("open"), F.lit(1).cast("long").alias("rank"))
    opened = {"open": F.count_if("open")}
    ranked, seen = scratch.save_observed(arcs, "arcs", **opened)
    while seen["open"]:
        step = ranked.select(F.col("v").alias("at"), F.col("came").alias("via"), F.col("at").alias("at2"), F.col("via").alias("via2"), F.col("open").alias("open2"), F.col("rank").alias("rank2"))
        closed = ranked.where("not open")
        jumped = ranked.where("open").join(step, ["at", "via"]).select("v", "came", F.col("at2").alias("at"), F.col("via2").alias("via"), F.col("open2").alias("open"), (F.col("rank") + F.col("rank2")).alias("rank"))
        before = ranked
        ranked, seen = scratch.save_observed(closed.unionByName(jumped), "arcs", **opened)
        scratch.drop(before)
    ends = ranked.groupBy("v").agg(F.min(F.struct("rank", "at"))["at"].alias("p"), F.min("at").alias("a"), F.max("at").alias("b"))
    gone = scratch.save(ends, "chained")
    kept = edges.join(gone.select(F.col("v").alias("a")), "a", "left_anti").join(gone.select(F.col("v").alias("b")), "b", "left_anti")
    scratch.drop(ranked)
    return _simple(kept.select("a", "b").unionByName(gone.select("a", "b"))), gone.select("v", "p")


def _hook(edges: DataFrame, deg: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each vertex with a smaller neighbour hooks to its smallest; the trees contract to their roots."""
    up = scratch.save(deg.where("lo < v").select("v", F.col("lo").alias("p")), "hooks")
    moved = 1
    while moved:
        before = up
        far = _jumped(up)
        up, seen = scratch.save_observed(far, "hooks", moved=F.count_if("moved"))
        moved = seen["moved"]
        scratch.drop(before)
        up = up.drop("moved")
    root = lambda c: up.select(F.col("v").alias(c), F.col("p").alias(f"{c}_root"))
    ends = edges.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return _simple(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), up


def _jumped(up: DataFrame) -> DataFrame:
    """(v, p, moved): every pointer moved on to what its target points to."""
    step = up.select(F.col("v").alias("p"), F.col("p").alias("p2"))
    return up.join(step, "p", "left").select("v", F.coalesce("p2", "p").alias("p"), F.col("p2").isNotNull().alias("moved"))


def components(edges: DataFrame, scratch: Scratch, least_share: float = 0.1) -> DataFrame:
    """(v, label): every vertex of an edge with the smallest vertex that it is linked to, directly or indirectly.

    edges: columns a and b of one orderable type. Loops and repeated edges are allowed and change nothing, null ends are
    dropped; an empty table gives an empty table; other columns are ignored. Stripping and compressing go on while they
    remove at least `least_share` of the remaining vertices; the core is then contracted to nothing. Each removed vertex points to one
    that was removed later or never, so the labels return by doubling these pointers, as often as it takes to pass all steps.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    edges, n = scratch.save_counted(_simple(known), "edges")
    removed, turn, none = [], 0, edges.select(F.col("a").alias("v"), F.col("a").alias("label")).where("false")
    while n:
        deg, counts = scratch.save_observed(_degrees(edges), "degrees", all=F.count(F.lit(1)), leaves=F.count_if(F.col("n") == 1), inner=F.count_if(F.expr(INNER)))
        shares = (counts["leaves"] / counts["all"], counts["inner"] / counts["all"])
        if max(shares) < least_share:
            step = _hook
        else:
            # Turn about, so that neither long paths nor deep trees take many rounds.
            if shares[turn] < least_share:
                turn = 1 - turn
            step, turn = (_strip, _compress)[turn], 1 - turn
        rest, gone = step(edges, deg, scratch)
        removed.append(gone)
        before = edges
        edges, n = scratch.save_counted(rest, "edges")
        scratch.drop(deg, before)
    if not removed:
        return none
    up = removed[0]
    for gone in removed[1:]:
        up = up.unionByName(gone)
    for i in range(max(0, len(removed) - 1).bit_length()):
        before, up = up, scratch.save(_jumped(up).select("v", "p"), "labels")
        scratch.drop(before if i else None)
    smallest = up.groupBy("p").agg(F.least(F.min("v"), F.col("p")).alias("label"))
    return up.join(smallest, "p").select("v", "label").unionByName(smallest.select(F.col("p").alias("v"), "label"))


def linked_groups(items: DataFrame, scratch: Scratch, key: str = "item_id", exact: str = "sha256", hashed: str = "phash64", distance: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """(group_<key>, <key>): every record that matches another, with the smallest key of its group.

    items: one row per key. Records without a match give no row; null keys are dropped; an empty table gives none.
    """
    found = components(match_edges(items, scratch, key, exact, hashed, distance, hot), scratch)
    return found.select(F.col("label").alias(f"group_{key}"), F.col("v").alias(key))
