"""Reachability over tables of edges (parent, child).

Rounds are what costs: each is a job over what changed. Nodes with one parent
and one child form chains, which pointer doubling measures in as many rounds as
the logarithm of the longest one; what follows then goes over chains in one
step. ``closure`` (least depths from roots), ``components`` (strongly connected
ones) and ``on_cycles`` use that. ``reachable`` has all pairs by path doubling,
and ``updated`` keeps them up to date as edges come and go.

Defined results: repeated edges count once; an edge from a node to itself is a
cycle; rows with a null end are no edges; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.shared import discard, written

#: Levels after which what was reached is written in one table again.
JOINED = 8


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("parent", "child").where("parent is not null and child is not null").distinct()


def _inner(edges: DataFrame, ends: DataFrame | None) -> DataFrame:
    """(node, before, after) of the nodes with exactly one parent and one child, others than themselves, that are not in ``ends`` (node)."""
    into = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("n_in"), F.min("parent").alias("before"))
    out = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_out"), F.min("child").alias("after"))
    found = into.join(out, "node").where("n_in = 1 and n_out = 1 and before <> node").select("node", "before", "after")
    return found if ends is None else found.join(ends, "node", "left_anti")


def _doubled(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``now`` (node, to, steps, least) with ``to`` followed until it stays; and the rows that have no end, which are the nodes of plain rings."""
    now = written(now, "chains")
    for _ in range(now.count().bit_length() + 1):
        onward = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("least").alias("least_on"))
        step = written(now.join(onward.hint("merge"), "to").select("node", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "least_on").alias("least"), (F.col("more") > 0).alias("moved")), "chains")
        discard(now)
        now = step.drop("moved")
        now.tarn_path = step.tarn_path
        if step.where("moved").isEmpty():
            return now, now.where("false")
    # What still moves goes round; its least node has been met by all of it.
    ends = now.where("steps = 0").select("to")
    return now.join(ends, "to", "left_semi"), now.join(ends, "to", "left_anti")


def chains(edges: DataFrame, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges with each chain as one, the chains' members, and plain rings.

    Edges: (parent, child, length); members: (node, parent, child, at), where
    ``at`` is the node's distance from the parent of its chain; rings: (node,
    least), cut off from all else.
    """
    inner = written(_inner(edges, ends), "inner")
    if inner.isEmpty():
        none = inner.select("node", F.col("before").alias("parent"), F.col("after").alias("child"), F.lit(0).cast("long").alias("at"))
        return edges.select("parent", "child", F.lit(1).cast("long").alias("length")), none, none.select("node", F.col("node").alias("least"))
    known = inner.select(F.col("node").alias("after"), F.lit(True).alias("on"))
    start = inner.join(known, "after", "left").select("node", F.when(F.col("on"), F.col("after")).otherwise(F.col("node")).alias("to"), F.when(F.col("on"), 1).otherwise(0).cast("long").alias("steps"), F.col("node").alias("least"))
    measured, rings = _doubled(start)
    whole = measured.groupBy("to").agg(F.max("steps").alias("length"), F.max_by("node", "steps").alias("head"))
    whole = whole.join(inner.select(F.col("node").alias("to"), F.col("after").alias("child")), "to").join(inner.select(F.col("node").alias("head"), F.col("before").alias("parent")), "head")
    whole = written(whole.select("to", "parent", "child", "length"), "whole")
    members = written(measured.join(whole, "to").select("node", "parent", "child", (F.col("length") - F.col("steps") + 1).alias("at")), "members")
    rings = written(rings.select("node", "least"), "rings")
    plain = edges.join(inner.select(F.col("node").alias("parent")), "parent", "left_anti").join(inner.select(F.col("node").alias("child")), "child", "left_anti")
    short = plain.select("parent", "child", F.lit(1).cast("long").alias("length")).unionByName(whole.select("parent", "child", (F.col("length") + 2).alias("length")))
    short = written(short.groupBy("parent", "child").agg(F.min("length").alias("length")), "short")
    for used in (measured, whole, inner):
        discard(used)
    return short, members, rings


def closure(roots: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, depth) for all that is reachable, at its least depth.

    ``roots`` has root, ``edges`` parent and child; nodes in ``stop`` (node)
    are not gone into, and are left out. Each round joins the frontier with the
    edges, chains as one, and goes on from what it has reached for the first
    time or by a shorter way, so cycles end. There are as many rounds as the
    longest of the ways with fewest edges has, and the logarithm of the longest
    chain for measuring chains.
    """
    edges = _plain(edges)
    front = roots.select("root", F.col("root").alias("node"))
    if stop is not None:
        front = front.join(stop, "node", "left_anti").select("root", "node")
        for end in ("parent", "child"):
            edges = edges.join(stop.withColumnRenamed("node", end), end, "left_anti")
    edges = written(edges.select("parent", "child"), "edges")
    short, members, _ = chains(edges, roots.select(F.col("root").alias("node")).distinct())
    weighted = not members.isEmpty()
    seen = written(front.distinct().withColumn("depth", F.lit(0).cast("long")), "closure")
    front, levels = seen, [seen]
    while not front.isEmpty():
        step = front.join(short, front.node == short.parent).groupBy("root", F.col("child").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        if weighted:
            best = seen.groupBy("root", "node").agg(F.min("depth").alias("best"))
            step = step.join(best, ["root", "node"], "left").where("best is null or depth < best").select("root", "node", "depth")
        else:
            step = step.join(seen, ["root", "node"], "left_anti").select("root", "node", "depth")
        front = written(step, "closure")
        levels.append(front)
        seen = seen.unionByName(front)
        if len(levels) > JOINED:
            seen = written(seen.groupBy("root", "node").agg(F.min("depth").alias("depth")) if weighted else seen, "closure")
            # The frontier is read once more.
            for df in levels[:-1]:
                discard(df)
            levels = [seen, front]
    if weighted:
        seen = seen.groupBy("root", "node").agg(F.min("depth").alias("depth"))
        on = members.select("node", F.col("parent").alias("entry"), "at")
        within = seen.join(on, seen.node == on.entry).select("root", on.node, (F.col("depth") + F.col("at")).alias("depth"))
        seen = seen.unionByName(within)
    return seen.select("root", "node", F.col("depth").cast("int").alias("depth"))


def _trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """The edges without those whose ends can be on no cycle, as far as a few rounds of looking at both directions tell."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child")
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, component, cyclic) of all nodes: the least node of the strongly connected component, and whether that has a cycle.

    Chains are made short, ends that lead nowhere are trimmed, and the rest is
    coloured: each node takes the greatest node that reaches it, over edges and
    over the colours' own colours, so colours travel at growing speed. A node
    of its own colour, and what reaches it within the colour, is a component,
    and goes; what is left is coloured anew.
    """
    edges = written(_plain(edges), "edges")
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    loops = edges.where("parent = child").select(F.col("parent").alias("node"))
    short, members, rings = chains(edges.where("parent <> child"))
    done = [nodes.where("false").withColumn("component", F.col("node"))]
    left = written(_trimmed(short.where("parent <> child").select("parent", "child")), "left")
    while not left.isEmpty():
        color = written(left.select(F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("color", F.col("node")), "color")
        while True:
            told = left.join(color, left.parent == color.node).groupBy(F.col("child").alias("node")).agg(F.max("color").alias("told"))
            via = color.select(F.col("node").alias("color"), F.col("color").alias("via"))
            step = color.join(told, "node", "left").join(via, "color").select("node", F.greatest("color", "told", "via").alias("color"), (F.greatest("color", "told", "via") > F.col("color")).alias("moved"))
            step = written(step, "color")
            discard(color)
            color = step.drop("moved")
            color.tarn_path = step.tarn_path
            if step.where("moved").isEmpty():
                break
        same = left.join(color.select(F.col("node").alias("parent"), F.col("color").alias("a")), "parent").join(color.select(F.col("node").alias("child"), F.col("color").alias("b")), "child").where("a = b").select("parent", "child", F.col("a").alias("color"))
        same = written(same, "same")
        reached = closure(color.where("node = color").select(F.col("node").alias("root")), same.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
        group = written(reached.select("node", F.col("root").alias("component")), "group")
        done.append(group)
        rest = left
        for end in ("parent", "child"):
            rest = rest.join(group.select(F.col("node").alias(end)), end, "left_anti")
        left, before = written(_trimmed(rest.select("parent", "child")), "left"), left
        for used in (before, color, same):
            discard(used)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    named = written(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "named")
    # A chain that goes from a component to the same one is in it.
    ends = named.select(F.col("node").alias("parent"), F.col("component").alias("a")), named.select(F.col("node").alias("child"), F.col("component").alias("b"))
    within = members.join(ends[0], "parent").join(ends[1], "child").where("a = b").select("node", F.col("a").alias("own"))
    within = within.unionByName(rings.select("node", F.col("least").alias("own")))
    label = written(named.join(within, "node", "left").select("node", F.coalesce("own", "component").alias("component")), "label")
    sizes = label.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    out = label.join(sizes, "component").join(loops.withColumn("loop", F.lit(True)), "node", "left")
    return out.select("node", F.col("least").alias("component"), ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes (node) that are on a cycle."""
    return components(edges).where("cyclic").select("node")


def leading_to_cycles(edges: DataFrame) -> DataFrame:
    """Nodes (node) that are on a cycle or lead to one."""
    cyclic = written(on_cycles(edges), "cyclic")
    back = _plain(edges).select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    front, seen = cyclic, cyclic
    short, members, _ = chains(written(back, "back"), cyclic)
    while not front.isEmpty():
        step = front.join(short, front.node == short.parent).select(F.col("child").alias("node")).distinct()
        front = written(step.join(seen, "node", "left_anti"), "leading")
        seen = seen.unionByName(front)
    return seen.unionByName(members.join(seen.select(F.col("node").alias("parent")), "parent", "left_semi").select("node"))


def reachable(edges: DataFrame) -> DataFrame:
    """All pairs (parent, child) with a way of one edge or more, by path doubling: as many rounds as the logarithm of the longest shortest way."""
    seen = written(_plain(edges), "pairs")
    new = seen
    while not new.isEmpty():
        # A way of up to twice the length has a half that is new, or both.
        ahead = seen.select(F.col("parent").alias("middle"), F.col("child").alias("to"))
        behind = seen.select(F.col("child").alias("middle"), F.col("parent").alias("of"))
        step = new.join(ahead, new.child == ahead.middle).select("parent", F.col("to").alias("child")).unionByName(new.join(behind, new.parent == behind.middle).select(F.col("of").alias("parent"), "child"))
        new = written(step.distinct().join(seen, ["parent", "child"], "left_anti"), "pairs")
        seen = written(seen.unionByName(new), "pairs")
    return seen


def _over(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with a way over one of ``edges`` and otherwise over ``pairs``."""
    edges = edges.select(F.col("parent").alias("u"), F.col("child").alias("v"))
    left = edges.join(pairs.select("parent", F.col("child").alias("u")), "u").select("parent", "v").unionByName(edges.select(F.col("u").alias("parent"), "v")).distinct()
    right = left.join(pairs.select(F.col("parent").alias("v"), "child"), "v").select("parent", "child").unionByName(left.select("parent", F.col("v").alias("child")))
    return right.distinct()


def updated(pairs: DataFrame, edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``reachable`` of changed edges from that of ``edges``.

    Of removed edges, pairs with a way over them are taken out, and those that
    have another way are put back: by an edge to a node from which the rest is
    known, until nothing more comes back. Of added edges, pairs with a way over
    them come in, ways with twice as many of them each round. Joins start from
    the changes, so what does not touch them is read but not shuffled when they
    are few.
    """
    known = pairs.select("parent", "child")
    edges = _plain(edges)
    if removed is not None:
        gone = written(_plain(removed).join(edges, ["parent", "child"], "left_semi"), "gone")
        edges = written(edges.join(gone, ["parent", "child"], "left_anti"), "edges")
        lost = written(_over(known, gone), "lost")
        known = written(known.join(lost, ["parent", "child"], "left_anti"), "known")
        first = lost.select("parent").distinct().join(edges, "parent").select("parent", F.col("child").alias("middle"))
        first = written(first, "first")
        back = first.select("parent", F.col("middle").alias("child")).unionByName(first.join(known.select(F.col("parent").alias("middle"), "child"), "middle").select("parent", "child"))
        back = written(back.distinct().join(lost, ["parent", "child"], "left_semi"), "back")
        while not back.isEmpty():
            known = written(known.unionByName(back), "known")
            more = first.join(back.select(F.col("parent").alias("middle"), "child"), "middle").select("parent", "child").distinct()
            back = written(more.join(lost, ["parent", "child"], "left_semi").join(known, ["parent", "child"], "left_anti"), "back")
    if added is not None:
        added = written(_plain(added), "added")
        while True:
            new = written(_over(known, added).join(known, ["parent", "child"], "left_anti"), "new")
            if new.isEmpty():
                break
            known = written(known.unionByName(new), "known")
    return known
