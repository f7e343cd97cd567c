"""Deleting results that nothing needs any more.

What is kept is given as keys of steps; what their records say they were made
from is kept too, and so is what kept links point to. All else goes, links to
nothing with it. Results go in two phases: first a list of what goes is
published, and each result is renamed, so that no reader finds a part of one;
then the renamed ones are deleted, and the list last. A run that is stopped in
between leaves its list, and ``recover`` goes on from there.

Results that are published while a sweep runs are not in its list and stay. One
that is built meanwhile from a result that goes keeps its own data; it says in
its record what it was made from.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import graph
from tarn.plans import reuse
from tarn.sources import results
from tarn.sources.shared import file_system, written

LISTS = ".sweeps"
THREADS = 16


def unreachable(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (node) that nothing in ``keep`` (node) leads to over ``edges`` (parent, child). Nodes are texts, none of them empty."""
    # One root for all that is kept: what is asked is whether a node is reached, not from where.
    root = F.lit("")
    linked = edges.select("parent", "child").unionByName(keep.select(root.alias("parent"), F.col("node").alias("child")))
    reached = graph.closure(nodes.sparkSession.range(1).select(root.alias("root")), linked).select("node")
    return nodes.join(reached, "node", "left_anti")


def place(path):
    """The last three parts of a path: a result's place below its root."""
    return F.substring_index(path, "/", -3)


def needless(spark: SparkSession, root: str, keep: list[str]) -> DataFrame:
    """(path, node) of the results and links below ``root`` that no kept key needs; ``keep`` has keys of steps."""
    found = written(reuse.catalog(spark, root).select(F.regexp_replace("path", f"/{results.MANIFEST}$", "").alias("path"), "inputs", "read", "link"), "catalog")
    named = found.select("path", place("path").alias("node"), "inputs", "read", "link")
    asked = F.explode(F.concat(F.coalesce("inputs", F.array()), F.coalesce("read", F.array())))
    edges = named.select(F.col("node").alias("parent"), asked.alias("key")).select("parent", F.replace("key", F.lit(":"), F.lit("/")).alias("child"))
    edges = edges.unionByName(named.where("link is not null").select(F.col("node").alias("parent"), place("link").alias("child")))
    kept = spark.createDataFrame([(k.replace(":", "/"),) for k in keep], "node string")
    loose = unreachable(named.select("node", "path"), edges, kept)
    dangling = named.where("link is not null").withColumn("to", place("link")).join(named.select(F.col("node").alias("to")), "to", "left_anti").select("node", "path")
    return loose.unionByName(dangling).distinct()


def sweep(spark: SparkSession, root: str, keep: list[str]) -> list[str]:
    """Delete what ``keep`` does not need; the places that went."""
    gone = sorted(r.node for r in needless(spark, root, keep).select("node").collect())
    if gone:
        name = uuid.uuid4().hex
        results.write_text(spark, f"{root}/{LISTS}/{name}.json.tmp", json.dumps(gone))
        fs, made = file_system(spark, f"{root}/{LISTS}/{name}.json.tmp")
        fs.rename(made, file_system(spark, f"{root}/{LISTS}/{name}.json")[1])
        _finish(spark, root, name)
    return gone


def _finish(spark: SparkSession, root: str, name: str) -> None:
    fs, listed = file_system(spark, f"{root}/{LISTS}/{name}.json")
    places = json.loads(results.read_bytes(spark, f"{root}/{LISTS}/{name}.json"))

    def both(phase):
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(phase, places))

    def aside(at: str) -> None:
        own, to = (file_system(spark, f"{root}/{at}{end}")[1] for end in ("", f".gone-{name}"))
        if fs.exists(own) and not fs.exists(to):
            fs.rename(own, to)

    both(aside)
    both(lambda at: fs.delete(file_system(spark, f"{root}/{at}.gone-{name}")[1], True))
    fs.delete(listed, False)


def recover(spark: SparkSession, root: str) -> int:
    """Finish sweeps that were stopped; how many. Lists that were not published yet are removed."""
    fs, folder = file_system(spark, f"{root}/{LISTS}")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    for n in names:
        if n.endswith(".json"):
            _finish(spark, root, n.removesuffix(".json"))
        else:
            fs.delete(file_system(spark, f"{root}/{LISTS}/{n}")[1], False)
    return sum(n.endswith(".json") for n in names)
