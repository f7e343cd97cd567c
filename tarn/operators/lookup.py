"""Filters and look-ups over catalog tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(done: Column, linked: Column, running: Column, started: Column) -> Column:
    """The first that holds of: done, linked (also done), running, started (so failed); else missing."""
    return F.when(done | linked, "done").when(running, "running").when(started, "failed").otherwise("missing")


def hit_or_miss(requests: DataFrame, store: DataFrame, key: str, out: str = "found") -> DataFrame:
    """``requests`` marked ``hit`` or ``miss``; a key that is stored several times still gives one row."""
    known = store.select(key).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, key, "left").withColumn(out, F.when(F.col("_known"), "hit").otherwise("miss")).drop("_known")


def missing(requests: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return requests.join(store, key, "left_anti")


def late_hits(misses: DataFrame, store_now: DataFrame, key: str) -> DataFrame:
    """Earlier misses that the store has by now."""
    return misses.join(store_now, key, "left_semi")


def stale(expires: str, now: Column, slop_seconds: int = 10) -> Column:
    """A lease past its end and the clocks' tolerance."""
    return F.col(expires) + F.expr(f"INTERVAL {slop_seconds} SECONDS") <= now


@dataclass(frozen=True)
class Range:
    """What is asked of a resource: an inclusive range, open above without ``high``."""

    low: float
    high: float | None = None

    def __post_init__(self):
        if self.low < 0:
            raise ValueError(f"a range begins at zero or above, not at {self.low}")
        if self.high is not None and self.high < self.low:
            raise ValueError(f"a range that ends at {self.high} can't begin at {self.low}")

    def holds(self, offered: Column) -> Column:
        return satisfies(offered, F.lit(self.low), F.lit(self.high))

    def columns(self, name: str) -> list[Column]:
        """The bounds as the columns of a table of requests."""
        return [F.lit(self.low).alias(f"{name}_low"), F.lit(self.high).alias(f"{name}_high")]


def exactly(n: float) -> Range:
    return Range(n, n)


def at_least(n: float) -> Range:
    return Range(n)


def between(low: float, high: float) -> Range:
    return Range(low, high)


def satisfies(offered: Column, low: Column, high: Column) -> Column:
    """A resource within an inclusive range; a null bound is open."""
    return (low.isNull() | (offered >= low)) & (high.isNull() | (offered <= high))


def eligible(jobs: DataFrame, workers: DataFrame, ranges: dict[str, tuple[str, str]], need: list[str]) -> DataFrame:
    """For each worker the jobs whose ranges it satisfies.

    ``ranges`` names a worker's resource and the two columns of its bounds in
    ``jobs``. Jobs are first grouped by what they ask for (``need``) and workers
    by what they have, so that only the different requests meet the different
    offers, whatever the number of jobs and workers; both are an equality away.
    """
    kinds = jobs.groupBy(*need).agg(F.count("*").alias("jobs"))
    fits = F.lit(True)
    for resource, (low, high) in ranges.items():
        fits = fits & satisfies(F.col(resource), F.col(low), F.col(high))
    same = F.lit(True)
    offers = workers.select(*(F.col(r).alias(f"_{r}") for r in ranges)).distinct()
    for resource in ranges:
        same = same & workers[resource].eqNullSafe(F.col(f"_{resource}"))
    met = kinds.join(offers.select("*", *(F.col(f"_{r}").alias(r) for r in ranges)), fits).drop(*ranges)
    return met.join(workers, same).drop(*(f"_{r}" for r in ranges))


def ready(nodes: DataFrame, edges: DataFrame, incomplete: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    """Nodes with no incomplete child; ``incomplete`` has the column ``child``."""
    return nodes.join(edges.join(incomplete, child, "left_semi").select(F.col(parent).alias(key)), key, "left_anti")


def released(edges: DataFrame, completed: DataFrame, parent: list[str], child: list[str]) -> DataFrame:
    """Parents all of whose children are completed; ``completed`` has the columns ``child``."""
    left = edges.join(completed, child, "left_anti").select(*parent)
    return edges.select(*parent).distinct().join(left, parent, "left_anti")
