"""Deduplication, grouping, ordering and limits over catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order`` (unique within a key).

    A minimum, which is taken before the shuffle too, rather than a window.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def numbered(df: DataFrame, keys: list[str], order: str, out: str, width: int = 1_000_000) -> DataFrame:
    """Numbers the rows of each key from 0 by ``order``, a unique whole number.

    Rows are numbered within stretches of ``width`` values of ``order``, and
    the stretches' sizes are summed up apart, so a hot key is many tasks.
    """
    cut = df.withColumn("_cut", F.floor(F.col(order) / width))
    sizes = cut.groupBy(*keys, "_cut").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_cut").orderBy(order)
    out_col = F.row_number().over(within) - 1 + F.col("_start")
    same = F.col("_cut") == F.col("_of")
    for i, k in enumerate(keys):  # null is a key like any other
        starts, same = starts.withColumnRenamed(k, f"_key{i}"), same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    starts = starts.withColumnRenamed("_cut", "_of")
    return cut.join(starts, same).withColumn(out, out_col.cast("long")).drop("_cut", "_start", "_of", *(f"_key{i}" for i in range(len(keys))))


def chunks(df: DataFrame, keys: list[str], order: str, cap: int, out: str = "chunk") -> DataFrame:
    """Rows of each key in chunks of at most ``cap``, in order."""
    return numbered(df, keys, order, "_at").withColumn(out, F.floor(F.col("_at") / cap).cast("long")).drop("_at")


def at_most(df: DataFrame, kind: str, order: list, most: int, out: str = "slot") -> DataFrame:
    """The first ``most`` rows of each kind; ranks are limited before the shuffle as well."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    return ranked.where(F.col(out) <= most)


def state_counts(df: DataFrame, state: str, out: str = "n") -> DataFrame:
    return df.groupBy(state).agg(F.count("*").alias(out))


def retries(failures: DataFrame, key: str, limit: int) -> DataFrame:
    """Failed attempts of each key and whether one more is allowed."""
    return failures.groupBy(key).agg(F.count("*").alias("attempts")).withColumn("retry", F.col("attempts") <= limit)


def distinct_list(df: DataFrame, key: str, member: Column, out: str, sep: str = ",") -> DataFrame:
    """The sorted distinct members of each key as text."""
    return df.select(key, member.alias("_m")).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_m")), sep).alias(out))


def totals(df: DataFrame, by: str, size: str, limit: int) -> DataFrame:
    """Sum and largest size by group, and whether the sum is over the limit."""
    return df.groupBy(by).agg(F.sum(size).alias("total"), F.max(size).alias("largest")).withColumn("over", F.col("total") > limit)


def largest(df: DataFrame, size: str, tie: str, n: int = 10) -> DataFrame:
    """The ``n`` largest rows: a report."""
    return df.orderBy(F.desc(size), tie).limit(n)


def counted_names(df: DataFrame, by: list[str], name: str, out: str) -> DataFrame:
    """Equal names as ``name ×n``, in order, per group."""
    n = df.groupBy(*by, name).agg(F.count("*").alias("_n"))
    label = F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit(" ×"), F.col("_n").cast("string"))).otherwise(F.col(name))
    return n.select(*by, label.alias("_l")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("_l")), ", ").alias(out))


def demand(counts: DataFrame, wanted: str, tracked: str, most: int) -> DataFrame:
    """Workers to start (positive) or to cancel (negative)."""
    return counts.withColumn("change", F.least(F.col(wanted), F.lit(most)) - F.col(tracked))
