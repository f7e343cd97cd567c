"""Content keys of rows: projection, canonical form, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a key.
WIDTH = 20


def canonical_json(*columns: str) -> Column:
    """The columns as JSON with sorted names and explicit nulls."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def canonical(json: str) -> Column:
    """JSON text with the names of all its objects sorted; null where it is no JSON."""
    return F.to_json(F.try_parse_json(F.col(json)))


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, WIDTH)


def content_key(*columns: str, skip: tuple[str, ...] = ()) -> Column:
    """The key of a row by its columns, without those in ``skip``."""
    return digest(canonical_json(*(c for c in columns if c not in skip)))


def object_id(name: Column, schema_key: Column, value_key: Column) -> Column:
    return F.concat_ws(":", name, schema_key, value_key)


def ordered_set(array: str) -> Column:
    """A set's canonical form: distinct members in order."""
    return F.array_sort(F.array_distinct(array))


def group_key(df: DataFrame, by: list[str], member: str, out: str) -> DataFrame:
    """One key per group over its distinct members in order.

    Members are made distinct before they are gathered, so that a group's
    array holds each of them once.
    """
    members = df.select(*by, member).distinct().groupBy(*by).agg(F.array_sort(F.collect_list(member)).alias("_members"))
    return members.select(*by, digest(F.array_join("_members", "\n")).alias(out))


def mismatched(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows whose stored key is not that of their content."""
    return df.where(~F.col(key).eqNullSafe(content_key(*columns)))
