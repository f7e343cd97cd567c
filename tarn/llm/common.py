"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources.shared import file_system, shared_dir

#: One or more characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's ``options``, to the shared folder and return a scan of it.

    This cuts the lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tarn_path = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def tables() -> Iterator[list[DataFrame]]:
    """Collects what ``materialize`` writes, for a caller that knows when nothing reads it any more."""
    made: list[DataFrame] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def discard(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more."""
    path = df.__dict__.get("tarn_path")
    if path:
        delete(df.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with ``fields`` at the end; fields of the same name go first."""
    new = {name for name, _ in fields}
    kept = [f for f in schema.fields if f.name not in new]
    return T.StructType(kept + [T.StructField(n, t) for n, t in fields])


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` and, as the struct ``rest_``, all other columns, whose names then can't clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*rest).alias("rest_")] if rest else []))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that went into ``packed``, in the given order."""
    rest = df.schema["rest_"].dataType.names if "rest_" in df.columns else []
    return df.select(*(F.col("rest_").getField(c).alias(c) if c in rest else F.col(c) for c in columns))


def text_key(text="text"):
    """A digest by which equal texts meet (null and empty text are one)."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def with_length(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from what was ``packed``; ``n_chars``, if there is one, follows the text."""
    out = unpacked(df, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
