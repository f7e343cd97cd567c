"""Arrays of any length as ``.npy`` shards that executors write and read.

An array is a table of rows, its first dimension: an index from 0 without gaps
and a value, a number or a list of ``shape`` numbers (in C order if the row has
several dimensions). ``save`` deals rows out by ranges of the index; a task
writes its rows as shards of at most ``SHARD`` bytes and reports them, and the
list of shards is written last. ``load`` splits shards by row: a task seeks to
its rows and reads no others, so neither a shard nor the array has to fit
anywhere. ``load_npy`` reads a single ``.npy`` file, as numpy writes it, in the
same way. The driver sees headers and the list of shards only.

Arrays of objects, structures and texts are refused, and so are nulls, rows of
unequal length, gaps and repeated indices; nothing is left of a save that fails.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources import files, results
from tarn.sources.shared import file_system

MANIFEST = "array.json"
#: Most bytes of a shard, and of what a task reads at once.
SHARD = 256 << 20
SPLIT = 16 << 20

KINDS = {T.ByteType(): "|i1", T.ShortType(): "<i2", T.IntegerType(): "<i4", T.LongType(): "<i8", T.FloatType(): "<f4", T.DoubleType(): "<f8", T.BooleanType(): "|b1"}
#: Types of numpy that Spark has only in a wider form.
WIDER = {"u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "f2": T.FloatType()}


@dataclass(frozen=True)
class Rows:
    """An array as a table, for a result that holds one: published as shards, loaded as a table again."""

    frame: DataFrame
    index: str = "index"
    value: str = "value"
    shape: tuple[int, ...] | None = None


class ArrayRows(results.Codec, register=False):
    name = "array_rows"

    @classmethod
    def matches(cls, value):
        return isinstance(value, Rows)

    @classmethod
    def save(cls, spark, value, path):
        save(value.frame, path, value.index, value.value, value.shape)
        return {"index": value.index, "value": value.value, "shape": None if value.shape is None else list(value.shape)}

    @classmethod
    def load(cls, spark, meta, path):
        frame = load(spark, path).toDF(meta["index"], meta["value"])
        return Rows(frame, meta["index"], meta["value"], None if meta["shape"] is None else tuple(meta["shape"]))


def spark_type(dtype: np.dtype) -> T.DataType:
    if dtype.hasobject or dtype.names or dtype.kind not in "iufb" or dtype.itemsize > 8:
        raise TypeError(f"arrays of {dtype} are not for tables")
    code = f"{dtype.kind}{dtype.itemsize}"
    if code in WIDER:
        return WIDER[code]
    for kind, own in KINDS.items():
        if own[1:] == code:
            return kind
    raise TypeError(f"Spark has no type for {dtype}")


def header(stream: BinaryIO) -> tuple[np.dtype, tuple[int, ...], int]:
    """The dtype and shape of a ``.npy`` file, and where its data begin."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    spark_type(dtype)
    if fortran and len(shape) > 1:
        raise ValueError("rows of an array in Fortran order are not together in the file")
    return dtype, shape, stream.tell()


def save(df: DataFrame, path: str, index: str = "index", value: str = "value", shape: tuple[int, ...] | None = None, most: int = SHARD) -> None:
    """Write ``df`` (index, value) as shards below ``path``."""
    spark, kind = df.sparkSession, df.schema[value].dataType
    scalar = not isinstance(kind, T.ArrayType)
    element = kind if scalar else kind.elementType
    if element not in KINDS:
        raise TypeError(f"no array of {element.simpleString()}")
    dtype = np.dtype(KINDS[element])
    if scalar:
        shape = ()
    elif shape is None:
        first = df.select(F.size(value)).first()
        shape = (first[0] if first else 0,)
    width = math.prod(shape)
    row = max(width * dtype.itemsize, 1)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first = nxt = None

        def out() -> pa.RecordBatch:
            name = f"shard-{uuid.uuid4().hex}.npy"
            with files.writer(f"{path}/{name}") as f:
                np.lib.format.write_array_header_1_0(f, {"descr": dtype.str, "fortran_order": False, "shape": (nxt - first, *shape)})
                for part in held:
                    f.write(np.ascontiguousarray(part, dtype).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([nxt - first], pa.int64())], names=["file", "first", "rows"])

        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            data = b.column(1)
            if data.null_count or not scalar and (data.flatten().null_count or (np.diff(data.offsets.to_numpy()) != width).any()):
                raise ValueError(f"rows need {width} numbers each, none null")
            data = (data if scalar else data.flatten()).to_numpy(zero_copy_only=False).reshape(len(at), width)
            for begin in range(0, len(at), max(most // row, 1)):
                part, ids = data[begin : begin + max(most // row, 1)], at[begin : begin + max(most // row, 1)]
                if first is None:
                    first = nxt = int(ids[0])
                if (ids != np.arange(nxt, nxt + len(ids))).any():
                    raise ValueError(f"indices are not without gaps from {nxt}")
                if held and (nxt - first + len(ids)) * row > most:
                    yield out()
                    held.clear()
                    first = nxt
                held.append(part)
                nxt += len(ids)
        if held:
            yield out()

    try:
        dealt = df.select(F.col(index).cast("long").alias("index"), F.col(value).alias("value")).repartitionByRange("index").sortWithinPartitions("index")
        found = sorted(tuple(r) for r in dealt.mapInArrow(shards, "file string, first long, rows long").collect() if r.rows)
        found.sort(key=lambda x: x[1])
        total = 0
        for name, first, rows in found:
            if first != total:
                raise ValueError(f"index {total} is missing or repeated")
            total += rows
        about = {"dtype": dtype.str, "shape": [total, *shape], "shards": [{"file": n, "first": f, "rows": r} for n, f, r in found]}
        results.write_text(spark, f"{path}/{MANIFEST}", json.dumps(about))
    except BaseException:
        fs, gone = file_system(spark, path)
        fs.delete(gone, True)
        raise


def _scan(spark: SparkSession, shards: list[tuple[str, int, int]], dtype: np.dtype, shape: tuple[int, ...], split: int) -> DataFrame:
    """(index, value) of shards (path, first index, rows)."""
    element = spark_type(dtype)
    kind = T.StructType([T.StructField("index", T.LongType()), T.StructField("value", T.ArrayType(element) if shape else element)])
    width = math.prod(shape)
    step = max(split // max(width * dtype.itemsize, 1), 1)
    arrow = pa.from_numpy_dtype(np.dtype(KINDS[element]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, begin, rows in zip(*(b.column(i).to_pylist() for i in range(4))):
                with files.reader(path) as f:
                    own, have, start = header(f)
                    if own != dtype or have[1:] != shape or begin + rows > have[0]:
                        raise ValueError(f"{path} is not as its list of shards says")
                    f.seek(start + begin * width * dtype.itemsize)
                    data = np.frombuffer(f.read(rows * width * dtype.itemsize), dtype).astype(KINDS[element])
                flat = pa.array(data, arrow)
                value = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width, pa.int32()), flat) if shape else flat
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + begin, first + begin + rows)), value], names=["index", "value"])

    listed = spark.createDataFrame(shards, "path string, first long, rows long")
    ranges = listed.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(step).cast("long"))))
    ranges = ranges.select("path", "first", "begin", F.least(F.lit(step).cast("long"), F.col("rows") - F.col("begin")).alias("rows"))
    pieces = sum(-(-rows // step) for _, _, rows in shards)
    return ranges.repartition(max(pieces, 1)).mapInArrow(read, kind)


def load(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(index, value) of the array below ``path``, read by tasks of about ``split`` bytes."""
    about = json.loads(results.read_bytes(spark, f"{path}/{MANIFEST}"))
    shards = [(f"{path}/{s['file']}", s["first"], s["rows"]) for s in about["shards"]]
    return _scan(spark, shards, np.dtype(about["dtype"]), tuple(about["shape"][1:]), split)


def load_npy(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(index, value) of one ``.npy`` file; of an array without dimensions, one row."""
    with files.reader(path) as f:
        dtype, shape, _ = header(f)
    if not shape:
        return _scan(spark, [], dtype, (), split).unionByName(spark.createDataFrame([(0, np.load(files.reader(path)).item())], T.StructType([T.StructField("index", T.LongType()), T.StructField("value", spark_type(dtype))])))
    return _scan(spark, [(path, 0, shape[0])] if shape[0] else [], dtype, tuple(shape[1:]), split)


results.BUILT_IN += (ArrayRows,)
