"""Snapshots of folders as Merkle trees, and what two of them differ in.

A file's hash is that of a git blob, so equal contents have one hash whether
they are committed or not. Executors read files in pieces, of any size. A
folder's hash is made of its entries' names, kinds and hashes, from the deepest
level up; entries are digested one by one and the digests summed, so a folder
of very many files is no single group. Two snapshots are compared from the root
down, and only below folders whose hashes differ.

Defined results: empty files have the empty blob's hash; folders without files
are not there, as in git; repeated rows of a path count once; an empty snapshot
has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources import files
from tarn.sources.shared import written

#: Bytes of a file that are held at once.
PIECE = 8 << 20


def blob_hash(content: str) -> Column:
    """Git's hash of the content in a column."""
    raw = F.col(content).cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(raw).cast("string").cast("binary"), F.lit(b"\0"), raw))


def _hash_file(path: str, size: int) -> str:
    digest = hashlib.sha1(b"blob %d\0" % size)
    with files.reader(path) as f:
        while piece := f.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of all files below a folder, empty ones too, paths relative to it: folders are listed by tasks, a level at a time."""
    top = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(f"{p}/{name}" if p else name, is_folder, size) for p in b.column("path").to_pylist() for name, is_folder, size in files.entries(f"{top}/{p}" if p else top)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ([], [], []), (pa.string(), pa.bool_(), pa.int64()))], names=["path", "folder", "size"])

    level, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = written(level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, folder boolean, size long"), "listed")
        out = found.where("not folder") if out is None else out.unionByName(found.where("not folder"))
        level = found.where("folder").select("path")
        if level.isEmpty():
            return out.select("path", "size")


def blobs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, hash) of the files below a folder whose names fit ``pattern``, paths relative to it; contents are read in pieces by tasks."""
    top = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n) for p, n in zip(b.column("path").to_pylist(), b.column("size").to_pylist()) if fnmatch(p.rpartition("/")[2], pattern)]
            hashes = [_hash_file(f"{top}/{p}", n) for p, n in rows]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64()), pa.array(hashes, pa.string())], names=["path", "size", "hash"])

    return listed(spark, top).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, size long, hash string")


def tree(found: DataFrame) -> DataFrame:
    """(path, parent, kind, size, files, hash) of all files and folders of ``found`` (path, size, hash); the root's path is empty."""
    cut = F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)
    level = found.groupBy("path").agg(F.first("size").alias("size"), F.first("hash").alias("hash"))
    level = level.select("path", cut.alias("parent"), F.lit("file").alias("kind"), F.col("size").cast("long").alias("size"), F.lit(1).cast("long").alias("files"), "hash", F.size(F.split("path", "/")).alias("depth"))
    level = written(level, "tree")
    out, deepest = level, level.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest, 0, -1):
        entry = F.sha1(F.concat_ws("\n", F.element_at(F.split("path", "/"), -1), "kind", "hash"))
        parts = [F.sum(F.conv(F.substring(entry, 1 + 10 * i, 10), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
        made = out.where(F.col("depth") == depth).groupBy("parent").agg(F.sum("size").alias("size"), F.sum("files").alias("files"), F.sha1(F.concat_ws("-", F.count("*").cast("string"), *parts)).alias("hash"))
        made = made.withColumnRenamed("parent", "path").withColumn("parent", F.when(F.col("path") != "", cut))
        folders = made.select("path", "parent", F.lit("folder").alias("kind"), "size", "files", "hash", F.lit(depth - 1).alias("depth"))
        out = written(out.unionByName(folders), "tree")
    return out.drop("depth")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old, new) of files that differ between two trees: ``+`` new, ``-`` gone, ``~`` of other content, with their hashes.

    Each round looks at the entries of folders that differ, so equal parts are
    not gone into; there are as many rounds as differing folders are deep.
    """
    sides = [t.select(F.col("path"), F.col("parent"), F.struct("kind", "hash").alias(side)) for t, side in ((old, "old"), (new, "new"))]
    differ = ~F.col("old").eqNullSafe(F.col("new"))
    tops = [s.where("path = ''").drop("parent") for s in sides]
    level = written(tops[0].join(tops[1], "path", "full").where(differ), "changed")
    out = level
    while not level.where("old.kind = 'folder' or new.kind = 'folder'").isEmpty():
        inner = [level.where(f"{side}.kind = 'folder'").select(F.col("path").alias("parent")) for side in ("old", "new")]
        below = [s.join(i, "parent").drop("parent") for s, i in zip(sides, inner)]
        level = written(below[0].join(below[1], "path", "full").where(differ), "changed")
        out = out.unionByName(level)
    file = lambda side: F.when(F.col(f"{side}.kind") == "file", F.col(f"{side}.hash"))
    out = out.select("path", file("old").alias("old"), file("new").alias("new")).where("old is not null or new is not null")
    return out.select("path", F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "-").otherwise("~").alias("change"), "old", "new")
