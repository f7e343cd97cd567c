"""Rows that are computed once, by key: load or create for a table of requests.

A store is a folder with a description, data files and a log of commits. A row
has key columns and value columns; its hash gives its bucket, and each data
file holds rows of one bucket, sorted by hash. A commit is a folder of the log
with the list of the files that it adds, each with its bucket and least and
greatest hash; it is renamed into place once all its files are written, so a
reader sees all of a commit or nothing, and what a killed run leaves behind is
seen by none.

``Store.load_or_create`` anti-joins requests with what is stored, reading keys
of the files in reach only; misses go to ``build`` and are appended as one
commit. Rows that another writer has committed meanwhile are late hits: they
are dropped from the new commit, which so never holds a key twice.

Defined results: null is a key like any other; repeated requests are computed
once and each answered; of requests with one key and other columns that differ
the least is computed; an empty table of requests commits nothing. A build that
gives a key not asked for, twice, or not at all is an error, and nothing of it
is committed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators import grouping
from tarn.sources import results
from tarn.sources.shared import discard, file_system, written

META = "store.json"
COMMIT = "commit.json"
HASH = "_hash"
#: What a reader knows of a commit. ``whole``: the files are all of the store, older commits are in them.
LOGGED = "whole boolean, files array<struct<path: string, bucket: int, rows: bigint, low: bigint, high: bigint>>"
#: Widest stretch of hashes that is numbered by one task.
STRETCH = 1 << 52


class Missing(LookupError):
    """Rows that were only to be loaded are not there."""


@dataclass(frozen=True)
class Description:
    schema: str
    key: tuple[str, ...]
    buckets: int


def create(spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64) -> Store:
    """The store at ``path``, made if there is none. ``schema``: its columns as DDL, those of ``key`` among them."""
    kind = spark.createDataFrame([], schema).schema
    if lost := [k for k in key if k not in kind.names] or HASH in kind.names:
        raise ValueError(f"no columns for a key: {lost}")
    found = Description(kind.json(), tuple(key), buckets)
    scratch = f"{path}.tmp-{uuid.uuid4().hex}"
    results.write_text(spark, f"{scratch}/{META}", json.dumps(asdict(found)))
    results.make_folder(spark, f"{scratch}/log")
    results._claim(spark, scratch, path)
    store = Store(spark, path)
    if store.about != found:
        raise ValueError(f"{path} is a store of another kind: {store.about}")
    return store


def batched(compute: Callable[[pa.Table], pa.Table], schema: str, group: list[str] | None = None, cap: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A build from a function of Arrow tables.

    Without ``group`` it gets batches of misses; with it, misses of one group,
    at most ``cap`` of them, all full but a group's last.
    """
    if cap is not None and (type(cap) is not int or cap < 1):
        raise ValueError(f"a batch holds at least one member, not {cap!r}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from compute(pa.Table.from_batches([b])).to_batches()

    def build(misses: DataFrame) -> DataFrame:
        if group is None:
            return misses.drop(HASH).mapInArrow(each, schema)
        numbered = grouping.numbered(misses, group, HASH, "_at", STRETCH) if cap else misses.withColumn("_at", F.lit(0))
        # Numbers are written, so that a task that is done again finds the same groups.
        numbered = written(numbered.withColumn("_at", F.floor(F.col("_at") / (cap or 1))), "groups")
        return numbered.groupBy(*group, "_at").applyInArrow(lambda t: compute(t.drop_columns(["_at", HASH])), schema)

    return build


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        data = json.loads(results.read_bytes(spark, f"{self.path}/{META}"))
        self.about = Description(data["schema"], tuple(data["key"]), data["buckets"])
        self.key = list(self.about.key)
        self.schema = T.StructType.fromJson(json.loads(self.about.schema))

    # Commits

    def version(self) -> int:
        """The number of commits."""
        fs, log = file_system(self.spark, f"{self.path}/log")
        names = [f.getPath().getName() for f in fs.listStatus(log)]
        return max((int(n) + 1 for n in names if n.isdigit()), default=0)

    def files(self, version: int | None = None, since: int = 0) -> DataFrame:
        """(path, bucket, rows, low, high, version) of the data files that commits up to ``version`` have left."""
        version = self.version() if version is None else version
        paths = [f"{self.path}/log/{v:020d}/{COMMIT}" for v in range(since, version)]
        if not paths:
            return self.spark.createDataFrame([], "path string, bucket int, rows bigint, low bigint, high bigint, version int")
        log = self.spark.read.schema(LOGGED).json(paths).withColumn("version", F.regexp_extract("_metadata.file_path", r"/log/(\d+)/", 1).cast("int"))
        log = log.withColumn("_from", F.lit(log.where("whole").agg(F.max("version")).first()[0] or 0))
        return log.where("version >= _from").select("version", F.explode("files").alias("f")).select("f.*", "version")

    def commit(self, files: list[dict], expected: int, whole: bool = False) -> bool:
        """Append a commit as number ``expected``; False if another writer was first."""
        scratch = f"{self.path}/log/tmp-{uuid.uuid4().hex}"
        results.write_text(self.spark, f"{scratch}/{COMMIT}", json.dumps({"whole": whole, "files": files}))
        return results._claim(self.spark, scratch, f"{self.path}/log/{expected:020d}")

    # Rows

    def hash(self) -> Column:
        return F.xxhash64(*(F.col(k) for k in self.key))

    def bucket(self, of: str = HASH) -> Column:
        return F.pmod(F.col(of), F.lit(self.about.buckets)).cast("int")

    def _read(self, paths: list[str]) -> DataFrame:
        kind = T.StructType([*self.schema.fields, T.StructField(HASH, T.LongType())])
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{p}" for p in paths))

    def scan(self, version: int | None = None) -> DataFrame:
        """All rows, as of a version."""
        return self._read([r.path for r in self.files(version).select("path").collect()]).drop(HASH)

    def near(self, requests: DataFrame, version: int | None = None, since: int = 0) -> list[str]:
        """The files that can hold keys of ``requests`` (with their hashes): by bucket and range."""
        spans = requests.groupBy(self.bucket().alias("bucket")).agg(F.min(HASH).alias("_low"), F.max(HASH).alias("_high"))
        found = self.files(version, since).join(spans, "bucket").where("low <= _high and high >= _low")
        return sorted(r.path for r in found.select("path").collect())

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        same = a[HASH] == b[HASH]
        for k in self.key:
            same = same & a[f"`{k}`"].eqNullSafe(b[f"`{k}`"])
        return same

    def _without(self, requests: DataFrame, paths: list[str]) -> DataFrame:
        stored = self._read(paths).select(HASH, *self.key)
        return requests.join(stored, self._same(requests, stored), "left_anti")

    def missing(self, requests: DataFrame, version: int | None = None) -> DataFrame:
        """The distinct requests without a row, with their hashes."""
        rest = [c for c in requests.columns if c not in self.key]
        if rest:
            least = requests.groupBy(*self.key).agg(F.min(F.struct(*rest)).alias("_rest"))
            requests = least.select(*self.key, *(F.col("_rest").getField(c).alias(c) for c in rest))
        else:
            requests = requests.select(*self.key).distinct()
        requests = requests.withColumn(HASH, self.hash())
        return self._without(requests, self.near(requests, version))

    def answers(self, requests: DataFrame, version: int | None = None) -> DataFrame:
        """Each request that has a row, with the row's values."""
        asked = requests.withColumn(HASH, self.hash())
        values = [c for c in self.schema.names if c not in self.key]
        if taken := sorted(set(values) & set(requests.columns)):
            raise ValueError(f"requests have columns of the values: {taken}")
        stored = self._read(self.near(asked, version))
        return asked.join(stored, self._same(asked, stored)).select(*(asked[f"`{c}`"] for c in requests.columns), *(stored[f"`{c}`"] for c in values))

    def load_existing(self, requests: DataFrame) -> DataFrame:
        """``answers``, or an error that says how many rows are missing and names some. Nothing is computed."""
        version = self.version()
        lost = self.missing(requests, version).select(*self.key)
        if some := lost.limit(10).collect():
            raise Missing(f"{lost.count()} rows are missing, such as {[tuple(r) for r in some]}")
        return self.answers(requests, version)

    def _write(self, rows: DataFrame, commit: str) -> list[dict]:
        """Write rows (with hashes) as files of a commit to be; a file has one bucket, a large bucket several files."""
        folder = f"data/{commit}"
        dealt = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", HASH).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        back = self.spark.read.parquet(f"{self.path}/{folder}").select(HASH, "bucket", F.regexp_extract("_metadata.file_path", f"/({folder}/.*)$", 1).alias("path"))
        stats = back.groupBy("path", "bucket").agg(F.count("*").alias("rows"), F.min(HASH).alias("low"), F.max(HASH).alias("high"))
        return [r.asDict() for r in stats.collect()]

    def load_or_create(self, requests: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Each request with its row's values; rows that are missing are computed by ``build`` and stored.

        ``build`` gets the distinct missing requests, with all their columns,
        and returns a row of the store's columns for each (see ``batched``).
        """
        seen = self.version()
        misses = written(self.missing(requests, seen), "misses")
        if n := misses.count():
            made = build(misses).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn(HASH, self.hash())
            commit = uuid.uuid4().hex
            files = self._write(made, commit)
            self._check(misses, n, files)
            while not self.commit(files, seen):
                # Others were first: what they have of these rows are late hits.
                now = self.version()
                rows = self._read([f["path"] for f in files])
                late = self.near(rows, now, seen)
                seen = now
                if late:
                    rows = self._without(rows, late)
                    before, commit = commit, uuid.uuid4().hex
                    files = [] if rows.isEmpty() else self._write(rows, commit)
                    self._drop(before)
                    if not files:
                        break
        discard(misses)
        return self.answers(requests)

    def _check(self, misses: DataFrame, n: int, files: list[dict]) -> None:
        rows = self._read([f["path"] for f in files])
        built = sum(f["rows"] for f in files)
        lost = misses.join(rows.select(HASH, *self.key), self._same(misses, rows), "left_anti").select(*self.key).limit(5).collect()
        if built != n or lost:
            raise ValueError(f"{n} rows were asked for, {built} were built; not built: {[tuple(r) for r in lost]}")

    # Upkeep

    def compact(self) -> int:
        """Write the store's rows as few files a bucket, as one commit; files before. Readers of older versions are not disturbed."""
        seen = self.version()
        old = [r.path for r in self.files(seen).select("path").collect()]
        files = self._write(self._read(old), uuid.uuid4().hex) if old else []
        while old and not self.commit(files, seen, whole=True):
            now = self.version()
            files += [{k: v for k, v in r.asDict().items() if k != "version"} for r in self.files(now, seen).collect()]
            seen = now
        return len(old)

    def vacuum(self, hours: float = 24) -> int:
        """Remove data of no present commit that is older than ``hours``: what failed runs and compaction left. How many folders went."""
        used = {r[0] for r in self.files().select(F.split("path", "/")[1]).distinct().collect()}
        fs, data = file_system(self.spark, f"{self.path}/data")
        gone = 0
        for f in fs.listStatus(data) if fs.exists(data) else []:
            name = f.getPath().getName()
            if name not in used and f.getModificationTime() < 1000 * (time.time() - 3600 * hours):
                self._drop(name)
                gone += 1
        return gone

    def _drop(self, commit: str) -> None:
        fs, folder = file_system(self.spark, f"{self.path}/data/{commit}")
        fs.delete(folder, True)
