"""Published results as a data source: ``spark.read.format("tarn").load(root)``.

A row is a leaf of a result's tree: the step's name, the digests of its fields
and values (which with the name are its place), the leaf's path in the tree,
its value as JSON, or the codec and the place of what a codec has written, and
of a link the place that it points to. Filters on name, schema and key choose
the places that are listed and read; one on leaf is answered while reading. A
task reads up to ``PLACES`` manifests.

``df.write.format("tarn").mode("append").save(root)`` publishes a result for
each row (name, schema, key, value as JSON). Tasks write to a folder of their
own, which no reader looks into; results get their names when all tasks are
done, so nothing is seen of a job that fails. A place that is taken stays as it
is, as equal keys have equal results.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tarn.sources import files

SCHEMA = "name string, schema string, key string, leaf string, value string, codec string, artifact string, link string"
PLACE = ("name", "schema", "key")
MANIFEST = "manifest.json"
#: Manifests read by a task, and results named at the same time.
PLACES = 64
THREADS = 32


@dataclass
class Places(InputPartition):
    places: list[tuple[str, str, str]]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    places: list[tuple[str, str, str]]


def leaves(tree: object, at: str = "") -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """(path, value, codec, artifact) of a manifest's tree."""
    if isinstance(tree, dict) and "|leaf" in tree:
        yield at, None, tree["|leaf"], tree["path"]
    elif isinstance(tree, dict) and "|path" in tree:
        yield at, json.dumps(tree["|path"]), "path", None
    elif isinstance(tree, dict):
        for k, v in tree.items():
            if k == "|class":
                continue
            yield from leaves(v, at if k.startswith("|") else f"{at}/{k}" if at else k)
    elif isinstance(tree, list):
        for i, v in enumerate(tree):
            yield from leaves(v, f"{at}/{i}" if at else str(i))
    else:
        yield at, json.dumps(tree), None, None


class Reader(DataSourceReader):
    def __init__(self, root: str, places: int):
        self.root, self.size = root, places
        self.asked: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in (*PLACE, "leaf"):
                self.asked[name] = self.asked.get(name, values) & values
            else:
                yield f

    def _listed(self, folder: str, level: str) -> list[str]:
        """Names at a level: those asked for, if they are there, without a listing of the others."""
        if level in self.asked:
            return sorted(n for n in self.asked[level] if n and "/" not in n and n not in (".", "..") and files.exists(f"{folder}/{n}"))
        return [n for n in files.folders(folder) if ".tmp-" not in n and ".gone-" not in n]

    def partitions(self) -> list[InputPartition]:
        found = [
            (name, schema, key)
            for name in self._listed(self.root, "name")
            for schema in self._listed(f"{self.root}/{name}", "schema")
            for key in self._listed(f"{self.root}/{name}/{schema}", "key")
        ]
        return [Places(found[i : i + self.size]) for i in range(0, len(found), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for place in partition.places if partition else []:
            path = f"{self.root}/{'/'.join(place)}/{MANIFEST}"
            if not files.exists(path):
                continue  # deleted meanwhile, or no result
            with files.reader(path) as f:
                manifest = json.loads(f.read())
            rows = [("", None, None, None)] if "link" in manifest else leaves(manifest["value"])
            for leaf, value, codec, artifact in rows:
                if "leaf" not in self.asked or leaf in self.asked["leaf"]:
                    yield (*place, leaf, value, codec, artifact, manifest.get("link"))


class Writer(DataSourceWriter):
    def __init__(self, root: str, names: list[str]):
        if lost := [n for n in (*PLACE, "value") if n not in names]:
            raise ValueError(f"results have no columns {lost}")
        self.root, self.names = root, names
        self.scratch = f"{root}/job.tmp-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        folder, places = f"{self.scratch}/{uuid.uuid4().hex}", []
        for row in iterator:
            place = tuple(row[n] for n in PLACE)
            if any(not isinstance(p, str) or not p or p in (".", "..") or "/" in p or ".tmp-" in p for p in place):
                raise ValueError(f"no place for a result: {place}")
            tree = json.loads(row["value"])
            with files.writer(f"{folder}/{len(places)}/{MANIFEST}") as f:
                f.write(json.dumps({"value": tree, "facts": {}}, sort_keys=True).encode())
            places.append(place)
        return Written(folder, places)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        moves = [(f"{m.folder}/{i}", f"{self.root}/{'/'.join(p)}") for m in messages if m for i, p in enumerate(m.places)]
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda m: files.move(*m), moves))
        files.remove(self.scratch)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files.remove(self.scratch)


class Results(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarn"

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        if not self.options.get("path"):
            raise ValueError("results lie in a folder: load(root) or save(root)")
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> DataSourceReader:
        return Reader(self._root(), int(self.options.get("places", PLACES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("results are not overwritten; append to them")
        return Writer(self._root(), schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let its filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Results)
