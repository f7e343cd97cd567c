"""Typed results, codecs, references, and two writers of one result."""

import json
import math
from dataclasses import dataclass
from pathlib import Path
from typing import Annotated

import numpy as np
import pytest
from pyspark.sql import DataFrame

from tarn.plans import steps
from tarn.sources import results



class Shout(results.Codec, register=False):
    """Text in capitals, beside a note of its length."""

    name = "shout"

    @classmethod
    def matches(cls, value):
        return isinstance(value, str) and value.startswith("!")

    @classmethod
    def save(cls, spark, value, path):
        results.write_text(spark, f"{path}/text", value.upper())
        return {"size": (len(value), None), "file": Path(f"{path}/text")}

    @classmethod
    def load(cls, spark, meta, path):
        assert isinstance(meta["size"], tuple)
        return results.read_bytes(spark, str(meta["file"])).decode()


@dataclass(frozen=True)
class Report:
    title: str
    loud: Annotated[str, Shout]
    parts: tuple
    names: frozenset
    seen: set
    where: Path
    table: DataFrame
    weights: np.ndarray


def report(spark):
    return Report("t", "quiet", (1, [2.5, None], (True,)), frozenset({"a", "b"}), {1, 2}, Path("/x/y"), spark.range(3), np.arange(6.0).reshape(2, 3))


def test_typed_tree(spark, results_root):
    value = {"report": report(spark), "odd": [math.nan, math.inf, -math.inf]}
    assert results.publish(spark, value, results_root)
    back = results.load(spark, results_root, (Shout,))
    got = back["report"]
    assert type(got) is Report and got.loud == "QUIET" and got.title == "t"
    assert (got.parts, got.names, got.seen, got.where) == ((1, [2.5, None], (True,)), frozenset({"a", "b"}), {1, 2}, Path("/x/y"))
    assert type(got.names) is frozenset and got.table.count() == 3 and (got.weights == np.arange(6.0).reshape(2, 3)).all()
    assert math.isnan(back["odd"][0]) and back["odd"][1:] == [math.inf, -math.inf]
    for bad in (np.array([object()]), {object()}, {"|x": 1}, 1j):
        with pytest.raises((ValueError, TypeError)):
            results.publish(spark, bad, results_root + "-bad")
    assert not list(Path(results_root).parent.glob("*bad*"))


def test_layers_of_codecs(spark, results_root):
    assert results.find_codec("!a") is None and results.find_codec("!a", (Shout,)) is Shout

    class Own(results.Codec):
        matches = classmethod(lambda cls, v: isinstance(v, np.ndarray))
        save = classmethod(lambda cls, spark, v, path: results.make_folder(spark, path) or {"sum": float(v.sum())})
        load = classmethod(lambda cls, spark, meta, path: meta["sum"])

    # Registered ones go before the built-in ones; two of one layer are an error.
    results.publish(spark, [np.ones(3), "!x"], results_root, codecs=(Shout,))
    assert results.load(spark, results_root, (Shout,)) == [3.0, "!X"]
    with pytest.raises(LookupError):
        results.load(spark, results_root)

    class Also(Own):
        pass

    with pytest.raises(TypeError):
        results.publish(spark, np.ones(3), results_root + "2")


def test_notes_stay_within(spark, results_root):
    class Leaves(results.Codec, register=False):
        name = "leaves"
        matches = classmethod(lambda cls, v: v == "leave")
        save = classmethod(lambda cls, spark, v, path: {"file": Path(f"{path}/../../out")})
        load = classmethod(lambda cls, spark, meta, path: meta)

    with pytest.raises(ValueError, match="not inside"):
        results.publish(spark, "leave", results_root, codecs=(Leaves,))
    results.publish(spark, "!in", results_root, codecs=(Shout,))
    file = Path(results_root) / results.MANIFEST
    for change in ({"file": {"|path": "../../etc"}, "size": {"|tuple": [1]}}, {"file": {"|path": "/etc/x"}, "size": {"|tuple": [1]}}):
        data = json.loads(file.read_text())
        data["value"]["meta"] = change
        file.write_text(json.dumps(data))
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
        with pytest.raises((ValueError, Exception)):
            results.load(spark, results_root, (Shout,))


class Lazy(steps.Step):
    n: int

    def build(self, spark, inputs):
        return {"now": 1, "later": results.ref(spark.range(self.n))}


def test_references(spark, results_root):
    got = steps.materialize(spark, Lazy(n=4), results_root)
    assert got["now"] == 1 and isinstance(got["later"], results.Ref)
    assert got["later"].load().count() == 4 and got["later"].load() is got["later"].load()
    # The value is bound to what was published, not to what was computed.
    assert results_root in got["later"].load().inputFiles()[0]


def test_two_writers(spark, results_root, monkeypatch):
    """A file system that moves a folder into one that is there, and calls it a success."""
    assert results.publish(spark, 1, results_root)
    real = results.file_system

    class Into:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def exists(self, path):
            return self.fs.exists(path) and path.toString() != results_root

        def rename(self, own, target):
            return self.fs.rename(own, real(spark, f"{target.toString()}/{own.getName()}")[1])

    monkeypatch.setattr(results, "file_system", lambda spark, path: (Into(real(spark, path)[0]), real(spark, path)[1]))
    assert not results.publish(spark, 2, results_root)
    monkeypatch.undo()
    assert results.load(spark, results_root) == 1 and sorted(p.name for p in Path(results_root).iterdir() if not p.name.startswith(".")) == [results.MANIFEST]
