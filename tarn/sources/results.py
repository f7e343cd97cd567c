"""Published results: a directory of leaves and a manifest, written last.

A result is a tree of scalars, lists, tuples, sets, dicts, paths and records
(dataclasses), with leaves that a codec writes: tables as Parquet, arrays as
``.npy``, values of other types by codecs of one's own. ``publish`` writes each
leaf to ``artifacts/<path>`` under a temporary name, then the manifest, and
renames the whole: a reader sees all of it or nothing. Losing the race to
another writer of the same key is no fault, as equal keys have equal results.
``load`` returns lazy scans of tables, and a ``Ref`` where one was published.

A codec is found by the field's annotation (``Annotated[T, MyCodec]`` in a
record), then among those given by the caller, then the registered ones, then
the built-in ones. Two that match in one of the middle layers are an error.
"""

from __future__ import annotations

import dataclasses
import io
import json
import typing
import uuid
from pathlib import Path, PurePath
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from tarn.names import element_type, full_name, hints, resolve
from tarn.sources.shared import file_system

MANIFEST = "manifest.json"


class Codec:
    """Writes values of a type to a folder and reads them back. Subclasses register themselves, newest first, unless ``register=False``."""

    name: ClassVar[str]
    registered: ClassVar[list[type[Codec]]] = []

    def __init_subclass__(cls, register: bool = True, **options):
        super().__init_subclass__(**options)
        cls.name = cls.__dict__.get("name", full_name(cls))
        if register:
            Codec.registered.insert(0, cls)

    @classmethod
    def matches(cls, value: object) -> bool:
        raise NotImplementedError

    @classmethod
    def save(cls, spark: SparkSession, value: object, path: str) -> dict:
        """Write to ``path``, and return what ``load`` needs to know: plain values, tuples and paths within ``path``."""
        raise NotImplementedError

    @classmethod
    def load(cls, spark: SparkSession, meta: dict, path: str) -> object:
        raise NotImplementedError


class Table(Codec, register=False):
    name = "table"

    @classmethod
    def matches(cls, value):
        return isinstance(value, DataFrame)

    @classmethod
    def save(cls, spark, value, path):
        value.write.parquet(path)
        return {"schema": value.schema.json()}

    @classmethod
    def load(cls, spark, meta, path):
        from pyspark.sql.types import StructType

        return spark.read.schema(StructType.fromJson(json.loads(meta["schema"]))).parquet(path)


class Array(Codec, register=False):
    """Arrays of the driver; those of objects are refused."""

    name = "array"

    @classmethod
    def matches(cls, value):
        import numpy as np

        return isinstance(value, np.ndarray)

    @classmethod
    def save(cls, spark, value, path):
        import numpy as np

        raw = io.BytesIO()
        np.save(raw, value, allow_pickle=False)
        write_bytes(spark, f"{path}/data.npy", raw.getvalue())
        return {"shape": list(value.shape), "dtype": value.dtype.str}

    @classmethod
    def load(cls, spark, meta, path):
        import numpy as np

        return np.load(io.BytesIO(read_bytes(spark, f"{path}/data.npy")), allow_pickle=False)


BUILT_IN: tuple[type[Codec], ...] = (Table, Array)

#: Codecs by name that were registered as functions.
CODECS: dict[str, type[Codec]] = {}


def register(name: str, matches, save, load) -> None:
    """Add a codec given as functions; a value that two registered codecs claim is an error when it is saved."""
    body = {"name": name, "matches": staticmethod(matches), "save": staticmethod(save), "load": staticmethod(load) if load else None}
    CODECS[name] = type(name, (Codec,), body, register=False)


def find_codec(value: object, own: tuple = ()) -> type[Codec] | None:
    for layer in (own, (*CODECS.values(), *Codec.registered)):
        found = [c for c in layer if c.matches(value)]
        if len(found) > 1:
            raise TypeError(f"several codecs match: {[c.name for c in found]}")
        if found:
            return found[0]
    return next((c for c in BUILT_IN if c.matches(value)), None)


def codec_named(name: str, own: tuple = ()) -> type[Codec]:
    for c in (*own, *CODECS.values(), *Codec.registered, *BUILT_IN):
        if c.name == name:
            return c
    found = resolve(name)
    if not (isinstance(found, type) and issubclass(found, Codec)):
        raise TypeError(f"{name} is no codec")
    return found


class Ref:
    """A value that is read when it is asked for, once."""

    def __init__(self, value: object = None, load=None):
        self._value, self._load = value, load

    def load(self) -> object:
        if self._load is not None:
            self._value, self._load = self._load(), None
        return self._value


def ref(value: object) -> Ref:
    """A part of a result that readers load only when they need it."""
    return Ref(value)


def check_name(name: str) -> str:
    """A path segment from a key of a result; what could leave the directory is refused."""
    if not isinstance(name, str) or not name or name in (".", "..") or any(c in name for c in "/\\\0") or name.startswith("|"):
        raise ValueError(f"not a usable key: {name!r}")
    return name


def _inside(path: PurePath, folder: str) -> str:
    """A path below ``folder``, relative to it."""
    parts = path.as_posix().removeprefix(f"{folder}/").split("/")
    if path.as_posix() == folder or parts[0] == "" or ".." in parts:
        raise ValueError(f"{path} is not inside {folder}")
    return "/".join(parts)


def _meta_data(meta: object, folder: str) -> object:
    """What a codec's ``save`` returned, as JSON data."""
    if meta is None or isinstance(meta, (bool, int, float, str)):
        return meta
    if isinstance(meta, PurePath):
        return {"|path": _inside(meta, folder)}
    if isinstance(meta, (list, tuple)):
        data = [_meta_data(v, folder) for v in meta]
        return {"|tuple": data} if isinstance(meta, tuple) else data
    if isinstance(meta, dict):
        return {check_name(k): _meta_data(v, folder) for k, v in meta.items()}
    raise TypeError(f"a codec's notes hold plain values, not {meta!r}")


def _meta_back(data: object, folder: str) -> object:
    if isinstance(data, list):
        return [_meta_back(v, folder) for v in data]
    if isinstance(data, dict):
        if "|path" in data:
            return Path(f"{folder}/{_inside(PurePath(data['|path']), folder)}")
        if "|tuple" in data:
            return tuple(_meta_back(v, folder) for v in data["|tuple"])
        return {k: _meta_back(v, folder) for k, v in data.items()}
    return data


def _annotated_codec(kind: object) -> type[Codec] | None:
    marks = typing.get_args(kind)[1:] if typing.get_origin(kind) is typing.Annotated else ()
    return next((m for m in marks if isinstance(m, type) and issubclass(m, Codec)), None)


def _set_order(value: object) -> tuple[str, str]:
    shown = repr(value)
    if type(value).__repr__ is object.__repr__:
        raise ValueError(f"a member of a set needs a repr of its own: {shown}")
    return full_name(type(value)), shown


def publish(spark: SparkSession, value: object, path: str, facts: dict | None = None, codecs: tuple = (), kind: object = typing.Any) -> bool:
    """Write a result; ``kind`` is its declared type, if any. False if another was first."""
    scratch = f"{path}.tmp-{uuid.uuid4().hex}"

    def save(v: object, at: tuple[str, ...], kind: object):
        codec = _annotated_codec(kind) or find_codec(v, codecs)
        if codec:
            place = "artifacts/" + "/".join(at or ("root",))
            folder = f"{scratch}/{place}"
            return {"|leaf": codec.name, "path": place, "meta": _meta_data(codec.save(spark, v, folder), folder)}
        if v is None or isinstance(v, (bool, int, float, str)):
            return v
        if isinstance(v, Ref):
            return {"|ref": save(v.load(), at, kind)}
        if isinstance(v, PurePath):
            return {"|path": v.as_posix()}
        if isinstance(v, dict):
            return {check_name(k): save(x, (*at, k), element_type(kind, k)) for k, x in v.items()}
        if isinstance(v, (list, tuple, set, frozenset)):
            held = sorted(v, key=_set_order) if isinstance(v, (set, frozenset)) else v
            wide = len(str(len(held)))
            data = [save(x, (*at, str(i).zfill(wide)), element_type(kind, i)) for i, x in enumerate(held)]
            return data if isinstance(v, list) else {f"|{type(v).__name__}": data}
        if dataclasses.is_dataclass(v) and not isinstance(v, type):
            of = hints(type(v))
            return {"|class": full_name(type(v)), "|fields": {f.name: save(getattr(v, f.name), (*at, check_name(f.name)), of[f.name]) for f in dataclasses.fields(v)}}
        raise ValueError(f"no codec for {'/'.join(at) or '<root>'}: {type(v).__name__}")

    try:
        tree = save(value, (), kind)
        write_text(spark, f"{scratch}/{MANIFEST}", json.dumps({"value": tree, "facts": facts or {}}, sort_keys=True))
    except BaseException:
        fs, gone = file_system(spark, scratch)
        fs.delete(gone, True)
        raise
    return _claim(spark, scratch, path)


def _claim(spark: SparkSession, scratch: str, path: str) -> bool:
    """Give ``scratch`` its name. Where another writer was first, some file systems move it into what is there and report success; it is taken out again."""
    fs, target = file_system(spark, path)
    own = file_system(spark, scratch)[1]
    fs.mkdirs(target.getParent())
    first = not fs.exists(target) and fs.rename(own, target)
    within = file_system(spark, f"{path}/{scratch.rpartition('/')[2]}")[1]
    if first and fs.exists(within):
        fs.delete(within, True)
        return False
    if not first:
        fs.delete(own, True)
    return bool(first)


def publish_link(spark: SparkSession, path: str, source: str, changes: list[str]) -> bool:
    """A result that is another one's, by ``changes``. False if something is there already."""
    scratch = f"{path}.tmp-{uuid.uuid4().hex}"
    write_text(spark, f"{scratch}/{MANIFEST}", json.dumps({"link": source, "changes": changes}))
    return _claim(spark, scratch, path)


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, read by the driver."""
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.mkdirs(target)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    fs, target = file_system(spark, f"{path}/{MANIFEST}")
    return json.loads(read_bytes(spark, f"{path}/{MANIFEST}")) if fs.exists(target) else None


def load(spark: SparkSession, path: str, codecs: tuple = ()) -> object:
    """The result at ``path``; tables are lazy scans of what was published."""
    found = read_manifest(spark, path)
    if found is None:
        raise FileNotFoundError(path)

    def back(v: object):
        if isinstance(v, list):
            return [back(x) for x in v]
        if not isinstance(v, dict):
            return v
        if "|leaf" in v:
            place = v["path"]
            if not place.startswith("artifacts/") or ".." in place.split("/"):
                raise ValueError(f"a leaf outside its result: {place}")
            folder = f"{path}/{place}"
            return codec_named(v["|leaf"], codecs).load(spark, _meta_back(v["meta"], folder), folder)
        if "|ref" in v:
            return Ref(load=lambda: back(v["|ref"]))
        if "|path" in v:
            return Path(v["|path"])
        for kind in (tuple, set, frozenset):
            if f"|{kind.__name__}" in v:
                return kind(back(x) for x in v[f"|{kind.__name__}"])
        if "|class" in v:
            cls, given = resolve(v["|class"]), v["|fields"]
            names = {f.name for f in dataclasses.fields(cls)}
            if names != given.keys():
                raise ValueError(f"{v['|class']} has the fields {sorted(names)}, the result {sorted(given)}")
            return cls(**{k: back(x) for k, x in given.items()})
        return {k: back(x) for k, x in v.items()}

    return back(found["value"])


def delete(spark: SparkSession, path: str) -> bool:
    """Take a result away: it is renamed first, so that no reader sees a part of it."""
    fs, target = file_system(spark, path)
    gone = file_system(spark, f"{path}.gone-{uuid.uuid4().hex}")[1]
    return bool(fs.exists(target) and fs.rename(target, gone) and fs.delete(gone, True))
