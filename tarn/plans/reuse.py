"""Results of older forms of a step: found through declared migrations, and linked.

A class lists its changes, oldest first, as steps of ``tarn.operators.evolve``:
``Renamed``, ``Added``, ``Retyped`` (with ``was``), ``Moved`` (with ``was``)
and ``Rewritten``. Walking them backward gives the name and the fields of every
older form, and so where its results lie. Parameters of stored results are a
table (one row a result, each field as canonical JSON); migrated, the row that
equals the wanted step's parameters is its result; wanted steps of a class are
searched together, by a join. A link is then published in its place, so that
the search is made once; no data are copied.

Steps and records within the parameters may have migrations of their own
(``Rewritten`` by its ``data``). Records of older results are then brought to the present form from the inside out, and found by the key
that this gives.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.names import describe, full_name, hints, shape
from tarn.operators import evolve
from tarn.plans.parameters import canonical, canonical_json, digest, encode, keyed_fields
from tarn.plans.steps import Step, path_of, schema_key
from tarn.sources import files, results
from tarn.sources.shared import file_system


class Stale(RuntimeError):
    """There are results of forms of the class that no migration explains."""


@dataclass(frozen=True)
class Form:
    """An older form of a class and the changes that lead from it to the present one."""

    name: str
    fields: dict[str, str]
    changes: tuple

    @property
    def place(self) -> str:
        return f"{self.name}/{schema_key(self.fields)}"

    @property
    def reusable(self) -> bool:
        return not any(c.breaking for c in self.changes)


def declared(cls: type) -> dict[str, str]:
    """The keyed fields of a step or a record and their types."""
    of = hints(cls)
    return {f.name: describe(of[f.name], keyed_fields) for f in keyed_fields(cls)}


def forms(cls: type) -> list[Form]:
    """The present form first, then older ones, newest first. Two alike are an error. Names in ``Moved`` are those within the class's module."""
    module, name, fields = cls.__module__, cls.__qualname__, declared(cls)
    changes = getattr(cls, "migrations", ())
    out = [Form(f"{module}.{name}", dict(fields), ())]
    for i in range(len(changes) - 1, -1, -1):
        c = changes[i]
        if isinstance(c, evolve.Renamed):
            if c.to not in fields or c.field in fields:
                raise ValueError(f"can't undo {c}: fields at that point are {sorted(fields)}")
            fields = {c.field if k == c.to else k: v for k, v in fields.items()}
        elif isinstance(c, evolve.Added):
            if c.field not in fields:
                raise ValueError(f"can't undo {c}: fields at that point are {sorted(fields)}")
            fields = {k: v for k, v in fields.items() if k != c.field}
        elif isinstance(c, evolve.Retyped):
            if c.field not in fields or c.was is None or shape(c.was) == shape(fields[c.field]):
                raise ValueError(f"{c} changes no declared type: fields at that point are {fields}")
            fields = fields | {c.field: c.was}
        elif isinstance(c, evolve.Moved):
            if c.name != name or not c.was:
                raise ValueError(f"can't undo {c}: the class is {name} at that point")
            name, module = c.was, c.was_module or module
        elif not isinstance(c, evolve.Rewritten):
            raise TypeError(f"not a migration of a step: {c!r}")
        out.append(Form(f"{module}.{name}", dict(fields), tuple(changes[i:])))
    # A rewrite alone leaves the fields as they are; it belongs to the change it stands beside.
    places: dict[str, Form] = {}
    for f in out:
        rewrites = bool(f.changes) and isinstance(f.changes[0], evolve.Rewritten)
        if f.place in places and not rewrites:
            raise ValueError(f"two forms of {cls.__qualname__} look alike: {f.fields}")
        if rewrites and f.place == out[0].place:
            raise ValueError(f"{f.changes[0]} can't be told from the present form: it needs a change of fields beside it")
        places[f.place] = f
    return list(places.values())


def stored(spark: SparkSession, root: str, place: str) -> DataFrame | None:
    """(path, parameters) of the results of one form, or None if there are none."""
    fs, pattern = file_system(spark, f"{root}/{place}/*/{results.MANIFEST}")
    if not fs.globStatus(pattern):
        return None
    text = spark.read.text(pattern.toString(), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "facts struct<parameters: map<string,string>>, link string").alias("m"))
    return text.where("m.link is null").select(F.regexp_replace("path", f"/{results.MANIFEST}$", "").alias("path"), F.col("m.facts.parameters").alias("parameters"))


def _as_json(change):
    """A change of values as a change of their JSON."""
    if isinstance(change, evolve.Added):
        return evolve.Added(change.field, canonical_json(canonical(change.default)))
    return change


def migrated(rows: DataFrame, form: Form) -> DataFrame:
    """The form's parameters as columns of the present form."""
    df = rows.select("path", *(F.col("parameters").getItem(f).alias(f) for f in form.fields))
    changes = [_as_json(c) for c in form.changes if not isinstance(c, (evolve.Retyped, evolve.Moved))]
    return evolve.migrate(df, changes)


def matching(spark: SparkSession, cls: type[Step], wanted: list[Step], root: str) -> dict[str, tuple[str, list[str]]]:
    """By key of a wanted step of the class: the path of an older form's result with its parameters, and the changes that lead from it. Newest form first, then least path."""
    found: dict[str, tuple[str, list[str]]] = {}
    for form in forms(cls)[1:]:
        left = [s for s in wanted if s.key() not in found]
        rows = stored(spark, root, form.place) if form.reusable and left else None
        if rows is None:
            continue
        names = list(left[0].parameters())
        asked = spark.createDataFrame([(s.key(), *s.parameters().values()) for s in left], ["_key", *(f"_{i}" for i in range(len(names)))])
        fits = F.lit(True)
        same = migrated(rows, form)
        for i, name in enumerate(names):
            fits = fits & (same[f"`{name}`"] == asked[f"_{i}"])
        for r in same.join(asked, fits).groupBy("_key").agg(F.min("path").alias("path")).collect():
            found[r._key] = r.path, [evolve.described(c) for c in form.changes]
    return found


# Steps and records within parameters


def within(value: object) -> Iterator[type]:
    """Classes of the steps and records in a value, its own first."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        yield type(value)
        for f in dataclasses.fields(value):
            yield from within(getattr(value, f.name))
    elif isinstance(value, dict):
        for v in value.values():
            yield from within(v)
    elif isinstance(value, (list, tuple, set, frozenset)):
        for v in value:
            yield from within(v)


@dataclass(frozen=True)
class Present:
    """What records need to know of a class: its name, whether it is a step, its schema, keyed and other fields, and its forms with plain changes."""

    name: str
    step: bool
    schema: str
    keyed: tuple[str, ...]
    free: tuple[str, ...]
    forms: tuple[tuple[str, frozenset, tuple | None], ...]


def present(cls: type) -> Present:
    def plain(form: Form) -> tuple | None:
        """Changes as data; None for a form whose results are not reused."""
        if not form.reusable or any(isinstance(c, evolve.Rewritten) and c.data is None for c in form.changes):
            return None
        say = {evolve.Renamed: lambda c: (c.field, c.to), evolve.Added: lambda c: (c.field, None, encode(c.default)), evolve.Rewritten: lambda c: (c.data,)}
        return tuple(say[type(c)](c) for c in form.changes if type(c) in say)

    fields = declared(cls)
    free = tuple(f.name for f in dataclasses.fields(cls) if f.name not in fields)
    return Present(full_name(cls), getattr(cls, "is_step", False), schema_key(fields), tuple(fields), free, tuple((f.name, frozenset(f.fields), plain(f)) for f in forms(cls)))


class Unlike(Exception):
    """A record that can't be brought to the present form; ``known`` if its form is declared, but not reused."""

    def __init__(self, known: bool):
        super().__init__()
        self.known = known


def renewed(data: object, classes: list[Present]) -> object:
    """A record's data in the present form, from the inside out."""
    if isinstance(data, list):
        return [renewed(v, classes) for v in data]
    if not isinstance(data, dict):
        return data
    if "|class" not in data:
        return {k: renewed(v, classes) for k, v in data.items()}
    fields = {k: renewed(v, classes) for k, v in data["|fields"].items()}
    named = False
    for c in classes:
        for name, has, changes in c.forms:
            if name != data["|class"]:
                continue
            named = True
            if not has <= fields.keys() or fields.keys() - has - set(c.free):
                continue
            if changes is None:
                raise Unlike(True)
            for change in changes:
                if len(change) == 1:
                    new = change[0](dict(fields))
                    if new.keys() - fields.keys():
                        raise ValueError(f"a rewrite of {c.name} gives fields that it has not: {sorted(new.keys() - fields.keys())}")
                    fields |= new
                elif len(change) == 2:
                    fields[change[1]] = fields.pop(change[0])
                else:
                    fields[change[0]] = change[2]
            return {"|class": c.name, "|fields": fields}
    if named:
        raise Unlike(False)
    return {"|class": data["|class"], "|fields": fields}


def key_of(data: object, classes: dict[str, Present]) -> object:
    """A record's data as ``canonical`` gives them; of a step, {"|step": key}."""
    if isinstance(data, list):
        return [key_of(v, classes) for v in data]
    if not isinstance(data, dict):
        return data
    if "|frozenset" in data or "|set" in data:
        return {"|set": sorted((key_of(v, classes) for v in data.get("|set", data.get("|frozenset"))), key=canonical_json)}
    if "|class" not in data:
        return {k: key_of(v, classes) for k, v in data.items()}
    if data["|class"] not in classes:
        raise Unlike(True)
    c = classes[data["|class"]]
    values = {k: key_of(data["|fields"][k], classes) for k in c.keyed}
    return {"|step": f"{c.name}:{c.schema}:{digest(values)}"} if c.step else {"|class": c.name, "|fields": values}


def records(spark: SparkSession, cls: type[Step], wanted: list[Step], root: str) -> DataFrame | None:
    """(path, place, key, known) of all results under the class's names: the key that a record has in the present form, if it has one."""
    patterns = []
    for name in {f.name for f in forms(cls)}:
        fs, pattern = file_system(spark, f"{root}/{name}/*/*/{results.MANIFEST}")
        if fs.globStatus(pattern):
            patterns.append(pattern.toString())
    if not patterns:
        return None
    classes = [present(c) for c in dict.fromkeys(c for s in wanted for c in within(s))]
    by_name = {c.name: c for c in classes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, known = [], []
            for text in b.column("step").to_pylist():
                try:
                    keys.append(key_of(renewed(json.loads(text), classes), by_name)["|step"])
                    known.append(True)
                except Unlike as e:
                    keys.append(None)
                    known.append(e.known)
            path = b.column("path").to_pylist()
            place = ["/".join(p.split("/")[-4:-2]) for p in path]
            yield pa.RecordBatch.from_arrays([pa.array([p.rpartition("/")[0] for p in path], pa.string()), pa.array(place, pa.string()), pa.array(keys, pa.string()), pa.array(known, pa.bool_())], names=["path", "place", "key", "known"])

    text = spark.read.text(patterns, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.get_json_object("value", "$.facts.step").alias("step"))
    return text.where("step is not null").mapInArrow(run, "path string, place string, key string, known boolean")


def matching_within(spark: SparkSession, cls: type[Step], wanted: list[Step], root: str) -> tuple[dict[str, tuple[str, list[str]]], set[str]]:
    """The same where what is within the parameters has changed; and the stored forms that this explains."""
    rows = records(spark, cls, wanted, root)
    if rows is None:
        return {}, set()
    asked = spark.createDataFrame([(s.key(),) for s in wanted], "key string")
    found = rows.join(asked, "key").groupBy("key").agg(F.min("path").alias("path")).collect()
    classes = {full_name(c): c for s in wanted for c in within(s) if getattr(c, "migrations", ())}
    changed = [f"{c.__qualname__}: {'; '.join(map(evolve.described, c.migrations))}" for _, c in sorted(classes.items())]
    explained = {r.place for r in rows.where("known").select("place").distinct().collect()}
    return {r.key: (r.path, changed) for r in found}, explained


def changes(old: dict[str, str], new: dict[str, str]) -> list[str]:
    """Fields and types that differ, a line each: ``+`` only new, ``-`` only old, ``~`` of another type."""
    lines = []
    for name in sorted(old.keys() | new.keys()):
        if name not in old:
            lines.append(f"+ {name}: {new[name]}")
        elif name not in new:
            lines.append(f"- {name}: {old[name]}")
        elif shape(old[name]) != shape(new[name]):
            lines.append(f"~ {name}: {old[name]} -> {new[name]}")
    return lines


def report(spark: SparkSession, cls: type[Step], root: str, places: list[str]) -> str:
    """What stored forms that no migration explains have otherwise than the class, whose results they are, and since when."""
    lines = [f"{cls.__qualname__} has results of other forms. Declare migrations, breaking ones to compute anew."]
    for place in places:
        text = spark.read.text(f"{root}/{place}/*/{results.MANIFEST}", wholetext=True)
        facts = F.from_json("value", "facts struct<schema: map<string,string>, submitted: struct<user: string>, began: string>").alias("m")
        one = text.select(facts).agg(F.count("*").alias("n"), F.min_by("m.facts", "m.facts.began").alias("first")).first()
        first = one.first
        lines.append(f"{place}: {one.n} results, the first of {first.began} by {first.submitted.user if first.submitted else 'unknown'}")
        lines += [f"  {line}" for line in changes(first.schema or {}, declared(cls))] or ["  the same fields under another name"]
    return "\n".join(lines)


def audit(spark: SparkSession, root: str, classes: list[type[Step]]) -> DataFrame:
    """(name, schema, results, links, state) for every form with anything published below ``root``, by one job.

    state: current, covered (a migration leads to the present form), superseded
    (a breaking one does), orphaned (of one of ``classes``, and no migration
    explains it) or unknown (of no class given).
    """
    known = {f.place: "current" if not f.changes else "covered" if f.reusable else "superseded" for c in classes for f in forms(c)}
    names = {f.name for c in classes for f in forms(c)}
    places = spark.createDataFrame([(*p.rsplit("/", 1), s) for p, s in known.items()], "name string, schema string, state string")
    owned = spark.createDataFrame([(n, True) for n in sorted(names)], "name string, owned boolean")
    text = spark.read.text(f"{root}/*/*/*/{results.MANIFEST}", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.get_json_object("value", "$.link").alias("link"))
    parts = F.split("path", "/")
    at = lambda i: F.element_at(parts, i)
    stored = text.groupBy(at(-4).alias("name"), at(-3).alias("schema")).agg(F.count_if(F.col("link").isNull()).alias("results"), F.count("link").alias("links"))
    rest = F.when(F.col("owned"), "orphaned").otherwise("unknown")
    return stored.join(places, ["name", "schema"], "left").join(owned, "name", "left").select("name", "schema", "results", "links", F.coalesce("state", rest).alias("state"))


def orphans(spark: SparkSession, cls: type[Step], root: str) -> list[str]:
    """Stored forms under the class's names that are neither present nor explained."""
    known = {f.place for f in forms(cls)}
    out = []
    for name in {f.name for f in forms(cls)}:
        fs, folder = file_system(spark, f"{root}/{name}")
        if fs.exists(folder):
            for found in fs.listStatus(folder):
                place = f"{name}/{found.getPath().getName()}"
                _, inside = file_system(spark, f"{root}/{place}/*/{results.MANIFEST}")
                if place not in known and fs.globStatus(inside):
                    out.append(place)
    return sorted(out)


#: So many manifests are read by the driver; more, by a job.
FEW = 32


def manifests(spark: SparkSession, paths: list[str]) -> dict[str, dict | None]:
    """What the manifests at ``paths`` say of links: None where there is none, ``link`` of a link, and whether its target is ``there``.

    Many are read by tasks, each by its path: no folder is listed, and the
    driver gets a few words of each.
    """
    if len(paths) <= FEW or not files.known(paths[0]):
        found = {p: results.read_manifest(spark, p) for p in paths}
        return {p: None if m is None else {"link": m["link"], "there": results.read_manifest(spark, m["link"]) is not None} if "link" in m else {} for p, m in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links, there = [], []
            for path in b.column("path").to_pylist():
                try:
                    with files.reader(f"{path}/{results.MANIFEST}") as f:
                        link = json.loads(f.read()).get("link")
                except FileNotFoundError:
                    links.append(None)
                    there.append(None)
                else:
                    links.append(link)
                    there.append(link is None or files.exists(f"{link}/{results.MANIFEST}"))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(links, pa.string()), pa.array(there, pa.bool_())], names=["path", "link", "there"])

    asked = spark.createDataFrame(pd.DataFrame({"path": paths}))
    found = asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, link string, there boolean").toArrow()
    return {p: None if t is None else {} if link is None else {"link": link, "there": t} for p, link, t in zip(*(found.column(i).to_pylist() for i in range(3)))}


def find(spark: SparkSession, step: Step, root: str) -> str | None:
    """Where the step's result lies: its own place, a linked one, or one found through migrations, which is then linked."""
    return find_all(spark, [step], root)[step.key()]


def find_all(spark: SparkSession, wanted: list[Step], root: str) -> dict[str, str | None]:
    """The same for many steps, by key; what has no result of its own is searched once for each class."""
    out: dict[str, str | None] = {}
    lost: dict[tuple[type[Step], str], list[Step]] = {}
    unique = {s.key(): s for s in wanted}
    read = manifests(spark, [path_of(root, s) for s in unique.values()])
    for s in unique.values():
        own = path_of(root, s)
        manifest = read[own]
        out[s.key()] = None
        if manifest is not None and "link" not in manifest:
            out[s.key()] = own
        elif manifest is not None and manifest["there"]:
            out[s.key()] = manifest["link"]
        else:
            if manifest is not None:
                results.delete(spark, own)  # what it pointed to is gone
            lost.setdefault((type(s), s.root(root)), []).append(s)
    for (cls, at), members in lost.items():
        got, explained = matching(spark, cls, members, at), set()
        left = [s for s in members if s.key() not in got]
        if any(getattr(c, "migrations", ()) for s in left for f in dataclasses.fields(s) for c in within(getattr(s, f.name))):
            more, explained = matching_within(spark, cls, left, at)
            got |= more
        for s in members:
            if s.key() in got:
                results.publish_link(spark, path_of(root, s), *got[s.key()])
                out[s.key()] = got[s.key()][0]
        if any(s.key() not in got for s in members):
            if stale := [p for p in orphans(spark, cls, at) if p not in explained]:
                raise Stale(report(spark, cls, at, stale))
    return out


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row for each published result or link below ``root``."""
    facts = "name string, key string, step string, schema map<string,string>, parameters map<string,string>, inputs array<string>, read array<string>, began string"
    text = spark.read.text(f"{root}/*/*/*/{results.MANIFEST}", wholetext=True)
    m = F.from_json("value", f"facts struct<{facts}>, link string, changes array<string>").alias("m")
    return text.select(F.col("_metadata.file_path").alias("path"), m).select("path", "m.facts.*", "m.link", "m.changes")
