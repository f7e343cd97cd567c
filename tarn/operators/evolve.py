"""Schema evolution: migration steps on tables of parameters, and matching old results."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Renamed:
    field: str
    to: str
    breaking: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.field not in df.columns or self.to in df.columns:
            raise ValueError(f"can't rename {self.field} to {self.to}: fields are {df.columns}")
        return df.withColumnRenamed(self.field, self.to)


@dataclass(frozen=True)
class Added:
    field: str
    default: object = None
    breaking: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.field in df.columns:
            raise ValueError(f"{self.field} is there already")
        return df.withColumn(self.field, F.lit(self.default))


@dataclass(frozen=True)
class Retyped:
    """Values stay as they are; ``to`` is the new storage type, ``was`` the type as it was declared before."""

    field: str
    to: str
    breaking: bool = False
    was: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.field not in df.columns:
            raise ValueError(f"no field {self.field}: fields are {df.columns}")
        return df.withColumn(self.field, F.col(self.field).cast(self.to))


@dataclass(frozen=True)
class Moved:
    """The class that the rows belong to has a new name; ``was`` is the old one, in ``was_module`` if not in the same module."""

    name: str
    breaking: bool = False
    was: str | None = None
    was_module: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn("class_name", F.lit(self.name))


@dataclass(frozen=True)
class Rewritten:
    """New values for some fields; the set of fields must not change.

    ``values`` gives columns by field, from nothing or, as it must within
    records (see ``Cascade``), from the fields as columns by name. ``data`` is
    the same for a record's fields as data, for steps and records within the
    parameters of a step.
    """

    values: Callable[..., dict[str, Column]] | None = None
    breaking: bool = False
    data: Callable[[dict], dict] | None = None

    def new(self, fields: dict[str, Column]) -> dict[str, Column]:
        if self.values is None:
            raise ValueError("this change is for parameters as data, not for tables")
        found = self.values(fields) if inspect.signature(self.values).parameters else self.values()
        if unknown := set(found) - set(fields):
            raise ValueError(f"no fields {sorted(unknown)}: fields are {list(fields)}")
        return found

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.new({c: F.col(f"`{c}`") for c in df.columns}))


@dataclass(frozen=True)
class Nested:
    """A rename within the elements of an array of structs, or within a struct."""

    field: str
    old: str
    new: str
    breaking: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        rename = lambda s: s.withField(self.new, s[self.old]).dropFields(self.old)
        kind = dict(df.dtypes)[self.field]
        return df.withColumn(self.field, F.transform(self.field, rename) if kind.startswith("array") else rename(F.col(self.field)))


def described(change) -> str:
    """A change as it is shown beside a link: what it does, and whether it breaks."""
    if isinstance(change, Renamed):
        body = f"{change.field} becomes {change.to}"
    elif isinstance(change, Added):
        body = f"{change.field} is added as {change.default!r}"
    elif isinstance(change, Retyped):
        body = f"{change.field} was {change.was or 'of another type'} and is {change.to}"
    elif isinstance(change, Moved):
        body = f"{'.'.join(x for x in (change.was_module, change.was) if x) or 'the class'} becomes {change.name}"
    elif isinstance(change, Rewritten):
        made = change.values or change.data
        body = f"new values by {getattr(made, '__qualname__', repr(made))}"
    elif isinstance(change, Nested):
        body = f"{change.old} becomes {change.new} within {change.field}"
    else:
        body = repr(change)
    return f"{body} (breaking)" if change.breaking else body


def of_class(name: str) -> dict[str, str]:
    """Metadata of a column or field: the structs in it, or in its arrays and maps, are records of the class."""
    return {"class": name}


@dataclass(frozen=True)
class Cascade:
    """The changes of the classes of records that a table's columns hold, at any depth.

    ``classes`` has each class's changes, oldest first. Fields say by their
    metadata (``of_class``) what class their structs are, also within arrays,
    maps and arrays of arrays. The table's types are compiled to one expression
    a column, of nested transforms, in which what a record holds is changed
    before the record itself; columns without such a class are not touched.
    Null records stay null.
    """

    classes: dict[str, list]

    @property
    def breaking(self) -> bool:
        return any(c.breaking for changes in self.classes.values() for c in changes)

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            made = self._value(f.dataType, f.metadata.get("class"))
            column = F.col(f"`{f.name}`")
            out.append(column if made is None else made(column).alias(f.name, metadata=f.metadata))
        return df.select(*out)

    def _value(self, kind: T.DataType, name: str | None) -> Callable[[Column], Column] | None:
        """What makes a new value of an old one; None if nothing changes."""
        if isinstance(kind, T.ArrayType):
            inner = self._value(kind.elementType, name)
            return inner and (lambda c: F.transform(c, inner))
        if isinstance(kind, T.MapType):
            inner = self._value(kind.valueType, name)
            return inner and (lambda c: F.transform_values(c, lambda _, v: inner(v)))
        if isinstance(kind, T.StructType):
            return self._record(kind, name)
        if name is not None:
            raise TypeError(f"{name} is the class of {kind.simpleString()}, which is no record")
        return None

    def _record(self, kind: T.StructType, name: str | None) -> Callable[[Column], Column] | None:
        below = {f.name: self._value(f.dataType, f.metadata.get("class")) for f in kind.fields}
        changes = self.classes.get(name, []) if name else []
        if not changes and not any(below.values()):
            return None

        def of(record: Column) -> Column:
            fields = {f: record.getField(f) if make is None else make(record.getField(f)) for f, make in below.items()}
            for c in changes:
                fields = self._changed(fields, c)
            return F.when(record.isNotNull(), F.struct(*(v.alias(f, metadata=meta.get(f, {})) for f, v in fields.items())))

        meta = {f.name: f.metadata for f in kind.fields}
        for c in changes:
            if isinstance(c, Renamed):
                meta[c.to] = meta.pop(c.field, {})
        return of

    @staticmethod
    def _changed(fields: dict[str, Column], change) -> dict[str, Column]:
        if isinstance(change, Renamed):
            if change.field not in fields or change.to in fields:
                raise ValueError(f"can't rename {change.field} to {change.to}: fields are {list(fields)}")
            return {change.to if k == change.field else k: v for k, v in fields.items()}
        if isinstance(change, Added):
            if change.field in fields:
                raise ValueError(f"{change.field} is there already")
            return fields | {change.field: F.lit(change.default)}
        if isinstance(change, Retyped):
            if change.field not in fields:
                raise ValueError(f"no field {change.field}: fields are {list(fields)}")
            return fields | {change.field: fields[change.field].cast(change.to)}
        if isinstance(change, Rewritten):
            return fields | change.new(fields)
        if isinstance(change, Moved):
            return fields
        raise TypeError(f"not a change of a record: {change!r}")


def migrate(df: DataFrame, steps: list) -> DataFrame:
    """Rows of an old generation as the newest one has them."""
    for step in steps:
        df = step.apply(df)
    return df


def reusable_from(steps: list) -> int:
    """The oldest generation whose results may be reused: the one after the last breaking step."""
    return max((i + 1 for i, s in enumerate(steps) if s.breaking), default=0)


def classify(stored: DataFrame, generations: DataFrame, current: int, reusable: int) -> DataFrame:
    """``stored`` (schema) with ``state``: current, covered, superseded or orphaned. ``generations`` has schema and generation."""
    known = F.when(F.col("generation") == current, "current").when(F.col("generation") >= reusable, "covered").when(F.col("generation").isNotNull(), "superseded").otherwise("orphaned")
    return stored.join(generations, "schema", "left").withColumn("state", known)


def newest_match(targets: DataFrame, sources: DataFrame, on: list[str], generation: str, name: str) -> DataFrame:
    """For each target the source with equal fields of the newest generation (of those, the least name).

    Taken as an aggregate before the join, so many sources of one key are one row.
    """
    best = sources.groupBy(*on).agg(F.min(F.struct((-F.col(generation)).alias("g"), F.col(name).alias("name"))).alias("_best"))
    return targets.join(best, on).withColumn("source", F.col("_best.name")).withColumn("generation", -F.col("_best.g")).drop("_best")


def final_links(links: DataFrame) -> DataFrame:
    """(current, source): chains of links collapsed to their last source, by doubling.

    After k rounds each link spans 2 ** k old ones, so the longest possible
    chain bounds the rounds; links that still go on are a cycle, an error. Both
    sides are shuffled: a broadcast in each round would pass the links through
    the driver, and they look small to Spark as the files of them do.
    """
    from tarn.sources.shared import discard, written

    now = written(links.select("current", "source"), "links")
    for _ in range(now.count().bit_length() + 1):
        onward = now.select(F.col("current").alias("source"), F.col("source").alias("next"))
        step = now.join(onward.hint("merge"), "source", "left")
        step = written(step.select("current", F.coalesce("next", "source").alias("source"), F.col("next").isNotNull().alias("moved")), "links")
        discard(now)
        now = step.drop("moved")
        now.tarn_path = step.tarn_path
        if step.where("moved").isEmpty():
            return now
    raise ValueError("links form a cycle")


def fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Long form: (key, field, value) with the value as text."""
    values = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(key, F.explode(values).alias("_f")).select(key, "_f.*")


def field_diff(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Fields (on, value) that differ: ``+`` new, ``-`` gone, ``~`` changed."""
    a = old.select(*on, F.col("value").alias("old"), F.lit(True).alias("_a"))
    b = new.select(*on, F.col("value").alias("new"), F.lit(True).alias("_b"))
    sign = F.when(F.col("_a").isNull(), "+").when(F.col("_b").isNull(), "-").otherwise("~")
    return a.join(b, on, "full").where("_a is null or _b is null or not (old <=> new)").withColumn("change", sign).drop("_a", "_b")


def newest_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
