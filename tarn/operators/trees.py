"""Records of any shape: VARIANT columns level by level to rows of paths, their differences and what they refer to.

A record is JSON text or a VARIANT. Objects, arrays and values become nodes with
a path (``turns/0/role``); each level is one lateral join with
``variant_explode``, so there are as many rounds as records are deep, however
wide they are. An object ``{"|class": name, "|fields": {...}}`` is a record of
that class (so parameters of steps are encoded): its fields have its path, and
it owns what is below it up to the next record. ``|tuple`` and ``|set`` add
nothing to a path.

Defined results: a null record, or text that is no JSON, has no nodes; a JSON
null is a value; empty containers are nodes; a key with "/" is written as it is;
records with one key are told apart by the caller's ``keys`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources.shared import written

#: Wrappers of containers in encoded parameters (fixed values).
WRAPPERS = ("|tuple", "|set", "|frozenset")


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _unwrapped(v: Column) -> Column:
    return F.coalesce(*(_part(v, w) for w in WRAPPERS), v)


def nodes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, kind, value, owner, owner_path): every node of every record.

    kind: object, array, record or value; value: JSON, of a record its class;
    owner and owner_path: class and path of the record around it.
    """
    own = F.col(column) if isinstance(df.schema[column].dataType, T.VariantType) else F.try_parse_json(F.col(column))
    text = lambda s: F.lit(s).cast("string")
    level = df.select(*keys, F.lit("").alias("path"), own.alias("v"), text(None).alias("owner"), text(None).alias("owner_path")).where("v is not null")
    levels = []
    while True:
        shape = F.schema_of_variant("v")
        name = F.try_variant_get("v", "$['|class']", "string")
        kind = F.when(F.col("class").isNotNull(), "record").when(F.col("shape").startswith("OBJECT"), "object").when(F.col("shape").startswith("ARRAY"), "array").otherwise("value")
        level = level.withColumn("v", _unwrapped(F.col("v"))).withColumns({"shape": shape, "class": name}).withColumn("kind", kind)
        level = written(level.drop("shape"), "level")
        levels.append(level.select(*keys, "path", "kind", F.coalesce("class", F.to_json("v")).alias("value"), "owner", "owner_path"))
        inner = level.where("kind <> 'value'").withColumn("v", F.when(F.col("kind") == "record", _part(F.col("v"), "|fields")).otherwise(F.col("v")))
        inner = inner.withColumns({"owner": F.coalesce("class", "owner"), "owner_path": F.when(F.col("kind") == "record", F.col("path")).otherwise(F.col("owner_path"))})
        if inner.isEmpty():
            break
        below = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "below"))
        step = F.coalesce("key", F.col("pos").cast("string"))
        level = below.select(*keys, F.when(F.col("path") == "", step).otherwise(F.concat_ws("/", "path", step)).alias("path"), F.col("below").alias("v"), "owner", "owner_path")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def references(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, class, owner, owner_path) of the records within records."""
    found = nodes(df, keys, column).where("kind = 'record' and owner is not null")
    return found.select(*keys, "path", F.col("value").alias("class"), "owner", "owner_path")


def differences(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, change, old, new): what records of equal keys differ in, at the topmost place.

    ``+`` is only in the new record, ``-`` only in the old one, ``~`` another
    value, kind or class; what lies below such a place is not listed.
    """
    names = [f"key{i}" for i in range(len(keys))]
    sides = []
    for side, df in (("old", old), ("new", new)):
        found = nodes(df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), column), names, column)
        # Containers are equal if what is in them is; empty ones have nothing in them.
        value = F.when(F.col("kind").isin("object", "array") & ~F.col("value").isin("{}", "[]"), F.col("kind")).otherwise(F.col("value"))
        sides.append(found.select(*(F.col(n).alias(f"{side}_{n}") for n in names), F.col("path").alias(f"{side}_path"), F.struct("kind", value.alias("value")).alias(f"{side}_as"), F.col("value").alias(side)))
    same = F.col("old_path") == F.col("new_path")
    for n in names:
        same = same & F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}"))
    sign = F.when(F.col("old_as").isNull(), "+").when(F.col("new_as").isNull(), "-").otherwise("~")
    both = sides[0].join(sides[1], same, "full").where(~F.col("old_as").eqNullSafe(F.col("new_as")))
    side = lambda n: F.when(F.col("old_as").isNull(), F.col(f"new_{n}")).otherwise(F.col(f"old_{n}"))
    changed = written(both.select(*(side(n).alias(n) for n in names), side("path").alias("path"), sign.alias("change"), "old", "new"), "changed")
    # Places above a path: all its beginnings, the root (an empty path) among them.
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = changed.where("path <> ''").select("*", F.explode(above).alias("upper"))
    tops = changed.select(*(F.col(n).alias(f"top_{n}") for n in names), F.col("path").alias("upper_path"))
    same = F.col("upper") == F.col("upper_path")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"top_{n}"))
    hidden = below.join(tops, same, "left_semi").select(*(F.col(n).alias(f"h_{n}") for n in names), F.col("path").alias("h_path")).distinct()
    same = F.col("path") == F.col("h_path")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"h_{n}"))
    return changed.join(hidden, same, "left_anti").select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "path", "change", "old", "new")
