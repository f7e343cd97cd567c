"""Records of any shape, and changes of the classes in them at any depth."""

import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import evolve, trees


def table(spark, records):
    return spark.createDataFrame([(i, None if r is None else r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "id int, tree string")


def slow(v, path="", owner=None, at=None):
    """(path, kind, value, owner, owner_path) of a tree."""
    while isinstance(v, dict) and (w := next((w for w in trees.WRAPPERS if w in v), None)):
        v = v[w]
    if isinstance(v, dict) and "|class" in v:
        yield path, "record", v["|class"], owner, at
        owner, at, v = v["|class"], path, v["|fields"]
    else:
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "value"
        yield path, kind, json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True), owner, at
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from slow(x, f"{path}/{k}" if path else str(k), owner, at)


STEP = {"|class": "Train", "|fields": {"data": {"|class": "Data", "|fields": {"path": "x", "parts": {"|tuple": [{"|class": "Part", "|fields": {"n": 1}}, {"k": {"|class": "Part", "|fields": {"n": None}}}]}}}, "lr": 0.5, "tags": {"|set": []}}}
RECORDS = [{}, [], 1, "s", None, "not json {", "null", {"a": {"b": [1, [2, {"c": None}], {}], "é": "x y"}, "z": True}, STEP, [[[[[[1]]]]]], {"a": [STEP, STEP]}]


def test_nodes(spark):
    df = table(spark, RECORDS)
    want = sorted((i, *n) for i, r in enumerate(RECORDS) for n in ([] if r is None or r == "not json {" or r == "s" else slow(None if r == "null" else r)))
    for column in ("tree", "v"):
        got = trees.nodes(df.withColumn("v", F.try_parse_json("tree")), ["id"], column)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert trees.nodes(df.where("false"), ["id"], "tree").count() == 0


def test_references(spark):
    got = trees.references(table(spark, [STEP]), ["id"], "tree")
    assert sorted(map(tuple, got.collect())) == [(0, "data", "Data", "Train", ""), (0, "data/parts/0", "Part", "Data", "data"), (0, "data/parts/1/k", "Part", "Data", "data")]


def changed(a, b):
    return json.loads(json.dumps(a).replace(*b))


def test_differences(spark):
    pairs = [
        (STEP, STEP, []), (STEP, changed(STEP, ("0.5", "0.25")), [("lr", "~", "0.5", "0.25")]),
        (STEP, changed(STEP, ('"Data"', '"Other"')), [("data", "~", "Data", "Other")]),
        ({"a": 1, "b": {"c": 2}}, {"a": 1}, [("b", "-", '{"c":2}', None)]), ({"a": []}, {"a": [1, {"x": 2}]}, [("a", "~", "[]", '[1,{"x":2}]')]),
        ({"a": [1, 2]}, {"a": [1, 3, 4]}, [("a/1", "~", "2", "3"), ("a/2", "+", None, "4")]), ({"a": {"b": 1}}, {"a": [1]}, [("a", "~", '{"b":1}', "[1]")]),
        ({"a": None}, {}, [("", "~", '{"a":null}', "{}")]), ({"a": None, "k": 1}, {"k": 1}, [("a", "-", "null", None)]), (1, {"a": 1}, [("", "~", "1", '{"a":1}')]),
        ({"x": {"y": {"z": {"w": [0, {"v": 1}]}}}}, {"x": {"y": {"z": {"w": [0, {"v": 2}]}}}}, [("x/y/z/w/1/v", "~", "1", "2")]),
    ]
    a, b = (table(spark, [p[i] for p in pairs]) for i in (0, 1))
    got = {}
    for r in trees.differences(a, b, ["id"], "tree").collect():
        got.setdefault(r.id, []).append((r.path, r.change, r.old, r.new))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(p[2]) for i, p in enumerate(pairs) if p[2]}
    only = trees.differences(a.where("id = 4"), b.where("id = 3"), ["id"], "tree")
    assert sorted((r.id, r.path, r.change) for r in only.collect()) == [(3, "", "+"), (4, "", "-")]


TOKENIZER = [evolve.Renamed("vocabulary_size", "vocab_size"), evolve.Added("lower", True)]
MODEL = [evolve.Rewritten(lambda f: {"layers": f["layers"] + f["tokenizer"]["vocab_size"]})]


def test_cascade_at_any_depth(spark):
    """A child's changes go before its parent's, in arrays of arrays, maps and structs; nulls stay."""
    tok = "struct<vocabulary_size: int>"
    ddl = f"id int, model struct<tokenizer: {tok}, layers: int>, all array<array<struct<name: string, by: map<string, struct<tokenizer: {tok}, layers: int>>>>>"
    t = lambda n: None if n is None else (n,)
    rows = [
        (1, (t(10), 2), [[("a", {"x": (t(1), 1), "y": (t(2), 2), "n": None})], [], None]),
        (2, None, None), (3, (t(5), None), [[None, ("b", None)]]),
    ]
    df = spark.createDataFrame(rows, ddl)
    from pyspark.sql import types as T

    def tag(kind, under=None):
        if isinstance(kind, T.StructType):
            names = {"tokenizer": "Tokenizer", "model": "Model", "by": "Model"}
            return T.StructType([T.StructField(f.name, tag(f.dataType), f.nullable, evolve.of_class(names[f.name]) if f.name in names else {}) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(tag(kind.elementType))
        return T.MapType(kind.keyType, tag(kind.valueType)) if isinstance(kind, T.MapType) else kind

    out = evolve.Cascade({"Tokenizer": TOKENIZER, "Model": MODEL}).apply(spark.createDataFrame(df.rdd, tag(df.schema)))
    got = {r.id: r.asDict(recursive=True) for r in out.collect()}
    new = lambda n, layers: {"tokenizer": {"vocab_size": n, "lower": True}, "layers": layers}
    assert got[1] == {"id": 1, "model": new(10, 12), "all": [[{"name": "a", "by": {"x": new(1, 2), "y": new(2, 4), "n": None}}], [], None]}
    assert got[2] == {"id": 2, "model": None, "all": None} and got[3] == {"id": 3, "model": new(5, None), "all": [[None, {"name": "b", "by": None}]]}
    # What is new is found again by what it is: types keep their classes.
    again = evolve.Cascade({"Tokenizer": [evolve.Renamed("vocab_size", "size")]}).apply(out)
    assert again.select("model.tokenizer.size", F.col("all")[0][0]["by"]["x"]["tokenizer"]["size"]).first() == (10, 1)


def test_wrong_cascades(spark):
    df = spark.range(1).select(F.struct("id").alias("r", metadata=evolve.of_class("R")), F.col("id").alias("x"))
    for change in (evolve.Renamed("no", "new"), evolve.Added("id", 1), evolve.Retyped("no", "int"), evolve.Rewritten(lambda f: {"no": F.lit(1)}), evolve.Rewritten(data=dict)):
        with pytest.raises(ValueError):
            evolve.Cascade({"R": [change]}).apply(df)
    with pytest.raises(TypeError):
        evolve.Cascade({"R": [object()]}).apply(df)
    with pytest.raises(TypeError):
        evolve.Cascade({"X": []}).apply(df.withColumn("x", F.col("x").alias("x", metadata=evolve.of_class("X"))))
    assert evolve.Cascade({"Q": TOKENIZER}).apply(df).collect() == df.collect() and not evolve.Cascade({"Q": TOKENIZER}).breaking
