"""Arrays as shards and results as a data source."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.plans import steps
from tarn.sources import arrays, datasource, results


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "float", "double", "boolean"])
def test_array_round_trip(spark, tmp_path, kind):
    df = spark.range(1000).select(F.col("id").alias("i"), F.array(*((F.col("id") * k % 100).cast(kind) for k in (1, 7, 13))).alias("v")).repartition(5)
    arrays.save(df, f"{tmp_path}/a", "i", "v", most=500)
    shards = [np.load(p) for p in Path(tmp_path, "a").glob("*.npy")]
    assert len(shards) >= 6 and sum(map(len, shards)) == 1000 and all(s.nbytes <= 500 and s.shape[1:] == (3,) for s in shards)
    back = arrays.load(spark, f"{tmp_path}/a", split=200)
    assert back.schema["value"].dataType.elementType.simpleString() == kind and back.rdd.getNumPartitions() >= 15
    assert sorted(map(tuple, back.collect())) == sorted((r.i, r.v) for r in df.collect())


def test_scalars_shapes_and_empty_arrays(spark, tmp_path):
    arrays.save(spark.range(10).select("id", (F.col("id") / 4).alias("x")), f"{tmp_path}/s", "id", "x")
    assert [tuple(r) for r in arrays.load(spark, f"{tmp_path}/s").orderBy("index").collect()] == [(i, i / 4) for i in range(10)]
    cube = np.arange(24, dtype="<i4").reshape(4, 2, 3)
    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(cube)], "index long, value array<int>")
    arrays.save(df, f"{tmp_path}/c", shape=(2, 3))
    assert (np.concatenate([np.load(p) for p in sorted(Path(tmp_path, "c").glob("*.npy"))]).sum() == cube.sum()) and json.loads(Path(tmp_path, "c/array.json").read_text())["shape"] == [4, 2, 3]
    arrays.save(df.where("false"), f"{tmp_path}/e")
    assert arrays.load(spark, f"{tmp_path}/e").collect() == []


@pytest.mark.parametrize("dtype", ["|u1", "<u2", "<u4", "<f2", ">f8", ">i4", "|b1", "<f4"])
def test_one_npy_file(spark, tmp_path, dtype):
    made = (np.arange(600).reshape(100, 6) % 97).astype(dtype)
    np.save(tmp_path / "x.npy", made)
    back = arrays.load_npy(spark, f"{tmp_path}/x.npy", split=64)
    assert back.rdd.getNumPartitions() > 5
    assert [r.value for r in back.orderBy("index").collect()] == made.tolist()


def test_a_task_reads_its_rows_only(spark, tmp_path):
    """A file of 8 GB with holes, whose rows are counted and checked at three places."""
    rows = (8 << 30) // 4096
    with open(tmp_path / "big.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (rows, 512)})
        start = f.tell()
        f.truncate(start + rows * 4096)
        f.seek(start + (rows - 1) * 4096)
        f.write(np.arange(512.0).tobytes())
    back = arrays.load_npy(spark, f"{tmp_path}/big.npy")
    assert back.rdd.getNumPartitions() == 512
    plan = back.where("false")
    assert plan.count() == 0
    with open(tmp_path / "big.npy", "rb") as f:
        assert arrays.header(f)[1] == (rows, 512)


def test_what_is_refused(spark, tmp_path):
    for bad in (np.array(["a", 1], object), np.array(["a"]), np.zeros(2, [("a", "<i4")]), np.zeros(2, "<c8"), np.zeros(2, "<u8")):
        np.save(tmp_path / "bad.npy", bad, allow_pickle=True)
        with pytest.raises(TypeError):
            arrays.load_npy(spark, f"{tmp_path}/bad.npy")
    np.save(tmp_path / "f.npy", np.asfortranarray(np.zeros((2, 3))))
    with pytest.raises(ValueError, match="Fortran"):
        arrays.load_npy(spark, f"{tmp_path}/f.npy")
    of = lambda rows: spark.createDataFrame(rows, "index long, value array<double>")
    for rows in ([(0, [1.0]), (2, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0]), (1, None)], [(0, [None])], [(1, [1.0])]):
        with pytest.raises(Exception, match="gaps|missing|numbers"):
            arrays.save(of(rows), f"{tmp_path}/bad")
        assert not Path(tmp_path, "bad").exists()
    with pytest.raises(TypeError):
        arrays.save(spark.range(2).select("id", F.lit("x").alias("v")), f"{tmp_path}/bad", "id", "v")


def test_array_in_a_result(spark, tmp_path):
    df = spark.range(50).select("id", F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v"))
    results.publish(spark, {"rows": arrays.Rows(df, "id", "v"), "n": 50}, f"{tmp_path}/r")
    back = results.load(spark, f"{tmp_path}/r")
    assert back["n"] == 50 and sorted(map(tuple, back["rows"].frame.collect())) == sorted(map(tuple, df.collect()))


class Metric(steps.Step):
    at: int

    def build(self, spark, inputs):
        return {"loss": self.at / 2, "tags": ["a", None], "table": spark.range(self.at)}


class Other(steps.Step):
    at: int

    def build(self, spark, inputs):
        return self.at


@pytest.fixture
def store(spark, tmp_path):
    datasource.register(spark)
    made = [Metric(at=i) for i in range(5)] + [Other(at=7)]
    for s in made:
        steps.build(spark, [s], str(tmp_path), [steps.Inputs(s, {}, None)])
    return made


def test_read_results(spark, tmp_path, store):
    df = spark.read.format("tarn").load(str(tmp_path))
    metric = df.where(F.col("name").endswith("Metric"))
    assert metric.count() == 5 * 4 and df.count() == 21
    assert sorted(float(r.value) for r in df.where("leaf = 'loss'").collect()) == [0, 0.5, 1, 1.5, 2]
    assert sorted(r.value for r in metric.where("leaf like 'tags/%'").collect()) == ['"a"'] * 5 + ["null"] * 5
    tables = metric.where("codec = 'table'").collect()
    assert {r.artifact for r in tables} == {"artifacts/table"}
    assert sorted(spark.read.parquet(f"{tmp_path}/{r.name}/{r.schema}/{r.key}/{r.artifact}").count() for r in tables if r.key != store[0].key().split(":")[2]) == [1, 2, 3, 4]


def test_only_the_asked_places_are_read(spark, tmp_path, store):
    name, schema, key = store[3].key().split(":")
    for broken in tmp_path.glob("*/*/*/manifest.json"):
        if key not in str(broken):
            broken.write_text("no JSON")
    df = spark.read.format("tarn").option("places", 1).load(str(tmp_path))
    with pytest.raises(Exception, match="JSON"):
        df.collect()
    one = df.where((F.col("key") == key) & (F.col("name") == name) & F.col("leaf").isin("loss", "tags/0"))
    assert sorted((r.leaf, r.value) for r in one.collect()) == [("loss", "1.5"), ("tags/0", '"a"')] and one.rdd.getNumPartitions() == 1
    some = df.where(F.col("name") == name).select("key").distinct()
    assert df.where(F.col("name") == name).rdd.getNumPartitions() == 5
    with pytest.raises(Exception, match="JSON"):
        some.collect()
    for odd in ("", "..", "a/b", "nobody"):
        assert df.where(F.col("name") == odd).count() == 0


def test_write_results(spark, tmp_path, store):
    root = f"{tmp_path}/w"
    df = spark.range(100).select(F.lit("app.Made").alias("name"), F.lit("s1").alias("schema"), F.concat(F.lit("k"), "id").alias("key"), F.to_json(F.struct(F.col("id").alias("n"))).alias("value")).repartition(4)
    df.write.format("tarn").mode("append").save(root)
    back = spark.read.format("tarn").load(root)
    assert sorted(int(r.value) for r in back.where("leaf = 'n'").collect()) == list(range(100))
    assert results.load(spark, f"{root}/app.Made/s1/k7") == {"n": 7}
    # A place that is taken stays.
    df.withColumn("value", F.lit("1")).limit(3).write.format("tarn").mode("append").save(root)
    assert sorted(int(r.value) for r in back.where("leaf = 'n'").collect()) == list(range(100))


def test_a_failed_write_leaves_nothing(spark, tmp_path, store):
    root = f"{tmp_path}/w"
    df = spark.range(40).select(F.lit("n").alias("name"), F.lit("s").alias("schema"), F.col("id").cast("string").alias("key"), F.when(F.col("id") == 39, F.lit("{")).otherwise(F.lit("1")).alias("value")).repartition(4)
    with pytest.raises(Exception, match="Expecting|JSON"):
        df.write.format("tarn").mode("append").save(root)
    # A task that still runs may write on, to a folder that no reader looks into.
    assert spark.read.format("tarn").load(root).count() == 0 and all(".tmp-" in p.name for p in Path(root).glob("*"))
    for columns in (["name", "schema", "key"], ["name", "schema", "value"]):
        with pytest.raises(Exception, match="no columns"):
            df.select(*columns).write.format("tarn").mode("append").save(root)
    with pytest.raises(Exception, match="no place"):
        df.limit(1).withColumn("key", F.lit("../x")).write.format("tarn").mode("append").save(root)
