"""Load or create by row: what is computed, committed and seen."""

from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tarn.sources import rows

SCHEMA = "user string, day int, score double"


def store(spark, tmp_path, buckets=8):
    return rows.create(spark, f"{tmp_path}/store", SCHEMA, ["user", "day"], buckets)


def requests(spark, pairs):
    return spark.createDataFrame(pairs, "user string, day int")


def scored(t: pa.Table) -> pa.Table:
    return t.select(["user", "day"]).append_column("score", pc.cast(pc.add(pc.fill_null(t["day"], 0), 0.5), pa.float64()))


def counting(folder: Path):
    """``scored`` that leaves a file for each call, with the calls' sizes."""

    def compute(t):
        import uuid

        (folder / uuid.uuid4().hex).write_text(str(t.num_rows))
        return scored(t)

    return compute, lambda: sorted(int(p.read_text()) for p in folder.iterdir())


def pairs_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_row_once(spark, tmp_path):
    s = store(spark, tmp_path)
    (calls := tmp_path / "calls").mkdir()
    compute, sizes = counting(calls)
    build = rows.batched(compute, SCHEMA)
    first = [("a", 1), ("b", None), (None, None), ("a", 1), ("", 2)]
    got = s.load_or_create(requests(spark, first), build)
    assert pairs_of(got) == sorted([(u, d, (d or 0) + 0.5) for u, d in first], key=str) and s.version() == 1
    assert sum(sizes()) == 4
    # Hits alone: nothing is computed or committed.
    assert s.load_or_create(requests(spark, first[:2]), build).count() == 2 and s.version() == 1 and sum(sizes()) == 4
    more = s.load_or_create(requests(spark, [("a", 1), ("c", 3)]), build)
    assert pairs_of(more) == [("a", 1, 1.5), ("c", 3, 3.5)] and s.version() == 2 and sum(sizes()) == 5
    assert s.scan(1).count() == 4 and s.scan().count() == 5 and s.scan(0).count() == 0
    # Another session of the same store; a store of another kind there is refused.
    assert rows.Store(spark, s.path).scan().count() == 5
    with pytest.raises(ValueError, match="another kind"):
        rows.create(spark, s.path, SCHEMA, ["user"], 8)


def test_one_in_a_hundred(spark, tmp_path):
    """Of many requests with 1 % misses 1 % are computed."""
    s = rows.create(spark, f"{tmp_path}/s", "id long, twice long", ["id"], 16)
    double = lambda misses: misses.select("id", (F.col("id") * 2).alias("twice"))
    s.load_or_create(spark.range(0, 198_000), double)
    asked = []

    def build(misses):
        asked.append(misses.count())
        return double(misses)

    got = s.load_or_create(spark.range(0, 200_000), build)
    assert asked == [2000] and got.where("twice = 2 * id").count() == 200_000
    assert sum(r.rows for r in s.files(2, 1).collect()) == 2000


def test_groups_are_capped(spark, tmp_path):
    s = store(spark, tmp_path)
    (calls := tmp_path / "calls").mkdir()
    compute, sizes = counting(calls)
    asked = requests(spark, [("hot", i) for i in range(103)] + [("b", i) for i in range(7)] + [(None, 1)])
    assert s.load_or_create(asked, rows.batched(compute, SCHEMA, ["user"], 10)).count() == 111
    assert sizes() == sorted([10] * 10 + [3, 7, 1])
    for cap in (0, -1, True, 2.0):
        with pytest.raises(ValueError, match="at least one"):
            rows.batched(compute, SCHEMA, ["user"], cap)


def test_a_failed_build_leaves_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    s.load_or_create(requests(spark, [("a", 1)]), rows.batched(scored, SCHEMA))

    def dies(t):
        if "c" in t["user"].to_pylist():
            raise RuntimeError("killed")
        return scored(t)

    wanted = requests(spark, [("b", i) for i in range(50)] + [("c", 1)]).repartition(8)
    with pytest.raises(Exception, match="killed"):
        s.load_or_create(wanted, rows.batched(dies, SCHEMA))
    assert s.version() == 1 and s.scan().count() == 1
    assert s.load_or_create(wanted, rows.batched(scored, SCHEMA)).count() == 51
    # Data of a run that was killed before its commit are not read, and go with a vacuum.
    s._write(requests(spark, [("z", 1)]).selectExpr("*", "1D as score", "1L as _hash"), "killed")
    assert s.scan().count() == 52 and s.vacuum() == 0 and s.vacuum(-1) >= 1 and s.scan().count() == 52


@pytest.mark.parametrize("wrong", ["less", "twice", "other"])
def test_wrong_builds_are_refused(spark, tmp_path, wrong):
    s = store(spark, tmp_path)
    full = rows.batched(scored, SCHEMA)
    change = {"less": lambda d: d.where("day > 0"), "twice": lambda d: d.unionByName(d.where("day = 0")), "other": lambda d: d.withColumn("day", F.col("day") + 1)}[wrong]
    with pytest.raises(ValueError, match="asked for"):
        s.load_or_create(requests(spark, [("a", 0), ("a", 1)]), lambda m: change(full(m)))
    assert s.version() == 0


def test_late_hits(spark, tmp_path):
    """What another writer commits during a build is not stored a second time."""
    s, other = store(spark, tmp_path), rows.Store(spark, f"{tmp_path}/store")

    def build(misses):
        other.load_or_create(requests(spark, [("b", 2), ("q", 9)]), lambda m: m.select("user", "day", F.lit(7.0).alias("score")))
        return rows.batched(scored, SCHEMA)(misses)

    got = s.load_or_create(requests(spark, [("a", 1), ("b", 2)]), build)
    assert pairs_of(got) == [("a", 1, 1.5), ("b", 2, 7.0)]
    assert s.version() == 2 and s.scan().count() == 3

    def all_late(misses):
        other.load_or_create(misses.select("user", "day"), rows.batched(scored, SCHEMA))
        return rows.batched(scored, SCHEMA)(misses)

    assert s.load_or_create(requests(spark, [("n", 5)]), all_late).count() == 1 and s.scan().count() == 4


def test_load_existing(spark, tmp_path):
    s = store(spark, tmp_path)
    s.load_or_create(requests(spark, [("a", 1)]), rows.batched(scored, SCHEMA))
    assert pairs_of(s.load_existing(requests(spark, [("a", 1), ("a", 1)]))) == [("a", 1, 1.5)] * 2
    with pytest.raises(rows.Missing, match="2 rows are missing.*'b', 2"):
        s.load_existing(requests(spark, [("a", 1), ("b", 2), ("b", 2), (None, 2)]))


def test_only_files_in_reach_are_read(spark, tmp_path):
    s = store(spark, tmp_path, buckets=16)
    wanted = requests(spark, [("u", i) for i in range(400)])
    s.load_or_create(wanted, rows.batched(scored, SCHEMA))
    all_files = {r.path for r in s.files().collect()}
    one = requests(spark, [("u", 3)]).withColumn(rows.HASH, s.hash())
    assert len(all_files) >= 16 and len(s.near(one)) == 1
    assert len(s.answers(requests(spark, [("u", 3)])).inputFiles()) <= 2
    nobody = spark.createDataFrame([], "user string, day int")
    assert s.near(nobody.withColumn(rows.HASH, s.hash())) == [] and s.load_or_create(nobody, None).count() == 0


def test_compact(spark, tmp_path):
    s = store(spark, tmp_path, buckets=2)
    for i in range(4):
        s.load_or_create(requests(spark, [("u", j) for j in range(10 * i, 10 * i + 10)]), rows.batched(scored, SCHEMA))
    before = s.files().count()
    assert s.compact() == before and s.files().count() == 2 and s.scan().count() == 40 and s.scan(2).count() == 20
    assert s.load_or_create(requests(spark, [("u", 1), ("w", 1)]), rows.batched(scored, SCHEMA)).count() == 2
    assert s.scan().count() == 41 and s.vacuum(-1) == 4 and s.scan().count() == 41


def test_further_columns_of_requests(spark, tmp_path):
    s = store(spark, tmp_path)
    asked = spark.createDataFrame([("a", 1, "y", 5), ("a", 1, "x", 9), ("b", 1, None, 1)], "user string, day int, text string, n int")
    got = s.load_or_create(asked, lambda m: m.select("user", "day", F.coalesce(F.length("text") + F.col("n"), F.lit(0)).cast("double").alias("score")))
    assert pairs_of(got) == [("a", 1, "x", 9, 10.0), ("a", 1, "y", 5, 10.0), ("b", 1, None, 1, 0.0)]
    with pytest.raises(ValueError, match="columns of the values"):
        s.answers(asked.withColumn("score", F.lit(1)))
