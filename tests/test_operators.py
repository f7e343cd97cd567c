"""Edge cases of the operators: nulls, ties, repeated rows, empty tables, cycles."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import evolve, graph, grouping, keys, lineage, lookup


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"d":[2,1],"c":null}}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in df.select(keys.canonical("j")).collect()] == ['{"a":{"c":null,"d":[2,1]},"b":1}', None, None]
    two = spark.createDataFrame([(None, "1"), ("null", "1")], "a string, b string")
    assert len({r[0] for r in two.select(keys.content_key("a", "b")).collect()}) == 2


def test_numbering_spans_stretches(spark, rng):
    data = [(k, int(i)) for k in ("a", None, "b") for i in rng.permutation(50)]
    df = spark.createDataFrame(data, "k string, i long")
    got = rows(grouping.numbered(df.where("k is not null"), ["k"], "i", "at", width=7))
    assert got == sorted(((k, i, i) for k, i in data if k), key=str)
    cut = grouping.chunks(df.where("k = 'a'"), ["k"], "i", 8).groupBy("chunk").count()
    assert rows(cut) == sorted([(c, 8 if c < 6 else 2) for c in range(7)], key=str)


def test_hit_or_miss_with_repeats(spark):
    asked = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    store = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert rows(lookup.hit_or_miss(asked, store, "id")) == [(1, "hit"), (1, "hit"), (2, "miss"), (None, "miss")]
    assert rows(lookup.hit_or_miss(asked.limit(0), store, "id")) == []


def test_resource_bounds(spark):
    jobs = spark.createDataFrame([(None, None), (2, None), (2, 3), (4, 4), (2, 3)], "low int, high int")
    workers = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "w string, n int")
    got = lookup.eligible(jobs, workers, {"n": ("low", "high")}, ["low", "high"]).groupBy("w").agg(F.sum("jobs"))
    assert rows(got) == [("a", 1), ("b", 4), ("c", 3)]


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "c"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("x",)], "root string")
    assert rows(graph.closure(roots, edges)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("x", "x", 0), ("x", "y", 1)]
    assert rows(graph.leading_to_cycles(edges)) == [("a",), ("b",), ("c",), ("d",)]
    assert graph.leading_to_cycles(edges.where("parent = 'x'")).isEmpty() and graph.closure(roots.limit(0), edges).isEmpty()


def test_steps_refuse_wrong_fields(spark):
    df = spark.range(1).withColumn("x", F.lit(1))
    for bad in (evolve.Renamed("y", "z"), evolve.Renamed("x", "id"), evolve.Added("x", 1), evolve.Retyped("y", "int"), evolve.Rewritten(lambda: {"y": F.lit(1)})):
        with pytest.raises(ValueError):
            evolve.migrate(df, [bad])
    assert evolve.reusable_from([]) == 0 and evolve.reusable_from([evolve.Added("a"), evolve.Added("b", breaking=True), evolve.Added("c")]) == 2


def test_links_collapse(spark):
    links = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 20)] + [("p", "q")], "current string, source string")
    assert dict(rows(evolve.final_links(links))) == {**{str(i): "0" for i in range(1, 20)}, "p": "q"}


def test_diff_signs(spark):
    a = spark.createDataFrame([(1, "x", "1"), (1, "y", None), (1, "z", "3")], "k int, field string, value string")
    b = spark.createDataFrame([(1, "x", "2"), (1, "y", None), (1, "w", None)], "k int, field string, value string")
    assert rows(evolve.field_diff(a, b, ["k", "field"]).select("field", "change")) == [("w", "+"), ("x", "~"), ("z", "-")]


def test_snapshots(spark, tmp_path):
    for name, content in (("a.txt", "one"), ("sub/b.txt", "two"), ("c.bin", "three")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    files = lineage.file_hashes(spark, str(tmp_path), "*.txt").withColumn("g", F.lit(1))
    assert files.count() == 2
    one = lineage.snapshot_ids(files, "g", "path", "hash").first().snapshot_id
    assert lineage.snapshot_ids(files.unionByName(files), "g", "path", "hash").first().snapshot_id == one
    (tmp_path / "a.txt").write_text("changed")
    assert lineage.snapshot_ids(files, "g", "path", "hash").first().snapshot_id != one


# Seconds and how they must be shown.
@pytest.mark.parametrize(("seconds", "shown"), [(0.0, "0ms"), (0.85, "850ms"), (0.999, "999ms"), (1.0, "1.0s"), (3.2, "3.2s"), (59.9, "59.9s"), (60.0, "1m00s"), (125.0, "2m05s"), (3599.0, "59m59s"), (3599.9, "59m59s"), (3600.0, "1h00m"), (3661.0, "1h01m"), (7384.0, "2h03m")])
def test_durations(spark, seconds, shown):
    assert spark.range(1).select(text.format_duration(F.lit(seconds))).first()[0] == shown


@pytest.mark.parametrize(("value", "shown"), [("plain", "plain"), ("", '""'), ("a b", '"a b"'), ('q"', '"q\\""'), ("a=b", '"a=b"'), ("l\n\t", '"l\\n\\t"'), ("back\\", '"back\\\\"'), ("\x1b[0m\x85", '"\\x1b[0m\\x85"'), ("n\xa0b", "n\xa0b")])
def test_log_values(spark, value, shown):
    assert spark.range(1).select(text.logfmt_value(F.lit(value))).first()[0] == shown


def test_labels(spark):
    got = spark.range(1).select(text.elide(F.lit("abcdefghij"), 5), text.elide(F.lit("abc"), 5), text.job_state(F.lit("CANCELLED by 12")), text.job_state(F.lit("FAILED+")), text.padded_index(F.lit(7), F.lit(100)), text.shown_path(F.array())).first()
    assert tuple(got) == ("ab…ij", "abc", "CANCELLED", "FAILED", "007", "<root>")


def test_ranges(spark):
    for bad in ((-1, 2), (3, 2)):
        with pytest.raises(ValueError, match="range"):
            lookup.between(*bad)
    df = spark.range(6)
    held = lambda r: [x.id for x in df.where(r.holds(F.col("id"))).collect()]
    assert held(lookup.between(2, 4)) == [2, 3, 4] and held(lookup.at_least(4)) == [4, 5] and held(lookup.exactly(0)) == [0]
    assert df.limit(1).select(*lookup.at_least(2).columns("cpus")).first().asDict() == {"cpus_low": 2, "cpus_high": None}


def test_changes_are_described():
    changes = [evolve.Renamed("a", "b"), evolve.Added("c", 0, breaking=True), evolve.Retyped("c", "string", was="int"), evolve.Moved("New", was="Old"), evolve.Rewritten(dict), evolve.Nested("f", "x", "y")]
    assert [evolve.described(c) for c in changes] == ["a becomes b", "c is added as 0 (breaking)", "c was int and is string", "Old becomes New", "new values by dict", "x becomes y within f"]


def test_links_do_not_pass_through_the_driver(spark, monkeypatch):
    """Following links broadcasts no table, however small it looks."""
    from tarn.sources import shared

    plans, before = [], shared.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return before(df, name)

    monkeypatch.setattr(shared, "written", seen)
    links = spark.range(8, 200).selectExpr("id as current", "id - 8 as source")
    assert {(r.current, r.source) for r in evolve.final_links(links).collect()} == {(i, i % 8) for i in range(8, 200)}
    assert len(plans) == 7 and sum("SortMergeJoin" in p for p in plans) == 6 and not any("Broadcast" in p for p in plans)
