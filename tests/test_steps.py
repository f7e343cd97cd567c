from pathlib import Path

import pytest

from tarn.plans import steps
from tarn.sources import results


class Numbers(steps.Step):
    n: int
    note: str = steps.unkeyed(default="")

    def build(self, spark, inputs):
        BUILT.append(self.key())
        return spark.range(self.n)


class Doubled(steps.Step):
    source: Numbers
    factor: float = 2.0

    def build(self, spark, inputs):
        BUILT.append(self.key())
        return inputs["source"].selectExpr(f"id * {self.factor} as x")


BUILT: list[str] = []


def test_keys_tell_values_apart():
    assert len({Numbers(n=v).key() for v in (1, 1.0, True, "1", None, [1], (1,), {1}, Path("1"), {"a": 1})}) == 10
    assert Numbers(n=1, note="a").key() == Numbers(n=1, note="b").key()
    assert Numbers(n={"a": 1, "b": 2}).key() == Numbers(n={"b": 2, "a": 1}).key()
    assert Numbers(n={3, 1, 2}).key() == Numbers(n={2, 3, 1}).key()
    assert Doubled(source=Numbers(n=1)).key() != Doubled(source=Numbers(n=2)).key()
    with pytest.raises(TypeError):
        Numbers(n=object()).key()
    with pytest.raises(TypeError):
        Numbers(n={"|x": 1}).key()


def test_built_once(spark, tmp_path):
    BUILT.clear()
    step = Doubled(source=Numbers(n=5))
    assert steps.status(spark, step, str(tmp_path)) == "missing"
    for _ in range(2):
        assert sorted(r.x for r in steps.materialize(spark, step, str(tmp_path)).collect()) == [0, 2, 4, 6, 8]
    assert BUILT == [Numbers(n=5).key(), step.key()]
    assert [s.key() for s in steps.closure(step)] == BUILT
    assert steps.status(spark, step, str(tmp_path)) == "done"
    assert results.delete(spark, steps.path_of(str(tmp_path), step))
    assert steps.status(spark, step, str(tmp_path)) == "missing"
    assert not results.delete(spark, steps.path_of(str(tmp_path), step))


def test_failed_build_publishes_nothing(spark, tmp_path):
    class Broken(steps.Step):
        def build(self, spark, inputs):
            return spark.sql("select raise_error('no') as x")

    with pytest.raises(Exception, match="no"):
        steps.materialize(spark, Broken(), str(tmp_path))
    assert steps.status(spark, Broken(), str(tmp_path)) == "missing"


def test_result_trees(spark, tmp_path):
    value = {"metrics": {"loss": 0.5, "ok": True}, "items": [1, None, spark.range(3)] + [0] * 9, "table": spark.range(2)}
    path = str(tmp_path / "r")
    assert results.publish(spark, value, path) and not results.publish(spark, value, path)
    back = results.load(spark, path)
    assert back["metrics"] == value["metrics"] and back["items"][:2] == [1, None]
    assert back["items"][2].count() == 3 and back["table"].count() == 2
    assert (tmp_path / "r/artifacts/items/02").is_dir()
    for bad in ({"..": 1}, {"a/b": 1}, {"": 1}, {"x": object()}):
        with pytest.raises(ValueError):
            results.publish(spark, bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_custom_codec(spark, tmp_path):
    def save(spark, v, path):
        spark.createDataFrame([(str(v.real), str(v.imag))], "re string, im string").write.parquet(path)
        return {"kind": "complex"}

    results.register("complex", lambda v: isinstance(v, complex), save, lambda spark, meta, path: complex(*map(float, spark.read.parquet(path).first())))
    try:
        results.publish(spark, [1 + 2j], str(tmp_path / "c"))
        assert results.load(spark, str(tmp_path / "c")) == [1 + 2j]
        results.register("also", lambda v: isinstance(v, complex), save, None)
        with pytest.raises(TypeError):
            results.publish(spark, 1j, str(tmp_path / "d"))
    finally:
        results.CODECS.pop("complex")
        results.CODECS.pop("also")


def test_explain_and_diff():
    a, b = Doubled(source=Numbers(n=1000)), Doubled(source=Numbers(n=7), factor=3.0)
    assert "n: 1_000" in steps.explain(a) and "source: Numbers" in steps.explain(a, 0)
    assert steps.diff(a, b) == [("source/n", 1000, 7), ("factor", 2.0, 3.0)]
    assert steps.diff(a, a) == [] and steps.diff(a, Numbers(n=1))[0][0] == "<root>"
