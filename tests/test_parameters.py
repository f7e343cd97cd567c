"""Keys, schemas, and steps rebuilt from records."""

import dataclasses
import sys
import threading
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Annotated, Literal

import pytest

from tarn import names
from tarn.operators import evolve
from tarn.plans import parameters, reuse, steps
from tests import other_module



class Clean(steps.Step):
    n: int

    def build(self, spark, inputs):
        return spark.range(self.n)


@dataclass(frozen=True)
class Options:
    depth: int
    names: list[str] = dataclasses.field(default_factory=list)


class Everything(steps.Step):
    source: Clean
    options: Options
    values: tuple
    named: dict
    chosen: frozenset
    kinds: set
    path: Path
    at: datetime
    cls: type
    mode: Literal["a", "b"] = "a"
    limit: int | None = None
    note: str = steps.unkeyed(default="")

    def build(self, spark, inputs):
        return inputs["source"]


def everything(**more):
    given = dict(source=Clean(n=1), options=Options(3, ["x"]), values=(1, [2.5, None], True), named={"a": Clean(n=2)}, chosen=frozenset({1, 2}), kinds={"b", "a"}, path=Path("/a/b"), at=datetime(2024, 1, 2, 3), cls=Options)
    return Everything(**given | more)


def test_classes_of_one_name(spark, results_root):
    a, b = Clean(n=1), other_module.Clean(n=1)
    assert a.key() != b.key() and a.key().split(":")[1:] == b.key().split(":")[1:]
    assert [df.count() for df in steps.materialize_all(spark, [a, b], results_root)] == [1, 101]


def described(cls):
    return names.describe(cls, parameters.keyed_fields)


def test_schema_goes_into_records():
    wide = dataclasses.make_dataclass("Options", [("depth", int), ("names", list[str]), ("more", int)], frozen=True, module=Options.__module__)
    assert described(Options) != described(wide) and names.shape(described(Options)) == names.shape(described(wide))
    assert described(int | None) == described(None | int) == "None | int"
    assert described(dict[str, list[int]]) == "dict[str, list[int]]" and described(tuple[int, str]) != described(tuple[str, int])
    assert described(Annotated[int, "note"]) == "int" and described(Literal["b", "a"]) == "Literal['a', 'b']"
    assert "Options{depth: int, names: list[str]}" in Everything.declared()["options"] and "note" not in Everything.declared()
    assert names.element_type(dict[str, int], "k") is int and names.element_type(tuple[int, str], 1) is str and names.element_type(Options, "depth") is int


def test_names_of_a_steps_own():
    with pytest.raises(TypeError, match="own"):
        type("Bad", (steps.Step,), {"__annotations__": {"key": str}})


def test_round_trip():
    step = everything(note="kept")
    record = {"step": parameters.canonical_json(parameters.encode(step)), "key": step.key()}
    again = steps.restored(record)
    assert again == step and again.note == "kept" and type(again.chosen) is frozenset and type(again.values) is tuple
    for part in range(3):
        parts = step.key().split(":")
        parts[part] = "other"
        with pytest.raises(ValueError):
            steps.restored(record | {"key": ":".join(parts)})
    with pytest.raises(ValueError, match="fields"):
        parameters.decode({"|class": names.full_name(Options), "|fields": {"depth": 1}})
    with pytest.raises(ValueError):
        parameters.decode({"|step": step.key()})
    with pytest.raises(LookupError):
        parameters.decode({"|class": "nowhere.Class", "|fields": {}})
    with pytest.raises(LookupError):
        names.resolve("a.<locals>.b")
    with pytest.raises(TypeError):
        steps.restored({"step": 5, "key": "a:b:c"})


def test_restored_from_a_result(spark, results_root):
    step = everything(path=Path("/c"))
    steps.materialize(spark, step, results_root)
    assert steps.restored_from(spark, steps.path_of(results_root, step)) == step
    row = next(r for r in reuse.catalog(spark, results_root).collect() if r.key == step.key())
    assert steps.restored(row.asDict()) == step
    facts = steps.provenance(spark, step, results_root)
    assert facts["submitted"]["command"] == sys.argv and facts["executed"]["spark"] == spark.version and facts["read"] == [Clean(n=1).key()]
    assert steps.provenance(spark, everything(limit=1), results_root) is None
    with pytest.raises(steps.Missing):
        steps.restored_from(spark, results_root + "/none")


class Money:
    def __init__(self, cents):
        self.cents = cents

    def to_parameter(self):
        return self.cents

    @classmethod
    def from_parameter(cls, cents):
        return cls(cents)


class Owned(steps.Step):
    x: object

    encoders = (parameters.Encoder(lambda v: isinstance(v, complex), "complex", lambda v: [v.real, v.imag], lambda v: complex(*v)),)

    def build(self, spark, inputs):
        return spark.range(1)


def test_encoders_by_layer(results_root):
    assert steps.restored({"step": parameters.encode(Owned(x=1 + 2j)), "key": Owned(x=1 + 2j).key()}).x == 1 + 2j
    with pytest.raises(TypeError):
        Clean(n=1j).key()
    paid = Clean(n=Money(5))
    assert steps.restored({"step": parameters.encode(paid), "key": paid.key()}).n.cents == 5
    parameters.register_encoder(lambda v: isinstance(v, bytes), "bytes", bytes.hex)
    with pytest.raises(ValueError, match="way back"):
        parameters.decode(parameters.encode(Clean(n=b"x")))


@steps.step
def squares(spark, numbers: Clean, inputs, power: int = 2):
    return inputs["numbers"].selectExpr(f"cast(pow(id, {power}) as long) as x")


def test_function_form(spark, results_root):
    step = squares(numbers=Clean(n=3))
    assert [r.x for r in steps.materialize(spark, step, results_root).orderBy("x").collect()] == [0, 1, 4]
    assert step.key() != squares(numbers=Clean(n=3), power=3).key() and squares.__name__ == "squares"
    assert steps.restored({"step": parameters.encode(step), "key": step.key()}) == step
    with pytest.raises(TypeError):
        steps.step(lambda *args: None)


class Chosen(steps.Step):
    n: int
    produces = "id bigint"

    @steps.dependency
    def base(self):
        return Clean(n=self.n)

    def root(self, given):
        return given + "/own" if self.n > 5 else given

    def build(self, spark, inputs):
        more = inputs.require(Clean(n=inputs["base"].count() + 1))
        return more if self.n < 9 else more.selectExpr("id as other")


def test_dependencies_and_own_folder(spark, results_root):
    step = Chosen(n=6)
    assert list(step.inputs()) == ["base"]
    assert steps.materialize(spark, step, results_root).count() == 7 and "/own/" in steps.path_of(results_root, step)
    assert steps.provenance(spark, step, results_root)["read"] == sorted([Clean(n=6).key(), Clean(n=7).key()])
    with pytest.raises(TypeError, match="declares"):
        steps.materialize(spark, Chosen(n=9), results_root)
    assert steps.status(spark, Chosen(n=9), results_root) == "missing"
    assert Path(steps.data_folder(spark, step, results_root)).is_dir()


MEET = threading.Barrier(3, timeout=60)


class Meets(steps.Step):
    n: int

    def build(self, spark, inputs):
        MEET.wait()
        return spark.range(self.n)


class Sum(steps.Step):
    parts: tuple

    def build(self, spark, inputs):
        return spark.range(sum(inputs[k].count() for k in inputs))


def test_threads(spark, results_root):
    """Three steps that wait for each other are built at once; what needs them comes after."""
    step = Sum(parts=tuple(Meets(n=i) for i in (1, 2, 3)))
    assert steps.materialize(spark, step, results_root, threads=3).count() == 6

    class Fails(steps.Step):
        def build(self, spark, inputs):
            raise KeyError("no")

    with pytest.raises(KeyError):
        steps.materialize(spark, Sum(parts=(Fails(), Clean(n=3))), results_root, threads=2)


def test_explain_and_diff_go_into_containers():
    a, b = everything(), everything(options=Options(4, ["x", "y"]), values=(1, [2.0, None], True), named={"a": Clean(n=3)})
    assert steps.diff(a, b) == [("options/depth", 3, 4), ("options/names", ["x"], ["x", "y"]), ("values/1/0", 2.5, 2.0), ("named/a/n", 2, 3)]
    assert steps.diff(everything(values=(1,)), everything(values=(1.0,))) == [("values/0", 1, 1.0)]
    shown = steps.explain(a)
    assert "  named: dict\n    a: Clean [" in shown and "    depth: 3" in shown


# Records and steps within parameters at different times


@dataclass(frozen=True)
class Rate:
    start: float


@dataclass(frozen=True)
class RateNow:
    first: float
    decay: int

    migrations = (evolve.Moved("RateNow", was="Rate"), evolve.Renamed("start", to="first"), evolve.Added("decay", 0))


class Part(steps.Step):
    size: int

    def build(self, spark, inputs):
        return spark.range(self.size)


class PartNow(steps.Step):
    count: int
    note: str = steps.unkeyed(default="")

    migrations = (evolve.Moved("PartNow", was="Part"), evolve.Renamed("size", to="count"))

    def build(self, spark, inputs):
        raise AssertionError("not built")


class Fit(steps.Step):
    rates: list
    part: Part

    def build(self, spark, inputs):
        return inputs["part"]


class FitNow(steps.Step):
    rates: list
    part: PartNow
    migrations = (evolve.Moved("FitNow", was="Fit"),)

    def build(self, spark, inputs):
        raise AssertionError("not built")


class FitBreaking(steps.Step):
    rates: list
    part: PartNow
    migrations = (evolve.Moved("FitBreaking", was="Fit", breaking=True),)

    def build(self, spark, inputs):
        return inputs["part"].selectExpr("id * 2 as id")


class FitUndeclared(FitNow):
    rates: list
    part: PartNow
    more: int
    migrations = (evolve.Moved("FitUndeclared", was="Fit"),)


def test_changes_within_parameters(spark, results_root):
    for n in (3, 4):
        steps.materialize(spark, Fit(rates=[Rate(0.5), Rate(0.1)], part=Part(size=n)), results_root)
    now = FitNow(rates=[RateNow(0.5, 0), RateNow(0.1, 0)], part=PartNow(count=4))
    assert steps.status(spark, now, results_root) == "done" and steps.materialize(spark, now, results_root).count() == 4
    link = next(r for r in reuse.catalog(spark, results_root).collect() if r.path.startswith("file:" + steps.path_of(results_root, now)))
    assert link.link is not None and len(link.changes) == 3
    for other in (FitNow(rates=[RateNow(0.5, 1)], part=PartNow(count=4)), FitNow(rates=[RateNow(0.5, 0), RateNow(0.1, 0)], part=PartNow(count=5))):
        assert steps.status(spark, other, results_root) == "missing"
    fresh = FitBreaking(rates=now.rates, part=now.part)
    assert steps.status(spark, fresh, results_root) == "missing" and steps.materialize(spark, fresh, results_root).count() == 4
    with pytest.raises(reuse.Stale):
        steps.materialize(spark, FitUndeclared(rates=now.rates, part=now.part, more=1), results_root)


@dataclass(frozen=True)
class RateDoubled:
    start: float

    migrations = (evolve.Rewritten(data=lambda f: {"start": f["start"] * 2}), evolve.Moved("RateDoubled", was="Rate"))


class FitDoubled(steps.Step):
    rates: list
    part: Part
    migrations = (evolve.Moved("FitDoubled", was="Fit"),)

    def build(self, spark, inputs):
        raise AssertionError("not built")


def test_rewrites_within_parameters(spark, results_root):
    """A record's values are rewritten on the way to its present form, also within lists."""
    steps.materialize(spark, Fit(rates=[Rate(0.5), Rate(0.25)], part=Part(size=3)), results_root)
    now = FitDoubled(rates=[RateDoubled(1.0), RateDoubled(0.5)], part=Part(size=3))
    assert steps.status(spark, now, results_root) == "done" and steps.materialize(spark, now, results_root).count() == 3
    assert steps.status(spark, FitDoubled(rates=[RateDoubled(0.5), RateDoubled(0.25)], part=Part(size=3)), results_root) == "missing"


def test_links_that_form_a_cycle(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "current int, source int")
    with pytest.raises(ValueError, match="cycle"):
        evolve.final_links(links)
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "current int, source int")
    assert {r.source for r in evolve.final_links(chain).collect()} == {300}
