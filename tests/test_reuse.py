"""Results of older forms of a step. Classes of one name stand for one class at different times."""

import pytest

from tarn.operators import evolve
from tarn.plans import reuse, steps

BUILT = []


def form(fields: dict, *migrations, name="Model"):
    def build(self, spark, inputs):
        BUILT.append(name)
        return spark.createDataFrame([(repr(sorted(self.parameters().items())),)], "made string")

    body = {"__annotations__": fields, "build": build, "migrations": migrations, "__qualname__": name}
    return type(name, (steps.Step,), body)


V0 = form({"rate": "float", "data": "str"})
RENAME = evolve.Renamed("rate", to="lr")
ADD = evolve.Added("seed", 0)
V1 = form({"lr": "float", "data": "str", "seed": "int"}, RENAME, ADD)
V2 = form({"lr": "float | str", "data": "str", "seed": "int"}, RENAME, ADD, evolve.Retyped("lr", "string", was="float"))


def test_rename_and_add(spark, tmp_path):
    BUILT.clear()
    root = str(tmp_path)
    made = steps.materialize(spark, V0(rate=0.5, data="a"), root).first()
    new = V1(lr=0.5, data="a", seed=0)
    assert steps.status(spark, new, root) == "done"
    assert steps.load_existing(spark, [new, new], root)[1].first() == made and len(BUILT) == 1
    # Only the pinned default is bound, and other parameters are missing.
    assert steps.status(spark, V1(lr=0.5, data="a", seed=1), root) == "missing"
    assert steps.status(spark, V1(lr=0.6, data="a", seed=0), root) == "missing"
    # Two hops link straight to the source.
    last = V2(lr=0.5, data="a", seed=0)
    assert steps.materialize(spark, last, root).first() == made and len(BUILT) == 1
    rows = {r.path.rpartition("Model/")[2]: r for r in reuse.catalog(spark, root).collect()}
    assert sorted(r.link is None for r in rows.values()) == [False, False, True]
    assert max(len(r.changes or []) for r in rows.values()) == 3
    source = next(r for r in rows.values() if r.link is None)
    assert source.parameters == {"rate": "0.5", "data": '"a"'} and source.key == V0(rate=0.5, data="a").key()


def test_dangling_link(spark, tmp_path):
    BUILT.clear()
    root, old, new = str(tmp_path), V0(rate=1.0, data="b"), V1(lr=1.0, data="b", seed=0)
    steps.materialize(spark, old, root)
    steps.materialize(spark, new, root)
    from tarn.sources import results

    results.delete(spark, steps.path_of(root, old))
    assert steps.status(spark, new, root) == "missing"
    with pytest.raises(steps.Missing):
        steps.load_existing(spark, [new], root)
    steps.materialize(spark, new, root)
    assert len(BUILT) == 2 and steps.status(spark, new, root) == "done"


def test_stale_and_breaking(spark, tmp_path):
    root = str(tmp_path)
    steps.materialize(spark, V0(rate=1.0, data="b"), root)
    undeclared = form({"lr": "float"})(lr=1.0)
    assert steps.status(spark, undeclared, root) == "stale"
    with pytest.raises(reuse.Stale):
        steps.materialize(spark, undeclared, root)
    broken = form({"lr": "float", "data": "str"}, evolve.Renamed("rate", to="lr", breaking=True))(lr=1.0, data="b")
    assert steps.status(spark, broken, root) == "missing"
    BUILT.clear()
    steps.materialize(spark, broken, root)
    assert BUILT == ["Model"]
    # What changed after the last breaking step still migrates.
    later = form({"lr": "float", "data": "str", "seed": "int"}, evolve.Renamed("rate", to="lr", breaking=True), ADD)(lr=1.0, data="b", seed=0)
    assert steps.status(spark, later, root) == "done"


def test_move_and_rewrite(spark, tmp_path):
    from pyspark.sql import functions as F

    root = str(tmp_path)
    steps.materialize(spark, form({"size": "int"}, name="Old")(size=3), root)
    moved = form({"size": "int"}, evolve.Moved("New", was="Old"), name="New")
    assert steps.status(spark, moved(size=3), root) == "done"
    as_text = evolve.Rewritten(lambda: {"size": F.concat(F.lit('"'), "size", F.lit('"'))})
    text = form({"size": "str"}, as_text, evolve.Retyped("size", "string", was="int"), name="Old")
    assert steps.status(spark, text(size="3"), root) == "done" and steps.status(spark, text(size="4"), root) == "missing"


@pytest.mark.parametrize("migrations", [
    (evolve.Renamed("a", to="nowhere"),), (evolve.Added("nowhere", 1),), (evolve.Retyped("lr", "string"),),
    (evolve.Moved("Other", was="Model"),), (evolve.Rewritten(dict),), ("no migration",),
    (evolve.Renamed("lr", to="x"), evolve.Renamed("x", to="lr")),
])
def test_bad_chains(migrations):
    with pytest.raises((ValueError, TypeError)):
        reuse.forms(form({"lr": "float"}, *migrations))


class Leaf(steps.Step):
    n: int

    def build(self, spark, inputs):
        BUILT.append(self.n)
        return spark.range(self.n)


class Chooser(steps.Step):
    left: Leaf
    right: Leaf
    take: str

    def build(self, spark, inputs):
        return inputs[self.take].selectExpr("id + 1 as x")


def test_shared_inputs_and_what_was_read(spark, tmp_path):
    BUILT.clear()
    root, a, b = str(tmp_path), Leaf(n=2), Leaf(n=3)
    wanted = [Chooser(left=a, right=b, take="left"), b, Chooser(left=b, right=a, take="left"), b]
    got = steps.materialize_all(spark, wanted, root)
    assert [df.count() for df in got] == [2, 3, 3, 3] and sorted(BUILT) == [2, 3]
    facts = {r.key: r for r in reuse.catalog(spark, root).collect()}
    first = facts[wanted[0].key()]
    assert first.inputs == sorted([a.key(), b.key()]) and first.read == [a.key()]


class Sized(steps.Step):
    n: int
    group: str = "g"

    def batch(self):
        return self.group, 2

    @classmethod
    def build_batch(cls, spark, members, inputs):
        BUILT.append([m.n for m in members])
        return [spark.range(m.n) for m in members]


def test_batches(spark, tmp_path):
    BUILT.clear()
    root = str(tmp_path)
    steps.materialize(spark, Sized(n=3), root)
    wanted = [Sized(n=n) for n in (1, 2, 3, 4, 5)] + [Sized(n=6, group="h"), Sized(n=1)]
    assert [df.count() for df in steps.materialize_all(spark, wanted, root)] == [1, 2, 3, 4, 5, 6, 1]
    assert BUILT == [[3], [1, 2], [4, 5], [6]]


class Several(steps.Step):
    parts: tuple
    named: dict

    def inputs(self):
        return super().inputs() | {"made": Leaf(n=len(self.parts) + 7)}

    def build(self, spark, inputs):
        return inputs["parts/0"].union(inputs["named/x"]).union(inputs["made"])


def test_nested_and_computed_inputs(spark, tmp_path):
    step = Several(parts=(Leaf(n=1), 5, [Leaf(n=2)]), named={"x": Leaf(n=4)})
    assert sorted(step.inputs()) == ["made", "named/x", "parts/0", "parts/2/0"]
    assert steps.materialize(spark, step, str(tmp_path)).count() == 15


def test_encoders():
    with pytest.raises(TypeError):
        Leaf(n=1j).key()
    steps.register_encoder(lambda v: isinstance(v, complex), "complex", lambda v: [v.real, v.imag])
    try:
        assert Leaf(n=1j).key() == Leaf(n=1j).key() != Leaf(n=2j).key()
        steps.register_encoder(lambda v: v == 1j, "also", str)
        with pytest.raises(TypeError):
            Leaf(n=1j).key()
    finally:
        steps.ENCODERS.clear()


def test_many_keys_are_looked_up_by_a_job(spark, tmp_path, monkeypatch):
    """Not one call of the driver for each key; hits, links, dangling links and misses as one by one."""
    root = str(tmp_path)
    from tarn.sources import results

    leaves = [Leaf(n=n) for n in range(3000)]
    for s in leaves[:40]:
        results.publish(spark, s.n, steps.path_of(root, s))
    for s, source in ((leaves[50], leaves[1]), (leaves[51], leaves[60])):
        results.publish_link(spark, steps.path_of(root, s), steps.path_of(root, source), [])
    few = {s.key(): reuse.find(spark, s, root) for s in (leaves[0], leaves[50], leaves[70])}
    calls = []
    one = results.read_manifest
    monkeypatch.setattr(results, "read_manifest", lambda *a: calls.append(a) or one(*a))
    found = reuse.find_all(spark, leaves, root)
    assert not calls and sum(p is not None for p in found.values()) == 41
    assert all(found[k] == p for k, p in few.items()) and found[leaves[51].key()] is None
    assert results.read_manifest(spark, steps.path_of(root, leaves[51])) is None  # what pointed nowhere is gone
    with pytest.raises(steps.Missing):
        steps.load_existing(spark, leaves, root)


def test_stale_results_say_what_differs(spark, tmp_path):
    root = str(tmp_path)
    steps.materialize(spark, V0(rate=1.0, data="b"), root)
    with pytest.raises(reuse.Stale) as e:
        steps.materialize(spark, form({"lr": "float", "data": "int"})(lr=1.0, data=1), root)
    said = str(e.value).splitlines()
    assert "1 results, the first of" in said[1] and " by " in said[1]
    assert said[2:] == ["  ~ data: str -> int", "  + lr: float", "  - rate: float"]


def test_audit(spark, tmp_path):
    """All forms of a store at once: current, covered, superseded, orphaned, unknown."""
    root = str(tmp_path)
    for n in (1.0, 2.0):
        steps.materialize(spark, V0(rate=n, data="b"), root)
    steps.materialize(spark, V1(lr=1.0, data="b", seed=0), root)
    steps.materialize(spark, Leaf(n=1), root)
    got = {(r.name.rpartition(".")[2], r.results, r.links, r.state) for r in reuse.audit(spark, root, [V1]).collect()}
    assert got == {("Model", 2, 0, "covered"), ("Model", 0, 1, "current"), ("Leaf", 1, 0, "unknown")}
    broken = form({"lr": "float"}, evolve.Renamed("rate", to="lr", breaking=True))
    assert {r.state for r in reuse.audit(spark, root, [broken]).collect()} == {"orphaned", "unknown"}
    new = form({"lr": "float", "data": "str"}, evolve.Renamed("rate", to="lr", breaking=True))
    assert {(r.state, r.results) for r in reuse.audit(spark, root, [new, Leaf]).collect()} == {("superseded", 2), ("orphaned", 0), ("current", 1)}


def test_large_graphs_are_scheduled_in_order(spark, tmp_path, monkeypatch):
    """Each step's inputs are asked for a few times, not once for every other step that ends."""
    asked = []
    inputs = Chain.inputs
    monkeypatch.setattr(Chain, "inputs", lambda self: asked.append(self.n) or inputs(self))
    monkeypatch.setattr(steps, "build", lambda spark, members, root, given: [BUILT.append(m.n) for m in members])
    monkeypatch.setattr(steps.results, "load", lambda *a: None)
    BUILT.clear()
    steps.materialize_all(spark, [chain(60)], str(tmp_path))
    assert BUILT == list(range(61)) and len(asked) <= 10 * 61


class Chain(steps.Step):
    n: int
    before: object = None

    def build(self, spark, inputs):
        raise AssertionError("not built")


def chain(n):
    out = None
    for i in range(n + 1):
        out = Chain(n=i, before=out)
    return out
