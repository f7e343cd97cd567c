"""Snapshots against git, and sweeps of results."""

import hashlib
import shutil
import subprocess

import pytest

from tarn.operators import snapshots
from tarn.plans import prune, reuse, steps
from tarn.sources import results


def fill(folder, files):
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)


FILES = {"a.txt": b"one", "sub/b.bin": bytes(range(256)) * 50, "sub/deep/c": b"", "sub/deep/d e.txt": "é".encode(), "z/x": b"one"}


def test_blobs_are_those_of_git(spark, tmp_path):
    fill(tmp_path, FILES)
    got = {r.path: (r.size, r.hash) for r in snapshots.blobs(spark, str(tmp_path)).collect()}
    assert {p: n for p, (n, _) in got.items()} == {p: len(c) for p, c in FILES.items()}
    assert got["a.txt"][1] == got["z/x"][1] == hashlib.sha1(b"blob 3\0one").hexdigest()
    if shutil.which("git"):
        for p in FILES:
            assert subprocess.run(["git", "hash-object", str(tmp_path / p)], capture_output=True, text=True).stdout.strip() == got[p][1]
    column = spark.createDataFrame([("one",), ("",), ("é",)], "text string").select(snapshots.blob_hash("text")).collect()
    assert [r[0] for r in column] == [got["a.txt"][1], got["sub/deep/c"][1], got["sub/deep/d e.txt"][1]]


def test_files_are_read_in_pieces(spark, tmp_path):
    """A file of 3 GB with a hole, beyond what one row could hold."""
    with open(tmp_path / "big", "wb") as f:
        f.truncate(3 << 30)
    (r,) = snapshots.blobs(spark, str(tmp_path)).collect()
    want = hashlib.sha1(b"blob %d\0" % (3 << 30))
    for _ in range(3 << 10):
        want.update(bytes(1 << 20))
    assert (r.path, r.size, r.hash) == ("big", 3 << 30, want.hexdigest())


def test_trees(spark, tmp_path):
    fill(tmp_path / "x", FILES)
    fill(tmp_path / "y", FILES)
    x, y = (snapshots.tree(snapshots.blobs(spark, f"{tmp_path}/{n}")) for n in "xy")
    rows = {r.path: r for r in x.collect()}
    assert set(rows) == {"", "sub", "sub/deep", "z", *FILES} and rows[""].files == 5 and rows[""].size == sum(map(len, FILES.values()))
    assert rows["sub/deep"].parent == "sub" and rows["a.txt"].parent == "" and rows[""].parent is None
    assert {tuple(r) for r in y.collect()} == {tuple(r) for r in rows.values()} and snapshots.changed(x, y).count() == 0
    (tmp_path / "y/sub/deep/c").write_bytes(b"now")
    (tmp_path / "y/z/x").unlink()
    fill(tmp_path / "y", {"new/n": b"n"})
    after = snapshots.tree(snapshots.blobs(spark, f"{tmp_path}/y"))
    assert sorted((r.path, r.change) for r in snapshots.changed(x, after).collect()) == [("new/n", "+"), ("sub/deep/c", "~"), ("z/x", "-")]
    none = x.where("false")
    assert sorted(r.path for r in snapshots.changed(none, x).collect()) == sorted(FILES) and snapshots.changed(none, none).count() == 0


def test_equal_parts_are_not_gone_into(spark, monkeypatch):
    files = [(f"{a}/{b}/{c}", 1, f"{a}{b}{c}") for a in range(6) for b in range(6) for c in range(6)]
    old = snapshots.tree(spark.createDataFrame(files, "path string, size long, hash string"))
    new = snapshots.tree(spark.createDataFrame([(p, n, "other" if p == "3/4/5" else h) for p, n, h in files], "path string, size long, hash string"))
    seen = []
    written = snapshots.written
    monkeypatch.setattr(snapshots, "written", lambda df, name: (out := written(df, name), seen.append(out.count()))[0])
    assert [(r.path, r.change, r.old, r.new) for r in snapshots.changed(old, new).collect()] == [("3/4/5", "~", "345", "other")]
    assert seen == [1, 1, 1, 1]


class Base(steps.Step):
    n: int

    def build(self, spark, inputs):
        return spark.range(self.n)


class Sum(steps.Step):
    parts: tuple

    def build(self, spark, inputs):
        return inputs["parts/0"].union(inputs["parts/1"])


@pytest.fixture
def store(spark, tmp_path):
    root = str(tmp_path)
    made = [Sum(parts=(Base(n=1), Base(n=2))), Sum(parts=(Base(n=2), Base(n=3))), Base(n=9)]
    steps.materialize_all(spark, made, root)
    results.publish_link(spark, steps.path_of(root, Base(n=50)), steps.path_of(root, Base(n=9)), [])
    results.publish_link(spark, steps.path_of(root, Base(n=51)), steps.path_of(root, Base(n=52)), [])
    return root, made


def there(spark, root):
    return {r.path.rsplit("/", 2)[-2] for r in reuse.catalog(spark, root).select("path").collect()}


def values(*found):
    return {s.key().rsplit(":", 1)[1] for s in found}


def test_what_is_needed_stays(spark, store):
    root, (first, second, _) = store
    gone = prune.sweep(spark, root, [first.key(), Base(n=50).key()])
    # The kept step with its inputs, and the link with what it points to.
    assert there(spark, root) == values(first, Base(n=1), Base(n=2), Base(n=50), Base(n=9))
    assert len(gone) == 3 and steps.materialize(spark, first, root).count() == 3
    assert prune.sweep(spark, root, [first.key(), Base(n=50).key()]) == [] and steps.status(spark, second, root) == "missing"


def test_a_stopped_sweep_is_finished(spark, store, monkeypatch):
    root, (first, second, _) = store
    move = prune.file_system
    calls = []

    def dies(spark, path):
        if ".gone-" in path:
            calls.append(path)
            if len(calls) == 3:
                raise RuntimeError("killed")
        return move(spark, path)

    monkeypatch.setattr(prune, "file_system", dies)
    with pytest.raises(RuntimeError):
        prune.sweep(spark, root, [second.key()])
    monkeypatch.setattr(prune, "file_system", move)
    assert prune.recover(spark, root) == 1 and prune.recover(spark, root) == 0
    assert there(spark, root) == values(second, Base(n=2), Base(n=3))
    assert steps.load_existing(spark, [second], root)[0].count() == 5
