import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import simhash


def slow_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    left, out = set(fps), {}
    while left:
        root = min(left)
        left.discard(root)
        front, group = [root], [root]
        while front:
            q = front.pop()
            new = {x for x in left if (x ^ q).bit_count() <= 4}
            left -= new
            front += new
            group += new
        out |= dict.fromkeys(group, frozenset(group))
    return out


def test_fingerprint(rng):
    for n in (0, 1, 3, 4, 5, 300, 3000):
        text = " ".join(rng.choice(["Ab", "cé", "X y", "zz", "I"], n)) + "\n"
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.integers(0, 2**32))
def test_within_counts_bits(xs, seed):
    r = np.random.default_rng(seed)
    close = [x & int(r.integers(0, 2**10)) for x in xs]
    both = np.array(xs + close, np.uint64)
    found = simhash.lanes(simhash.within(simhash.planes(both)))
    assert [i for i in found if i < len(both)] == [i for i, x in enumerate(both.tolist()) if x.bit_count() <= 4]


@settings(max_examples=20, deadline=None)
@given(st.integers(3, 40), st.integers(1, 3), st.integers(0, 2**32))
def test_within_any_radius(radius, words, seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 2**64, (150, words), dtype=np.uint64) & r.integers(0, 2**64, (150, words), dtype=np.uint64) & r.integers(0, 2**64, (150, words), dtype=np.uint64)
    found = simhash.lanes(simhash.within(simhash.planes(x), radius))
    assert [i for i in found if i < 150] == np.flatnonzero(np.bitwise_count(x).sum(1) <= radius).tolist()


def near(rng, n):
    base = [int(x) for x in rng.integers(0, 2**64, 5, dtype=np.uint64)]
    out = set(int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64))
    for i in range(n):
        x = base[i % 5]
        for b in rng.integers(0, 64, i % 9):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


def test_bucket_links_span_components(rng):
    fps = near(rng, 300)
    a, b = simhash.bucket_links(np.array(fps, np.uint64))
    want, parent = slow_components(fps), {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[root(y)] = root(x)
    groups = {}
    for x in fps:
        groups.setdefault(root(x), set()).add(x)
    assert all(frozenset(g) == want[x] for g in groups.values() for x in g)


def test_operator(spark, rng, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "one", "A b c", "a B c"]
    for i in range(30):
        w = list(rng.choice(words, 150))
        texts.append(" ".join(w))
        for _ in range(i % 4):
            w[int(rng.integers(150))] = "new"
            texts.append(" ".join(w))
    rows = [(i * 3 % 101 + 5, t, "x") for i, t in enumerate(texts)]
    rows += [(None, "alone and null", "x"), (None, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    want = slow_components(fps)
    least = {g: min((r[0] for r, f in zip(rows, fps) if f in g and r[0] is not None), default=None) for g in set(want.values())}
    for split in (simhash.SPLIT, 2):
        monkeypatch.setattr(simhash, "SPLIT", split)
        got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
        assert got == sorted(((r[0], f"{f:016x}", least[want[f]]) for r, f in zip(rows, fps)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
