import re

import numpy as np

from tarn.llm import licenses


def slow(rows):
    """Containment of every template in every stretch of a text, by sets of shingles."""
    out = set()
    for doc, text in rows:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        for name, template in licenses.TEMPLATES:
            t = licenses.template_words(template)
            want = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            at = [i for i, s in enumerate(shingles) if s in want]
            for i in at:
                if len({shingles[j] for j in at if i <= j <= i + len(t)}) >= 0.8 * len(want):
                    out.add((doc, name))
    return out


def test_against_brute_force(spark, rng):
    def prose(n):
        return " ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(n))

    rows = [(1, None), (2, ""), (3, "MIT License"), (4, "released   UNDER the\nMIT license!")]
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        words = t.split()
        for k in range(6):
            some = words[: len(words) * 3 // 4 if k == 4 else None]
            if k == 5:
                some = [w if rng.random() > 0.02 else "changed" for w in words]
            rows.append((100 * (i + 1) + k, f"{prose(int(rng.integers(0, 90)))} {' '.join(some)} {prose(int(rng.integers(0, 90)))}"))
    rows += [(5, prose(3000)), (6, "Released under the MIT License. " * 200), (None, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = [(r.doc_id, r.license) for r in licenses.matches(docs, "doc_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == slow(rows)
    assert licenses.matches(docs.limit(0), "doc_id").count() == 0


def test_bands_are_independent(rng):
    """A shingle anywhere among the hashes is the least of its window in one band of four: of windows of four, one in a million has it in none of 48."""
    bands = np.zeros(licenses.BANDS)
    missed, n = 0, 20_000
    for _ in range(n):
        hashes = [int(x) - (1 << 63) for x in rng.integers(0, 2**63, licenses.WINDOW, dtype=np.uint64)]
        hit = np.array([licenses.band_value(hashes[:1], j) == licenses.band_value(hashes, j) for j in range(licenses.BANDS)])
        bands += hit
        missed += not hit.any()
    assert missed <= 2 and (abs(bands / n - 0.25) < 0.02).all()


def test_band_values_are_those_of_the_column(spark):
    h = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    rows = spark.createDataFrame([(x, j) for x in h for j in (0, 1, 47)], "h long, band int").selectExpr("h", "band", "xxhash64(h, band) as value").collect()
    assert all(r.value == licenses.band_value([r.h], r.band) for r in rows)
