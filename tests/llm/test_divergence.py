import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tarn.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string, rank string"


def slow(rows, least, top):
    """Every word of every pair of sources."""
    docs = [tuple(x or "" for x in r) for r in rows]  # lang, source, text
    words = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for _, _, text in docs]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), own in zip(docs, words):
        seen[lang].update(set(own))
        counts[lang, source].update(own)
    out = []
    for lang, source in counts:
        kept = [w for w, n in seen[lang].items() if n >= least]

        def share(groups):
            n = {w: sum(counts[g][w] for g in groups) for w in kept}
            return n, {w: 1 + 1_000_000_000 * (n[w] + 5) // (sum(n.values()) + 5 * len(kept)) for w in kept}

        own, p = share([(lang, source)])
        _, q = share([g for g in counts if g[0] == lang])
        others = {s: share([(lang, s)])[1] for x, s in counts if x == lang and s != source}
        parts = {"pair": [(s, sum(abs(p[w] - r[w]) for w in kept)) for s, r in others.items()], "term": [(w, p[w] - q[w]) for w in kept if own[w] and p[w] > q[w]]}
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[: top if part == "term" else None])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, source, "x", 1, "y", "z") for i, (lang, source, text) in enumerate(rows)], SCHEMA)


def compare(spark, rows, least, top, **sizes):
    got = [tuple(r) for r in divergence.audit(table(spark, rows), least, top, **sizes).collect()]
    want = slow(rows, least, top)
    assert sorted(got) == want
    return want


def test_against_brute_force(spark, rng):
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("", "É", "z", "ß\u4e00")] + ["Straße", "ABC", "aBc", "x1y", "don't"]
    rows = []
    for i in range(400):
        lang = [None, "", "en", "en", "de"][i % 5]
        source = ["hot", None, "", "a", "b", "c é", "d"][min(int(rng.integers(12)), 6)]
        picked = rng.choice(len(vocabulary), int(rng.integers(0, 30)), p=(w := 1 / (1 + rng.permutation(len(vocabulary)))) / w.sum())
        rows.append((lang, source, " ".join(vocabulary[k] for k in picked) if i % 17 else None))
    rows += rows[:20]  # repeated rows
    rows += [("en", "no words", "1 2 3"), ("en", "none kept", "qqqq"), ("alone", "s", "word word"), ("rare", "s", "word"), ("rare", "t", "other")]
    want = compare(spark, rows, 10, 7)
    assert {r[0] for r in want if r[2] == "term"} == {"", "en", "de"}
    assert {r[4] for r in want if r[0] == "rare"} == {0}
    # Many buckets of words and blocks of sources give the same.
    compare(spark, rows, 10, 7, terms=3, sources=2)
    assert compare(spark, rows, 1, 1000, terms=5, sources=1)


def test_long_text_and_many_batches(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert sum(divergence.words(b"Ab" * 100 + b" c1D\n" * 100), []) == [b"ab" * 100] + [b"c", b"d"] * 100
    text = "alpha BETA gamma " * 40_000 + "x" * 100_000
    rows = [("en", "a", text), ("en", "b", "alpha"), ("en", "b", "beta " * 9)]
    compare(spark, rows, 1, 10)


def test_large_numbers_are_exact(spark):
    n = [(0, 0, 1), (2**31, 2**40, 10**6), (10**15 + 7, 10**16, 10**8), (5, 2**62, 1), (2**62, 2**62, 3)]
    df = spark.createDataFrame(n, "n long, total long, terms long").withColumn("p", divergence.share("n", "total", "terms"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (a + 5) // (b + 5 * v) for a, b, v in n]


def test_empty(spark):
    assert divergence.audit(table(spark, []).where("false")).count() == 0
    one = divergence.audit(table(spark, [(None, None, None)]))
    assert one.collect() == [] and dict(one.dtypes)["rank"] == "int"


def test_no_rows_of_pairs_of_words(spark):
    """What leaves the tally is distinct pairs of counts, however many words have them."""
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    rows = [("en", s, " ".join(words)) for s in "xyz"]
    compare(spark, rows[:2], 1, 3)
    cells = table(spark, rows).select("lang", "source", F.explode(F.split("text", " ")).alias("term"))
    cells = cells.union(cells.select("lang", "source", F.lit(None).cast("string")).distinct())
    cells = cells.select("*", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    out = divergence.tally(cells.toArrow())
    assert sorted(out.to_pylist(), key=str) == sorted(({"lang": "en", "one": a, "two": b, "a": 1, "b": 1, "n": 1000} for a, b in ("xy", "xz", "yz")), key=str)
