import re
from collections import Counter

from tarn.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measure(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + d for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), len(lines)


def slow_kept(rows):
    got = {}
    hosts = {}
    for i, text, host in rows:
        n, _, sym, dup, rep, lines = slow_measure(text)
        base = n < 50 or 100 * rep > 50 * n
        got[i] = (base, host)
        hosts.setdefault(host, []).append(base or 10 * sym > n or 10 * dup > 3 * lines)
    hosts.pop(None, None)
    n, x = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    m = x / n if n else 0.0
    away = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v in hosts.values()) - (len(hosts) - 1) * m * (1 - m)
    unlike = n - sum(len(v) ** 2 for v in hosts.values()) / n if n else 0
    between = away / unlike if unlike > 0 else 0
    if m * (1 - m) and between > 0:
        s = max(m * (1 - m) / between - 1, 0)
        bad = {h for h, v in hosts.items() if (sum(v) + m * s) / (len(v) + s) > 0.5}
    else:
        bad = set(hosts) if m > 0.5 else set()
    return {i for i, (base, host) in got.items() if not base and host not in bad}


def test_measure(rng):
    for n in (0, 1, 2, 3, 50, 400):
        for sep in (" ", "\n", "\t  ", "\x1c "):
            text = sep.join(rng.choice(["a", "é#", "b|", "𝄞", "c d", ""], n))
            assert quality.measure(text.encode()) == slow_measure(text)
    assert quality.measure(b"") == slow_measure(None)


def test_operator(spark, rng):
    words = [f"w{i}" for i in range(500)]
    good = lambda: " ".join(rng.choice(words, 80))
    rows = [(1, None, "a"), (2, "", "a"), (3, good(), None), (4, "x y z " * 40, "a")]
    rows += [(10 + i, good(), "good") for i in range(30)]
    rows += [(50 + i, good() if i < 3 else "short", "bad") for i in range(30)]
    rows += [(90 + i, "short", f"h{i}") for i in range(3)] + [(99, good(), "h0")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_words int")
    scored = quality.judge(quality.measured(docs))
    got = {r.doc_id: r for r in scored.collect()}
    assert {i for i, r in got.items() if r.kept} == slow_kept(rows)
    assert not got[50].kept and not got[50].base_failed and got[3].kept
    assert [tuple(got[i][c] for c in quality.COUNTS) for i, *_ in rows] == [slow_measure(t) for _, t, _ in rows]
    assert quality.judge(quality.measured(docs.limit(0))).count() == 0


def test_hosts_that_differ_by_chance_are_shrunk(spark):
    """Ten small hosts, each with one failure in four: one with three is no worse than chance, a large one with as many is."""
    ok, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(h, bad if i < (3 if h == "unlucky" else 1) else ok) for h in ["unlucky", *(f"h{n}" for n in range(9))] for i in range(4)]
    of = lambda rows: {r.source: r.host_rejected for r in quality.host_verdicts(quality.host_counts(quality.measured(spark.createDataFrame(rows, "source string, text string")))).collect()}
    assert not any(of(rows).values())
    large = of(rows + [("large", bad if i % 4 else ok) for i in range(400)])
    assert large["large"] and not large["h1"]


def test_stage_drops_a_failing_host(spark):
    good = [f"{' '.join(f'w{i}x{j}' for j in range(60))}" for i in range(40)]
    rows = [(i, t, "good", len(t), "n") for i, t in enumerate(good[:20])] + [(20 + i, t if i < 4 else "junk", "bad", len(t), None) for i, t in enumerate(good[20:])]
    rows += [(90, None, "good", None, "n"), (91, good[0], None, 9, "n"), (None, good[1], "good", 9, "n"), (None, good[1], "good", 9, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, host_rate string")
    got = quality.filter_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [*range(20), 91] and got.where("doc_id is null").count() == 2
    assert quality.filter_stage(spark, docs.limit(0), "").count() == 0
