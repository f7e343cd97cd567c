from collections import defaultdict

from tarn.llm import chunks


def slow_cuts(t):
    cuts, last = [], 0
    for i in range(len(t)):
        if i - last >= chunks.MAX_CHUNK:
            cut = last + chunks.MAX_CHUNK
            while t[cut] & 0xC0 == 0x80:
                cut -= 1
            cuts.append(cut)
            last = cut
        h = 0
        for b in t[max(0, i - 31) : i + 1]:
            h = ((h << 1) + int(chunks.GEAR[b])) % 2**32
        inside = i + 1 < len(t) and t[i + 1] & 0xC0 == 0x80
        if not h & int(chunks.MASK) and not inside and i + 1 - last >= chunks.MIN_CHUNK:
            cuts.append(i + 1)
            last = i + 1
    return cuts + [len(t)] * (last < len(t))


def slow(rows, min_run):
    first = {}
    pieces = []
    for doc, text in rows:
        t = (text or "").encode()
        cuts = chunks.gear_cuts(t)
        pieces.append([(s, e, t[s:e]) for s, e in zip([0, *cuts], cuts)])
    for doc, parts in sorted(((r[0], p) for r, p in zip(rows, pieces)), key=lambda x: (x[0] is None, x[0] or 0)):
        for s, e, c in parts:
            first.setdefault(c, (doc, s))
    out = []
    for (doc, text), parts in zip(rows, pieces):
        gone, run = set(), []
        for s, e, c in [*parts, (0, 0, None)]:
            if c is not None and first[c] != (doc, s):
                run.append((s, e))
            else:
                t = (text or "").encode()[run[0][0] : run[-1][1]] if run else b""
                if run and (len(t) >= min_run or len(t.split()) >= chunks.MIN_WORDS):
                    gone.update(range(run[0][0], run[-1][1]))
                run = []
        t = (text or "").encode()
        out.append((doc, bytes(b for i, b in enumerate(t) if i not in gone).decode(), len(gone)))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeéß"), int(rng.integers(2, 9)))) for _ in range(n))


def test_cuts(rng):
    for n in (0, 1, 3, 40, 400, 3000):
        t = prose(rng, n).encode()
        assert chunks.gear_cuts(t) == slow_cuts(t)
    t = "é".encode() * 2000
    assert chunks.gear_cuts(t) == slow_cuts(t)
    for s in ([0, *chunks.gear_cuts(t)]):
        t[s:].decode()


def test_against_brute_force(spark, rng):
    shared = [prose(rng, 60) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "short text"), (3, "short text"), (4, "again and again " * 400)]
    for i in range(5, 40):
        parts = [prose(rng, int(rng.integers(1, 90)))]
        for _ in range(i % 3):
            parts += [shared[int(rng.integers(4))], prose(rng, int(rng.integers(5, 90)))]
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[20][1]), (51, rows[20][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    out = chunks.dedup(docs)
    got = {r.doc_id: (r.text or "", r.n_removed) for r in out.collect()}
    want = slow(rows, chunks.MIN_RUN)
    assert got == {i: (t, n) for i, t, n in want}
    assert out.columns == ["doc_id", "text", "key", "n_bytes", "n_removed", "removed"]
    # Each shared passage of 60 words is cut where it comes again.
    hits = defaultdict(list)
    for i, t in rows[5:40]:
        for k, s in enumerate(shared):
            if s in t:
                hits[k].append(i)
    assert all(got[i][1] for k in hits for i in hits[k][1:])
    same = spark.createDataFrame([(None, rows[20][1]), (7, rows[20][1]), (7, rows[20][1])], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in chunks.dedup(same).collect()) == [(False, False), (False, False), (True, True)]
    assert chunks.dedup(docs.limit(0)).count() == 0


def test_documents_without_ids(spark, rng):
    """Those without an id are documents of their own: what repeats among them is cut."""
    shared = prose(rng, 80)
    rows = [(None, f"{prose(rng, 20)} {shared} {prose(rng, 20)}") for _ in range(6)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.n_removed > 0 for r in chunks.dedup(docs).collect()) == [False] * 3 + [True] * 5
    out = chunks.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 8
    assert chunks.dedup_stage(spark, docs.limit(0), "").count() == 0


def test_recall_by_word_length(spark, rng):
    """Passages of 51 words in two contexts are found, whatever the length of their words; the README has the shares."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    text = lambda k, n: " ".join("".join(rng.choice(letters, k)) for _ in range(n))
    for k, least in ((2, 0.85), (3, 0.93), (6, 0.98)):
        rows = []
        for i in range(150):
            shared = text(k, 51)
            rows += [(2 * i, f"{text(k, 40)} {shared} {text(k, 40)}"), (2 * i + 1, f"{text(k, 40)} {shared} {text(k, 40)}")]
        got = {r.doc_id: r.n_removed for r in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sum(got[2 * i + 1] > 0 for i in range(150)) >= least * 150 and not any(got[2 * i] for i in range(150))
