import pytest

from tarn.llm import pieces


def all_segmentations(lattice, word):
    """Every path of the lattice, by plain recursion."""
    if not word:
        return [(0.0, ())]
    out = []
    for end in range(1, len(word) + 1):
        p = lattice.pieces.get(word[:end])
        if p:
            out += [(s + p[1], (p[0], *i)) for s, i in all_segmentations(lattice, word[end:])]
    if word[0] not in lattice.pieces:
        ids = tuple(lattice.byte_ids[b] for b in word[0].encode())
        out += [(s + lattice.unknown, ids + i) for s, i in all_segmentations(lattice, word[1:])]
    return sorted(out, reverse=True)


@pytest.fixture(scope="module")
def real():
    return pieces.model(pieces.default_model())


def test_nbest_is_exhaustive(real, rng):
    lattice, _ = real
    for text in ("the", "▁there", "▁▁in", "x\ny", "▁ß𝄞a", "▁tionals"):
        want = all_segmentations(lattice, text)
        for n in (1, 3, 50, 10_000):
            got = lattice.nbest(text, n)
            assert [s for s, _ in got] == [s for s, _ in want[:n]]
            assert set(got) <= set(want) and len(set(got)) == len(got)


def test_texts_combine_words(real):
    lattice, raw = real
    for text in ("in the", "a  b", " of to\n", "on 𝄞 it"):
        marked = "▁" + text.replace(" ", "▁")
        want = all_segmentations(lattice, marked)
        for n in (1, 2, 5):
            got = pieces.Encoder(lattice, raw, n).nbest(text)
            assert [s for s, _ in got] == [s for s, _ in want[:n]] and set(got) <= set(want)
            assert all(pieces.decode(i, raw) == text for _, i in got)


def test_columns(spark, rng):
    long = " ".join(rng.choice(["the", "tion", "été", "zq", "0x"], 5000)) + "é" * 3000
    rows = [(1, None), (2, ""), (3, " "), (4, "Hello  world"), (4, "Hello  world"), (None, long), (6, "a▁b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, nbest string")
    out = pieces.encode_nbest(df, 3).selectExpr("doc_id", "text", "nbest[0].ids as ids", "size(nbest) as n")
    back = pieces.decode_ids(out).collect()
    assert all((r.text or "").replace("▁", " ") == r.decoded for r in back)
    got = pieces.nbest_digests(df).collect()
    assert all(r.round_trip for r in got) and len(got) == 7
    assert [r.scores for r in got if r.doc_id == 1] == [[0.0]]
    assert pieces.nbest_digests(df.limit(0)).count() == 0


def slow_scores(lattice, word, n):
    """The n best scores, from the n best of each suffix."""
    best = [[] for _ in word] + [[0.0]]
    for start in reversed(range(len(word))):
        arcs = [(end, lattice.pieces[word[start:end]][1]) for end in range(start + 1, min(len(word), start + 64) + 1) if word[start:end] in lattice.pieces]
        if word[start] not in lattice.pieces:
            arcs.append((start + 1, lattice.unknown))
        best[start] = sorted((s + cost for end, cost in arcs for s in best[end]), reverse=True)[:n]
    return best[0]


def test_runs_of_equal_characters(real, monkeypatch):
    lattice, raw = real
    for word in ("▁" + "-" * 83, "a" * 301, "▁" + "." * 150, "▁" + "ab" * 100, "一" * 90):
        got = lattice.nbest(word, 4)
        assert [s for s, _ in got] == slow_scores(lattice, word, 4) and len(set(got)) == len(got)
    pushed, push = [0], pieces.heapq.heappush

    def counted(queue, entry):
        pushed[0] += 1
        assert pushed[0] < 1_000_000
        push(queue, entry)

    monkeypatch.setattr(pieces.heapq, "heappush", counted)
    for c in "-a.":
        pushed[0] = 0
        text = c * 20_000
        assert all(pieces.decode(i, raw) == text for _, i in pieces.Encoder(lattice, raw, 4).nbest(text))
