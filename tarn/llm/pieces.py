"""Operator 1, SentencePiece encoding and decoding: N-best segmentation.

One Aho-Corasick automaton finds all pieces in a word, which are the arcs of
its lattice. Forward Viterbi over them gives the best score of every prefix;
it runs over many words at once, place by place. Search then runs backward
from the end: a partial path's priority is its own score plus the best score
of the prefix before it, which is exact, so that A* pops whole segmentations
in falling order of score. Of equal ones the place nearest to the start is
popped first, and no place more than ``n`` times, as none of the ``n`` best
takes a later path to it: pops are at most ``n`` a place.

No piece goes over the start of a word (a run of word marks and what follows),
so a text's lattice is that of its words in a row. The N best of a text differ
from its best only in the N - 1 words whose second choice costs least, and
what a second choice costs follows from Viterbi alone: the least loss at any
place of the best path by taking another arc there. So only those words are
searched by A*; of all others the best path is enough. Words are kept in a
bounded table.

A character without a piece costs ``UNKNOWN`` below the least score and becomes
byte pieces, so decoding gives the text back; a text's own word mark (U+2581)
is read as a space.

Defined results: a null or empty text has one segmentation, without pieces;
ties keep the order of the search, which depends on the text alone; repeated
rows give equal rows; an empty table none; clashing columns are replaced.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarn.llm import common

MARK = "▁"
UNKNOWN = 10.0
#: Characters of words that a worker keeps, and that are looked at together.
KEPT, TOGETHER = 6_000_000, 1_000_000
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

Segmentation = tuple[float, tuple[int, ...]]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """The pieces of a model and the search over them."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        import ahocorasick

        self.pieces = pieces
        self.byte_ids = byte_ids
        self.unknown = min(s for _, s in pieces.values()) - UNKNOWN
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece goes over the start of a word")
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.scores = np.array([s for _, s in pieces.values()])
        self.ids = np.array([i for i, _ in pieces.values()], np.int64)
        self.arc = [(len(p), s, (i,)) for p, (i, s) in pieces.items()]
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(pieces):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        # A character that no piece has: no arc goes over it.
        used = set().union(*pieces)
        self.gap = next(c for c in map(chr, range(0xD800)) if c not in used)

    def arcs(self, word: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For each end: (start, score, ids) of the arcs there, longest first; and the best score of each prefix."""
        n = len(word)
        arcs: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for last, k in self.automaton.iter(word):
            size, score, ids = self.arc[k]
            arcs[last + 1].append((last + 1 - size, score, ids))
        best = [0.0] * (n + 1)
        for end in range(1, n + 1):
            here = arcs[end]
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, self.unknown, tuple(self.byte_ids[b] for b in word[end - 1].encode())))
            best[end] = max([best[start] + score for start, score, _ in here])
        return arcs, best

    def nbest(self, word: str, n: int) -> list[Segmentation]:
        arcs, best = self.arcs(word)
        out: list[Segmentation] = []
        # (-priority, place, -score so far, order, path as a chain)
        queue = [(-best[-1], len(word), 0.0, 0, None)]
        order = 0
        pops = [0] * (len(word) + 1)
        while queue and len(out) < n:
            _, at, score, _, path = heapq.heappop(queue)
            if pops[at] == n:
                continue
            pops[at] += 1
            score = -score
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((score, tuple(ids)))
                continue
            for start, cost, ids in arcs[at]:
                if pops[start] < n:
                    order += 1
                    heapq.heappush(queue, (-(score + cost + best[start]), start, -(score + cost), order, (ids, path)))
        return out

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward Viterbi over many words: best scores, what second choices cost more, ids of the best paths in a row, and each word's end there.

        Place ``at + i`` of all words in a row is that after ``i`` characters
        of the word that starts at ``at``. Of arcs that tie, the path takes the
        longest, as the search does.
        """
        text = self.gap.join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.r_[0, np.cumsum(size + 1)[:-1]]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        end, piece = found[::2] + 1, found[1::2]
        # Steps: characters from the word's start. A character without a piece gets an arc of its own, the shortest at its place.
        step = np.arange(len(text) + 1) - np.repeat(at, size + 1)[: len(text) + 1]
        alone = step > 0
        alone[end[self.lengths[piece] == 1]] = False
        alone = np.flatnonzero(alone)
        start = np.r_[end - self.lengths[piece], alone - 1]
        cost = np.r_[self.scores[piece], np.full(len(alone), self.unknown)]
        end, piece = np.r_[end, alone], np.r_[piece, np.full(len(alone), -1)]
        order = np.argsort(step[end] * (len(text) + 1) + end, kind="stable")
        start, end, cost, piece = start[order], end[order], cost[order], piece[order]
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        places = end[first]
        best, value = np.zeros(len(text) + 1), np.empty(len(end))
        cuts = np.searchsorted(step[places], np.arange(1, size.max() + 2))
        arcs = np.r_[first, len(end)]
        for lo, hi in zip(cuts, cuts[1:]):
            a, b = arcs[lo], arcs[hi]
            value[a:b] = best[start[a:b]] + cost[a:b]
            best[places[lo:hi]] = np.maximum.reduceat(value[a:b], first[lo:hi] - a)
        top = np.repeat(best[places], np.diff(arcs))
        taken = np.minimum.reduceat(np.where(value == top, np.arange(len(end)), len(end)), first)
        value[taken] = -np.inf
        arc, loss = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1)
        arc[places], loss[places] = taken, best[places] - np.maximum.reduceat(value, first)
        # Back along the best paths of all words, an arc of each at a time.
        scores, second, word, here = best[at + size], np.full(len(words), np.inf), np.arange(len(words)), at + size
        path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            second[word] = np.minimum(second[word], loss[here])
            path.append((word, piece[arc[here]], here))
            here = start[arc[here]]
            more = here > at[word]
            word, here = word[more], here[more]
        word, piece, here = (np.concatenate([p[i] for p in reversed(path)]) for i in range(3))
        order = np.argsort(word, kind="stable")
        word, piece, here = word[order], piece[order], here[order]
        ids, number = self.ids[piece], np.ones(len(piece), np.int64)
        unknown = np.flatnonzero(piece < 0)
        if len(unknown):
            forms = [[self.byte_ids[b] for b in text[i - 1].encode()] for i in here[unknown].tolist()]
            number[unknown] = [len(f) for f in forms]
            ids = np.repeat(ids, number)
            ids[np.repeat(piece < 0, number)] = list(chain.from_iterable(forms))
        return scores, second, ids, np.cumsum(np.bincount(word, number, len(words)).astype(np.int64))


@cache
def model(path: str) -> tuple[Lattice, list[bytes]]:
    """The lattice of a model file, and the bytes of each id."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces, byte_ids, raw = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            pieces[piece] = (i, sp.get_score(i))
            raw.append(piece.replace(MARK, " ").encode())
    return Lattice(pieces, byte_ids), raw


class Encoder:
    """Segments texts; of each distinct word the best path is found once, and kept ready to be joined.

    Known words have numbers; by number there are a word's best score, what
    its second choice costs more, and packed ids and bytes of the best path.
    """

    def __init__(self, lattice: Lattice, raw: list[bytes], n: int):
        self.lattice, self.raw, self.n = lattice, raw, n
        self.raw_sizes = np.array([len(r) for r in raw])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.scores, self.seconds = np.array([]), np.array([])
        self.packed: list[bytes] = []
        self.raws: list[bytes] = []
        self.searched: dict[int, tuple[list[float], list[bytes]]] = {}
        self.kept = 0

    def learn(self, words: list[str]) -> None:
        """Make ``words`` known, ``TOGETHER`` characters at a time."""
        at = 0
        while at < len(words):
            size, stop = 0, at
            while stop < len(words) and (stop == at or size + len(words[stop]) <= TOGETHER):
                size += len(words[stop])
                stop += 1
            some = words[at:stop]
            scores, seconds, ids, ends = self.lattice.best(some)
            self.number.update(zip(some, range(len(self.texts), len(self.texts) + len(some))))
            self.texts += some
            self.scores, self.seconds = np.r_[self.scores, scores], np.r_[self.seconds, seconds]
            packed, raw = ids.astype("<u4").tobytes(), b"".join([self.raw[i] for i in ids.tolist()])
            cut = np.r_[0, ends]
            byte = np.r_[0, np.cumsum(self.raw_sizes[ids])][cut].tolist()
            cut = (4 * cut).tolist()
            self.packed += [packed[i:j] for i, j in zip(cut, cut[1:])]
            self.raws += [raw[i:j] for i, j in zip(byte, byte[1:])]
            self.kept += size
            at = stop

    def words(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's words."""
        parts = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.kept > KEPT:
            self.forget()
        self.learn(sorted(w for w in set().union(*parts) if w not in self.number))
        return [np.fromiter(map(self.number.__getitem__, p), np.int64, len(p)) for p in parts]

    def choices(self, word: int) -> tuple[list[float], list[bytes]]:
        """Scores and packed ids of the n best of a word, the best path first."""
        if word not in self.searched:
            found = [(s, pack(i)) for s, i in self.lattice.nbest(self.texts[word], self.n)]
            # Where sums round, a path that ties can come before.
            found.sort(key=lambda f: f[1] != self.packed[word])
            self.searched[word] = [s for s, _ in found], [i for _, i in found]
        return self.searched[word]

    def decoded(self, packed: bytes) -> bytes:
        return b"".join([self.raw[i] for i in unpack(packed)])

    def choose(self, found: np.ndarray) -> list[tuple[float, dict[int, int]]]:
        """Of the n best segmentations of a text's words, best first, the score and the words that take another choice than their first."""
        total = float(self.scores[found].sum())
        if self.n == 1 or not len(found):
            return [(total, {})]
        seconds = self.seconds[found]
        # Only the words whose second choice costs least can differ; of equal ones the first.
        if len(seconds) > self.n:
            limit = np.partition(seconds, self.n - 2)[self.n - 2]
            near = np.flatnonzero(seconds <= limit)
            cheap = near[np.argsort(seconds[near], kind="stable")[: self.n - 1]].tolist()
        else:
            cheap = np.argsort(seconds, kind="stable")[: self.n - 1].tolist()
        # (loss, ((word, choice), ...)) of the best combinations so far
        best: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for w in cheap:
            scores = self.choices(int(found[w]))[0]
            new = [(loss + scores[0] - c, how + ((w, k),) * (k > 0)) for loss, how in best for k, c in enumerate(scores)]
            best = heapq.nsmallest(self.n, new, key=lambda x: x[0])
        return [(total - loss, dict(how)) for loss, how in best]

    def joined(self, found: np.ndarray, changes: list[dict[int, int]]) -> list[bytes]:
        """The packed ids of segmentations of one text."""
        words = found.tolist()
        first = [self.packed[w] for w in words]
        out = []
        for change in changes:
            for at, k in change.items():
                first[at] = self.choices(words[at])[1][k]
            out.append(b"".join(first))
            for at in change:
                first[at] = self.packed[words[at]]
        return out

    def nbest(self, text: str | None) -> list[Segmentation]:
        """The n best segmentations of a text, best first."""
        found = self.words([text])[0]
        best = self.choose(found)
        return [(score, unpack(ids)) for (score, _), ids in zip(best, self.joined(found, [c for _, c in best]))]

    def first_bytes(self, found: np.ndarray) -> bytes:
        """What the best segmentation decodes to."""
        return b"".join([self.raws[w] for w in found.tolist()])

    def decode_alike(self, found: np.ndarray, changes: list[dict[int, int]]) -> bool:
        """Whether other choices of words decode to what the first ones do."""
        return all(self.decoded(self.choices(w)[1][k]) == self.raws[w] for change in changes for w, k in ((int(found[at]), k) for at, k in change.items()))


def pack(ids: tuple[int, ...]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def unpack(packed: bytes) -> tuple[int, ...]:
    return tuple(np.frombuffer(packed, "<u4").tolist())


@cache
def encoder(path: str, n: int) -> Encoder:
    """A worker's encoder of a model; what it knows serves all its tasks."""
    return Encoder(*model(path), n)


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, about ``TOGETHER`` characters at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    yield some


def decode(ids, raw: list[bytes]) -> str:
    """The text of a sequence of ids, without the first word mark."""
    return b"".join([raw[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


NBEST = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode_nbest(df: DataFrame, n: int = 4, text: str = "text", out: str = "nbest", path: str | None = None) -> DataFrame:
    """``df`` with the ``n`` best segmentations of a text column."""
    path = path or default_model()
    schema = common.with_fields(df.schema, (out, NBEST))
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, n)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for b in batches:
            found = [[{"score": s, "ids": list(i)} for s, i in own.nbest(t)] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, kind)], names=[*keep, out])

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of a column of ids (null: null)."""
    path = path or default_model()
    schema = common.with_fields(df.schema, (out, T.StringType()))
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = model(path)[1]
        for b in batches:
            texts = [None if x is None else decode(x, raw) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return df.mapInArrow(run, schema)


DIGEST = "doc_id long, n_pieces long, scores array<double>, ids_crc32 long, nbest_crc32 long, round_trip boolean"


def nbest_digests(docs: DataFrame, n: int = 4, path: str | None = None) -> DataFrame:
    """Per document the n best scores, checksums of the best and of all segmentations, and whether each decodes to the text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, n)
        for b in batches:
            rows, ids = [], iter(b.column("doc_id").to_pylist())
            for texts in groups(b.column("text").to_pylist()):
                for text, found in zip(texts, own.words(texts)):
                    best = own.choose(found)
                    changes = [c for _, c in best]
                    packed = own.joined(found, changes)
                    # The first word's mark is no part of the text.
                    want = (text or "").replace(MARK, " ").encode()
                    same = own.first_bytes(found)[1:] == want and own.decode_alike(found, changes)
                    rows.append((next(ids), len(packed[0]) // 4, [s for s, _ in best], zlib.crc32(packed[0]), zlib.crc32(b"".join(packed)), same))
            types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.bool_()]
            names = ["doc_id", "n_pieces", "scores", "ids_crc32", "nbest_crc32", "round_trip"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def op1_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_digests(common.read(spark, sf_dir, "documents"))
