"""Operator 8, suffix-array dedup: depth-limited radix sort.

A byte goes if a 400-byte string that covers it starts anywhere else too.
Suffixes are ordered only through 400 bytes, by passes from the most
significant digit on; what is alone after a pass is dropped, and groups that
are equal through all passes are exactly the repeated windows.

Suffixes are ordered at anchors, not at every byte: the anchor of a window is
the gram of 64 bytes in it with the least hash, so equal windows have theirs at
the same place, and neighbouring windows share one.

1. Passes over the suffixes at anchors. Digits are the bytes through 64 (the
   gram), 192 and 400; each pass groups what the one before left
   unresolved, and drops suffixes that are alone. How far a suffix came bounds
   the windows of its anchor that can recur.
2. Windows of an anchor in runs of up to 32. The 369 bytes that a run's
   windows share must recur, else all its windows are unique. If the 431 bytes
   that they cover recur, all are repeated.
3. The whole 400 bytes of each window of the runs left, and of one member of
   each repeated class that shares its inner bytes with others.

Each pass is a grouping by digit (64 bits of digest while suffixes are only
dropped, 128 bits or more where windows are judged) that Spark aggregates before it
shuffles; a passage that a third of the documents share is one group with a
count, not one task. Equal texts are first made one unit.

The same passes over words instead of bytes, through 51 words, give the words
of passages of over 50 words that recur, which may be under 400 bytes long
(``n_repeat_words``); nothing is removed for these.

Defined results: a null text is empty; empty and short texts lose nothing;
repeated rows are copies of each other, so texts of 400 bytes or more go
whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common

DEPTH = 400
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
#: A random number for each byte, from a fixed seed.
_BYTE = np.random.default_rng(20240817).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Unit:
    """What suffixes are made of: tokens through ``depth``, of which a gram is the first digit; the ends of all digits; windows of a run."""

    depth: int
    digits: tuple[int, ...]
    run: int
    words: bool = False

    @property
    def gram(self) -> int:
        return self.digits[0]

    def tokens(self, text: bytes) -> np.ndarray:
        x = np.frombuffer(text, np.uint8)
        return word_hashes(x) if self.words else x


BYTES = Unit(DEPTH, (64, 192, DEPTH), 32)
WORDS = Unit(51, (8, 24, 51), 8, words=True)
#: Both go through all passes together, as rows that say which they are by place.
UNITS = (BYTES, WORDS)


_powers = [np.array([1], np.uint64), np.array([1], np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers, over ``n`` of them, of an odd number and of its inverse; kept for the next text."""
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, x)]) for x in (_ODD, inverse)]
    return _powers[0], _powers[1]


class Stretches:
    """Hashes of any stretches of a text's tokens: polynomials from sums of all before, brought to their start by division."""

    def __init__(self, values: np.ndarray):
        self.power, self.back = powers(len(values))
        with np.errstate(over="ignore"):
            self.total = np.r_[np.uint64(0), np.cumsum(values * self.power[: len(values)], dtype=np.uint64)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.total[end] - self.total[start]) * self.back[start]
            h ^= h >> np.uint64(32)
            h *= _ODD
            return h ^ (h >> np.uint64(29))


def word_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    inside = np.r_[False, ~_SPACE[x], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return Stretches(_BYTE[x]).hashes(edge[::2], edge[1::2]) if len(edge) else np.array([], np.uint64)


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all grams of a size that is a power of two, built from halves."""
    h, k, factor = x.astype(np.uint64) + np.uint64(1), 1, _ODD
    while k < size:
        h = h[:-k] * factor + h[k:]
        factor, k = factor * factor, 2 * k
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(x: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each chosen gram, and the first and last window that it stands for."""
    with np.errstate(over="ignore"):
        h = gram_hashes(x, unit.gram)
    # Of equal hashes the last: its place counts down in the low bits.
    low = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    k, span = 1, unit.depth - unit.gram + 1
    while 2 * k <= span:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    if k < span:
        low = np.minimum(low[: -(span - k)], low[span - k :])
    chosen = (_LOW - (low & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(chosen)] - 1
    at = chosen[first]
    return h[at].view(np.int64), at, first, last


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes at the anchors of each text: hashes through each digit, as far as the text goes."""
    for b in batches:
        got = []
        for i, t in enumerate(common.utf8(b.column("text"))):
            for u, unit in enumerate(UNITS):
                x = unit.tokens(t) if len(t) >= unit.depth else b""
                if len(x) < unit.depth:
                    continue
                h, at, first, last = grams(x, unit)
                of = Stretches(_BYTE[x] if x.dtype == np.uint8 else x)
                # The unit goes into the hash: a digit of words is none of bytes.
                digits = [(h, np.ones(len(at), bool))] + [(of.hashes(at, np.minimum(at + k, len(x))) ^ np.uint64(k), at + k <= len(x)) for k in unit.digits[1:]]
                got.append((np.full(len(at), i), np.full(len(at), u), at, first, last, *(d.view(np.int64) for d, _ in digits), *(whole for _, whole in digits)))
        if got:
            columns = [np.concatenate(c) for c in zip(*got)]
            n = len(BYTES.digits)
            numbers = [pa.array(c) for c in columns[1:5]] + [pa.array(d, mask=~whole) for d, whole in zip(columns[5 : 5 + n], columns[5 + n :])]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(columns[0])), *numbers], names=["key", "u", "at", "first", "last", *(f"d{k}" for k in range(n))])


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each record of a column of lists, and the records' fields."""
    counts = column.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(len(column)), counts), [x.to_numpy().astype(np.int64) for x in column.flatten().flatten()]


def _expanded(start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that stand for ``counts`` numbers from ``start`` on, and these numbers."""
    of = np.repeat(np.arange(len(start)), counts)
    return of, start[of] + np.arange(len(of)) - (np.cumsum(counts) - counts)[of]


def _by_text(texts: list[bytes], row: np.ndarray, u: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes, int, int]]:
    """For each unit of a text in which something was found: the unit, the places found, the tokens as bytes, a token's bytes, the number of tokens."""
    place = row * len(UNITS) + u
    order = np.argsort(place, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
        k = int(u[here[0]])
        x = UNITS[k].tokens(texts[row[here[0]]])
        yield k, here, x.tobytes(), x.itemsize, len(x)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what the windows of a run share, and of what they cover."""
    from xxhash import xxh3_64_intdigest as number
    from xxhash import xxh3_128_digest as digest

    per_run, depths = (np.array([getattr(unit, x) for unit in UNITS]) for x in ("run", "depth"))
    for b in batches:
        texts = common.utf8(b.column("text"))
        row, (u, at, first, last) = _flat(b.column("found"))
        low = (at - last) // per_run[u]
        of, d = _expanded(low, (at - first) // per_run[u] - low + 1)
        row, u, at, first, last = (x[of] for x in (row, u, at, first, last))
        end = at - d * per_run[u]  # the run's last window
        start = end - per_run[u] + 1
        seeds = d << 1 | u
        core, full, orders = [], [], []
        for k, here, raw, w, n in _by_text(texts, row, u):
            orders.append(here)
            s, e, seed = start[here], end[here] + depths[k], seeds[here].tolist()
            core += [digest(raw[x:y], z) for x, y, z in zip((end[here] * w).tolist(), ((s + depths[k]) * w).tolist(), seed)]
            whole = (s >= 0) & (e <= n)
            found = [number(raw[x:y], z) for x, y, z in zip((np.maximum(s, 0) * w).tolist(), (e * w).tolist(), seed)]
            # What the text's ends cut off is equal to nothing.
            for i in np.flatnonzero(~whole).tolist():
                found[i] = number(b"%b %d %d" % (b.column("key")[int(row[here[i]])].as_py(), at[here[i]], seed[i]), 1 << 40)
            full += found
        if orders:
            here = np.concatenate(orders)
            numbers = (u[here], np.maximum(first, start)[here], np.minimum(last, end)[here])
            yield pa.RecordBatch.from_arrays([*_halves(core), pa.array(np.array(full, np.uint64).view(np.int64)), b.column("key").take(pa.array(row[here])), *(pa.array(x.astype(np.int32)) for x in numbers)], names=["c1", "c2", "f", "key", "u", "lo", "hi"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each window of the runs that are left."""
    from xxhash import xxh3_128_digest as digest

    for b in batches:
        texts = common.utf8(b.column("text"))
        row, (u, lo, hi) = _flat(b.column("found"))
        of, p = _expanded(lo, hi - lo + 1)
        row, u = row[of], u[of]
        out, orders = [], []
        for k, here, raw, w, _ in _by_text(texts, row, u):
            orders.append(here)
            wide = UNITS[k].depth * w
            out += [digest(raw[x : x + wide], k) for x in (p[here] * w).tolist()]
        if orders:
            here = np.concatenate(orders)
            yield pa.RecordBatch.from_arrays([*_halves(out), b.column("key").take(pa.array(row[here])), pa.array(u[here].astype(np.int32)), pa.array(p[here].astype(np.int32))], names=["w1", "w2", "key", "u", "p"])


def merged(lo: np.ndarray, hi: np.ndarray, depth: int = DEPTH) -> list[tuple[int, int]]:
    """Maximal runs of what windows cover that start in the given ranges."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order]) + depth
    first = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
    return list(zip(lo[first].tolist(), end[np.r_[first[1:] - 1, len(lo) - 1]].tolist()))


CUT = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeat_words long, spans array<struct<start:long,end:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        row, (u, lo, hi) = _flat(b.column("found"))
        ends = np.searchsorted(row, np.arange(b.num_rows + 1))
        for i, (text, key, copies) in enumerate(zip(common.utf8(b.column("text")), *(b.column(c).to_pylist() for c in ("key", "copies")))):
            here = slice(ends[i], ends[i + 1])
            spans, more = (merged(lo[here][u[here] == k], hi[here][u[here] == k], unit.depth) for k, unit in enumerate(UNITS))
            words = sum(e - s for s, e in more)
            if copies > 1:
                spans = [(0, len(text))] if len(text) >= DEPTH else []
                n = len(text.split())
                words = n if n >= WORDS.depth else 0
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            rows.append((key, len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), words, [{"start": s, "end": e} for s, e in spans]))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), spans_type]
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeat_words", "spans"])


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts with their number of copies, as a table bucketed by ``key``.

    One shuffle brings copies together and makes the buckets; later joins by
    ``key`` leave the texts in place.
    """
    spark = docs.sparkSession
    name = f"units_{uuid.uuid4().hex}"
    found = docs.select(common.text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{common.shared_dir(spark)}/{name}"
    found.write.bucketBy(n, "key").sortBy("key").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.tarn_path = path
    return out


def drop_units(texts: DataFrame) -> None:
    """Remove the table of ``units`` and its files."""
    common.delete(texts.sparkSession, texts.tarn_path)
    texts.sparkSession.sql(f"DROP TABLE IF EXISTS {texts.tarn_path.rpartition('/')[2]}")


def of_unit(values) -> Column:
    """A number of the row's unit."""
    return F.when(F.col("u") == 0, values[0]).otherwise(values[1])


def ordered(texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, u, at, first, last): anchors whose suffixes recur, with the windows that can recur; most significant digit first. And the tables that it reads.

    What a pass drops is kept with the digit that it reached: the suffix is
    then unlike all others before the next digit's end, and so are windows
    that go on beyond it.
    """
    digits = [f"d{k}" for k in range(len(BYTES.digits))]
    schema = "key binary, u long, at long, first long, last long, " + ", ".join(f"{d} long" for d in digits)
    left = common.materialize(texts.select("key", "text").mapInArrow(_anchors, schema), "suffixes")
    reached = []
    for k, digit in enumerate(digits):
        # Groupings are written before they are joined: a join of two plain exchanges is one that adaptive execution splits where a key is hot.
        twice = common.materialize(left.where(F.col(digit).isNotNull()).groupBy(digit).count().where("count > 1").select(F.col(digit).alias("_d")), "twice")
        alone = F.col(digit) == F.col("_d")
        if k:
            # Windows through the digit's end at most.
            less = F.col("at") + of_unit([u.digits[k] - u.depth for u in UNITS])
            out = left.join(twice, alone, "left_anti").select("key", "u", "at", "first", F.least("last", less).alias("last"))
            reached.append(common.materialize(out.where("first <= last"), "reached"))
        left, before = common.materialize(left.join(twice, alone, "left_semi").drop(digit), "suffixes"), left
        common.discard(before)
        common.discard(twice)
    out = left.select("key", "u", "at", "first", "last")
    for more in reached:
        out = out.unionByName(more)
    return out, [left, *reached]


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(key, u, lo, hi): ranges of window starts whose tokens also start elsewhere among ``texts`` (key, text), as a written table."""
    anchors, used = ordered(texts)

    def written(df: DataFrame, name: str) -> DataFrame:
        used.append(common.materialize(df, name))
        return used[-1]

    found = anchors.groupBy("key").agg(F.collect_list(F.struct("u", "at", "first", "last")).alias("found"))
    runs = written(texts.join(found, "key").select("key", "text", "found").mapInArrow(_runs, "c1 long, c2 long, f long, key binary, u int, lo int, hi int"), "runs")
    # What a run covers is told apart among those that share their core, so 64 bits more are enough.
    counted = runs.groupBy("c1", "c2", "f").count()
    alike = written(counted.groupBy("c1", "c2").agg(F.count("*").alias("classes"), F.max("count").alias("most")).where("classes > 1 or most > 1"), "alike")
    near = written(runs.join(alike, ["c1", "c2"], "left_semi"), "near")
    common.discard(runs)
    classes = near.groupBy("c1", "c2", "f").agg(F.count("*").alias("n"), F.min(F.struct("key", "u", "lo", "hi")).alias("one"))
    several = alike.where("classes > 1").select("c1", "c2")
    left = classes.join(several, ["c1", "c2"], "left_semi").select("one.*").groupBy("key").agg(F.collect_list(F.struct("u", "lo", "hi")).alias("found"))
    windows = written(texts.join(left, "key").select("key", "text", "found").mapInArrow(_windows, "w1 long, w2 long, key binary, u int, p int"), "windows")
    same = written(windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"), "same")
    single = windows.join(same, ["w1", "w2"], "left_semi").select("key", "u", F.col("p").alias("lo"), F.col("p").alias("hi"))
    repeated = written(near.groupBy("c1", "c2", "f").count().where("count > 1").select("c1", "c2", "f"), "whole")
    whole = near.join(repeated, ["c1", "c2", "f"], "left_semi").select("key", "u", "lo", "hi")
    out = common.materialize(whole.unionByName(single), "repeated")
    for df in used:
        common.discard(df)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document its bytes, removed bytes and runs, the digest of what is left, the words of repeated passages, and the runs."""
    texts = units(docs)
    repeated = repeated_windows(texts)
    found = repeated.groupBy("key").agg(F.collect_list(F.struct("u", "lo", "hi")).alias("found"))
    cut = common.materialize(texts.join(found, "key", "left").select("key", "text", "copies", "found").mapInArrow(_cut, CUT), "cut")
    drop_units(texts)
    common.discard(repeated)
    return docs.select("doc_id", common.text_key().alias("key")).join(cut, "key").drop("key")


def op8_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read(spark, sf_dir, "documents")).drop("spans")
