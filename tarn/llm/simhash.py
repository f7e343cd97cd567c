"""Operator 2, SimHash near-dedup: bit-sliced comparison.

Texts become 64-bit fingerprints; equal ones are grouped before anything is
compared. Two fingerprints within ``RADIUS`` = 4 bits agree on at least two of
six blocks of bits, so each distinct fingerprint goes into 15 buckets, one for
each pair of blocks, and every link lies within some bucket. A bucket of over
``SPLIT`` fingerprints is dealt anew by 15 pairs of blocks of its other bits,
by the same argument. Within a bucket fingerprints are stored as vertical bit
planes; many distances at once are counted by carry-save adders, and blocks of
lanes whose distances are all over the radius are abandoned. A bucket yields
links that span its components, never all pairs.

Defined results: a null text has no words, and fingerprint zero; a null doc_id
is ignored where the least of a component is sought (only nulls: null); an
empty table gives no rows; repeated rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import common
from tarn.llm.components import components

SHINGLE = 4
RADIUS = 4
SPLIT = 4096
#: Buckets up to this size are compared pair by pair, many buckets at a time.
SMALL = 16


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= k:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: n - k] + 1).tolist()]
    h = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, stops)], np.uint64)
    return int(majority(h)[0])


def majority(h: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes (n, or n rows of several words), as words."""
    # Byte-wide counters for 8 bits a word; 255 rows at most before a counter is full.
    words = h.reshape(len(h), -1).shape[1]
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8 * words)
    counts = np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64 * words).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint as a (signed) long."""
    schema = common.with_fields(df.schema, (out, T.LongType()))
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in common.utf8(b.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps)], names=[*keep, out])

    return df.mapInArrow(run, schema)


def _blocks(bits: list[int], n: int = 6) -> list[list[int]]:
    size, more = divmod(len(bits), n)
    cuts = [i * size + min(i, more) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


BLOCKS = _blocks(list(range(64)))
PAIRS = list(combinations(range(6), 2))


def _mask(bits: list[int]) -> int:
    found = sum(1 << b for b in bits)
    return found - (1 << 64) if found >> 63 else found


def _keys(fp: str) -> Column:
    """The buckets (table, bits) of a fingerprint."""
    return F.array(*(F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(_mask(BLOCKS[i] + BLOCKS[j]))).alias("key")) for t, (i, j) in enumerate(PAIRS)))


def _finer(fp: str) -> Column:
    """For a bucket that is too large: 15 finer ones, by the bits that its own table leaves free."""
    choice = None
    for t, (i, j) in enumerate(PAIRS):
        free = _blocks([b for b in range(64) if b not in BLOCKS[i] + BLOCKS[j]])
        own = F.array(*(F.struct(F.lit(100 + 15 * t + s).alias("t"), F.col(fp).bitwiseAND(F.lit(_mask(BLOCKS[i] + BLOCKS[j] + free[a] + free[b]))).alias("key")) for s, (a, b) in enumerate(PAIRS)))
        choice = F.when(F.col("t") == t, own) if choice is None else choice.when(F.col("t") == t, own)
    return choice


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints of one word, or of rows of several: (bits, words of 64 lanes)."""
    x = x[:, None] if x.ndim == 1 else x
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")
    full = np.zeros((64 * x.shape[1], -(-len(x) // 64) * 64), np.uint8)
    full[:, : len(x)] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _full_adder(a, b, c):
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def within(diff: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The lanes with at most ``radius`` (3 or more) bits set over all planes of ``diff`` (planes, words).

    Seven planes at a time go through carry-save adders into a number of three
    bits, which is added to vertical counters just wide enough for the radius;
    a carry out of them marks a lane as over. Words whose lanes are all over
    are abandoned.
    """
    words, ones = diff.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(words)
    count, over = [np.zeros(words, np.uint64) for _ in range(max(3, radius.bit_length()))], np.zeros(words, np.uint64)
    for at in range(0, len(diff), 7):
        p = list(diff[at : at + 7, live] if len(live) < words else diff[at : at + 7])
        p += [np.zeros_like(over)] * (7 - len(p))
        s, x = _full_adder(p[0], p[1], p[2])
        s, y = _full_adder(s, p[3], p[4])
        s, z = _full_adder(s, p[5], p[6])
        t, f = _full_adder(x, y, z)
        count[0], k = count[0] ^ s, count[0] & s
        count[1], k = _full_adder(count[1], t, k)
        count[2], k = _full_adder(count[2], f, k)
        for i in range(3, len(count)):
            count[i], k = count[i] ^ k, count[i] & k
        over = over | k
        if at + 7 <= radius:
            continue
        # Counts above the radius, from the highest bit down.
        same = ~over
        for i in reversed(range(len(count))):
            if radius >> i & 1:
                same = same & count[i]
            else:
                over = over | (same & count[i])
                same = same & ~count[i]
        alive = over != ones
        if not alive.all():
            live, count, over = live[alive], [c[alive] for c in count], over[alive]
            if not len(live):
                break
    out = np.zeros(words, np.uint64)
    out[live] = ~over
    return out


def bucket_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one large bucket of distinct fingerprints."""
    i, j = bucket_places(fps, radius)
    return fps[i], fps[j]


def bucket_places(fps: np.ndarray, radius: int, absorb: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same links as places in ``fps``, whose fingerprints may have several words.

    Each fingerprint is compared once, with those that no component has yet.
    With ``absorb``, only those within so many bits join a component; others
    within the radius are linked, and stay for the next.
    """
    fps = fps[:, None] if fps.ndim == 1 else fps
    place, left = np.arange(len(fps)), fps
    vertical = planes(left)
    alive = np.zeros(vertical.shape[1] * 64, np.uint8)
    alive[: len(left)] = 1
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    a, b = [], []
    seed, removed = 0, 0
    while True:
        while seed < len(left) and not alive[seed]:
            seed += 1
        if seed == len(left):
            break
        root = int(place[seed])
        alive[seed] = 0
        removed += 1
        front = [root]
        while front:
            q = front.pop()
            query = (np.unpackbits(fps[q].view(np.uint8), bitorder="little").astype(np.uint64) * ones)[:, None]
            hit = within(vertical ^ query, radius) & np.packbits(alive, bitorder="little").view(np.uint64)
            if hit.any():
                found = lanes(hit)
                a.append(np.full(len(found), root if absorb is None else q))
                b.append(place[found])
                if absorb is not None:
                    found = found[np.bitwise_count(left[found] ^ fps[q]).sum(1) <= absorb]
                alive[found] = 0
                removed += len(found)
                front.extend(place[found].tolist())
            if removed > len(left) // 2 and removed > 64:  # store anew what is left
                stay = np.flatnonzero(alive[: len(left)])
                place, left = place[stay], left[stay]
                vertical = planes(left)
                alive = np.zeros(vertical.shape[1] * 64, np.uint8)
                alive[: len(left)] = 1
                seed, removed = 0, 0
    empty = np.array([], np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small buckets: each pair of a bucket is a lane."""
    left, right = [], []
    for n in np.unique(sizes):
        i, j = np.triu_indices(int(n), 1)
        s = starts[sizes == n][:, None]
        left.append((s + i).ravel())
        right.append((s + j).ravel())
    a, b = fps[np.concatenate(left)], fps[np.concatenate(right)]
    close = [lanes(within(planes(a[k : k + 65536] ^ b[k : k + 65536]), radius)) + k for k in range(0, len(a), 65536)]
    found = np.concatenate(close)
    found = found[found < len(a)]
    return a[found], b[found]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of a partition sorted by bucket; a bucket may go over several batches."""

    def linked(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[new, len(fp)])
        u = fp.view(np.uint64)
        small = (sizes > 1) & (sizes <= SMALL)
        found = [_small_links(u, new[small], sizes[small], RADIUS)] if small.any() else []
        found += [bucket_links(u[s : s + n]) for s, n in zip(new[sizes > SMALL], sizes[sizes > SMALL])]
        a, b = (np.concatenate([x[i] for x in found]) if found else np.array([], np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    kept: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, key, fp = (batch.column(c).to_numpy() for c in ("t", "key", "fp"))
        if last is not None and (t[-1], key[-1]) == last:
            kept.append([t, key, fp])
            continue
        cut = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (t[0], key[0]) != (t[-1], key[-1]) else 0
        kept.append([t[:cut], key[:cut], fp[:cut]])
        if sum(len(x[0]) for x in kept):
            yield linked(*(np.concatenate(x) for x in zip(*kept)))
        kept, last = [[t[cut:], key[cut:], fp[cut:]]], (t[-1], key[-1])
    if kept:
        yield linked(*(np.concatenate(x) for x in zip(*kept)))


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column ``fp``) within the radius."""
    rows = distinct.select("fp", F.explode(_keys("fp")).alias("k")).select("k.t", "k.key", "fp")
    large = rows.groupBy("t", "key").count().where(F.col("count") > SPLIT).select("t", "key")
    common_rows = rows.join(large, ["t", "key"], "left_anti")
    finer = rows.join(large, ["t", "key"], "left_semi").select("fp", F.explode(_finer("fp")).alias("k")).select("k.t", "k.key", "fp")
    dealt = common_rows.unionByName(finer)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(_links, "a long, b long")


def labelled(scored: DataFrame) -> DataFrame:
    """(fp, label, least doc_id of the component) for each distinct fingerprint of ``scored`` (doc_id, fp)."""
    groups = common.materialize(scored.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    label = components(links(groups.select("fp")))
    named = groups.join(label, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    # Written first: a join of two plain exchanges is one that adaptive execution splits where a component is large.
    ids = common.materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    return named.join(ids, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    scored = common.materialize(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "simhash")
    return scored.join(labelled(scored), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
