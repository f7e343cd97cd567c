"""Near-duplicates by similarity: SimHash finds candidates, shingles confirm them.

The pipeline's form of operator 2. Texts are sets of shingles of five words;
two are near-duplicates at a Jaccard similarity of at least 0.8. Sets become
fingerprints of 128 bits, in which such pairs differ in 19 bits on average at
0.8, so a fixed few bits would not do. A table takes some of the 128 bits, drawn
once and for all, as its key; fingerprints meet in a bucket if they agree in a
table's bits. The key grows with the number of fingerprints, so that buckets
stay small, and the number of tables with the key, so that a pair 19 bits apart
meets in ``HITS`` tables on average (``drawn``). Two that meet, differ in up to
``RADIUS`` bits, counted on bit planes as in operator 2, and have sets of sizes
that allow a similarity of 0.8, are compared by 256 more bits, each of the least
shingle in an order of its own, of which 26 differ on average at 0.8, and 51 at
0.6; up to ``SKETCH`` make a candidate. So edited copies of one text that are no
near-duplicates of each other are few candidates, however many they are. The
exact similarity of the shingles confirms a candidate or not.

The result is the components of all confirmed candidates, found in two steps:

* First, few tables with long keys: each member of a bucket is held against the
  bucket's first. This joins most of a large group of near copies by as many
  candidates as it has members.
* Then all tables. Members of a bucket whose components differ are candidates;
  members of the bucket's largest component are not compared with each other.
  Candidates do not leave a bucket as pairs, which are as many as the square of
  its members, but as stars: each member with the least one that it is joined
  to. What all stars join is a group, which holds both ends of every candidate.
  A group's members, one row each, are compared there by their exact sets,
  again but for pairs within its largest component. Groups of over ``FIRST``
  members go in blocks, so that no task holds more than two of them.

So no candidate between different components is left untested, whatever the
size of a bucket, and none within a component is needed.

Equal sets of shingles are one node of the graph. What SimHash itself misses is
measured in the README.

Defined results: a null text is empty; texts of under five words have one
shingle, all their words, and texts without words are equal; of a component
the row with the least doc_id stays (null ones last, of equal ones the least
digest of the text); rows that agree in id and text are one; an empty table
gives no rows; other columns are passed on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common
from tarn.llm.components import components
from tarn.llm.simhash import lanes, majority, planes, within

SHINGLE = 5
BITS = 128
#: The farthest that candidates may be apart, and the distance at similarity 0.8.
RADIUS = 28
USUAL = 19
SKETCH = 38
#: Tables in which a pair at the usual distance meets on average; bits of a key at least and at most; nodes of a bucket.
HITS = 5
KEY = (16, 40)
HELD = 256
#: Bits and tables of the first round.
LONG = 40, 16
#: Members of a block of a group, and shingles for each that are compared at once. Buckets of up to ``SMALL`` are compared as lanes.
FIRST, MORE = 256, 8
SMALL = 16
#: Words of bit planes that are compared at once.
PLANES = 1 << 22
SEED = 11
#: A node's fingerprint and sketch.
WORDS = ("lo", "hi", "m0", "m1", "m2", "m3")
#: Bits of the sketch.
LEAST = 256
WORDS_DDL = ", ".join(f"{w} long" for w in WORDS)

def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """128-bit hashes of the distinct shingles of a text: rows of two words."""
    from xxhash import xxh3_128_digest

    words = text.lower().split()
    n, joined = len(words), b" ".join(words)
    if n <= k:
        found = {xxh3_128_digest(joined)} if n else set()
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - k] + 1).tolist()]
        found = {xxh3_128_digest(joined[s:e]) for s, e in zip(starts, ends[k - 1 :].tolist())}
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


#: Odd multipliers, one for each order of the sketch, and the bit of the least product that is kept.
ORDERS = np.random.default_rng(SEED).integers(0, 2**63, LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEPT = np.uint64(23)


def sketch(h: np.ndarray) -> np.ndarray:
    """A bit of the least of the hashes (n, two words) in each of 256 orders, as four words."""
    least = np.full(LEAST, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 256):
        np.minimum(least, (h[at : at + 256, :1] * ORDERS).min(0), out=least)
    return np.packbits((least >> KEPT & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node (a digest of the set of shingles), size of the set and fingerprint of each text."""
    for b in batches:
        nodes, sizes, fps = [], [], np.zeros((b.num_rows, len(WORDS)), np.uint64)
        for i, text in enumerate(common.utf8(b.column("text"))):
            h = shingles(text)
            nodes.append(h.sum(0, dtype=np.uint64).tobytes())
            sizes.append(len(h))
            if len(h):
                fps[i] = *majority(h), *sketch(h)
        fps = fps.view(np.int64)
        numbers = [pa.array(np.ascontiguousarray(fps[:, i])) for i in range(len(WORDS))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), *numbers], names=["doc_id", "key", "node", "size", *WORDS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shingles(t)[:, 0].view(np.int64) for t in common.utf8(b.column("text"))]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        values = np.concatenate(found) if found else np.array([], np.int64)
        yield pa.RecordBatch.from_arrays([b.column("vid"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["vid", "parts"])


def drawn(n: int) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` nodes."""
    bits = min(max(math.ceil(math.log2(max(n, 1) / HELD)), KEY[0]), KEY[1])
    meet = math.prod((BITS - USUAL - i) / (BITS - i) for i in range(bits))
    return bits, math.ceil(HITS / meet)


@cache
def tables(bits: int, n: int) -> np.ndarray:
    """The places of the bits of ``n`` tables."""
    return np.random.default_rng(SEED).permuted(np.tile(np.arange(BITS), (n, 1)), axis=1)[:, :bits]


def dealt(nodes: DataFrame, bits: int, n: int) -> DataFrame:
    """``nodes`` (vid, label, size, ``WORDS``), a row for each table, with its bucket there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fps = np.stack([b.column(c).to_numpy() for c in ("lo", "hi")], 1)
                own = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little").astype(bool)
                weights = np.int64(1) << np.arange(bits, dtype=np.int64)
                for t, places in enumerate(tables(bits, n)):
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, places] @ weights + (t << bits)), *b.columns], names=["bucket", *names])

    names = ["vid", "label", "size", *WORDS]
    return nodes.select(*names).mapInArrow(run, f"bucket long, vid long, label long, size int, {WORDS_DDL}")


def like_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * np.minimum(a, b).astype(np.int64) >= 4 * np.maximum(a, b).astype(np.int64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (the first two words of each row)."""
    return np.bitwise_count(a[:, :2] ^ b[:, :2]).sum(1, dtype=np.int64)


def like_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, 2:] ^ b[:, 2:]).sum(1, dtype=np.int64) <= SKETCH


def star_links(start: np.ndarray, vid: np.ndarray, size: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of buckets that begin at ``start``, each member and the first, if they can be alike."""
    first = np.repeat(start, np.diff(np.r_[start, len(vid)]))
    at = np.flatnonzero(first < np.arange(len(vid)))
    at = at[like_sizes(size[at], size[first[at]])]
    at = at[(_distance(fps[at], fps[first[at]]) <= RADIUS) & like_sketches(fps[at], fps[first[at]])]
    return vid[first[at]], vid[at]


def small_links(start: np.ndarray, sizes: np.ndarray, label: np.ndarray, size: np.ndarray, fps: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (places) within many small buckets: each pair of a bucket is a lane."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes):
        i, j = np.triu_indices(int(n), 1)
        s = start[sizes == n][:, None]
        left.append((s + i).ravel())
        right.append((s + j).ravel())
    i, j = np.concatenate(left), np.concatenate(right)
    some = (label[i] != label[j]) & (asks[i] | asks[j])
    i, j = i[some], j[some]
    some = like_sizes(size[i], size[j])
    i, j = i[some], j[some]
    bits = np.ascontiguousarray(fps[:, :2])
    found = [np.zeros(0, np.int64), *(k + lanes(within(planes(bits[i[k : k + 65536]] ^ bits[j[k : k + 65536]]), RADIUS)) for k in range(0, len(i), 65536))]
    found = np.concatenate(found)
    found = found[found < len(i)]
    found = found[like_sketches(fps[i[found]], fps[j[found]])]
    return i[found], j[found]


def large_links(label: np.ndarray, size: np.ndarray, fps: np.ndarray, asks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (places) within one bucket, for each member that asks its ``most`` closest, and the members that have more."""
    names, code, n = np.unique(label, return_inverse=True, return_counts=True)
    queries = np.flatnonzero(asks & (code != n.argmax()))
    asked = np.zeros(len(label), bool)
    asked[queries] = True
    vertical = planes(np.ascontiguousarray(fps[:, :2]))
    step = max(PLANES // vertical.size, 1)
    a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        bits = np.unpackbits(np.ascontiguousarray(fps[q, :2]).view(np.uint8), axis=1, bitorder="little").T
        diff = vertical[:, None, :] ^ (bits.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF))[:, :, None]
        i, j = divmod(lanes(within(diff.reshape(BITS, -1), RADIUS)), vertical.shape[1] * 64)
        i, j = i[j < len(fps)], j[j < len(fps)]
        # Of two members that ask, the first does.
        some = (label[q[i]] != label[j]) & ~(asked[j] & (j < q[i]))
        i, j = i[some], j[some]
        some = like_sizes(size[q[i]], size[j]) & like_sketches(fps[q[i]], fps[j])
        i, j = q[i[some]], j[some]
        order = np.lexsort((j, _distance(fps[i], fps[j]), i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        a.append(i[rank < most])
        b.append(j[rank < most])
        more.append(i[rank == most])
    return np.concatenate(a), np.concatenate(b), np.concatenate(more)


def stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` places joined by links (i, j): the least of its component and the place, for all others than the least."""
    least = np.arange(n)
    while True:
        low, new = np.minimum(least[i], least[j]), least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == least).all():
            at = np.flatnonzero(least < np.arange(n))
            return least[at], at
        least = new


def large_stars(label: np.ndarray, size: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the candidates of one bucket join; few members ask at a time, so that their pairs fit in memory."""
    n = len(label)
    names, code, counts = np.unique(label, return_inverse=True, return_counts=True)
    queries = np.flatnonzero(code != counts.argmax())
    step = max(PLANES // n, 1)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(queries), step):
        asks = np.zeros(n, bool)
        asks[queries[at : at + step]] = True
        i, j, _ = large_links(label, size, fps, asks, n)
        a, b = stars(np.r_[a, i], np.r_[b, j], n)
    return a, b


def linked(rows: DataFrame, first: bool = False) -> DataFrame:
    """What the candidates of each bucket of what was ``dealt`` join, as stars (a, b), a < b. ``first``: each member with its bucket's first, if these are candidates."""

    def links(bucket, vid, label, size, fps) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[new, len(vid)])
        if first:
            a, b = star_links(new, vid, size, fps)
        else:
            few = (sizes > 1) & (sizes <= SMALL)
            found = [stars(*small_links(new[few], sizes[few], label, size, fps, np.ones(len(vid), bool)), len(vid))]
            for s, n in zip(new[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                i, j = large_stars(*(x[s : s + n] for x in (label, size, fps)))
                found.append((i + s, j + s))
            a, b = (vid[np.concatenate(x)] for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # a bucket may go over several batches
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, vid, label, size = (batch.column(c).to_numpy() for c in ("bucket", "vid", "label", "size"))
            fps = np.stack([batch.column(c).to_numpy() for c in WORDS], 1).view(np.uint64)
            now = (bucket, vid, label, size, fps)
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut or not kept or kept[-1][0][-1] != bucket[0]:
                kept.append(tuple(x[:cut] for x in now))
                if sum(len(x[0]) for x in kept):
                    yield links(*(np.concatenate(x) for x in zip(*kept)))
                kept = []
            kept.append(tuple(x[cut:] for x in now))
        if kept:
            yield links(*(np.concatenate(x) for x in zip(*kept)))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "vid").mapInArrow(run, "a long, b long").distinct()


def _same_row(left: DataFrame, right: DataFrame):
    return left.doc_id.eqNullSafe(right.w_id) & (left.key == right.w_key)


class Sets:
    """The sets of shingles of nodes that are ends of links, each made once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes, self.made = docs, nodes, None

    def of(self, links: DataFrame) -> DataFrame:
        ends = links.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
        if self.made is not None:
            ends = ends.join(self.made, "vid", "left_anti")
        needed = common.materialize(self.nodes.join(ends, "vid", "left_semi").select("vid", "w_id", "w_key"), "needed")
        texts = self.docs.join(needed, _same_row(self.docs, needed)).select("vid", "text")
        # Repeated rows give a node's text more than once.
        sets = texts.mapInArrow(_sets, "vid long, parts array<long>").groupBy("vid").agg(F.first("parts").alias("parts"))
        sets = common.materialize(sets, "sets")
        self.made = sets if self.made is None else self.made.unionByName(sets)
        return self.made


def confirmed(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) whose sets (vid, parts) have a similarity of at least 0.8."""
    both = links.join(sets.select(F.col("vid").alias("a"), F.col("parts").alias("x")), "a").join(sets.select(F.col("vid").alias("b"), F.col("parts").alias("y")), "b")
    common_ = F.size(F.array_intersect("x", "y"))
    # 5 * common >= 4 * (x + y - common)
    return both.where(9 * common_ >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def alike(values: np.ndarray, sizes: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) of a left and a right one of other labels whose sets have a similarity of at least 0.8; ``values`` has the sets one after the other."""
    n = len(sizes)
    order = np.argsort(values, kind="stable")
    owner, v = np.repeat(np.arange(n), sizes)[order], values[order]
    new = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    times = np.diff(np.r_[new, len(v)])
    # Shingles of one set alone count in its size only.
    owner, column = owner[np.repeat(times > 1, times)], np.repeat(np.arange((times > 1).sum()), times[times > 1])
    left, right = np.flatnonzero(left), np.flatnonzero(right)
    both = np.zeros((len(left), len(right)), np.float32)
    wide = FIRST * MORE
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        here = slice(*np.searchsorted(column, (at, at + wide)))
        has = np.zeros((n, min(wide, int(column[-1]) + 1 - at)), np.float32)
        has[owner[here], column[here] - at] = 1
        both += has[left] @ has[right].T
    # 5 * common >= 4 * (x + y - common)
    i, j = np.nonzero((9 * both >= 4 * (sizes[left][:, None] + sizes[right])) & (label[left][:, None] != label[right]))
    return left[i], right[j]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each cell (group, q, m), as stars; a cell may go over several batches."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        cell = np.stack([rows.column(c).to_numpy() for c in ("group", "q", "m")], 1)
        vid, label, left, right = (rows.column(c).to_numpy() for c in ("vid", "label", "left", "right"))
        parts = rows.column("parts").combine_chunks()
        values, sizes = parts.flatten().to_numpy(), parts.value_lengths().to_numpy().astype(np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        new = np.r_[np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)]), len(vid)]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(new[:-1].tolist(), new[1:].tolist()):
            i, j = stars(*alike(values[ends[s] : ends[e]], sizes[s:e], label[s:e], left[s:e], right[s:e]), e - s)
            a.append(vid[i + s])
            b.append(vid[j + s])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.table(batch)
        cell = np.stack([now.column(c).to_numpy() for c in ("group", "q", "m")], 1)
        cut = now.num_rows - int((cell == cell[-1]).all(1).sum())
        if kept and (cut or (np.array([kept[-1].column(c)[-1].as_py() for c in ("group", "q", "m")]) != cell[0]).any()):
            yield links(pa.concat_tables([*kept, now.slice(0, cut)]))
            kept = []
        elif cut:
            yield links(now.slice(0, cut))
        kept.append(now.slice(cut))
    if kept:
        yield links(pa.concat_tables(kept))


def compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join what is alike within each group of ``members`` (vid, label, group), by ``sets`` (vid, parts).

    Members outside the largest label of a group ask all its members. Both are
    dealt into blocks, each pair of which is a cell of its own.
    """
    of_label = members.groupBy("group", "label").count()
    whole = of_label.groupBy("group").agg(F.sum("count").alias("n"), F.max(F.struct("count", "label")).alias("top"))

    def blocks(n):
        return F.ceil(n / F.lit(FIRST)).cast("int")

    whole = common.materialize(whole.select("group", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.count")).alias("nq"), blocks(F.col("n")).alias("nm")), "groups")
    place = members.join(whole, "group").withColumn("asks", F.col("label") != F.col("top"))
    own_q, own_m = (F.pmod(F.xxhash64("vid"), F.col(n)).cast("int") for n in ("nq", "nm"))
    place = place.select("group", "vid", "label", "asks", "nq", "nm", F.when(F.col("asks"), own_q).otherwise(0).alias("own_q"), own_m.alias("own_m"))
    asked = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: F.struct(q.alias("q"), F.col("own_m").alias("m")))
    asking = F.transform(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("nm") - 1).otherwise(0)), lambda m: F.struct(F.col("own_q").alias("q"), F.when(F.col("asks"), m).otherwise(F.col("own_m")).alias("m")))
    rows = place.join(sets, "vid").withColumn("cell", F.explode(F.array_union(asked, asking)))
    left, right = F.col("asks") & (F.col("own_q") == F.col("cell.q")), F.col("own_m") == F.col("cell.m")
    rows = rows.select("group", "cell.q", "cell.m", "vid", "label", left.alias("left"), right.alias("right"), "parts")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "group", "q", "m").sortWithinPartitions("group", "q", "m", "vid").mapInArrow(_compare, "a long, b long").distinct()


def grouped(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) for the nodes that have a near-duplicate; ``docs`` has doc_id, key and text, ``nodes`` vid, size, ``WORDS`` and the row (w_id, w_key) of one text."""
    sets = Sets(docs, nodes)
    bits, n = drawn(nodes.count())
    alone = nodes.select("vid", F.col("vid").alias("label"), "size", *WORDS)
    first = common.materialize(linked(dealt(alone, *LONG), first=True), "candidates")
    known = common.materialize(confirmed(first, sets.of(first)), "confirmed")
    label = components(known)
    named = alone.drop("label").join(label.withColumnRenamed("node", "vid"), "vid", "left").withColumn("label", F.coalesce("label", "vid"))
    named = common.materialize(named, "labelled")
    found = common.materialize(linked(dealt(named, bits, n)), "candidates")
    group = components(found).select(F.col("node").alias("vid"), F.col("label").alias("group"))
    members = common.materialize(group.join(named.select("vid", "label"), "vid"), "members")
    more = common.materialize(compared(members, sets.of(found)), "confirmed")
    common.discard(named)
    return label if more.isEmpty() else components(known.unionByName(more))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each component of near-duplicates one row stays."""
    rows = common.packed(docs, "doc_id", "text").withColumn("key", common.text_key())
    own = docs.schema["doc_id"].dataType.simpleString()
    slim = rows.select("doc_id", "key", "text").mapInArrow(_signatures, f"doc_id {own}, key binary, node binary, size int, {WORDS_DDL}")
    slim = common.materialize(slim, "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key"))
    nodes = slim.groupBy("node", "size", *WORDS).agg(first.alias("w")).select(F.monotonically_increasing_id().alias("vid"), "size", *WORDS, F.col("w.doc_id").alias("w_id"), F.col("w.key").alias("w_key"))
    nodes = common.materialize(nodes, "nodes")
    label = grouped(rows, nodes)
    named = nodes.join(label, F.col("vid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "vid"))
    best = named.groupBy("label").agg(F.min(F.struct(F.col("w_id").isNull().alias("n"), "w_id", "w_key")).alias("w")).select("w.w_id", "w.w_key")
    # Rows that agree in id and text: only these have to be looked at for repeats, so texts are not shuffled once more.
    again = slim.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    stays = common.materialize(best.join(again.withColumn("again", F.lit(True)), best.w_id.eqNullSafe(again.doc_id) & (best.w_key == again.key), "left").select("w_id", "w_key", F.coalesce("again", F.lit(False)).alias("again")), "stays")
    for used in (slim, nodes):
        common.discard(used)
    single, several = stays.where("not again"), stays.where("again")
    out = rows.join(single, _same_row(rows, single), "left_semi").unionByName(rows.join(several, _same_row(rows, several), "left_semi").dropDuplicates(["doc_id", "key"]))
    return common.unpacked(out, docs.columns)
