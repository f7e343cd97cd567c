"""Operator 12, vector code compression: product codes by filtering Lloyd.

Components become integers, vectors are cut into ``PARTS`` parts, and each part
position has a codebook of ``ENTRIES`` entries, moved in rounds to the means of
the parts nearest to them. All arithmetic is in integers and so exact.

The table is cut into chunks of at most ``CHUNK`` vectors. One job builds a
kd-tree for each chunk and part position and writes it, with each node's box,
sum and count. A round reads the trees with the codebooks at hand: going down a
tree, an entry leaves the candidates of a node if another one is nearer in all
of the node's box; a node with one candidate left is assigned as a whole by its
cached sum and count, and only points of leaves with several are compared one
by one. Each task gives its sums by entry, which Spark adds up; the driver gets
as many numbers as the codebooks have. A lost executor costs its tasks again.

Defined results: a null vector, or one with null or non-finite components, is
dropped, and so is one whose length is not that of most others (of equally many
the longest) or no positive multiple of ``PARTS``, as no codebook could fit it.
The seeds have the least distinct ids, null last; of rows with one id the
least vector is the seed. With fewer ids the codebooks are shorter. Repeated
rows each count and stay. Components of any size are taken exactly; an error
beyond a long is given as the largest long. A null label is a label. An empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import common

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
CHUNK = 4096
LEAF = 16
SALTS = 32
LARGEST = 2**63 - 1
#: Below this all squares and sums of a chunk fit 64 bits; beyond it arrays hold Python's integers.
SMALL = 2**24
#: Sums travel as digits of this many bits, so that longs hold them.
DIGIT = 30
PARTIAL = "part int, entry int, at int, digit int, value long"
#: Rows of trees are large: files have their true size, which bounds what a task reads.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


class Level(NamedTuple):
    """The nodes of one level: (part, node, place) and (part, node)."""

    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


class Forest(NamedTuple):
    """Trees of a chunk. points: (part, row, place); order: the rows of each part by leaf, the last row again to fill up; real: which are no fill."""

    points: np.ndarray
    order: np.ndarray
    real: np.ndarray
    levels: list[Level]


def integers(vectors) -> np.ndarray:
    """floor(SCALE * x) of all components."""
    found = np.asarray(vectors, np.float64)
    if not found.size or np.abs(found).max() * SCALE < SMALL:
        return np.floor(found * SCALE).astype(np.int64)
    return np.array([[math.floor(Fraction(x) * SCALE) for x in v] for v in found.tolist()], object)


def slim(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    return x if x.dtype == object or not x.size else x.astype(np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())))


def wide(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64)


def cut(vectors: np.ndarray) -> np.ndarray:
    """(part, row, place) of (row, component)."""
    return vectors.reshape(len(vectors), PARTS, -1).transpose(1, 0, 2)


def forest(points: np.ndarray) -> Forest:
    """Balanced kd-trees, all parts and nodes of a level at a time: each node is halved along its widest place."""
    n = points.shape[1]
    leaves = 1 << max(math.ceil(math.log2(n / LEAF)), 0)
    full = leaves * -(-n // leaves)
    order = np.tile(np.minimum(np.arange(full), n - 1), (PARTS, 1))
    real = np.tile(np.arange(full) < n, (PARTS, 1))
    part = np.arange(PARTS)[:, None, None]
    nodes = 1
    while nodes < leaves:
        order, real = order.reshape(PARTS, nodes, -1), real.reshape(PARTS, nodes, -1)
        own = points[part, order]
        widest = (own.max(2) - own.min(2)).argmax(-1)
        by = np.take_along_axis(own, widest[:, :, None, None], -1)[..., 0].argsort(-1, kind="stable")
        order, real = (np.take_along_axis(x, by, -1).reshape(PARTS, -1) for x in (order, real))
        nodes *= 2
    own, held = points[part, order.reshape(PARTS, leaves, -1)], real.reshape(PARTS, leaves, -1)
    level = Level(own.min(2), own.max(2), (own * held[..., None]).sum(2), held.sum(2))
    levels = [level]
    while levels[0].counts.shape[1] > 1:
        low, high, sums, counts = ((x[:, ::2], x[:, 1::2]) for x in levels[0])
        levels.insert(0, Level(np.minimum(*low), np.maximum(*high), sum(sums), sum(counts)))
    return Forest(points, order, real, levels)


def nearest(distance: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The least of each row's candidates; the first of equal ones."""
    return np.where(candidates, distance, distance.max() + 1).argmin(-1)


def assigned(trees: Forest, books: np.ndarray) -> np.ndarray:
    """``filtered`` for all points: the entry of each (part, row)."""
    owner = np.zeros(trees.points.shape[:2], np.int64)

    def settle(part, rows, entry):
        owner[part, rows] = entry

    filtered(trees, books, settle)
    return owner


def filtered(trees: Forest, books: np.ndarray, settle=None) -> tuple[np.ndarray, np.ndarray]:
    """Sums (part, entry, place) and counts (part, entry) of the points nearest to each entry of ``books``; settle(part, rows, entry) is told which."""
    if books.dtype == object or trees.points.dtype == object:
        books = books.astype(object)
    entries = np.arange(books.shape[1])
    sums, counts = np.zeros(books.shape, books.dtype), np.zeros(books.shape[:2], np.int64)
    part, node = np.arange(PARTS), np.zeros(PARTS, np.int64)
    candidates = np.ones((PARTS, len(entries)), bool)
    for level in trees.levels:
        low, high, own = level.low[part, node][:, None], level.high[part, node][:, None], books[part]
        best = nearest(((2 * own - low - high) ** 2).sum(-1), candidates)
        chosen = np.take_along_axis(own, best[:, None, None], 1)
        corner = np.where(own > chosen, high, low)  # the point of the box where an entry is best off against the chosen one
        behind = ((corner - own) ** 2 - (corner - chosen) ** 2).sum(-1)
        candidates = candidates & ~((behind > 0) | ((behind == 0) & (entries > best[:, None])))
        whole = candidates.sum(1) == 1
        at, one, entry = part[whole], node[whole], candidates[whole].argmax(1)
        np.add.at(sums, (at, entry), level.sums[at, one])
        np.add.at(counts, (at, entry), level.counts[at, one])
        if settle is not None and len(at):
            settle(at[:, None], trees.order.reshape(PARTS, level.counts.shape[1], -1)[at, one], entry[:, None])
        part, node, candidates = part[~whole], node[~whole], candidates[~whole]
        if not len(part):
            return sums, counts
        if level is not trees.levels[-1]:
            part, candidates = part.repeat(2), candidates.repeat(2, 0)
            node = (2 * node[:, None] + [0, 1]).ravel()
    leaves = trees.levels[-1].counts.shape[1]
    rows, real = (x.reshape(PARTS, leaves, -1)[part, node] for x in (trees.order, trees.real))
    points = trees.points[part[:, None], rows]
    entry = np.empty(rows.shape, np.int64)
    for at in range(0, len(part), 256):  # so that the table of distances stays small
        here = slice(at, at + 256)
        entry[here] = nearest(((points[here, :, None] - books[part[here], None]) ** 2).sum(-1), candidates[here, None])
    part = np.broadcast_to(part[:, None], rows.shape)
    np.add.at(sums, (part[real], entry[real]), points[real])
    np.add.at(counts, (part[real], entry[real]), 1)
    if settle is not None:
        settle(part, rows, entry)
    return sums, counts


def packed(trees: Forest) -> bytes:
    return pickle.dumps(Forest(slim(trees.points), slim(trees.order), trees.real, [Level(*map(slim, x)) for x in trees.levels]))


def unpacked(blob: bytes) -> Forest:
    points, order, real, levels = pickle.loads(blob)
    return Forest(wide(points), wide(order), real, [Level(*map(wide, x)) for x in levels])


def grown(kept: DataFrame) -> DataFrame:
    """Chunks of ``kept`` (vec_id, embedding, label): ids, labels, trees."""
    schema = T.StructType([T.StructField(f"{n}s", T.ArrayType(kept.schema[c].dataType)) for n, c in (("id", "vec_id"), ("label", "label"))] + [T.StructField("trees", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                vectors = b.column("embedding")
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([packed(forest(cut(integers(flat))))], pa.binary())], names=schema.names)

    return kept.select("vec_id", "embedding", "label").mapInArrow(run, schema)


def digits(part: np.ndarray, entry: np.ndarray, at: np.ndarray, value: np.ndarray) -> list[tuple]:
    """Rows (part, entry, at, digit, value) whose sums, weighted by digit, are the integers ``value``."""
    rows, digit = [], 0
    while True:
        last = not len(value) or abs(value).max() < 1 << DIGIT + 3
        now = value if last else value & ((1 << DIGIT) - 1)
        rows += [(*map(int, x[:3]), digit, int(x[3])) for x in zip(part, entry, at, now) if x[3]]
        if last:
            return rows
        value, digit = value >> DIGIT, digit + 1


def partial_sums(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """Sums by (part, entry, place), counts at the place after the last, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = books.shape
        total = np.zeros((*shape[:2], shape[2] + 1), object)
        for b in batches:
            for blob in b.column("trees"):
                sums, counts = filtered(unpacked(blob.as_py()), books)
                total += np.concatenate([sums.astype(object), counts.astype(object)[..., None]], 2)
        part, entry, at = (x.ravel() for x in np.indices(total.shape))
        rows = digits(part, entry, at, total.ravel())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "at", "digit", "value"])

    return chunks.select("trees").mapInArrow(run, PARTIAL)


def moved(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    total = np.zeros((*books.shape[:2], books.shape[2] + 1), object)
    for r in partial_sums(chunks, books).groupBy("part", "entry", "at", "digit").agg(F.sum("value").alias("value")).collect():
        total[r.part, r.entry, r.at] += r.value << DIGIT * r.digit
    sums, counts = total[..., :-1], total[..., -1:]
    found = np.where(counts > 0, sums // np.where(counts > 0, counts, 1), books.astype(object))
    return narrow(found)


def narrow(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers if the squares fit them."""
    return x.astype(np.int64) if not x.size or abs(x).max() < SMALL else x.astype(object)


def coded(chunks: DataFrame, books: np.ndarray, kept: DataFrame) -> DataFrame:
    """(vec_id, label, code, error)."""
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, blob in enumerate(b.column("trees")):
                trees = unpacked(blob.as_py())
                owner = assigned(trees, books)
                error = ((trees.points - books[np.arange(PARTS)[:, None], owner]) ** 2).sum((0, 2))
                codes = ["".join(f"{x:02x}" for x in row) for row in owner.T.tolist()]
                error = pa.array([min(int(x), LARGEST) for x in error], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(), pa.array(codes, pa.string()), error], names=schema.names)

    return chunks.mapInArrow(run, schema)


def usable(vectors: DataFrame) -> DataFrame:
    """The rows whose vectors are whole and of the usual length."""
    # Of float vectors, too, all finite ones are below the largest double.
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x).cast("double") == float("inf")))
    whole = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & ~bad)
    lengths = whole.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return whole.where(F.size("embedding") == (lengths["length"] if lengths else 0))


def first_books(kept: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, place) of the vectors with the least ids."""
    ids = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    wanted = F.col("vec_id").isin(known) if known else F.lit(False)
    if None in ids:
        wanted = wanted | F.col("vec_id").isNull()
    vectors = {r.vec_id: r.least for r in kept.where(wanted).groupBy("vec_id").agg(F.min("embedding").alias("least")).collect()}
    return cut(integers([vectors[i] for i in ids])) if ids else np.zeros((PARTS, 0, 0), np.int64)


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for ``vectors`` (vec_id, embedding, label)."""
    kept = usable(vectors.select("vec_id", "embedding", "label"))
    books = narrow(first_books(kept, entries))
    chunks = common.materialize(grown(kept), "trees", **PLAIN)
    for _ in range(rounds if books.size else 0):
        books = moved(chunks, books)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    found = common.materialize(coded(chunks, books, kept), "codes")
    common.discard(chunks)
    # The rows of a frequent label are dealt to SALTS tasks, each with a copy of the label's sum.
    total = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy("label").agg(total.alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("to"))
    salted = found.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    out = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_filtering_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.read(spark, sf_dir, "embeddings"))
