"""Operator 10, substring dedup: content-defined chunking.

A gear rolling hash over the last 16 bytes cuts a text where four of its bits
are zero, so that cuts depend on content alone and chunks line up again soon
after an insertion. Chunks are grouped by a 96-bit digest over the whole corpus;
of each, the first occurrence (least doc_id, then place) stays. An occurrence of
a chunk that is not the first goes if it lies in a run of such chunks of at
least ``MIN_RUN`` bytes or ``MIN_WORDS`` words, so that short common phrases
stay where they are, and passages of short words go as those of long ones do.

Digests are counted before they are shuffled, and the join that brings first
occurrences back is one that adaptive execution can split, so a passage that
very many documents share is no single task.

Defined results: a null text is empty and stays null; documents with a null
doc_id come last, in the order of a hash of their texts; rows with the same
doc_id, or with none and the same text, are one document to each other and to
all others; an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import common

#: A cut after 1 byte in 16 on average, at least MIN and at most MAX bytes after the last: chunks of about 30 bytes.
#: The highest bit of the mask is the 16th, which depends on the last 16 bytes. A repeated passage of 51 words loses its two
#: outer chunks and the bytes that the first cut depends on; what is left passes one of the limits in 9 of 10 cases for words of
#: two letters, and in 98 of 100 for three and more.
MASK, WINDOW = np.uint32(0x0000F000), 16
MIN_CHUNK, MAX_CHUNK = 16, 256
MIN_RUN, MIN_WORDS = 120, 20

#: A random number for each byte, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def gear_cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; no cut parts a character."""
    n = len(text)
    if not n:
        return []
    x = np.frombuffer(text, np.uint8)
    # h[i] is the sum of GEAR[x[i - j]] << j for j below WINDOW, by doubling.
    h, k = GEAR[x], 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
        k *= 2
    fits = (h & MASK) == 0
    starts = np.ones(n + 1, bool)
    starts[:n] = (x & 0xC0) != 0x80
    cuts, last = [], 0
    for cut in (np.flatnonzero(fits & starts[1:]) + 1).tolist():
        while cut - last > MAX_CHUNK:
            last += MAX_CHUNK
            while not starts[last]:
                last -= 1
            cuts.append(last)
        if cut - last >= MIN_CHUNK:
            cuts.append(cut)
            last = cut
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        while not starts[last]:
            last -= 1
        cuts.append(last)
    if last < n:
        cuts.append(n)
    return cuts


def digests(text: bytes) -> list[tuple[int, int, bytes]]:
    """Start, end and 96-bit digest of each chunk."""
    from xxhash import xxh3_128_digest

    cuts = gear_cuts(text)
    return [(s, e, xxh3_128_digest(text[s:e])[:12]) for s, e in zip([0, *cuts], cuts)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct chunk of a document."""
    for b in batches:
        found = [{d for _, _, d in digests(t)} for t in common.utf8(b.column("text"))]
        raw = np.frombuffer(b"".join(d for f in found for d in f), np.dtype([("c1", "<i8"), ("c2", "<i4")]))
        row = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
        yield pa.RecordBatch.from_arrays([pa.array(raw["c1"].copy()), pa.array(raw["c2"].copy()), b.column("doc").take(row)], names=["c1", "c2", "doc"])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc, found): for each document the digests of its chunks that an earlier one has. ``docs`` has doc and text.

    Chunks are made anew for each of the two passes, which is cheaper than to
    write them. First documents are written before they are joined: a join of
    two plain exchanges is one that adaptive execution splits.
    """
    rows = docs.select("doc", "text").mapInArrow(_chunks, "c1 long, c2 int, doc long")
    first = rows.groupBy("c1", "c2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("c1", "c2", "first")
    again = rows.join(common.materialize(first, "chunks"), ["c1", "c2"]).where("doc > first")
    return again.groupBy("doc").agg(F.collect_set(F.struct("c1", "c2")).alias("found"))


def _cut(text: bytes, found: set[bytes], min_run: int, min_words: int) -> list[tuple[int, int]]:
    """The runs of at least ``min_run`` bytes or ``min_words`` words, parts of words included, of chunks that are in ``found`` or were in the text before."""
    seen, spans = set(), []
    for s, e, d in digests(text):
        if d in found or d in seen:
            if spans and spans[-1][1] == s:
                spans[-1][1] = e
            else:
                spans.append([s, e])
        seen.add(d)
    return [(s, e) for s, e in spans if e - s >= min_run or len(text[s:e].split()) >= min_words]


def dedup(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeats cut from ``text``, and n_bytes, n_removed and ``removed`` (byte spans)."""
    columns = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "removed")]
    # A document without an id is known by its text, so that many of them are no one group.
    unnamed = F.lit(2**62) + F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1))
    keyed = common.packed(docs.select(*columns), "doc_id", "text").withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), unnamed))
    both = keyed.join(repeated_chunks(keyed), "doc", "left").drop("doc")
    schema = common.with_fields(both.drop("found").schema, ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("removed", SPANS))
    keep = [f.name for f in schema.fields[:-3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_bytes, n_removed, removed = [], [], [], []
            for text, found in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("found").to_pylist()):
                known = {g["c1"].to_bytes(8, "little", signed=True) + g["c2"].to_bytes(4, "little", signed=True) for g in found or []}
                spans = _cut(text or b"", known, min_run, min_words)
                kept, last = [], 0
                for s, e in spans:
                    kept.append(text[last:s])
                    last = e
                texts.append(b"".join([*kept, text[last:]]) if spans else text)
                n_bytes.append(len(text or b""))
                n_removed.append(sum(e - s for s, e in spans))
                removed.append([{"start": s, "end": e} for s, e in spans])
            new = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(new.get(c, b.column(c)) for c in keep), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span)], names=[*keep, "n_bytes", "n_removed", "removed"])

    return common.unpacked(both.mapInArrow(run, schema), [*columns, "n_bytes", "n_removed", "removed"])


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).withColumn("n_spans", F.size("removed").cast("long"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: all documents, with what repeats cut from their texts; ``n_chars`` follows the text."""
    return common.with_length(dedup(common.packed(docs, "doc_id", "text")), docs)
