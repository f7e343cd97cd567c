"""Operator 7, packing: best-fit decreasing.

Every document becomes token ids and the end id. A document of over ``WINDOW``
ids is first cut into full windows; what is left of each goes, longest first,
into the open window with the least room that still holds it. A segment tree
indexed by remaining capacity finds that window in ten steps.

Documents are dealt by a hash of the row into bins of about
``BIN_DOCS`` documents, and each bin is packed on its own: a bin has thousands
of pieces, so that what stays open at its end is a small share, and bins are
independent of each other and repeatable if an executor is lost. A hot source
plays no part. Only lengths and checksums are shuffled, never texts or ids.

Defined results: a null text is empty and gives the end id alone; repeated
rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common

WINDOW = 1024
BIN_DOCS = 2048
END_ID = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _encoder(path: str):
    """The vocabulary's encoder. tiktoken runs the same merges four times faster than the library that reads the file.

    A text that holds the string of a special token goes to that library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(open(path, encoding="utf-8").read())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = [x["content"] for x in model["added_tokens"]]
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long"


def pieces(docs: DataFrame, bins: int, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: full windows, and the rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for b in batches:
            rows = []
            for doc, text, to in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("bin").to_pylist()):
                ids = encode(text or "")
                ids.append(END_ID)
                raw = np.array(ids, "<u4").tobytes()
                rows += [(doc, s, min(window, len(ids) - s), zlib.crc32(raw[4 * s : 4 * (s + window)]), len(ids), to) for s in range(0, len(ids), window)]
            names = [x.split()[0] for x in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(names), names=names)

    # The row's place is hashed too: repeated rows, or many without an id, are no one bin.
    row = F.xxhash64("doc_id", F.length("text"), F.monotonically_increasing_id())
    salted = docs.select("doc_id", "text", F.pmod(row, F.lit(bins)).alias("bin"))
    return salted.mapInArrow(run, PIECE)


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; lengths come in falling order.

    The tree's leaf r says whether a sequence with exactly r free places is
    open; an inner node, whether one is open below it.
    """
    size = 1 << window.bit_length()
    tree = bytearray(2 * size)
    open_: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset, used = [], [], 0
    for n in lengths:
        p = size + n
        if not tree[p]:  # else: exactly n places are free somewhere
            while p > 1 and (p & 1 or not tree[p + 1]):
                p >>= 1
            if p > 1:
                p += 1
                while p < size:
                    p = 2 * p if tree[2 * p] else 2 * p + 1
            else:
                p = 0
        if p:
            room = p - size
            s = open_[room].pop()
            if not open_[room]:
                while p and tree[p] and (p >= size or not (tree[2 * p] or tree[2 * p + 1])):
                    tree[p] = 0
                    p >>= 1
        else:
            room, s, used = window, used, used + 1
        sequence.append(s)
        offset.append(window - room)
        room -= n
        if room:
            open_[room].append(s)
            p = size + room
            while p and not tree[p]:
                tree[p] = 1
                p >>= 1
    return sequence, offset


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, bin_docs: int = BIN_DOCS) -> DataFrame:
    """One row per piece with the sequence and the place there."""
    bins = max(1, docs.count() // bin_docs)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit(part.column("length").to_pylist(), window)
        # Sequence k of bin b: unique over all bins.
        sequence = np.array(sequence, "int64") * bins + part.column("bin").to_numpy()
        return part.drop_columns(["bin"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset, pa.int64()))

    return pieces(docs, bins, vocabulary or default_vocabulary(), window).groupBy("bin").applyInArrow(run, PACKED)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage."""
    return pack(docs)
