"""Operator 9, media columns: signature sniffing.

One Aho-Corasick automaton finds the magic bytes of all known formats in one
pass over a blob. A hit counts only if the validator of its format confirms
the structure and the lengths that the header states. The medium at offset 0
corrects the declared type; every other confirmed one is carved: reported with
its place, length and digest, or cut out as a row of its own (``carve``).

Where a format is a chain of chunks or blocks, each place of a chain is walked
once for all hits that lead to it, so that many repeated headers before one
long tail do not take a square of its length.

Defined results: a null blob counts as empty; an empty or unknown blob has
the type ``application/octet-stream`` and no media; of two hits at one place
both count if both are confirmed; media are in order of offset, then length;
columns of the input that clash with the operator's own are replaced; repeated
rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarn.llm import common

UNKNOWN = "application/octet-stream"

#: Payloads are padded with spaces to a multiple of so many bytes: one row of
#: 64 pixels of 3 samples.
BLOCK = 192

#: Magic bytes and their place from the start of the medium (fixed values).
MAGIC = (
    (b"RIFF", 0, "audio/wav"),
    (b"BM", 0, "image/bmp"),
    (b".snd", 0, "audio/basic"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
)


def wav(payload: bytes, inner: bytes = b"", rate: int = 8000) -> bytes:
    """8-bit PCM, one channel; a chunk of odd length gets a pad byte. ``inner`` is a cover picture in a chunk of its own."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack("<4sI", kind, len(body)) + body + b"\0" * (len(body) % 2)

    fmt = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8))
    body = b"WAVE" + fmt + (chunk(b"cart", inner) if inner else b"") + chunk(b"data", payload)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp(payload: bytes, inner: bytes = b"") -> bytes:
    """24 bits a pixel, rows of 64 pixels from the top; ``inner`` lies before them."""
    rows, start = len(payload) // BLOCK, 54 + len(inner)
    head = struct.pack("<IiiHHIIiiII", 40, 64, -rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0)
    return struct.pack("<2sIHHI", b"BM", start + len(payload), 0, 0, start) + head + inner + payload


def au(payload: bytes, inner: bytes = b"", rate: int = 8000) -> bytes:
    """8-bit linear samples, one channel; ``inner`` is the annotation."""
    return struct.pack(">4sIIIII", b".snd", 24 + len(inner), len(payload), 2, rate, 1) + inner + payload


def png(payload: bytes, inner: bytes = b"") -> bytes:
    """8-bit RGB, rows of 64 pixels, no filter; ``inner`` is a private chunk."""
    rows = len(payload) // BLOCK
    raw = b"".join(b"\0" + payload[i * BLOCK : (i + 1) * BLOCK] for i in range(rows))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", 64, rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"prVw", inner) if inner else b"") + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def png_samples(blob: bytes) -> bytes:
    """What ``png`` was given."""
    p, data = 8, b""
    while p < len(blob):
        n, kind = struct.unpack_from(">I", blob, p)[0], blob[p + 4 : p + 8]
        data += blob[p + 8 : p + 8 + n] if kind == b"IDAT" else b""
        p += 12 + n
    raw = zlib.decompress(data)
    return b"".join(raw[i + 1 : i + 1 + BLOCK] for i in range(0, len(raw), BLOCK + 1))


def follow(memo: dict, p: int, step):
    """The end of a chain of places: ``step`` gives the next place, or the end in a tuple. No place is walked twice."""
    passed = []
    while p not in memo:
        passed.append(p)
        got = step(p)
        if isinstance(got, tuple):
            memo[p] = got[0]
        else:
            p = got
    end = memo[p]
    memo |= dict.fromkeys(passed, end)
    return end


def _wav(b: bytes, at: int, memo: dict) -> tuple[int, int, int] | None:
    """(length of the medium, start and length of its samples) or None."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if at + size > len(b):
        return None

    def step(p: int):
        if p + 8 > len(b):
            return (None,)
        kind, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        return (p,) if kind in (b"fmt ", b"data") else p + 8 + n + n % 2

    # The format, then the samples; other chunks may come between.
    p = follow(memo, at + 12, step)
    if p is None or b[p : p + 4] != b"fmt ":
        return None
    n = struct.unpack_from("<I", b, p + 4)[0]
    if n < 16 or p + 8 + n > len(b) or struct.unpack_from("<H", b, p + 8)[0] not in (1, 3, 6, 7):
        return None
    p = follow(memo, p + 8 + n + n % 2, step)
    if p is None or b[p : p + 4] != b"data":
        return None
    n = struct.unpack_from("<I", b, p + 4)[0]
    return (size, p + 8, n) if p + 8 + n <= at + size else None


def _bmp(b: bytes, at: int, memo: dict) -> tuple[int, int, int] | None:
    if len(b) < at + 54:
        return None
    size, r1, r2, start = struct.unpack_from("<IHHI", b, at + 2)
    head, w, h, planes, bits, packed = struct.unpack_from("<IiiHHI", b, at + 14)
    if (r1, r2, planes) != (0, 0, 1) or head < 40 or bits not in (8, 24, 32) or packed or w <= 0 or not h:
        return None
    need = (w * bits + 31) // 32 * 4 * abs(h)
    return (size, at + start, need) if start + need <= size <= len(b) - at else None


def _au(b: bytes, at: int, memo: dict) -> tuple[int, int, int] | None:
    if len(b) < at + 24:
        return None
    start, n, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    good = start >= 24 and 1 <= coding <= 27 and rate and 1 <= channels <= 16 and at + start + n <= len(b)
    return (start + n, at + start, n) if good else None


def _png(b: bytes, at: int, memo: dict) -> tuple[int, int, int] | None:
    if b[at + 12 : at + 16] != b"IHDR":
        return None

    def step(p: int):
        if p + 12 > len(b):
            return (None,)
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or not kind.isalpha() or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return (None,)
        return (p + 12,) if kind == b"IEND" else p + 12 + n

    end = follow(memo, at + 8, step)
    return None if end is None else (end - at, at, end - at)


def _gif(b: bytes, at: int, memo: dict) -> tuple[int, int, int] | None:
    if len(b) < at + 14:
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    inner = memo.setdefault("blocks", {})

    def after(p: int) -> int:
        """The place after a row of blocks."""
        return follow(inner, p, lambda q: (q + 1,) if q >= len(b) or not b[q] else q + b[q] + 1)

    def step(p: int):
        if p >= len(b):
            return (None,)
        if b[p] == 0x3B:
            return (p + 1,)
        if b[p] == 0x21:
            return after(p + 2)
        if b[p] == 0x2C and p + 10 <= len(b):
            return after(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        return (None,)

    end = follow(memo, at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), step) if w and h else None
    return None if end is None else (end - at, at, end - at)


def _jpeg(b: bytes, at: int, memo: dict) -> tuple[int, int, int] | None:
    def step(p: int):
        if p + 4 > len(b) or b[p] != 0xFF:
            return (None,)
        if b[p + 1] == 0xDA:
            # The next end mark is the same for all scans before it.
            since, end = memo.get("end", (0, -2))
            if not since <= p <= end:
                end = b.find(b"\xff\xd9", p)
                memo["end"] = p, end if end >= 0 else len(b)
            return (None if end in (-1, len(b)) else end + 2,)
        n = struct.unpack_from(">H", b, p + 2)[0]
        return p + 2 + n if n >= 2 else (None,)

    end = follow(memo, at + 2, step)
    return None if end is None else (end - at, at, end - at)


VALIDATORS = {"audio/wav": _wav, "image/bmp": _bmp, "audio/basic": _au, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg}
WRITERS = (("audio/wav", wav), ("image/bmp", bmp), ("audio/basic", au), ("image/png", png))


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, back, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> tuple[list[tuple[int, int, str, int, int]], int]:
    """Confirmed media as (offset, length, type, samples' start, samples' length), and the number of hits."""
    media, hits, memo = [], 0, {kind: {} for kind in VALIDATORS}
    for end, (back, kind) in _automaton().iter(blob.decode("latin-1")):
        hits += 1
        at = end - back
        found = VALIDATORS[kind](blob, at, memo[kind])
        if found:
            media.append((at, found[0], kind, found[1], found[2]))
    return sorted(media), hits


MEDIUM = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())]))


def sniff_media(df: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """Add ``media_type``, ``type_corrected`` and ``media`` (offset, length and type of each confirmed medium)."""
    schema = common.with_fields(df.schema, ("media_type", T.StringType()), ("type_corrected", T.BooleanType()), ("media", MEDIUM))
    keep = [f.name for f in schema.fields[:-3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column(declared).to_pylist() if declared else [None] * b.num_rows
            found = [sniff(x)[0] for x in common.utf8(b.column(content))]
            kinds = [next((m[2] for m in f if m[0] == 0), UNKNOWN) for f in found]
            media = pa.array([[{"offset": m[0], "length": m[1], "type": m[2]} for m in f] for f in found], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(kinds, pa.string()), pa.array([bool(declared) and k != s for k, s in zip(kinds, said)], pa.bool_()), media], names=[*keep, "media_type", "type_corrected", "media"])

    return df.mapInArrow(run, schema)


CARVED = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()), T.StructField("medium", T.BinaryType())])


def carve(df: DataFrame, content: str = "content") -> DataFrame:
    """A row (the other columns and offset, length, type, medium) for each confirmed medium that does not start its blob."""
    schema = common.with_fields(df.drop(content).schema, *((f.name, f.dataType) for f in CARVED))
    keep = [f.name for f in schema.fields[: -len(CARVED)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, m[0], m[1], m[2], blob[m[0] : m[0] + m[1]]) for i, blob in enumerate(common.utf8(b.column(content))) for m in sniff(blob)[0] if m[0]]
            row, *new = zip(*rows) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row, pa.int64())) for c in keep), *(pa.array(c, t) for c, t in zip(new, types))], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def declared_type(payload: bytes) -> str:
    """What a careless source says of a payload: as often as not another format than it is stored in."""
    kinds = [kind for kind, _ in WRITERS]
    stored = zlib.crc32(payload)
    return kinds[stored % len(kinds)] if stored >> 8 & 1 else (UNKNOWN, *VALIDATORS)[zlib.adler32(payload) % (1 + len(VALIDATORS))]


def stored_form(payload: bytes) -> bytes:
    """The payload as a medium of one of four formats; every fourth holds a picture of its first row."""
    stored = zlib.crc32(payload)
    return WRITERS[stored % len(WRITERS)][1](payload, png(payload[:BLOCK]) if stored >> 9 & 3 == 0 else b"")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), common.utf8(b.column("text"))):
            payload = text + b" " * (-len(text) % BLOCK if text else BLOCK)
            said, blob = declared_type(payload), stored_form(payload)
            media, hits = sniff(blob)
            top = next(m for m in media if m[0] == 0)
            back = png_samples(blob) if top[2] == "image/png" else blob[top[3] : top[3] + top[4]]
            embedded = [[m[0], m[1], m[2], hashlib.sha256(blob[m[0] : m[0] + m[1]]).hexdigest()] for m in media if m[0]]
            feature = json.dumps({"type": top[2], "declared": said, "corrected": top[2] != said, "hits": hits, "embedded": embedded})
            rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        names = [x.split()[0] for x in DIGEST.split(", ")]
        types = [pa.string() if "string" in x else pa.int64() for x in DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as a medium, found again by sniffing, and read back.

    The feature has the type that sniffing finds, the declared one and whether
    it had to be corrected, the number of magic hits, and place, length, type
    and digest of the embedded media that were confirmed and carved.
    """
    return docs.select("doc_id", "text").mapInArrow(_digests, DIGEST)


def op9_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(common.read(spark, sf_dir, "documents"))
