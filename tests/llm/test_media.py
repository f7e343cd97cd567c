import hashlib
import json
import time
import zlib

import pytest

from tarn.llm import media


def test_formats_round_trip(rng):
    payload = rng.integers(0, 256, 192 * 5, dtype="uint8").tobytes()
    for kind, write in media.WRITERS:
        blob = write(payload)
        found, hits = media.sniff(blob)
        assert found[0][:3] == (0, len(blob), kind) and hits >= 1
        assert (media.png_samples(blob) if kind == "image/png" else blob[found[0][3] : found[0][3] + found[0][4]]) == payload
        picture = media.png(payload[:192])
        within = media.sniff(write(payload, picture))[0]
        assert [m[2] for m in within] == [kind, "image/png"] and within[1][1] == len(picture)
        for cut in (1, 10, len(blob) // 2, len(blob) - 1):
            assert (0, len(blob), kind) not in [m[:3] for m in media.sniff(blob[:cut])[0]]


def test_carving(rng):
    inner = [w(bytes(192)) for w in (media.wav, media.bmp, media.au, media.png)]
    gif = b"GIF89a\x01\0\x01\0\0\0\0" + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xyz\xff\xd9"
    inner += [gif, jpeg]
    blob, places = b"junk BM RIFF .snd \x89PNG\r\n\x1a\n ", []
    for x in inner:
        places.append((len(blob), len(x)))
        blob += x + b"\0junk"
    assert [m[:2] for m in media.sniff(blob)[0]] == places


def test_columns(spark):
    rows = [(1, media.wav(b"abc"), "image/png"), (2, b"", "image/png"), (3, None, None), (4, b"plain", media.UNKNOWN), (4, b"plain", media.UNKNOWN)]
    df = spark.createDataFrame(rows, "media long, content binary, declared string")
    got = media.sniff_media(df.withColumnRenamed("media", "id"), declared="declared").collect()
    assert [(r.media_type, r.type_corrected, len(r.media)) for r in sorted(got, key=lambda r: r.id)] == [("audio/wav", True, 1), (media.UNKNOWN, True, 0), (media.UNKNOWN, True, 0), (media.UNKNOWN, False, 0), (media.UNKNOWN, False, 0)]


@pytest.mark.parametrize("text", [None, "", "a", "é" * 96, "BM" * 5000, "x" * 200_000])
def test_digests(spark, text):
    docs = spark.createDataFrame([(7, text, "x"), (None, text, "y")], "doc_id long, text string, feature string")
    a, b = media.media_digests(docs).collect()
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    assert tuple(a)[1:] == tuple(b)[1:] and a.n_bytes == len(raw) and a.payload_bytes == len(payload)
    assert a.payload_sha256 == hashlib.sha256(payload).hexdigest() and a.tail_crc32 == zlib.crc32(payload[-16:])


def test_empty(spark):
    assert media.media_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_media(blob):
    """Media at every place where magic bytes stand, by validators that remember nothing."""
    out = []
    for magic, back, kind in media.MAGIC:
        at = blob.find(magic)
        while at >= 0:
            found = media.VALIDATORS[kind](blob, at - back, {})
            if found:
                out.append((at - back, found[0], kind))
            at = blob.find(magic, at + 1)
    return sorted(out)


def test_features(spark, rng):
    """Types that were declared right and wrong, and digests of what is embedded."""
    texts = [None, "", "BM" * 300, *("".join(rng.choice(list("abc é.sndRIFF"), int(rng.integers(1, 900)))) for _ in range(120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = set()
    for r in media.media_digests(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        blob, f = media.stored_form(payload), json.loads(r.feature)
        want = slow_media(blob)
        assert want[0] == (0, len(blob), f["type"]) and f["corrected"] == (f["type"] != f["declared"])
        assert f["embedded"] == [[at, n, kind, hashlib.sha256(blob[at : at + n]).hexdigest()] for at, n, kind in want[1:]]
        assert r.media_sha256 == hashlib.sha256(blob).hexdigest() and r.media_bytes == len(blob)
        seen.add((f["type"], f["corrected"], bool(f["embedded"])))
    assert len(seen) >= 12


def test_carve(spark):
    picture = media.png(bytes(192))
    rows = [(1, media.wav(bytes(400), picture), "x"), (2, b"plain", "y"), (3, None, "z"), (3, b"--" + picture + picture, "z")]
    got = media.carve(spark.createDataFrame(rows, "id long, content binary, type string")).collect()
    assert sorted((r.id, r.offset, r.type, bytes(r.medium)) for r in got) == [(1, 44, "image/png", picture), (3, 2, "image/png", picture), (3, 2 + len(picture), "image/png", picture)]


@pytest.mark.parametrize("head", [b"GIF89a\x01\0\x01\0\0\0\0!\xff\x0d", b"\xff\xd8\xff\xe0\0\x06abcd", b"RIFF\xff\xff\0\0WAVEjunk\x08\0\0\0", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR"])
def test_repeated_headers_take_no_square(head):
    """A megabyte of headers, each of which leads into the rest."""
    for tail in (b"", b"\x3b", b"\xff\xda\0\x02\xff\xd9"):
        began = time.process_time()
        media.sniff(head * (1_000_000 // len(head)) + tail)
        assert time.process_time() - began < 20
        small = head * 40 + tail
        assert [m[:3] for m in media.sniff(small)[0]] == slow_media(small)
