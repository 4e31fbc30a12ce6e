import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from matchlake.llm import media


def test_round_trip(docs, corpus, empty):
    got = {}
    for r in media.read_media(media.to_media(docs)).collect():
        got.setdefault(r.doc_id, r)
    for i, t in corpus:
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.error is None and len(r.feature) == 16
    assert (got[900].feature, got[900].media_sha256) == (got[901].feature, got[901].media_sha256)
    assert media.read_media(media.to_media(empty)).collect() == []


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_all_filters(kinds):
    rng = random.Random(3)
    image = np.array([[rng.randrange(256) for _ in range(9)] for _ in range(20)], np.uint8)
    kind = np.array([kinds[y % len(kinds)] for y in range(20)], np.uint8)
    rows = np.zeros_like(image)
    for y in range(20):
        for x in range(9):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = sorted([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)])[0][2]
            rows[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, near][kind[y]]) % 256
    assert (media.unfilter(kind, rows) == image).all()


def test_damage_is_told(spark):
    good = media.encode_png(bytes(range(256)))
    flipped = good[:60] + bytes([good[60] ^ 1]) + good[61:]
    bad = [b"", b"junk", good[:-5], flipped, None]
    found = media.read_media(spark.createDataFrame([(i, 0, bytearray(b) if b is not None else None) for i, b in enumerate(bad)], "doc_id long, n_bytes long, media binary")).orderBy("doc_id").collect()
    assert [bool(r.error) for r in found] == [True, True, True, True, False] and all(r.payload_bytes is None for r in found)


def chunks(data):
    """A reader of its own: the chunks of a PNG."""
    at, out = 8, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        out.append((data[at + 4 : at + 8], data[at + 8 : at + 8 + n]))
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(data[at + 4 : at + 8 + n])
        at += 12 + n
    return out


def plain_decode(data):
    """Samples by loops over bytes, one row after the other."""
    parts = chunks(data)
    assert parts[0][0] == b"IHDR" and parts[-1] == (b"IEND", b"")
    width, height = int.from_bytes(parts[0][1][:4], "big"), int.from_bytes(parts[0][1][4:8], "big")
    raw, above, out = zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), [0] * width, []
    for y in range(height):
        kind, *row = raw[y * (width + 1) : (y + 1) * (width + 1)]
        for x in range(width):
            row[x] = (row[x] + [0, row[x - 1] if x else 0, above[x]][kind]) % 256
        out += row
        above = row
    return bytes(out)


def plain_feature(payload):
    """The hash by the definition: means of 32 by 32 fields, sums of cosines, the median of all coefficients but the first."""
    rows = [list(payload[i : i + 64]) for i in range(0, len(payload), 64)]

    def means(lines):
        n = len(lines)
        if n < 32:
            return [[float(v) for v in lines[k * n // 32]] for k in range(32)]
        return [[sum(line[x] for line in lines[k * n // 32 : max((k + 1) * n // 32 if k < 31 else n, k * n // 32 + 1)]) / max(1, ((k + 1) * n // 32 if k < 31 else n) - k * n // 32) for x in range(len(lines[0]))] for k in range(32)]

    small = means(rows)
    small = [list(c) for c in zip(*means([list(c) for c in zip(*small)]))]
    cos = [[math.cos(math.pi * (2 * n + 1) * k / 64) for n in range(32)] for k in range(8)]
    low = [sum(cos[u][y] * cos[v][x] * small[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    rest = sorted(low[1:])
    return low, rest[len(rest) // 2]


@pytest.mark.parametrize("n", [1, 5, 31, 32, 33, 100, 257])
def test_against_a_plain_reader(n):
    rng = random.Random(n)
    payload = bytes(rng.choice(b"etaoin shrdlu") for _ in range(64 * n))
    png = media.encode_png(payload)
    assert plain_decode(png) == media.decode_png(png).tobytes() == payload
    low, median = plain_feature(payload)
    bits = f"{int(media.cosine_hash(media.decode_png(png)), 16):064b}"
    assert all((c > median) == (b == "1") for c, b in zip(low, bits) if abs(c - median) > 1e-6)


def made(header, raw, level=6):
    return media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(raw, level)) + media._chunk(b"IEND", b"")


def test_crafted_media_are_told(spark):
    head = lambda w, h: struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    bad = [
        made(b"\0" * 4, b""), made(head(0, 0), b""), made(head(64, 0), b""), made(head(1 << 31, 1 << 31), b"\0"), made(head(4, 1), b"\0" * 50_000_000), made(head(4, 1), b"\0" * 3), made(head(4, 1), b"\7" + b"\0" * 4),
        media.SIGNATURE + media._chunk(b"IDAT", zlib.compress(b"\0" * 5)) + media._chunk(b"IEND", b""), media.SIGNATURE + media._chunk(b"IHDR", head(4, 1)) + media._chunk(b"IEND", b""),
        media.SIGNATURE + media._chunk(b"IHDR", head(4, 1)) * 2 + media._chunk(b"IDAT", zlib.compress(b"\0" * 5)) + media._chunk(b"IEND", b""), media.SIGNATURE + b"\xff\xff\xff\xffIHDR",
    ]
    df = spark.createDataFrame([(i, 0, bytearray(b), "x") for i, b in enumerate(bad)], "doc_id long, n_bytes long, media binary, feature string")
    found = media.read_media(df).collect()
    assert len(found) == len(bad) and all(r.error and r.feature is None and r.media_bytes for r in found)
    assert media.decode_png(made(head(4, 1), b"\0abcd")).tobytes() == b"abcd"


def test_ties_and_long_texts(spark):
    rows = [(1, "same"), (2, "same"), (2, "same"), (3, "x" * 3_000_000)]
    found = media.read_media(media.to_media(spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, media string"))).collect()
    assert len({(r.media_sha256, r.feature) for r in found if r.doc_id < 3}) == 1 and max(r.payload_bytes for r in found) == 3_000_000
