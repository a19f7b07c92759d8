import gzip
import hashlib
import io
import math
import random
import struct
import zipfile
import zlib
from fractions import Fraction

from docquarry.llm import media


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello" * 20)
    return {
        "application/zip": z.getvalue(),
        "application/gzip": gzip.compress(b"abc" * 100_000),
        "image/png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b""),
        "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4,
        "application/pdf": b"%PDF-1.4\nfoo startxref\n0\n%%EOF",
        "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + b"\0" * 9 + b"\x02\x02\x44\x01\x00\x3b",
        "image/jpeg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\0" * 10 + b"\xff\xc0" + struct.pack(">H", 11) + b"\0" * 9 + b"\xff\xda" + struct.pack(">H", 8) + b"\0" * 6 + b"ab\xff\x00c\xff\xd9",
        "audio/wav": media.to_wave(b"abcd"),
    }


def test_formats_are_confirmed_and_carved():
    for kind, data in samples().items():
        assert media.sniff(data)[0] == (kind, 0, len(data))
        assert (kind, 3, len(data)) in media.sniff(b"abc" + data + b"xyz")
        broken = data[:-3]
        assert not any(s == 0 and n >= len(data) for _, s, n in media.sniff(broken))
        assert media.corrected_type(data, "image/tiff") == kind
    for text in (b"", None, b"BM", b"RIFF....WAVE", b"PK\3\4", b"GIF89a", b"\x1f\x8b\x08", b"%PDF-x", b"\xff\xd8\xff"):
        assert media.sniff(text) == []
    assert media.corrected_type(b"text", "image/png") == media.UNKNOWN
    assert media.corrected_type(b"text", "text/plain") == "text/plain"


def test_inspect_media(spark):
    data = samples()
    rows = [(1, data["image/png"], "image/jpeg"), (2, b"zz" + data["image/gif"], "text/plain"), (3, None, None)]
    got = {r.doc_id: r for r in media.inspect_media(spark.createDataFrame(rows, "doc_id long, media binary, declared_type string")).collect()}
    assert got[1].media_type == "image/png" and got[1].corrected
    assert [bytes(c) for c in got[2].carved] == [data["image/gif"]] and got[2].objects[0].start == 2 and not got[2].corrected
    assert got[3].media_type == media.UNKNOWN and got[3].carved == []


def test_payloads_come_back(frame, collected, odd):
    got = collected(media.media_digests(frame(odd)))
    for r, text in zip(got, odd, strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] == len(payload) + 44
    assert got[10]["feature"] == got[11]["feature"]
    stored = media.store_texts(frame(["hello"])).first()
    assert media.from_wave(bytes(stored.media)) == b"hello".ljust(192)
    assert media.media_digests(frame([])).count() == 0


def test_feature_against_brute_force(frame, collected, odd):
    r = random.Random(4)
    texts = odd + ["".join(chr(r.randint(1, 0x2FF)) for _ in range(r.choice((10, 500, 70_000)))) for _ in range(40)]
    texts += ["RIFF then GIF89a and PK\3\4", "\xff" * 66_000]
    for row, text in zip(collected(media.media_digests(frame(texts))), texts, strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        mean = Fraction(sum(payload), len(payload))
        dev = math.sqrt(float(Fraction(sum(b * b for b in payload), len(payload)) - mean**2))
        peak = max(sum(payload[k : k + 192]) for k in range(0, len(payload), 192))
        fields = dict(f.split("=", 1) for f in row["feature"].split(";")[1:])
        assert row["feature"].startswith("audio/wav;n=") and int(fields["n"]) == len(payload) and int(fields["peak"]) == peak
        assert abs(float(fields["mean"]) - float(mean)) < 6e-5 and abs(float(fields["dev"]) - dev) < 6e-5 and fields["inner"] == ""
    assert "inner=image/gif@47+" in media.wave_features(media.to_wave(b"abc" + samples()["image/gif"]))
