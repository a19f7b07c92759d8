"""Media columns: lossless storage of payloads, signature sniffing and carving.

An Aho-Corasick automaton over the magic bytes of the known formats finds every
place where an object may begin; a validator for each format then confirms the
structure and yields the object's length.  A column's declared type is corrected
to what the bytes at its start prove, and confirmed objects elsewhere inside are
carved out.

Null payloads count as empty.  Bytes that no validator confirms are
``application/octet-stream``.  Objects are reported in order of their start; an
object inside a confirmed object of a container format is reported as embedded
in it.  Every validator reads in proportion to the object, and a place whose
header is broken is dropped at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import prepare_workers

#: Samples that are squared at a time.
SQUARES = 1 << 16
UNKNOWN = "application/octet-stream"
BLOCK, SAMPLE_RATE = 192, 16_000


def _riff_wave(data: bytes, at: int) -> int:
    """RIFF/WAVE: the form's size must fit, with a fmt chunk before the data chunk."""
    if len(data) < at + 44 or data[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0
    k, fmt, sound = at + 12, False, False
    while k + 8 <= end:
        name, size = data[k : k + 4], struct.unpack_from("<I", data, k + 4)[0]
        if k + 8 + size > end or not name.strip().isalnum():
            return 0
        fmt |= name == b"fmt " and size >= 16
        sound |= fmt and name == b"data"
        k += 8 + size + size % 2
    return end - at if sound and k in (end, end + 1) else 0


def _png(data: bytes, at: int) -> int:
    """PNG: IHDR first, each chunk with its CRC, IEND last."""
    k, first = at + 8, True
    while k + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, k)
        if k + 12 + size > len(data) or first != (name == b"IHDR"):
            return 0
        if zlib.crc32(data[k + 4 : k + 8 + size]) != struct.unpack_from(">I", data, k + 8 + size)[0]:
            return 0
        k, first = k + 12 + size, False
        if name == b"IEND":
            return k - at
    return 0


def _gif(data: bytes, at: int) -> int:
    """GIF: logical screen, then blocks of sub-blocks to the trailer."""
    if len(data) < at + 13:
        return 0
    k = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0)
    while k < len(data):
        kind = data[k]
        if kind == 0x3B:
            return k + 1 - at
        if kind == 0x21:
            k += 2
        elif kind == 0x2C and k + 10 < len(data):
            k += 11 + (3 << (data[k + 9] & 7) + 1 if data[k + 9] & 128 else 0)
        else:
            return 0
        while k < len(data) and data[k]:
            k += data[k] + 1
        k += 1
    return 0


def _jpeg(data: bytes, at: int) -> int:
    """JPEG: segments with lengths up to the scan, entropy data up to EOI."""
    k, frame = at + 2, False
    while k + 4 <= len(data) and data[k] == 0xFF:
        kind = data[k + 1]
        if kind == 0xFF:
            k += 1
            continue
        if not 0xC0 <= kind <= 0xFE or 0xD0 <= kind <= 0xD9:
            return 0
        size = struct.unpack_from(">H", data, k + 2)[0]
        if size < 2 or k + 2 + size > len(data):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        k += 2 + size
        if kind == 0xDA:
            if not frame:
                return 0
            while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data):
                if data[k + 1] == 0xD9:
                    return k + 2 - at
                if data[k + 1] and not 0xD0 <= data[k + 1] <= 0xD7:
                    break
                k += 2
            if k < 0:
                return 0
    return 0


def _bmp(data: bytes, at: int) -> int:
    """BMP: file size, pixel offset and header size must agree."""
    if len(data) < at + 54:
        return 0
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    if zero or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return size if offset >= 14 + header and size == offset + rows and at + size <= len(data) else 0


def _gzip(data: bytes, at: int) -> int:
    """gzip: the member must inflate, with the right CRC and length at its end."""
    if len(data) < at + 18 or data[at + 3] & 0xE0:
        return 0
    inflate, k = zlib.decompressobj(31), at
    try:
        while k < len(data) and not inflate.eof:
            inflate.decompress(data[k : k + 65536], 1 << 20)
            k += 65536 - 0
            while inflate.unconsumed_tail and not inflate.eof:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
    except zlib.error:
        return 0
    return min(k, len(data)) - len(inflate.unused_data) - at if inflate.eof else 0


def _zip(data: bytes, at: int) -> int:
    """ZIP: local headers of known size up to the directory and its end record."""
    k = at
    while data[k : k + 4] == b"PK\3\4" and k + 30 <= len(data):
        flags, = struct.unpack_from("<H", data, k + 6)
        packed, = struct.unpack_from("<I", data, k + 18)
        names, extra = struct.unpack_from("<HH", data, k + 26)
        if flags & 8:
            return 0
        k += 30 + names + extra + packed
    start = k
    while data[k : k + 4] == b"PK\1\2" and k + 46 <= len(data):
        k += 46 + sum(struct.unpack_from("<HHH", data, k + 28))
    if data[k : k + 4] != b"PK\5\6" or k + 22 > len(data):
        return 0
    size, offset, comment = struct.unpack_from("<IIH", data, k + 12)
    end = k + 22 + comment
    return end - at if (size, offset) == (k - start, start - at) and end <= len(data) else 0


def _pdf(data: bytes, at: int) -> int:
    """PDF: a version, then startxref and %%EOF, the last before the next header."""
    if not data[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    following = data.find(b"%PDF-", at + 5)
    limit = following if following >= 0 else len(data)
    end = data.rfind(b"%%EOF", at, limit)
    return end + 5 - at if end >= 0 and data.rfind(b"startxref", at, end) >= 0 else 0


FORMATS = {
    b"RIFF": ("audio/wav", _riff_wave),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"PK\3\4": ("application/zip", _zip),
    b"%PDF-": ("application/pdf", _pdf),
}


def _automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for magic in FORMATS:
        built.add_word(magic.decode("latin-1"), magic)
    built.make_automaton()
    return built


_magic = _automaton()


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """Confirmed objects as (type, start, length), by start."""
    data = data or b""
    found = []
    for last, magic in _magic.iter(data.decode("latin-1")):
        start = last - len(magic) + 1
        kind, validate = FORMATS[magic]
        if length := validate(data, start):
            found.append((kind, start, length))
    return sorted(found, key=lambda x: (x[1], x[0]))


def corrected_type(data: bytes | None, declared: str | None) -> str:
    """The type that the bytes prove; unproven bytes keep no claim of a known type."""
    at_start = [kind for kind, start, _ in sniff(data) if not start]
    if at_start:
        return at_start[0]
    return UNKNOWN if declared is None or declared in {kind for kind, _ in FORMATS.values()} else declared


def to_wave(payload: bytes) -> bytes:
    """Payload as unsigned 8-bit mono samples."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def from_wave(stored: bytes) -> bytes:
    """The samples of the data chunk; ValueError if the bytes are no valid WAVE."""
    if not _riff_wave(stored, 0):
        raise ValueError("not a WAVE form")
    k = 12
    while stored[k : k + 4] != b"data":
        size = struct.unpack_from("<I", stored, k + 4)[0]
        k += 8 + size + size % 2
    return stored[k + 8 : k + 8 + struct.unpack_from("<I", stored, k + 4)[0]]


def pad(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with blanks to a positive multiple of BLOCK; their number before."""
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" "), len(raw)


def wave_features(stored: bytes) -> str:
    """Type by content, samples, mean, deviation and blocks' peak of the read samples, and the
    objects carved from inside, as type@start+length."""
    samples = np.frombuffer(from_wave(stored), np.uint8)
    mean = int(samples.sum(dtype=np.int64)) / max(1, samples.size)
    square = sum(int(np.square(samples[k : k + SQUARES].astype(np.uint64)).sum()) for k in range(0, samples.size, SQUARES))
    peak = int(samples.reshape(-1, BLOCK).sum(1, dtype=np.int64).max()) if samples.size and not samples.size % BLOCK else 0
    found = sniff(stored)
    inner = ",".join(f"{kind}@{start}+{length}" for kind, start, length in found if start)
    return f"{found[0][0]};n={samples.size};mean={mean:.4f};dev={max(0.0, square / max(1, samples.size) - mean * mean) ** 0.5:.4f};peak={peak};inner={inner}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, declared_type): each text as a WAVE payload in a binary column."""
    prepare_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            padded = [pad(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in padded], pa.int64()), pa.array([to_wave(p) for p, _ in padded], pa.binary()), pa.array([UNKNOWN] * len(padded), pa.string())], names=["id", "n_bytes", "media", "declared_type"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary, declared_type string").withColumnRenamed("id", id_col)


def inspect_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """(id, media_type, corrected, objects array<struct<type,start,length>>, carved
    array<binary>): sniffed type, whether it differs from the declared one, and the
    objects confirmed after the start, with their bytes."""
    prepare_workers(media.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for data, declared in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                inner = [x for x in sniff(data) if x[1]]
                kind = corrected_type(data, declared)
                rows.append((kind, kind != declared, [dict(zip(("type", "start", "length"), x, strict=True)) for x in inner], [data[s : s + n] for _, s, n in inner]))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.bool_(), pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "media_type", "corrected", "objects", "carved"])

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, media_type string, corrected boolean, objects array<struct<type:string,start:long,length:long>>, carved array<binary>"
    return media.select(id_col, media_col, declared_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of
    a table of stored payloads, from their bytes alone."""
    prepare_workers(media.sparkSession)

    def digest(stored: bytes) -> tuple:
        read = from_wave(stored)
        return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), wave_features(stored)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = [digest(stored.as_py()) for stored in batch.column(2)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_bytes", *names])

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of read_media for every text: the binary column of store_texts, read back."""
    return read_media(store_texts(docs, id_col, text_col), id_col)
