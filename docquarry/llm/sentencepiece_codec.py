"""SentencePiece BPE encoding with byte spans into the original text, and decoding.

Normalisation replaces, at each position, the longest prefix that the model's
compiled character map knows (a double-array trie) and records for every
normalised byte the source byte it came from.  BPE then runs on the normalised
text and every piece is projected through that alignment to a byte span of the
original text.

Two facts keep it fast.  No piece of a usable model holds a word mark after
another character (checked when the model is loaded), so merges never cross the
start of a word: a text is encoded word by word and words are memoised.  And
with an empty character map the alignment of a word depends on the word alone,
so it is memoised too.

Nulls and empty texts encode to the begin and end ids alone and decode to "".
Decoding is the library's own, of the ids that were made, for every text.
Very long texts need memory in proportion to one text; the memo is bounded in bytes, holds
no word of over MEMO_CHARS characters, and has no influence on results.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import prepare_workers

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Bytes of a worker's memo, with what Python takes for an entry; when full it is emptied.  Longer words pass.
MEMO_BYTES, ENTRY_BYTES, MEMO_CHARS = 48_000_000, 180, 64
#: Characters of text whose words are learnt together.
LEARN_CHARS = 1_000_000


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose
    values are offsets of zero-terminated replacement strings."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.strings = blob[4 + n :]

    def longest_prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """Replacement and number of source bytes it stands for."""
        best, used = -1, 0
        if self.units:
            units, node, k = self.units, 0, at
            node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
            while k < len(text):
                byte = text[k]
                node ^= byte
                if node >= len(units) or units[node] & 0x800000FF != byte:
                    break
                unit = units[node]
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                k += 1
                if unit >> 8 & 1:
                    best, used = units[node] & 0x7FFFFFFF, k - at
        if used:
            return self.strings[best : self.strings.index(b"\0", best)], used
        lead = text[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + width], width


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only BPE models with marks before words are supported")
        kinds = {p.type for p in proto.pieces}
        if pb.ModelProto.SentencePiece.USER_DEFINED in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces):
            raise ValueError("a piece crosses the start of a word")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.plain = not self.charmap.units and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and trainer.byte_fallback
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.bos, self.eos, self.unk = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.fallback = trainer.byte_fallback
        normal = pb.ModelProto.SentencePiece.NORMAL
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == normal}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
        #: Bytes of normalised text under each id; a byte piece covers one.
        self.width = np.array([1 if p.type == pb.ModelProto.SentencePiece.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        #: Bytes of source text where a mark stands for one blank and nothing else changes.
        self.span = self.width - 2 * np.array([p.piece.count(MARK) for p in proto.pieces], np.int64)
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    # -- normalisation --

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the source byte."""
        raw = text.encode()
        out, source = bytearray(), []
        at = 0
        if self.squeeze:
            while at < len(raw):
                put, used = self.charmap.longest_prefix(raw, at)
                if put != b" ":
                    break
                at += used
            if at == len(raw):
                return "", np.array([0], np.int64)
        if not raw:
            return "", np.array([0], np.int64)
        if self.dummy:
            out += MARK_BYTES
            source += [at] * 3
        spaced = self.squeeze
        while at < len(raw):
            put, used = self.charmap.longest_prefix(raw, at)
            if self.squeeze and spaced:
                put = put.lstrip(b" ")
            if put:
                marked = put.replace(b" ", MARK_BYTES)
                out += marked
                source += [at] * len(marked)
                spaced = put.endswith(b" ")
            at += used
            if not self.squeeze:
                spaced = False
        end = at
        if self.squeeze:
            while out.endswith(MARK_BYTES):
                end = source[-3]
                del out[-3:], source[-3:]
        return out.decode(), np.array([*source, end], np.int64)

    # -- merging --

    def merge(self, word: str) -> list[int]:
        """BPE of one marked word: the best-scored pair first, leftmost on ties."""
        parts: list[str | None] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (both := parts[i] + parts[j]) in self.rank:
                heapq.heappush(heap, (self.rank[both][0], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        ids: list[int] = []
        for p in parts:
            if p is None:
                continue
            if p in self.rank:
                ids.append(self.rank[p][1])
            elif self.fallback:
                ids += [self.byte_id[b] for b in p.encode()]
            else:
                ids.append(self.unk)
        return ids

    # -- whole texts --

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, as the raw bytes that are joined later; short words go to the
        memo.  Words come without their last mark."""
        fresh = list(words)
        coded = self.library.encode(fresh, num_threads=1)
        for k, ids in enumerate(coded):
            if not ids:  # the empty word is a lone mark
                coded[k] = self.merge(MARK)
        flat = np.fromiter(chain.from_iterable(coded), np.uint32).tobytes()
        memo, passing, at = self.memo, {}, 0
        for word, ids in zip(fresh, coded, strict=True):
            end = at + 4 * len(ids)
            if len(word) > MEMO_CHARS:
                passing[word] = flat[at:end]
            else:
                memo[word] = flat[at:end]
                self.memo_bytes += ENTRY_BYTES + len(word) + end - at
            at = end
        return passing

    def words_of(self, text: str) -> list[str]:
        """The text's marked words, each without its last mark's place: a word is
        what follows one space; further spaces before it stay with it."""
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ")
        return [w[1:] for w in re.findall(r" +[^ ]*", " " + text)]

    def encode_plain(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts, for models with an empty character map.  Words are learnt for some texts
        at a time, so that the library is called for many words at once."""
        at = 0
        while at < len(texts):
            if self.memo_bytes > MEMO_BYTES:
                self.memo.clear()
                self.memo_bytes = 0
            known, first, split, chars, new = self.memo.get, at, [], 0, set()
            while at < len(texts) and chars < LEARN_CHARS:
                own = self.words_of(texts[at]) if texts[at] else []
                got = list(map(known, own))
                missed = [w for w, g in zip(own, got, strict=True) if g is None] if None in got else None
                if missed:
                    new.update(missed)
                split.append((got, missed))
                chars += len(texts[at])
                at += 1
            passing = self.learn(new) if new else {}
            for got, missed in split:
                if missed:
                    fill = iter(missed)
                    got = [(known(w := next(fill)) or passing[w]) if g is None else g for g in got]
                yield b"".join(got)

    def encode_many(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids with begin and end, and the begin and end byte of each in its text; the
        begin and end ids have empty spans."""
        whole = [t or "" for t in texts]
        plain = self.encode_plain([t for t in whole if MARK not in t]) if self.plain else iter(())
        for text in whole:
            size = len(text.encode())
            if self.plain and MARK not in text:
                ids = np.frombuffer(next(plain), np.uint32)
                ends = np.cumsum(self.span[ids])
                begins = ends - self.span[ids]
                # the first mark stands for no byte of the text
                begins, ends = np.maximum(begins - 1, 0), np.maximum(ends - 1, 0)
            else:
                normal, source = self.normalise(text)
                got: list[int] = []
                for word in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", normal):
                    got += self.merge(word)
                ids = np.array(got, np.uint32)
                ends = np.cumsum(self.width[ids]) if got else np.zeros(0, np.int64)
                begins = source[ends - self.width[ids]] if got else ends
                ends = source[ends] if got else ends
            yield np.concatenate([[self.bos], ids, [self.eos]]).astype(np.uint32), np.concatenate([[0], begins, [size]]).astype(np.int64), np.concatenate([[0], ends, [size]]).astype(np.int64)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One text's ids and spans."""
        return next(self.encode_many([text]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode([int(i) for i in ids])

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str, str]]:
        """Number of ids and SHA-256 of ids, decoded text and spans."""
        head, tail = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        whole = [t or "" for t in texts]
        plain = self.encode_plain([t for t in whole if MARK not in t]) if self.plain else iter(())
        for text in whole:
            if self.plain and MARK not in text:
                ids = next(plain)
                ends = np.cumsum(self.span[np.frombuffer(ids, np.uint32)]) - 1
                ids, spans = head + ids + tail, np.maximum(ends, 0).astype("<u4").tobytes()
            else:
                at, _, ends = self.encode(text)
                ids, spans = at.astype("<u4").tobytes(), ends[1:-1].astype("<u4").tobytes()
            back = self.library.decode(np.frombuffer(ids, "<u4").tolist())
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), hashlib.sha256(spans).hexdigest()


_codecs: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    """One codec for each worker and model."""
    if model_path not in _codecs:
        _codecs[model_path] = Codec(model_path)
    return _codecs[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, ids array<int>, begins array<int>, ends array<int>), or (id, ids) without spans: one row per row."""
    prepare_workers(docs.sparkSession)
    names = ["ids", "begins", "ends"] if spans else ["ids"]

    def run(batches):
        own = codec(model_path)
        for batch in batches:
            # of a batch only what is asked for is held
            coded = [[x.astype(np.int32) for x in c[: len(names)]] for c in own.encode_many(batch.column(1).to_pylist())]
            lists = [pa.array([c[k] for c in coded], pa.list_(pa.int32())) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} array<int>" for n in names)).withColumnRenamed("id", id_col)


def decode_documents(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the decoded text of each list of ids; null ids give ""."""
    prepare_workers(coded.sparkSession)

    def run(batches):
        own = codec(model_path)
        for batch in batches:
            texts = own.library.decode([ids or [] for ids in batch.column(1).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): the same results as
    encode_documents and decode_documents, digested where they are made.

    spans_sha256 digests the end bytes of all pieces (unsigned 32 bits, little
    endian); each piece begins where the one before it ends.
    """
    prepare_workers(docs.sparkSession)

    def run(batches):
        own = codec(model_path)
        gc.disable()  # the memo holds no cycles, and scanning it is dear
        for batch in batches:
            rows = list(own.digests(batch.column(1).to_pylist()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
