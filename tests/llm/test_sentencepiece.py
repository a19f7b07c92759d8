import hashlib
import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from docquarry.llm import sentencepiece_codec as codec  # noqa: E402
from docquarry.llm.registry import tokenizer_model  # noqa: E402


@pytest.fixture(scope="module")
def own():
    return codec.Codec(tokenizer_model())


def random_texts(n=400):
    r = random.Random(5)
    return ["".join(r.choice(" ab▁é\n日.Zq<0x41>") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_same_as_library(own, odd):
    for text, (ids, begins, ends) in zip(odd + random_texts(), own.encode_many(odd + random_texts()), strict=True):
        assert ids.tolist() == own.library.encode(text or "", add_bos=True, add_eos=True)
        raw = (text or "").encode()
        assert (begins[1:-1] <= ends[1:-1]).all() and (not raw or ends[-2] == len(raw))
        if len(ids) > 2:  # the pieces' spans follow one another and cover the text
            assert (begins[2:-1] == ends[1:-2]).all() and begins[1] == 0


def test_own_merges_and_spans_agree_with_words(own, odd):
    for text in odd[:12] + random_texts(100):
        ids, begins, ends = own.encode(text)
        normal, source = own.normalise(text or "")
        merged = [i for w in codec.re.findall(f"{codec.MARK}+[^{codec.MARK}]*|[^{codec.MARK}]+", normal) for i in own.merge(w)]
        assert merged == ids[1:-1].tolist()
        if merged:
            at = np.cumsum(own.width[merged])
            assert (source[at] == ends[1:-1]).all()


def test_compiled_character_map_against_library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = codec.Codec.__new__(codec.Codec)
    own.charmap, own.dummy, own.squeeze = codec.CharMap(proto.normalizer_spec.precompiled_charsmap), True, True
    for text in [*random_texts(), "ＡＢＣ ①  x", "ﷺ ½", "  ﬁ  ", "é", "   "]:
        normal, source = own.normalise(text)
        starts = np.concatenate([[0], np.cumsum([len(c.encode()) for c in normal])]).astype(int)
        places = [len(text.encode()[: int(source[s])].decode()) for s in starts]
        assert (normal, places) == library.normalize(text, with_offsets=True)


def test_digests_and_round_trip(frame, collected, own, odd):
    ids = [None, *range(1, len(odd))]
    got = collected(codec.token_digests(frame(odd, ids), tokenizer_model()))
    for r, text in zip(sorted(got, key=lambda r: r["doc_id"] or 0), odd, strict=True):
        want = own.library.encode(text or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.library.decode(want).encode()).hexdigest()
    back = codec.decode_documents(codec.encode_documents(frame(["a b", "é 文"]), tokenizer_model()), tokenizer_model())
    assert [r["text"] for r in collected(back)] == ["a b", "é 文"]
    assert codec.token_digests(frame([]), tokenizer_model()).count() == 0


def test_ids_without_spans(frame, collected, odd):
    docs, model = frame(odd), tokenizer_model()
    got = codec.encode_documents(docs, model, spans=False)
    assert got.columns == ["doc_id", "ids"]
    assert collected(got) == collected(codec.encode_documents(docs, model).select("doc_id", "ids"))
    assert codec.encode_documents(frame([]), model, spans=False).count() == 0


def test_memo_bound_changes_nothing(monkeypatch, own):
    texts = random_texts(200)
    want = list(own.digests(texts))
    monkeypatch.setattr(codec, "MEMO_BYTES", 1000)
    monkeypatch.setattr(codec, "MEMO_CHARS", 3)
    monkeypatch.setattr(codec, "LEARN_CHARS", 50)
    assert list(own.digests(texts)) == want


def test_memo_is_bounded_in_bytes():
    r = random.Random(2)
    fresh = codec.Codec(tokenizer_model())
    texts = ["".join(r.choices("abcdef0123456789", k=30_000)) for _ in range(40)]
    list(fresh.digests(texts))
    assert not fresh.memo and not fresh.memo_bytes
    list(fresh.digests([" ".join("".join(r.choices("abcdef", k=8)) for _ in range(20_000)) for _ in range(3)]))
    assert fresh.memo_bytes >= sum(len(w) + len(ids) for w, ids in fresh.memo.items())


def test_decode_is_called_for_every_text(own, odd):
    class Counted:
        def __init__(self, library):
            self.library, self.calls = library, 0

        def __getattr__(self, name):
            return getattr(self.library, name)

        def decode(self, ids):
            self.calls += 1
            return self.library.decode(ids)

    fresh = codec.Codec(tokenizer_model())
    fresh.library = counted = Counted(fresh.library)
    assert len(list(fresh.digests(odd))) == counted.calls == len(odd)
