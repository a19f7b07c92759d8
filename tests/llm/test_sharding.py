import zlib
from collections import Counter, defaultdict

from docquarry.llm import sharding


def test_law_slots_and_growth(frame, collected, odd):
    texts = odd + [f"text {k}" for k in range(1500)]
    got = collected(sharding.assign_shards(frame(texts), [1.0] * 16, rows_per_bucket=10))
    slots = defaultdict(list)
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    moved = sum(r["grown_shard"] == 16 for r in got)
    assert 0.3 / 17 < moved / len(got) < 2 / 17
    # the owner with one more shard is what a plain assignment over seventeen gives
    again = collected(sharding.assign_shards(frame(texts), [1.0] * 17))
    assert [r["shard"] for r in again] == [r["grown_shard"] for r in got]


def test_weights_repeats_and_nulls(frame, collected):
    got = collected(sharding.assign_shards(frame(["x"] * 3000), [3.0, 1.0]))
    assert 0.7 < Counter(r["shard"] for r in got)[0] / len(got) < 0.8
    same = collected(sharding.assign_shards(frame(["x", "y", None, "x"], [None, None, 5, 5]), [1.0] * 4, rows_per_bucket=1))
    assert len(same) == 4 and len({r["shard"] for r in same if r["doc_id"] == 5}) == 1
    for shard in {r["shard"] for r in same}:
        own = sorted(r["slot"] for r in same if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert sharding.assign_shards(frame([]), [1.0]).count() == 0
    # ids and number of shards decide, whatever the texts
    assert [r["shard"] for r in collected(sharding.assign_shards(frame(["other"] * 50), [1.0] * 16))] == [r["shard"] for r in collected(sharding.assign_shards(frame(["text"] * 50), [1.0] * 16))]
