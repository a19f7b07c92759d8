import random
import re

import numpy as np
import xxhash

from docquarry.llm import simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, differ=2):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= differ:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_fingerprints_against_brute_force(odd):
    for text in [*odd, "The cat sat Ünder THE\x0bmat", "a b c " * 50_000]:
        if text is None or len(text) < 200_000:
            assert simhash.fingerprint(text) == brute(text)
    long = " ".join(str(k) for k in range(70_000))
    assert simhash.fingerprint(long) == brute(long)


def test_links_against_all_pairs(spark):
    r = random.Random(4)
    values = []
    for _ in range(40):
        v = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 30])):
            values.append(v)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                v ^= 1 << r.randrange(64)
    base = r.getrandbits(64)
    values += [base ^ k for k in range(300)] + [0, 3, (1 << 64) - 1]
    values = sorted(set(values))
    for differ in (2, 1, 0):
        signed = np.array(values, np.uint64).view(np.int64).tolist()
        frame = spark.createDataFrame([(v,) for v in signed], "fp long")
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(frame, differ).collect()]
        assert all((a ^ b).bit_count() <= differ for a, b in links)
        want, parent = groups(values, differ), {v: v for v in values}

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert {v: root(v) for v in values} == want
    found = dict(simhash.components(simhash.near_links(frame.unionAll(frame), 2)).collect())
    linked = groups(values, 2)
    sizes = {}
    for v in values:
        sizes.setdefault(linked[v], set()).add(v)
    for members in sizes.values():
        roots = {found.get(int(np.uint64(m).astype(np.int64)), "alone") for m in members}
        assert len(roots) == 1 and ("alone" in roots) == (len(members) == 1)


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(1000, 999)], "a long, b long")
    assert {r.root for r in simhash.components(links).collect() if r.v < 500} == {0}


def test_documents(frame, collected, odd):
    ids = [None, None, *range(2, len(odd))]
    got = collected(simhash.near_duplicates(frame(odd, ids)))
    assert len(got) == len(odd)
    prints = [brute(t) for t in odd]
    linked = groups(prints)
    for r in got:
        if r["doc_id"] is not None:
            k = r["doc_id"]
            assert r["fingerprint"] == f"{prints[k]:016x}"
            assert r["component_id"] == min(i for i, p in enumerate(prints) if i > 1 and linked[p] == linked[prints[k]])
    kept = collected(simhash.keep_one(frame(odd, ids)))
    assert {r["doc_id"] for r in kept} == {r["component_id"] for r in got}
    assert simhash.keep_one(frame(odd)).columns == frame(odd).columns
    assert simhash.near_duplicates(frame([])).count() == 0 and simhash.keep_one(frame([])).count() == 0
    assert simhash.keep_one(frame(["a b c d"] * 3, [7, 7, 7])).count() == 1
    assert simhash.keep_one(frame(["one two three four", "five six seven eight nine"], [None, None])).count() == 2
