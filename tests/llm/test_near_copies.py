import random

import numpy as np

import corpus_pipeline
from docquarry.llm import near_copies


def grams(text):
    words = (text or "").lower().split(" ")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_kept(texts):
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {root(k) for k in range(len(texts))}


def planted(seed=5):
    """Texts and copies of them with a few words replaced, about similarity 0.5 to 1."""
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([3, 8, 40, 100, 300]))]
        texts.append(" ".join(words))
        for _ in range(r.choice([0, 1, 4])):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 22))):
                own[r.randrange(len(own))] = f"x{r.randrange(5000)}"
            texts.append(" ".join(own))
    r.shuffle(texts)
    return texts


def test_stage_keeps_one_of_all_near_copies(spark, frame):
    texts = planted()
    sets = [grams(t) for t in texts]
    found = [similarity(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= s < 0.9 for s in found) > 10 and sum(0.6 <= s < 0.8 for s in found) > 10
    kept = corpus_pipeline.deduplicate(spark, frame(texts), "")
    assert {r.doc_id for r in kept.collect()} == brute_kept(texts)


def test_odd_documents(frame, odd):
    got = near_copies.keep_one(frame(odd))
    assert got.columns == frame(odd).columns
    ids = {r.doc_id for r in got.collect()}
    # without words, alike but for case, repeated
    assert 0 in ids and not ids & {1, 2, 3} and len(ids) == len(odd) - 3 - 1 - 1
    assert near_copies.keep_one(frame([])).count() == 0
    assert near_copies.keep_one(frame(["a b c d"] * 3, [7, 7, 7])).count() == 1
    assert near_copies.keep_one(frame(["one two three four", "five six seven eight nine"], [None, None])).count() == 2


def signed(values):
    return np.array(values, np.uint64).view(np.int64).tolist()


def rooted(links, values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_simhash_of_a_set_against_brute_force():
    for text in ["a", "one two three four five six", " ".join(f"w{k % 7000}" for k in range(9000))]:
        own = near_copies.shingles(text).tolist()
        assert near_copies.sim_bits(near_copies.shingles(text)) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    assert near_copies.sim_bits(near_copies.shingles("")) == 0


def test_candidates_are_all_within_the_distance(spark):
    """The stage's SimHash index links all that are up to DIFFER bits apart, and nothing else."""
    r, values = random.Random(6), [0, 63, (1 << 64) - 1]
    for size in (1, 2, 5, 60, 400):
        for _ in range(3):
            v = r.getrandbits(64)
            for _ in range(size):
                values.append(v ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))))
    values = sorted(set(values))
    frame = spark.createDataFrame([(v, v, 10) for v in signed(values)], "fp long, sim long, size long")
    for differ in (near_copies.DIFFER, 3):
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in near_copies.by_fingerprint(frame, differ=differ).collect()]
        assert all((a ^ b).bit_count() <= differ for a, b in links)
        every = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= differ]
        assert rooted(links, values) == rooted(every, values)


def test_simhash_index_links_without_keys(spark):
    """Near copies are found by the SimHash index itself where no MinHash key is given."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(["start", *words[1:-1], "end"]), " ".join(f"x{k}" for k in range(400))]
    own = [near_copies.shingles(t) for t in texts]
    rows = [(k, s, len(g), []) for k, (g, s) in enumerate(zip(own, signed([near_copies.sim_bits(g) for g in own]), strict=True))]
    sets = spark.createDataFrame(rows, "fp long, sim long, size long, keys array<long>")
    bodies = spark.createDataFrame(list(enumerate(texts)), "fp long, body string")
    links = near_copies.near_links(sets, lambda fps: bodies.join(fps, "fp")).collect()
    assert rooted(links, range(4)) == {0: 0, 1: 0, 2: 0, 3: 3}


def test_group_below_the_similarity_loses_no_link(spark, frame, monkeypatch):
    """Many texts alike but mostly not enough, in buckets cut into several parts."""
    r = random.Random(8)
    words, texts = [f"w{k}" for k in range(120)], []
    for _ in range(150):
        own = list(words)
        for at in r.sample(range(120), r.choice([2, 3, 4])):
            own[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
        if r.random() < 0.2:
            own[r.randrange(120)] = "y"
            texts.append(" ".join(own[: r.randint(100, 120)]))
    want = brute_kept(texts)
    assert 10 < len(want) < len(texts) - 10
    for cell in (near_copies.CELL, 1500):
        monkeypatch.setattr(near_copies, "CELL", cell)
        assert {k.doc_id for k in near_copies.keep_one(frame(texts)).collect()} == want
