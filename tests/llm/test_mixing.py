import random
from collections import defaultdict
from fractions import Fraction

from docquarry.llm import mixing


def brute_targets(sizes):
    """Sources' targets by plain filling up."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(2.0 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= above


def check(got, texts, sources, slack=mixing.BLOCK):
    words = [len((t or "").encode().split()) for t in texts]
    sizes = defaultdict(int)
    for s, n in zip(sources, words, strict=True):
        sizes[s] += n
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1.0, want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack, (s, taken[s], want[s])


def test_targets_and_taken(frame, collected, odd):
    texts = odd + [f"w{k} " * (k % 90) for k in range(600)]
    sources = [["b", "a", None, "Z", "é", "tiny"][min(5, k % 7)] for k in range(len(texts))]
    sources = ["tiny" if k == 5 else "b" if s == "tiny" else s for k, s in enumerate(sources)]
    docs = frame(texts, sources=sources)
    first = collected(mixing.mix_report(docs))
    check(first, texts, sources)
    assert first == collected(mixing.mix_report(docs.repartition(3)))


def test_hot_source_over_many_shards(frame, collected, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_SHARD", 20)
    texts = ["a b c d e f g h i j k l"] * 500
    sources = ["hot"] * 400 + ["x", "y", "z", "u"] * 25
    check(collected(mixing.mix_report(frame(texts, sources=sources))), texts, sources)


def test_many_sources_without_broadcast(frame, collected, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    texts = [f"{k} two three four five" for k in range(60)]
    sources = [f"s{k % 30}" for k in range(60)]
    check(collected(mixing.mix_report(frame(texts, sources=sources))), texts, sources)


def test_mixture_holds_what_the_report_counts(frame, collected):
    texts = ["  lead and  more\n words here ", "one", "", None, *(f"alpha beta{k} gamma delta epsilon zeta eta theta iota kappa" for k in range(80))]
    sources = [("p", "q", "r")[k % 3] for k in range(len(texts))]
    docs = frame(texts, sources=sources)
    report, mixture = collected(mixing.mix_report(docs)), collected(mixing.mix_documents(docs))
    assert list(mixture[0]) == docs.columns
    held = defaultdict(int)
    for r in mixture:
        held[r["doc_id"]] += len(r["text"].split())
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert dict(held) == {r["doc_id"]: r["taken"] for r in report if r["taken"]}


def test_nothing_to_take(frame, collected):
    assert mixing.mix_report(frame([])).count() == 0 and mixing.mix_documents(frame([])).count() == 0
    assert [(r["taken"], r["target"]) for r in collected(mixing.mix_report(frame(["", None])))] == [(0, 0.0)] * 2


def brute_seats(parties, house):
    """Seats one at a time to the highest quotient; equal ones by the party's number."""
    seats = {p: 0 for p, _, _ in parties}
    for _ in range(min(house, sum(c for _, _, c in parties))):
        best = max((p for p in parties if seats[p[0]] < p[2]), key=lambda p: (Fraction(p[1], 2 * seats[p[0]] + 1), -p[0]))
        seats[best[0]] += 1
    return seats


def test_apportionment_against_brute_force(spark):
    r = random.Random(5)
    groups = {
        "like": ([(k, 7, 9) for k in range(60)], 37),
        "one large": ([(0, 100_000, 10**6), *((k, 55, 10**6) for k in range(1, 40))], 1000),
        "small ones": ([(0, 1000, 10**6), *((k, 1, 10**6) for k in range(1, 80))], 600),
        "few seats": ([(k, r.randint(1, 9), 5) for k in range(50)], 4),
        "caps": ([(k, r.randint(1, 50), r.randint(0, 3)) for k in range(50)], 70),
        "all caps": ([(k, r.randint(1, 50), 2) for k in range(20)], 70),
        "nothing": ([(0, 0, 0), (1, 0, 0)], 0),
        **{f"r{j}": ([(k, r.choice((1, 2, 3, 5, 8, 13, 400)), r.randint(1, 60)) for k in range(r.randint(1, 30))], r.randint(0, 200)) for j in range(30)},
    }
    rows = [(g, p, float(v), float(sum(x for _, x, _ in ps)), h, c) for g, (ps, h) in groups.items() for p, v, c in ps]
    got = defaultdict(dict)
    for x in mixing.apportion(spark.createDataFrame(rows, "group string, party long, votes double, all double, house long, cap long").repartition(5)).collect():
        got[x.group][x.party] = x.seats
    for g, (ps, h) in groups.items():
        assert got[g] == brute_seats(ps, h), g


def test_many_like_sources(frame, collected):
    """Ties everywhere: every source within a block of its target, and all words near theirs."""
    texts = ["a b c d e f g"] * 3000
    got = collected(mixing.mix_report(frame(texts, sources=[f"s{k:04d}" for k in range(3000)])))
    check(got, texts, [f"s{k:04d}" for k in range(3000)])
    assert abs(sum(r["taken"] for r in got) - 31_500) <= 3000
    texts, sources = ["one two three", "four"] * 1500, [f"s{k // 2:04d}" for k in range(3000)]
    check(collected(mixing.mix_report(frame(texts, sources=sources))), texts, sources)


def test_repeated_rows_are_spread(frame, collected, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_SHARD", 20)
    texts = ["the same row of six words"] * 300 + [f"other row {k}" for k in range(300)]
    ids, sources = [7] * 300 + list(range(100, 400)), ["hot"] * 300 + ["hot", "x", "y"] * 100
    docs = frame(texts, ids, sources=sources)
    got = collected(mixing.mix_report(docs))
    assert len(got) == 600 and got == collected(mixing.mix_report(docs.repartition(7)))
    taken, target = defaultdict(int), {}
    for r, s in zip(sorted(got, key=lambda r: r["doc_id"]), sources, strict=True):
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target)
