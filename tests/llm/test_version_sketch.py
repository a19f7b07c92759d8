import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.llm import version_sketch as vs


def paragraphs(text):
    quarter = [*range(0x21, 0x7F, 4), 0x20]
    low, high = range(0x80, 0x800, 64), range(0x800, 0xD800, 4096)

    def marked(c):
        c = ord(c)
        return c in quarter or any(x <= c < x + 16 for x in low) or any(x <= c < x + 1024 for x in high)

    found, start = set(), 0
    for at in range(1, len(text) + 1):
        if (at - start > 96 and text[at - 1] == "\n") or (at - start >= 99 and all(map(marked, text[at - 3 : at]))):
            found.add(text[start:at])
            start = at
    return found | {text[start:]} - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(texts):
    rows = []
    for k, t in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        rows.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(paragraphs(t), paragraphs(edited)), jaccard(paragraphs(t), paragraphs(following))))
    return rows


def test_report_against_brute_force(frame, collected, odd):
    r = random.Random(6)
    lines = [f"line {k} 😀" for k in range(400)]
    texts = [t or "" for t in odd] + ["\n".join(r.sample(lines, r.choice([0, 1, 3, 10, 30, 120]))) for _ in range(60)]
    given = [None if k == 0 else t for k, t in enumerate(texts)]
    got = collected(vs.version_report(frame(given)))
    for row, want in zip(got, expected(texts), strict=True):
        assert (row["n_chars"], row["edited_sha256"]) == want[:2]
        assert row["near_edited"] == pytest.approx(want[2]) and row["near_next"] == pytest.approx(want[3])
    prints = {}
    for row, t in zip(got, texts, strict=True):
        assert prints.setdefault(t, row["fingerprint"]) == row["fingerprint"]
    direct = frame(texts).select("doc_id", vs.fingerprint(F.col("text")).alias("f"))
    assert {r.doc_id: r.f for r in direct.collect()} == {r["doc_id"]: r["fingerprint"] for r in got}


def test_peeling_recovers_digests(spark):
    one, other = list(range(1, 9)), list(range(5, 15))
    row = spark.createDataFrame([(one, other)], "a array<long>, b array<long>")
    seed = F.lit(1)
    got = row.select(vs.peel(vs.subtract(vs.sketch(F.col("a"), seed), vs.sketch(F.col("b"), seed)), seed).alias("p")).first().p
    assert got.ok and {(x.n, x.k) for x in got.found} == {(1, k) for k in range(1, 5)} | {(-1, k) for k in range(9, 15)}


def test_overfull_sketches_are_retried_larger(spark):
    sets = [(list(range(n)), list(range(n // 2, n + m))) for n, m in ((40, 0), (200, 7), (500, 500), (0, 300))]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(sets)], "k int, a array<long>, b array<long>")
    rows = rows.select("*", vs.peel(vs.subtract(vs.sketch(F.col("a"), F.lit(1)), vs.sketch(F.col("b"), F.lit(1))), F.lit(1)).alias("first"))
    got = {r.k: r.d for r in rows.select("k", vs.differing(F.col("a"), F.col("b"), F.col("first")).alias("d")).collect()}
    assert got == {k: len(set(a) ^ set(b)) for k, (a, b) in enumerate(sets)}


def test_exact_where_no_retry_is_left(spark, monkeypatch):
    monkeypatch.setattr(vs, "RETRIES", 1)
    test_overfull_sketches_are_retried_larger(spark)


def test_edits_inside_one_long_line_are_graded(frame, collected):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = " ".join(words)
    texts = [text, "one more word " + text, " ".join(words[:1500] + ["in", "between"] + words[1500:]), "文字" + text]
    got = collected(vs.version_report(frame(texts)))
    assert all(row["near_next"] > 0.9 for row in got), got


def test_long_texts_take_time_in_proportion(frame, collected):
    r = random.Random(1)
    texts = ["\n".join(f"line {r.random()}" for _ in range(60_000)) for _ in range(2)]
    for row, want in zip(collected(vs.version_report(frame(texts))), expected(texts), strict=True):
        assert row["near_edited"] == pytest.approx(want[2]) and row["near_next"] == 0.0


def test_small_tables_nulls_and_repeats(frame, collected):
    assert vs.version_report(frame([])).count() == 0
    alone = collected(vs.version_report(frame(["abcdefgh"])))
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone[0]["near_next"] == 1.0
    got = collected(vs.version_report(frame(["aaaa", "bbbb", "bbbb", "cccc"], [1, 2, 2, None])))
    assert [r["doc_id"] for r in got] == [1, 2, 2, None] and got[1] == got[2]
    assert got[1]["edited_sha256"] == hashlib.sha256(b"bbbc").hexdigest() and got[3]["edited_sha256"] == hashlib.sha256(b"ccca").hexdigest()
