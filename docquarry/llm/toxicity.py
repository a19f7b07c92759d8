"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - f) with one score f = w.x shared by all
thresholds theta_0 < theta_1 < ...; the expected grade, from 0 to the number of
thresholds, is the severity.  Features are the presence of a text's words and of
their first letters, taken over the whole text.

Labels tell only toxic or not.  Grades are made from them: 0 for clean; toxic
documents are split into grades 1 to 3 at the terciles of their score in a first
two-grade fit, that is by how much evidence they hold.  Rows held out (crc32 of the id as text,
modulo 5, is 0) are never learnt from.

Null and empty texts have no features and get the severity of an empty text;
null ids are never learnt from.  Repeated rows score alike.  The fit sees at most LABEL_ROWS labelled
rows and FIT_CHARS characters of their whole texts; of rows with one id it sees the shortest text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import prepare_workers

#: Bounds of the fit: labelled rows, and characters of all their texts.
LABEL_ROWS, FIT_CHARS = 8000, 48_000_000
#: Deviations by which a feature's share must differ between toxic and clean texts.
Z_LEAST = 5.0
#: Hashes of features that are held before they are counted.
PENDING = 1 << 20
PREFIXES = (4, 5)
GRADES = 4
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", chars: int = FIT_CHARS) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts that aren't held out, in the order of a hash of the id, and of these
    what fits into ``chars`` characters: a text longer than what is left is passed over.  Null texts
    are empty ones.  The ids are chosen first and lengths are looked up before texts, so that what
    is broadcast or collected has these bounds."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("fit_id"), F.col(label).cast("int").alias("fit_label")).orderBy(F.xxhash64("fit_id"), "fit_id", "fit_label").limit(rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("fit_doc"), F.length(text).alias("n"), F.xxhash64(text).alias("mark"))
    sized = slim.join(F.broadcast(chosen.select("fit_id").distinct()), F.col("fit_doc") == F.col("fit_id")).groupBy("fit_doc").agg(F.min(F.struct("n", "mark")).alias("one"))
    picked, left = [], chars
    for r in sorted(sized.select("fit_doc", "one.*", F.xxhash64("fit_doc").alias("h")).collect(), key=lambda r: (r.h, r.fit_doc)):
        if r.n <= left:
            picked.append((r.fit_doc, r.n, r.mark))
            left -= r.n
    if not picked:
        return [], np.zeros(0, np.int64)
    kind = docs.schema[id_col].dataType.simpleString()
    # as Arrow: from Python's rows it would take Python workers of another environment beside the operators'
    table = pa.table({"fit_id": [p[0] for p in picked], "fit_mark": [p[2] for p in picked]})
    keys = docs.sparkSession.createDataFrame(table, f"fit_id {kind}, fit_mark long")
    bodies = docs.select(F.col(id_col).alias("fit_doc"), text.alias("fit_text")).join(F.broadcast(keys), (F.col("fit_doc") == F.col("fit_id")) & (F.xxhash64("fit_text") == F.col("fit_mark")))
    texts = dict(bodies.groupBy("fit_doc").agg(F.min("fit_text").alias("fit_text")).collect())
    got = sorted((r.fit_id, r.fit_label) for r in chosen.collect() if r.fit_id in texts)
    return [texts[i] for i, _ in got], np.array([y for _, y in got], np.int64)


def features(text: str | None) -> set[str]:
    """Lower-case words of letters, and the first letters of longer words."""
    words = set(_LETTERS.findall((text or "").lower()))
    for n in PREFIXES:
        words.update([f"{w[:n]}*" for w in words if len(w) > n and w[-1] != "*"])
    return words


@dataclass
class OrdinalModel:
    """Weights of features and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def score(self, text: str | None) -> float:
        known, total = self.weights.get, 0.0
        seen = set()
        for w in set(_LETTERS.findall((text or "").lower())):
            total += known(w, 0.0)
            for n in PREFIXES:
                if len(w) > n:
                    seen.add(w[:n])
        for p in seen:
            total += known(p + "*", 0.0)
        return total

    def grades(self, score: float) -> list[float]:
        """Probability of each grade."""
        upto = [1 / (1 + math.exp(min(700.0, score - t))) for t in self.thresholds] + [1.0]
        return [b - a for a, b in zip([0.0, *upto], upto, strict=False)]


def _fit(rows: list[np.ndarray], grades: np.ndarray, n: int, levels: int, rounds: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch Adam on the cumulative-link likelihood; equal on every run."""
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]) if rows else np.zeros(0, int)
    cols = np.concatenate(rows) if rows else np.zeros(0, int)
    w = np.zeros(n)
    share = np.array([(grades <= k).mean() for k in range(levels - 1)]) if len(grades) else np.full(levels - 1, 0.5)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1)
    params = np.concatenate([w, [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    index = np.arange(len(grades))
    for step in range(1, rounds + 1):
        w, gaps = params[:n], np.exp(params[n + 1 :])
        theta = params[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, w[cols], len(grades)) if len(at) else np.zeros(len(grades))
        upto = np.hstack([np.zeros((len(grades), 1)), 1 / (1 + np.exp(np.clip(score[:, None] - theta, -60, 60))), np.ones((len(grades), 1))])
        p = np.maximum(upto[index, grades + 1] - upto[index, grades], 1e-9)
        slope = upto * (1 - upto)
        hi, lo = slope[index, grades + 1] / p, slope[index, grades] / p
        d_score = (hi - lo) / len(grades)
        d_theta = np.array([(lo[grades == k + 1].sum() - hi[grades == k].sum()) for k in range(levels - 1)]) / max(1, len(grades))
        grad = np.concatenate([np.bincount(cols, d_score[at], n) + l2 * w if len(at) else l2 * w, [d_theta.sum()], gaps * np.cumsum(d_theta[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n], params[n] + np.concatenate([[0.0], np.cumsum(np.exp(params[n + 1 :]))])


def _deviations(k1, k0, n1: int, n0: int):
    """By how many deviations a feature's shares of toxic and clean texts differ."""
    share = (k1 + k0 + 1) / (n1 + n0 + 2)
    return (k1 / n1 - k0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))


def _counted(held: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct numbers and how often each came, from rows of (numbers, counts)."""
    every, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return [(every, np.bincount(back, np.concatenate([n for _, n in held]), len(every)).astype(np.int64))]


def evident(texts: list[str], toxic: np.ndarray) -> tuple[list[str], list[list[str]]]:
    """Features whose share of toxic texts differs from that of clean ones by more than
    Z_LEAST deviations, in at least 3 texts, the most telling first; and those of every text.

    Features are counted by their 64-bit hashes, so that only the telling ones are held by name.
    """
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    counts = []
    for label in (0, 1):
        held, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for text in (t for t, y in zip(texts, toxic.tolist(), strict=True) if y == label):
            own = np.fromiter((xxhash.xxh64_intdigest(f) for f in features(text)), np.uint64)
            held.append((own, np.ones(len(own), np.int64)))
            size += len(own)
            if size > PENDING:
                held, size = _counted(held), 0
        counts.append(_counted(held)[0])
    every = np.union1d(counts[0][0], counts[1][0])
    k0, k1 = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for k, (keys, n) in zip((k0, k1), counts, strict=True):
        k[np.searchsorted(every, keys)] = n
    z = _deviations(k1, k0, n1, n0)
    able = (k0 + k1 > 2) & (np.abs(z) > Z_LEAST)
    telling = dict(zip(every[able].tolist(), np.abs(z[able]).tolist(), strict=True))
    names: dict[str, float] = {}
    found = []
    for text in texts:
        own = [(f, h) for f in features(text) if (h := xxhash.xxh64_intdigest(f)) in telling]
        names.update((f, telling[h]) for f, h in own)
        found.append([f for f, _ in own])
    return sorted(names, key=lambda f: (-names[f], f)), found


def train(texts: list[str], toxic: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> OrdinalModel:
    """Fits grades made from 0/1 labels; without both labels no feature has weight."""
    if len(texts) == 0 or len(set(toxic.tolist())) < 2:
        return OrdinalModel({}, [3.0, 4.0, 5.0])
    kept, found = evident(texts, toxic)
    place = {f: i for i, f in enumerate(kept)}
    rows = [np.array(sorted(place[f] for f in fs if f in place), np.int64) for fs in found]
    w, _ = _fit(rows, toxic, len(kept), 2, rounds, l2)
    evidence = np.array([w[r].sum() for r in rows])
    cuts = np.unique(np.quantile(evidence[toxic == 1], [k / (GRADES - 1) for k in range(1, GRADES - 1)]))
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, "left"), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # ties may leave a grade empty
    w, theta = _fit(rows, grades, len(kept), int(grades.max()) + 1, rounds, l2)
    return OrdinalModel({f: float(x) for f, x in zip(kept, w, strict=True) if abs(x) > 0.01}, theta.tolist())


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, severity double, grade int, toxic int): expected grade, likeliest
    grade, and 1 where a toxic grade is likelier than none.  The model, of as many weights as
    a bounded sample has telling features, travels with the task."""
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                p = own.grades(own.score(text))
                rows.append((sum(k * x for k, x in enumerate(p)), max(range(len(p)), key=lambda k: (p[k], -k)), int(p[0] < 0.5)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["id", "severity", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, severity double, grade int, toxic int")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "severity", "grade", "toxic")
