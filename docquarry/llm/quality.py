"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded and cut into chunks of CHUNK bytes that overlap by a filter's width less one, so that
every window of the whole text, at every byte, lies in exactly one chunk.  Learned filters take
the windows and are max-pooled in every chunk; the chunks' maxima are combined by their mean, their maximum
and their minimum over the text into one probability through a small learned layer.  Nothing but
the filters' outputs is seen: repetition shows in chunks where few of the filters find anything.

Null and empty texts are one chunk of padding.  Memory is bounded by one text
beside a fixed block.  Training is deterministic, on the whole texts of a bounded sample of
the labelled rows that aren't held out (crc32 of the id as text, modulo 5, is 0: held out): at most LABEL_ROWS
rows, and FIT_CHARS characters of toxicity.fit_rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import prepare_workers
from docquarry.llm.toxicity import fit_rows, held_out

#: Labelled rows to learn from, threshold.
LABEL_ROWS, THRESHOLD = 4000, 0.3
CHUNK, WIDTH, DIM, FILTERS, HIDDEN = 512, 8, 8, 32, 16
PAD = 0
#: Training steps, whatever the number of rows.
STEPS = 600
#: Bytes that are convolved at a time: whole chunks.
BLOCK = 1 << 16


@dataclass
class ByteNet:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> ByteNet:
        r = np.random.default_rng(seed)
        n = 3 * FILTERS
        f = np.float32
        return cls(r.normal(0, 0.5, (256, DIM)).astype(f), r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(f), np.zeros(FILTERS, f), r.normal(0, n**-0.5, (n, HIDDEN)).astype(f), np.zeros(HIDDEN, f), r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f), np.zeros(1, f))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]


def chunked(raw: bytes) -> np.ndarray:
    """The bytes padded to whole chunks, with at least a filter's width of padding, so
    that no window reaches into the text that follows in a block."""
    n = (len(raw) + WIDTH + CHUNK - 1) // CHUNK * CHUNK
    return np.frombuffer(raw.ljust(n, b"\0"), np.uint8)


def windows(net: ByteNet, data: np.ndarray) -> np.ndarray:
    """Filter outputs of the windows at every byte of data but the last WIDTH: chunks x CHUNK x FILTERS.
    Data is whole chunks and the first WIDTH bytes of what follows."""
    x = net.embed[data]
    m = (len(data) - WIDTH) // WIDTH
    out = np.empty((m, WIDTH, FILTERS), np.float32)
    for k in range(WIDTH):
        out[:, k] = x[k : k + m * WIDTH].reshape(m, WIDTH * DIM) @ net.filters
    return out.reshape(-1, CHUNK, FILTERS)


def pooled(net: ByteNet, data: np.ndarray, last: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Max-pooled filters of every chunk before bias, and the places of the maxima where asked for,
    a block at a time.  Windows of padding that reach over the end of a text, in its ``last``
    chunk, are left out."""
    tops, bests = [], []
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    for at in range(0, len(data) - WIDTH, BLOCK):
        own = windows(net, data[at : at + BLOCK + WIDTH])
        own[last[at // CHUNK : at // CHUNK + len(own)], 1 - WIDTH :] = -np.inf
        if places:
            bests.append(own.argmax(1))
            tops.append(np.take_along_axis(own, bests[-1][:, None, :], 1)[:, 0])
        else:
            tops.append(own.max(1))
    return np.vstack(tops), np.vstack(bests) if places else None


def ends_of(sizes: list[int]) -> np.ndarray:
    """Which chunks are the last of texts of so many chunks."""
    last = np.zeros(sum(sizes), bool)
    last[np.cumsum(sizes) - 1] = True
    return last


def summaries(chunks: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Mean, maximum and minimum over each text's chunks."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mean = np.add.reduceat(chunks, starts) / np.array(sizes, np.float32)[:, None]
    return np.hstack([mean, np.maximum.reduceat(chunks, starts), np.minimum.reduceat(chunks, starts)]).astype(np.float32)


def probabilities(net: ByteNet, summary: np.ndarray) -> np.ndarray:
    z = np.tanh(summary @ net.w1 + net.b1) @ net.w2 + net.b2
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def score_texts(net: ByteNet, texts: list[str | None]) -> np.ndarray:
    """One probability for each text; texts are gathered into blocks."""
    scores, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            sizes = [len(d) // CHUNK for d in held]
            top, _ = pooled(net, np.concatenate(held), ends_of(sizes))
            scores.append(probabilities(net, summaries(np.maximum(top + net.bias, 0), sizes)))
        held, size = [], 0

    for text in texts:
        held.append(chunked((text or "").encode()))
        size += len(held[-1])
        if size >= BLOCK:
            flush()
    flush()
    return np.concatenate(scores) if scores else np.zeros(0)


def train(texts: list[str], good: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 6e-3, seed: int = 7) -> ByteNet:
    """Adam on the cross entropy over whole texts; the gradient of a pooled filter goes to the
    window that gave the maximum."""
    net, r = ByteNet.fresh(seed), np.random.default_rng(seed)
    if not len(texts):
        return net
    data = [chunked(t.encode() if t else b"") for t in texts]
    params = net.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # rare label: each class weighs alike in half
    share = float(np.clip(good.mean(), 0.02, 0.98))
    weight = np.where(good == 1, 0.5 + 0.25 / share, 0.5 + 0.25 / (1 - share))
    step = 0
    while step < steps:
        order = r.permutation(len(data))
        for at in range(0, min(len(order), (steps - step) * batch), batch):
            rows = order[at : at + batch]
            sizes = [len(data[i]) // CHUNK for i in rows]
            flat = np.concatenate([data[i] for i in rows])
            top, best = pooled(net, flat, ends_of(sizes), places=True)
            act = np.maximum(top + net.bias, 0)
            summary = summaries(act, sizes)
            hidden = np.tanh(summary @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))
            dz = ((p - good[rows]) * weight[rows] / len(rows)).astype(np.float32)
            d_hidden = dz[:, None] * net.w2 * (1 - hidden**2)
            d_sum = d_hidden @ net.w1.T
            owner = np.repeat(np.arange(len(rows)), sizes)
            d_mean, d_most, d_least = np.split(d_sum[owner], 3, axis=1)
            _, most, least = np.split(summary[owner], 3, axis=1)
            d_chunk = d_mean / np.array(sizes, np.float32)[owner][:, None] + d_most * (act == most) + d_least * (act == least)
            d_chunk *= act > 0
            starts = np.arange(len(act))[:, None] * CHUNK + best  # chunks x FILTERS
            padded = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
            d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            for k in range(WIDTH):  # one tap of all windows at a time
                seen = padded[starts + k]
                rows_of = slice(k * DIM, (k + 1) * DIM)
                d_filters[rows_of] = np.einsum("cf,cfd->df", d_chunk, net.embed[seen])
                d_seen = (d_chunk[:, :, None] * net.filters[rows_of].T[None]).reshape(-1, DIM)
                for j in range(DIM):
                    d_embed[:, j] += np.bincount(seen.reshape(-1), d_seen[:, j], 256)
            grads = [d_embed, d_filters, d_chunk.sum(0), summary.T @ d_hidden + 1e-4 * net.w1, d_hidden.sum(0), hidden.T @ dz + 1e-4 * net.w2, dz.sum(keepdims=True)]
            step += 1
            now = rate * min(1.0, step / 50) * (1 - 0.9 * step / steps)
            for k, (q, g) in enumerate(zip(params, grads, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                q -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def score_documents(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted); the network, of a fixed size, travels with the task."""
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            scores = score_texts(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: ByteNet, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold."""
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept = score_texts(shared.value, batch.column(at).to_pylist()) >= threshold
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> ByteNet:
    """A network learnt from at most ``rows`` labelled rows."""
    texts, good = fit_rows(docs, labels, "quality", rows)
    return train(texts, good)
