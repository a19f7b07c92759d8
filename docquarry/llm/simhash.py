"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint has 64 bits, each set if it is set in over half the hashes of the text's
word shingles.  Documents whose fingerprints differ in at most two bits are linked, and
linked documents form components.

Equal fingerprints are one from the start.  Two bits lie in at most two of a fingerprint's
eight bytes, so two linked fingerprints agree in six bytes: each such masked pattern of 48 bits, 28
for a fingerprint, is an upper node of the index, and both lie in one node.  A node's members
are sorted by Gray rank; those that share one of the two free bytes form a subnode, and pairs of
subnodes are pruned as wholes once their difference exceeds what is allowed, before
the last byte adds its own.  A node has at most 65,536 members, however the data lie, so no node can
outgrow a task.  It puts out a spanning forest of its links, never all pairs.

The components of these links are found by alternating large and small stars, with every
round kept under spark.checkpoint.dir.

Null texts count as empty; texts without words have fingerprint zero and are linked like
others.  A component is named by its smallest id that isn't null; where all are null it is
null.  Repeated rows are linked by their equal fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import ensure_checkpoint_dir, prepare_workers

SHINGLE, SEED, DIFFER = 3, 42, 2
#: Shingles whose bits are counted at a time.
PART = 1 << 15
NODES = list(combinations(range(8), 2))
#: Nodes up to this size are compared pair by pair where more than two bytes are free.
SMALL = 16
_BITS = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only the six blanks split
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    total = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        upto = min(n, at + PART)
        own = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[at:upto].tolist(), ends[at + shingle - 1 : upto + shingle - 1].tolist(), strict=True)), np.uint64, upto - at)
        total += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The carried columns and ``fp``, the fingerprint as a signed long."""
    prepare_workers(docs.sparkSession)
    n = len(carry)

    def run(batches):
        for batch in batches:
            own = np.array([fingerprint(t, shingle, seed) for t in batch.column(n).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(own, pa.int64())], names=[*(str(k) for k in range(n)), "fp"])

    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    schema = "".join(f"`{k}` {kind}, " for k, kind in enumerate(kinds)) + "fp long"
    return docs.select(*carry, text_col).mapInArrow(run, schema).toDF(*carry, "fp")


# -- the index --


def gray_rank(byte: np.ndarray) -> np.ndarray:
    """Place of a byte in the Gray sequence: neighbours differ in one bit."""
    byte = byte ^ (byte >> 4)
    byte = byte ^ (byte >> 2)
    return byte ^ (byte >> 1)


def _forest(members: np.ndarray, first: int, second: int, differ: int) -> list[tuple[int, int]]:
    """Links that span the components of one node's members (distinct, equal in all but
    two bytes)."""
    high = (members >> np.uint64(8 * first) & np.uint64(255)).astype(np.uint8)
    low = (members >> np.uint64(8 * second) & np.uint64(255)).astype(np.uint8)
    order = np.lexsort((gray_rank(low), gray_rank(high)))
    members, high, low = members[order], high[order], low[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1, [len(high)]])
    heads = high[cuts[:-1]]
    parent = list(range(len(members)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    for i in range(len(heads)):
        apart = _BITS[heads[i:] ^ heads[i]]
        for j in np.flatnonzero(apart <= differ).tolist():
            a, b = slice(cuts[i], cuts[i + 1]), slice(cuts[i + j], cuts[i + j + 1])
            near = _BITS[low[a][:, None] ^ low[b][None, :]] <= differ - apart[j]
            for x, y in np.argwhere(near).tolist():
                u, v = root(cuts[i] + x), root(cuts[i + j] + y)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    links.append((int(members[cuts[i] + x]), int(members[cuts[i + j] + y])))
    return links


def _search(members: np.ndarray, free: tuple[int, ...], differ: int) -> list[tuple[int, int]]:
    """Links that span the components of one node's members (distinct, equal in all but the
    free bytes): each member reached asks the subnodes in Gray order for those not yet reached."""
    upper = np.uint64(sum(255 << 8 * k for k in free[: len(free) // 2]))
    left = members[np.lexsort([gray_rank((members >> np.uint64(8 * k)).astype(np.uint8)) for k in reversed(free)])]
    links, queue = [], []
    while len(left):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(left & upper)) + 1, [len(left)]])
        heads, spans = left[cuts[:-1]] & upper, np.diff(cuts)
        here, at, gone = np.ones(len(left), bool), 0, 0
        while 2 * gone <= len(left):
            if not queue:
                at += int(here[at:].argmax())
                here[at] = False
                gone += 1
                queue.append(left[at])
            asked = queue.pop()
            # a subnode is pruned as a whole once its own bytes differ by too much
            close = np.flatnonzero(np.bitwise_count(heads ^ (asked & upper)) <= differ)
            own = spans[close]
            places = np.repeat(cuts[close] - np.cumsum(own) + own, own) + np.arange(own.sum())
            places = places[here[places]]
            near = places[np.bitwise_count(left[places] ^ asked) <= differ]
            here[near] = False
            gone += len(near)
            queue.extend(left[near])
            links += [(int(m), int(asked)) for m in left[near]]
        left = left[here]
    return links


def _small(node: np.ndarray, members: np.ndarray, differ: int) -> list[tuple[int, int]]:
    """All links within small nodes, each a run of equal ``node``."""
    links = []
    for k in range(1, SMALL):
        same = np.flatnonzero(node[k:] == node[:-k])
        if not len(same):
            break
        same = same[np.bitwise_count(members[same + k] ^ members[same]) <= differ]
        links += zip(members[same + k].tolist(), members[same].tolist(), strict=True)
    return links


def near_links(distinct: DataFrame, differ: int = DIFFER) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints ``fp`` that connect all that are
    at most ``differ`` (0 to 6) bits apart.

    Beyond two bits a node has as many free bytes as bits may differ, so it may have more members than
    65,536; unlike fingerprints fill it with one in 2 to the power of its fixed bits.
    """
    if not 0 <= differ <= 6:
        raise ValueError("differ must be 0 to 6")
    prepare_workers(distinct.sparkSession)
    nodes = NODES if differ <= 2 else list(combinations(range(8), differ))
    masks = [~sum(255 << 8 * k for k in free) & (1 << 64) - 1 for free in nodes]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    node = F.explode(F.array(*(F.struct(F.lit(k).alias("node"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for k, m in enumerate(signed))))
    keyed = distinct.select("fp", node.alias("n")).select("n.node", "n.pattern", "fp")
    dealt = keyed.repartition("node", "pattern").sortWithinPartitions("node", "pattern", "fp")

    def run(batches):
        held: list[np.ndarray] = []  # the node that the last batch ended in

        def links(node: np.ndarray, pattern: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(node) != 0) | (np.diff(pattern) != 0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(node)]])
            found, sizes = [], ends - starts
            if differ > 2:
                few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
                found += _small(np.repeat(np.arange(len(sizes)), sizes)[few], fp.view(np.uint64)[few], differ)
            for k in np.flatnonzero(sizes > (SMALL if differ > 2 else 1)).tolist():
                free, members = nodes[int(node[starts[k]])], fp[starts[k] : ends[k]].view(np.uint64)
                found += _forest(members, *free, differ) if differ <= 2 else _search(members, free, differ)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.max(1) if len(pairs) else pairs[:, 0], pa.int64()), pa.array(pairs.min(1) if len(pairs) else pairs[:, 1], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = (now[0] != now[0][-1]) | (now[1] != now[1][-1])
            cut = int(last.sum())  # sorted: the last node is a suffix
            if cut:
                yield links(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held:
            yield links(*held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, root): for every linked value the smallest of its component.  Large and small
    stars alternate; each halves the depth of the trees, and hubs are met by joins only."""
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = star.union(down.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _classes(slim: DataFrame, differ: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint of the kept rows ``slim``."""
    distinct = slim.select("fp").distinct()
    found = components(near_links(distinct, differ))
    return distinct.join(found, F.col("fp") == F.col("v"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", differ: int = DIFFER, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fingerprint, component_id): one row per row."""
    ensure_checkpoint_dir(docs.sparkSession)
    slim = fingerprints(docs, [id_col], text_col, shingle, seed).select(F.col(id_col).alias("id"), "fp").checkpoint()
    least = slim.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = _classes(slim, differ).join(least, "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("own"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return slim.join(by_fp, F.col("fp") == F.col("own"), "left").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", differ: int = DIFFER, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest id, nulls last,
    and among rows that share it the one whose text has the smallest hash."""
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("text_hash"), F.col(text_col).alias("body"))
    slim = fingerprints(keyed, ["id", "text_hash"], "body", shingle, seed).checkpoint()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    least = slim.groupBy("fp").agg(first.alias("least"))
    kept = _classes(slim, differ).join(least, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("__id"), F.col("least.text_hash").alias("__hash"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(id_col).alias("__own"), key.alias("__own_hash"))
    rows = rows.join(kept, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__own_hash") == F.col("__hash")), "left_semi")
    # rows alike in id and text
    alike = Window.partitionBy("__own", "__own_hash").orderBy("__own")
    return rows.withColumn("__at", F.row_number().over(alike)).where("__at = 1").select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
