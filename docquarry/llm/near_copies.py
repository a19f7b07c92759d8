"""Near copies of whole texts: SimHash through its Gray-order index, completed by MinHash keys, each
link confirmed by exact Jaccard similarity.

Two texts are near copies where the sets of their runs of SHINGLE words have a Jaccard similarity
of at least SIMILAR; near copies are linked, and linked texts form components.

Texts with equal sets are one from the start.  Every other set has a SimHash of 64 bits, and
``simhash.near_links`` finds those at most DIFFER bits apart: these candidates come first.  A pair at
similarity 0.8 differs by 9.7 bits on average, so no distance that an index can bear covers all such pairs:
what is still apart is looked for by BANDS keys, each from ROWS minima of the set under
its own multiplication; sets that share a key are candidates.  A pair at similarity 0.8 shares none with a probability of 5 in 10^8, and
a more similar one with less.  Candidates are compared by the shingles of their whole texts, so no
link is in doubt.  Of a bucket's pairs those are left that the index's links haven't joined and whose
sizes allow the similarity.  For these a bucket is cut into parts of about CELL shingles by size, and
each two parts are compared by themselves, so that a text is sent once for a part and not for a
pair, and no more than two parts are held at once.  Comparisons still grow with the square of a group that is
alike but below SIMILAR.

Words are runs of anything but the six ASCII blanks, with A-Z lowered.  Fewer words than SHINGLE are
one shingle; null texts count as empty, and texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import simhash
from docquarry.llm.common import ensure_checkpoint_dir, prepare_workers
from docquarry.llm.simhash import components

SHINGLE, SIMILAR = 5, 0.8
#: Bits in which the index's candidates differ at most.
DIFFER = 6
BANDS, ROWS = 32, 4
#: Shingles of a part of a bucket, what a set adds to its own.
CELL, CELL_ROW = 100_000, 100
#: Shingles whose minima are taken at a time, keys that may be broadcast.
PART, BROADCAST_KEYS = 4096, 200_000
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word runs."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only the six blanks split
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    runs = np.full(n, width, np.uint64)
    for k in range(width):
        runs = runs * _STEP + own[k : k + n]
    runs = (runs ^ (runs >> np.uint64(32))) * _MIX
    return np.unique(runs ^ (runs >> np.uint64(32)))


def sim_bits(grams: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is set in over half the shingles."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), PART):
        total += np.unpackbits(grams[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(grams), bitorder="little").tobytes(), "little")


def band_keys(grams: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that isn't empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), PART):
        np.minimum(least, (grams[at : at + PART] * _FACTORS[:, None]).min(1), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = keys * _STEP + row
        keys ^= keys >> np.uint64(29)
    return keys


def alike(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both >= similar * every - 1e-9 * every


def _sets(docs: DataFrame, kind: str) -> DataFrame:
    """(id, text_hash, fp, sim, size, keys): ``fp`` names the set of shingles, ``sim`` is its SimHash."""
    prepare_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints, sims, sizes, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                grams = shingles(text)
                prints.append(xxhash.xxh64_intdigest(grams.tobytes()))
                sims.append(sim_bits(grams))
                sizes.append(len(grams))
                keys.append(band_keys(grams).view(np.int64) if len(grams) else [])
            fp, sim = (np.array(x, np.uint64).view(np.int64) for x in (prints, sims))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array(sim), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_hash", "fp", "sim", "size", "keys"])

    return docs.mapInArrow(run, f"id {kind}, text_hash long, fp long, sim long, size long, keys array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of the distinct (a, b) whose texts, (fp, body), are near copies."""
    own = pairs.join(texts.select(F.col("fp").alias("a"), F.col("body").alias("left")), "a")
    own = own.join(texts.select(F.col("fp").alias("b"), F.col("body").alias("right")), "b")

    def run(batches):
        held, grams = None, None
        for batch in batches:
            kept = []
            for b, left, right in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if b != held:  # the join's order by b brings a text's pairs together
                    held, grams = b, shingles(right)
                kept.append(alike(shingles(left), grams, similar))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return own.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def few(keys: DataFrame) -> DataFrame:
    """Kept keys, to be broadcast where they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _fit(a: str, b: str, similar: float):
    """Whether two sizes allow the similarity."""
    return F.least(a, b) >= similar * F.greatest(a, b) - 1e-9 * F.greatest(a, b)


def by_fingerprint(sets: DataFrame, similar: float = SIMILAR, differ: int = DIFFER) -> DataFrame:
    """(a, b): candidates among the distinct sets (fp, sim, size): those of one SimHash with the least of
    them, and the least ones of SimHashes that the Gray-order index links."""
    heads = sets.groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("head")).checkpoint()
    like = sets.join(heads, "sim").where("fp <> head.fp").where(_fit("size", "head.size", similar)).select(F.col("fp").alias("a"), F.col("head.fp").alias("b"))
    near = simhash.near_links(heads.select(F.col("sim").alias("fp")), differ)
    x, y = (heads.select(F.col("sim").alias(c), F.col("head").alias(f"{c}_head")) for c in "ab")
    ends = near.join(x, "a").join(y, "b").where(_fit("a_head.size", "b_head.size", similar))
    return like.union(ends.select(F.greatest("a_head.fp", "b_head.fp").alias("a"), F.least("a_head.fp", "b_head.fp").alias("b")))


def _cell_links(rows: list[tuple], similar: float) -> list[tuple[int, int]]:
    """Links that connect all near copies between the rows (side, fp, root, keys before this band,
    shingles) of the two sides, or within the only side, but for what is joined or met in an earlier band."""
    rows.sort(key=lambda r: r[0])
    fp, root = [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
    keys = np.array([r[3] for r in rows], np.int64).reshape(len(rows), -1)
    sizes = np.array([len(r[4]) for r in rows])
    ends = np.cumsum(sizes)
    held, place = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
    own = np.zeros(len(held), np.uint8)
    first = sum(r[0] == 0 for r in rows)
    links = []
    for i in range(first):
        at = first if first < len(rows) else i + 1
        others = sizes[at:]
        open_ = (root[at:] != root[i]) & (np.minimum(others, sizes[i]) >= (similar - 1e-9) * np.maximum(others, sizes[i])) & ~(keys[at:] == keys[i]).any(1)
        if not open_.any():
            continue
        mine = place[ends[i] - sizes[i] : ends[i]]
        own[mine] = 1
        if open_.sum() < 16:
            both = np.array([own[place[ends[at + j] - others[j] : ends[at + j]]].sum(dtype=np.int64) for j in np.flatnonzero(open_)])
        else:
            start = ends[at] - sizes[at]
            both = np.add.reduceat(own[place[start:]], ends[at:] - others - start, dtype=np.int64)[open_]
        own[mine] = 0
        every = others[open_] + sizes[i] - both
        for j in (at + np.flatnonzero(open_)[both >= (similar - 1e-9) * every]).tolist():
            if root[j] != root[i]:
                links.append((fp[i], fp[j]))
                root[root == root[j]] = root[i]
    return links


def _within(open_: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(a, b): links that connect all near copies of different roots in a bucket, from the open
    buckets' rows (band, key, fp, size, root) and the texts (fp, keys, body)."""
    # of buckets with the same sets, the one of the first band
    buckets = open_.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("mark"))
    firsts = buckets.groupBy("n", "mark").agg(F.min(F.struct("band", "key")).alias("own")).select("own.band", "own.key")
    before = Window.partitionBy("band", "key").orderBy("size", "fp").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum(F.col("size") + CELL_ROW).over(before), F.lit(0)) / CELL)
    placed = open_.join(firsts, ["band", "key"]).withColumn("part", part).checkpoint()
    parts = placed.groupBy("band", "key", "part").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("root").alias("least"), F.max("root").alias("most"))
    p = parts.select("band", "key", F.col("part").alias("p"), "high", F.col("least").alias("p_least"), F.col("most").alias("p_most"))
    q = parts.select("band", "key", F.col("part").alias("q"), "low", "least", "most")
    sized = (F.col("p") == F.col("q")) | ((F.col("p") < F.col("q")) & (F.col("high") >= (similar - 1e-9) * F.col("low")))
    cells = p.join(q, ["band", "key"]).where(sized).where(F.least("least", "p_least") != F.greatest("most", "p_most")).select("band", "key", "p", "q").checkpoint()
    sides = [placed.join(c.withColumn("part", F.col(at)), ["band", "key", "part"]).withColumn("side", F.lit(k)) for k, (c, at) in enumerate([(cells, "p"), (cells.where("p <> q"), "q")])]
    rows = sides[0].unionByName(sides[1]).join(texts, "fp")
    rows = rows.select("band", "key", "p", "q", "side", "fp", "root", F.slice("keys", F.lit(1), F.col("band")).alias("keys"), "body")
    where = ["band", "key", "p", "q"]

    def run(batches):
        cell, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != cell:
                    if held:
                        found += _cell_links(held, similar)
                    cell, held = row[:4], []
                held.append((*row[4:8], shingles(row[8])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if held:
            found = _cell_links(held, similar)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition(*where).sortWithinPartitions(*where).mapInArrow(run, "a long, b long")


def near_links(sets: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similar: float = SIMILAR) -> DataFrame:
    """(a, b): links between the distinct ``sets`` (fp, sim, size, keys) that connect all near copies;
    texts_of(kept rows of fp) gives (fp, body), asked for the sets with candidates only."""
    ensure_checkpoint_dir(sets.sparkSession)
    prepare_workers(sets.sparkSession)
    near = by_fingerprint(sets, similar).checkpoint()
    keyed = sets.select("fp", "size", F.posexplode("keys").alias("band", "key"))
    bucket = Window.partitionBy("band", "key")
    # a bucket of one set has no candidates
    held = keyed.withColumn("least", F.min("fp").over(bucket)).withColumn("most", F.max("fp").over(bucket)).where("least <> most").drop("least", "most").checkpoint()
    asked = held.select("fp").union(near.select("a")).union(near.select("b")).distinct().checkpoint()
    bodies = texts_of(asked).checkpoint()
    links = _confirmed(near, bodies, similar).checkpoint()
    rooted = held.join(components(links).distinct(), F.col("fp") == F.col("v"), "left").select("fp", "size", "band", "key", F.coalesce("root", "fp").alias("root"))
    # only buckets whose sets aren't all joined have pairs left
    open_ = rooted.withColumn("least", F.min("root").over(bucket)).withColumn("most", F.max("root").over(bucket)).where("least <> most").drop("least", "most").checkpoint()
    return links.union(_within(open_, bodies.join(sets.select("fp", "keys"), "fp"), similar))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest id, nulls last,
    and among rows that share it the one whose text has the smallest hash."""
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("text_hash"), F.col(text_col).alias("body"))
    slim = _sets(keyed, docs.schema[id_col].dataType.simpleString()).checkpoint()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    sets = slim.groupBy("fp").agg(first.alias("least"), F.first("sim").alias("sim"), F.first("size").alias("size"), F.first("keys").alias("keys")).checkpoint()

    def texts_of(fps: DataFrame) -> DataFrame:
        """One row's text stands for its set."""
        shown = sets.join(few(fps), "fp").select("fp", F.col("least.id").alias("at_id"), F.col("least.text_hash").alias("at_hash")).checkpoint()
        found = keyed.join(few(shown), F.col("id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash")))
        return found.select("fp", F.coalesce("body", F.lit("")).alias("body")).groupBy("fp").agg(F.first("body").alias("body"))

    found = components(near_links(sets, texts_of, similar))
    rooted = sets.join(found, F.col("fp") == F.col("v"), "left").select("least", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("__id"), F.col("least.text_hash").alias("__hash")).checkpoint()
    # what goes, and what stays but comes more than once, is found on slim rows, so that whole ones needn't be exchanged
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    counted = slim.groupBy("id", "text_hash").count().join(kept.withColumn("stays", F.lit(True)), same, "left")
    odd = counted.where(F.col("stays").isNull() | (F.col("count") > 1)).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.coalesce("stays", F.lit(False)).alias("__stays")).checkpoint()
    own = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__own_hash") == F.col("__hash"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(id_col).alias("__own"), key.alias("__own_hash"))
    once = rows.join(few(odd.drop("__stays")), own, "left_anti").select("__row")
    repeated = odd.where("__stays").drop("__stays").checkpoint()
    if not repeated.isEmpty():
        # rows alike in id and text: any one of them
        again = rows.join(few(repeated), own, "left_semi").groupBy("__own", "__own_hash").agg(F.first("__row").alias("__row"))
        once = once.union(again.select("__row"))
    return once.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
