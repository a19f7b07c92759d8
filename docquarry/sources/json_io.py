"""JSON import and export of collections."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docquarry.functions import variants
from docquarry.functions.ordering import ensure_checkpoint_dir
from docquarry.functions.workers import importable
from docquarry.sources import json_cuts
from docquarry.sources.store import Collection
from docquarry.status import Code, QuarryError

#: Characters of a piece of an exported file.
PIECE_CHARS = 1 << 20

_EFFECT = pa.struct([("inside", pa.bool_()), ("change", pa.int32()), ("least", pa.int32()), ("depths", pa.list_(pa.int32())), ("commas", pa.list_(pa.int32()))])
_BLOCK = pa.schema([("file", pa.string()), ("first", pa.int64()), ("k", pa.int32()), ("opens", pa.bool_()), ("outside", _EFFECT), ("inside", _EFFECT), ("block", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _BLOCK from the texts between commas, in each split's order."""
    key, k, held, size = None, 0, [], 0

    def block() -> pa.RecordBatch:
        text = b"".join(held)
        one = dict(zip(_BLOCK.names, (*key, k, key[1] == 0 and k == 0 and json_cuts.opens(text), *(json_cuts.effect(text, i)._asdict() for i in (False, True)), text), strict=True))
        return pa.RecordBatch.from_pylist([one], _BLOCK)

    for batch in batches:
        for file, first, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (file, first) or size >= json_cuts.BLOCK_BYTES:
                if held:
                    yield block()
                key, k, held, size = (file, first), k + 1 if key == (file, first) else 0, [], 0
            held += (text, b",")
            size += len(text) + 1
    if held:
        yield block()


def _kind(collection: Collection, path: str) -> str | None:
    """The type of a whole text that is no array; None where it is no JSON."""
    whole = collection.spark.read.text(path, wholetext=True).select(F.schema_of_variant(F.try_parse_json("value")))
    return next((r[0] for r in whole.collect() if r[0] is None or not r[0].startswith("ARRAY")), None)


def read_array(collection: Collection, path: str) -> DataFrame:
    """(pos, value): the elements of a file's one top-level array, which are cut and parsed in parallel."""
    spark = collection.spark
    if not collection.files.exists(path):
        raise QuarryError(Code.IO_ERROR, f"cannot open {path}")
    importable(spark)
    ensure_checkpoint_dir(spark)
    texts = spark.read.text(path, lineSep=",")
    file = F.col("_metadata.file_path") if len(texts.inputFiles()) > 1 else F.lit("")
    # splits may fall otherwise when they are read again, so the blocks are kept
    blocks = texts.select(file.alias("file"), F.col("_metadata.file_block_start").alias("first"), F.col("value").cast("binary")).mapInArrow(_blocks, from_arrow_schema(_BLOCK)).checkpoint()
    told = sorted(blocks.drop("block").collect(), key=lambda r: (r.file, r.first, r.k))
    known, ended = {}, bool(told)
    for _, rows in groupby(told, lambda r: r.file):
        rows = list(rows)
        if not rows[0].opens:
            if _kind(collection, path) is not None:
                raise QuarryError(Code.NOT_SUPPORTED, f"{path} holds no array of objects")
            ended = False
            break
        found, ends = json_cuts.starts((r.outside, r.inside) for r in rows)
        ended &= ends
        known |= {(r.file, r.first, r.k): s for r, s in zip(rows, found, strict=False)}
    if not ended:
        raise QuarryError(Code.INTERNAL_ERROR, f"{path} is no JSON text")

    def elements(whole: bool) -> DataFrame:
        def run(rows):
            for r in rows:
                if start := known.get((r.file, r.first, r.k)):
                    for pos, own, text in json_cuts.cut(r.block, start):
                        if own == whole:
                            yield r.file, pos, start.place, text

        return spark.createDataFrame(blocks.select("file", "first", "k", "block").rdd.mapPartitions(run), "file string, pos int, place int, text binary", verifySchema=False)

    parts = elements(False).groupBy("file", "pos").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("parts"))
    joined = parts.select("pos", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["text"])).alias("text"))
    text = F.concat(F.lit("["), F.col("text").cast("string"), F.lit("]"))
    items = elements(True).select("pos", "text").unionAll(joined).select("pos", F.try_variant_get(F.try_parse_json(text), "$[0]", "variant").alias("value")).checkpoint()
    if not items.where("value is null").isEmpty():
        raise QuarryError(Code.INTERNAL_ERROR, f"{path} is no JSON text")
    return items


def import_json(collection: Collection, path: str) -> dict[str, int]:
    """Inserts or replaces the objects of a file, in one commit, and counts them and the elements
    that are no objects.  An object without ``_id`` is named by its place; an ``_id``
    that isn't a string stops the import before anything is written."""
    items = read_array(collection, path)
    objects = items.where(variants.is_object(F.col("value")))
    own = variants.get(F.col("value"), "_id")
    wrong = F.sum((own.isNotNull() & (variants.kind_of(own) != "STRING")).cast("long"))
    total = items.count()
    kept, bad = objects.agg(F.count("*"), wrong).first()
    if bad:
        raise QuarryError(Code.INTERNAL_ERROR, f"{path} holds an _id that is no string")
    name = F.coalesce(F.try_variant_get("value", "$._id", "string"), F.concat(F.lit("doc_"), F.col("pos").cast("string")))
    collection.put(objects.select(name.alias("_id"), F.col("value").alias("data"), "pos"), F.col("pos"))
    return {"imported": kept, "skipped": total - kept}


def import_lines(collection: Collection, path: str) -> dict[str, int]:
    """Inserts or replaces documents of JSON lines, read in parallel, and counts them and the lines that are
    no objects with a text ``_id``.  Of lines with one id the last counts, by file and place."""
    rows = collection.spark.read.text(path).select(F.try_parse_json("value").alias("data"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at")).alias("place"))
    texts = variants.is_object(F.col("data")) & (variants.kind_of(variants.get(F.col("data"), "_id")) == "STRING")
    name = F.when(texts, F.try_variant_get("data", "$._id", "string"))
    named = rows.select(name.alias("_id"), "data", "place")
    total, kept = named.agg(F.count("*"), F.count("_id")).first()
    collection.put(named.where("_id is not null"), F.col("place"))
    return {"imported": kept, "skipped": total - kept}


def _shown(data: Any) -> str:
    text = json.dumps(variants.to_python(data), indent=4, sort_keys=True, ensure_ascii=False)
    return "\n".join("    " + line for line in text.split("\n"))


def export_json(collection: Collection, folder: str) -> str:
    """One array of all documents by id, indented and with sorted names, in
    ``<folder>/<collection>.json``; it appears in one step when complete.

    Executors make the text, in pieces of whole documents; one task puts the pieces into the one file.
    """
    spark, files, rows = collection.spark, collection.files, collection.frame()
    folder = folder.rstrip("/")
    files.make(folder)
    target = f"{folder}/{collection.name}.json"
    last = rows.agg(F.max("_id")).first()[0]
    if last is None:
        files.write(target, "[\n]\n")
        return target
    importable(spark)

    def pieces(part: int, rows):
        held, size, k = [] if part else ["["], 0, 0
        for r in rows:
            held.append(_shown(r.data) + ("\n]" if r._id == last else ","))
            size += len(held[-1])
            if size >= PIECE_CHARS:
                yield part, k, "\n".join(held)
                held, size, k = [], 0, k + 1
        if held:
            yield part, k, "\n".join(held)

    made = spark.createDataFrame(rows.orderBy("_id").rdd.mapPartitionsWithIndex(pieces), "part int, k int, value string", verifySchema=False)
    temporary = f"{target}.dump-{uuid.uuid4().hex[:8]}"
    try:
        made.repartition(1).sortWithinPartitions("part", "k").select("value").write.text(temporary, compression="none", lineSep="\n")
        (own,) = files.parts(temporary)
        files.rename(f"{temporary}/{own}", target)
    finally:
        files.delete(temporary)
    return target


def export_lines(collection: Collection, folder: str) -> None:
    """JSON lines, written in parallel: the form for large collections."""
    collection.frame().select(F.to_json("data").alias("value")).write.text(folder)


_pool = ThreadPoolExecutor(4, "export")


def export_json_async(collection: Collection, folder: str) -> Future:
    """Starts an export; the result is the file's path, or the failure."""
    return _pool.submit(export_json, collection, folder)
