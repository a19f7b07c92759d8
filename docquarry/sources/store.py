"""Databases and collections: versioned Parquet parts under a manifest.

A collection is a folder of parts, each written once: a base, with one row for every
document, and later changes, of which the newest row for an id counts.  A commit writes a part
and then swaps the manifest in one step, so a reader sees all of a commit or nothing,
and a DataFrame read before stays as it was.  Changes are folded into a new base once there are
MAX_CHANGES of them.  The manifest also holds the index registry and the batches already taken
from a stream, so that a repeated batch changes nothing.

A new manifest claims its version first: of two drivers that commit at once one fails with an
IO_ERROR, and its commit can be tried again.  A claim left by a driver that died is void after
CLAIM_SECONDS.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import variants
from docquarry.functions.ordering import ensure_checkpoint_dir
from docquarry.operators.find import DocumentView
from docquarry.operators.update import compile_update
from docquarry.sources.files import Files
from docquarry.status import OK, Code, QuarryError, Status, guarded

MAX_CHANGES = 16
BATCHES_KEPT = 1000
CLAIM_SECONDS = 600
_PART = "_id string, data variant, deleted boolean"


class Collection:
    """A named bag of documents, keyed by a string id."""

    def __init__(self, database: Database, name: str):
        self.database, self.spark, self.files, self.name = database, database.spark, database.files, name
        self.path = f"{database.path}/{name}"
        self.lock = threading.RLock()
        self.last_status = OK

    # -- manifest --

    def _manifest(self) -> dict:
        path = f"{self.path}/manifest.json"
        if not self.files.exists(path):
            raise QuarryError(Code.NOT_FOUND, f"no collection {self.name}")
        return json.loads(self.files.read(path))

    def _swap(self, manifest: dict) -> None:
        """Puts the manifest in the place of the version it was made from."""
        path, version = f"{self.path}/manifest.json", manifest["version"]
        claim = f"{self.path}/.claim-{version + 1:08d}"
        if not self.files.claim(claim):
            if self.files.age(claim) < CLAIM_SECONDS:
                raise QuarryError(Code.IO_ERROR, f"another commit to {self.name} is under way")
            self.files.delete(claim)
            if not self.files.claim(claim):
                raise QuarryError(Code.IO_ERROR, f"another commit to {self.name} is under way")
        now = json.loads(self.files.read(path))["version"] if self.files.exists(path) else 0
        if now != version:
            self.files.delete(claim)
            raise QuarryError(Code.IO_ERROR, f"another commit changed {self.name}")
        self.files.write(path, json.dumps(manifest | {"version": version + 1}, sort_keys=True))
        manifest["version"] = version + 1
        # a later claim of this version fails on the manifest
        self.files.delete(claim)

    def create(self) -> None:
        self.files.make(self.path)
        self._swap({"version": 0, "base": None, "changes": [], "indexes": [], "batches": []})

    # -- reading --

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.schema(_PART).parquet(f"{self.path}/{name}")

    def frame(self) -> DataFrame:
        """(_id, data): the current snapshot."""
        manifest = self._manifest()
        base = self._part(manifest["base"]).select("_id", "data") if manifest["base"] else None
        if not manifest["changes"]:
            return self.spark.createDataFrame([], "_id string, data variant") if base is None else base
        changes = None
        for k, name in enumerate(manifest["changes"]):
            part = self._part(name).withColumn("seq", F.lit(k))
            changes = part if changes is None else changes.unionAll(part)
        newest = Window.partitionBy("_id").orderBy(F.col("seq").desc())
        latest = changes.withColumn("at", F.row_number().over(newest)).where("at = 1")
        live = latest.where("not deleted").select("_id", "data")
        return live if base is None else base.join(latest.select("_id"), "_id", "left_anti").unionAll(live)

    def view(self) -> DocumentView:
        return DocumentView(self.frame(), "_id", set(self._manifest()["indexes"]))

    def find(self, query: Any, strict: bool = False) -> DataFrame:
        """Matching documents (_id, data, op_seq); see DocumentView.find."""
        view = self.view()
        found = view.find(query, strict)
        self.last_status = view.last_status
        return found

    def find_document(self, query: Any) -> list[str]:
        """Ids of matching documents, in sequence."""
        view = self.view()
        ids = view.find_ids(query)
        self.last_status = view.last_status
        return ids

    def read_document(self, doc_id: str) -> dict:
        rows = self.frame().where(F.col("_id") == doc_id).limit(1).collect()
        if not rows:
            raise QuarryError(Code.NOT_FOUND, f"no document {doc_id} in {self.name}")
        return variants.to_python(rows[0].data)

    def read_all_documents(self, limit: int | None = 10) -> list[dict]:
        """Documents by id: ten unless told otherwise."""
        rows = self.view().scan(limit).toLocalIterator()
        return [variants.to_python(r.data) for r in rows]

    def cursor(self) -> Cursor:
        return Cursor(self.frame())

    # -- writing --

    def _commit(self, rows: DataFrame, batch: str | None = None) -> None:
        """Adds a part of changes (_id, data, deleted), one row for an id; nothing of it where an
        indexed field would hold an object or array."""
        ensure_checkpoint_dir(self.spark)
        with self.lock:
            manifest = self._manifest()
            if batch is not None and batch in manifest["batches"]:
                return
            if manifest["indexes"]:
                # what is checked is what is written
                rows = rows.select("_id", "data", "deleted").checkpoint()
                values = [variants.get(F.col("data"), f) for f in manifest["indexes"]]
                wrong = [F.coalesce(variants.is_object(v) | variants.is_array(v), F.lit(False)) for v in values]
                if not rows.where("not deleted").where(reduce(lambda a, b: a | b, wrong)).isEmpty():
                    raise QuarryError(Code.INVALID_ARGUMENT, "an indexed field would hold an object or array")
            name = f"part-{manifest['version']:08d}-{uuid.uuid4().hex[:8]}"
            rows.select("_id", "data", "deleted").write.parquet(f"{self.path}/{name}")
            manifest["changes"].append(name)
            if batch is not None:
                manifest["batches"] = [*manifest["batches"], batch][-BATCHES_KEPT:]
            self._swap(manifest)
            if len(manifest["changes"]) >= MAX_CHANGES:
                self.compact()

    def compact(self) -> None:
        """Folds all changes into a new base, in order of id.  Parts that are no longer
        named stay for readers of older snapshots until vacuum."""
        with self.lock:
            rows = self.frame().withColumn("deleted", F.lit(False))
            manifest = self._manifest()
            name = f"base-{manifest['version']:08d}-{uuid.uuid4().hex[:8]}"
            rows.repartitionByRange("_id").sortWithinPartitions("_id").write.parquet(f"{self.path}/{name}")
            manifest["base"], manifest["changes"] = name, []
            self._swap(manifest)

    def vacuum(self) -> None:
        """Deletes parts that the manifest doesn't name."""
        with self.lock:
            manifest = self._manifest()
            for folder in self.files.folders(self.path):
                if folder not in (manifest["base"], *manifest["changes"]):
                    self.files.delete(f"{self.path}/{folder}")

    def put(self, rows: DataFrame, order: Column | None = None, batch: str | None = None) -> None:
        """Inserts or replaces documents (_id, data); of rows with one id the last by
        ``order`` counts, and without an order such rows are refused.  An object without ``_id``
        gets its id as a field."""
        if order is None:
            if not rows.groupBy("_id").count().where("count > 1").isEmpty():
                raise QuarryError(Code.INVALID_ARGUMENT, "several rows with one _id need an order")
        else:
            last = Window.partitionBy("_id").orderBy(order.desc())
            rows = rows.withColumn("__at", F.row_number().over(last)).where("__at = 1")
        data = F.when(variants.get(F.col("data"), "_id").isNull(), variants.with_member(F.col("data"), "_id", F.col("_id").cast("variant"))).otherwise(F.col("data"))
        self._commit(rows.select("_id", data.alias("data"), F.lit(False).alias("deleted")), batch)

    def _check_indexed(self, document: dict) -> None:
        for name in self.index_names():
            if isinstance(document.get(name), (dict, list)):
                raise QuarryError(Code.INVALID_ARGUMENT, f"indexed field {name} holds an object or array")

    def create_documents(self, documents: Iterable[tuple[str, dict]]) -> list[str]:
        """Inserts or replaces documents in one commit; empty ids are generated, the last of equal ids counts."""
        rows: dict[str, str] = {}
        for doc_id, document in documents:
            if not isinstance(document, dict):
                raise QuarryError(Code.INVALID_ARGUMENT, "a document is an object")
            self._check_indexed(document)
            doc_id = doc_id or uuid.uuid4().hex[:12]
            rows[doc_id] = variants.encode({"_id": doc_id} | document)
        if rows:
            frame = self.spark.createDataFrame(list(rows.items()), "_id string, text string")
            self._commit(frame.select("_id", F.parse_json("text").alias("data"), F.lit(False).alias("deleted")))
        return list(rows)

    def create_document(self, doc_id: str, document: dict) -> str:
        return self.create_documents([(doc_id, document)])[0]

    def delete_document(self, doc_id: str) -> None:
        self.read_document(doc_id)
        self._commit(self.spark.createDataFrame([(doc_id,)], "_id string").select("_id", F.lit(None).cast("variant").alias("data"), F.lit(True).alias("deleted")))

    def delete_where(self, query: Any) -> None:
        """Deletes all documents that a query finds, in one commit."""
        found = self.find(query).select("_id").distinct()
        self._commit(found.select("_id", F.lit(None).cast("variant").alias("data"), F.lit(True).alias("deleted")))

    def update_document(self, doc_id: str, update: Any, upsert: bool = False) -> None:
        """Applies an update to one document; with ``upsert`` a missing one starts with its id alone."""
        with self.lock:
            rows = self.frame().where(F.col("_id") == doc_id).limit(1)
            if not rows.count():
                if not upsert:
                    raise QuarryError(Code.NOT_FOUND, f"no document {doc_id} in {self.name}")
                rows = self.spark.createDataFrame([(doc_id,)], "_id string").select("_id", variants.literal({"_id": doc_id}).alias("data"))
            self._commit(self._updated(rows, update))

    def update_where(self, query: Any, update: Any) -> None:
        """Applies an update to all documents that a query finds, in one commit."""
        with self.lock:
            self._commit(self._updated(self.find(query).dropDuplicates(["_id"]).select("_id", "data"), update))

    def _updated(self, rows: DataFrame, update: Any) -> DataFrame:
        return rows.select("_id", compile_update(F.col("data"), update).alias("data"), F.lit(False).alias("deleted"))

    # -- indexes --

    def index_names(self) -> list[str]:
        return sorted(self._manifest()["indexes"])

    def create_index(self, field: str) -> None:
        """Makes a field queryable; documents whose value is an object or array forbid it."""
        with self.lock:
            manifest = self._manifest()
            if field in manifest["indexes"]:
                return
            own = variants.get(F.col("data"), field)
            if self.frame().where(variants.is_object(own) | variants.is_array(own)).limit(1).count():
                raise QuarryError(Code.CORRUPTION, f"field {field} holds objects or arrays")
            manifest["indexes"].append(field)
            self._swap(manifest)

    def delete_index(self, field: str) -> None:
        with self.lock:
            manifest = self._manifest()
            if field not in manifest["indexes"]:
                raise QuarryError(Code.NOT_FOUND, f"no index on {field}")
            manifest["indexes"].remove(field)
            self._swap(manifest)

    def indexes(self) -> DataFrame:
        return self.spark.createDataFrame([(self.name, f) for f in self.index_names()], "collection string, field string")


class Cursor:
    """Documents of one snapshot by ascending id, fetched partition by partition."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.reset()

    def _open(self, rows: DataFrame) -> None:
        self._rest: Iterator = rows.orderBy("_id").toLocalIterator(prefetchPartitions=True)
        self._row = next(self._rest, None)

    def reset(self) -> None:
        self._open(self.rows)

    def seek(self, doc_id: str) -> None:
        """To the first document whose id isn't less."""
        self._open(self.rows.where(F.col("_id") >= doc_id))

    def is_valid(self) -> bool:
        return self._row is not None

    def next(self) -> None:
        if self._row is not None:
            self._row = next(self._rest, None)

    def current(self) -> dict:
        if self._row is None:
            raise QuarryError(Code.INVALID_ARGUMENT, "the cursor is past the end")
        return variants.to_python(self._row.data)

    def current_id(self) -> str:
        return "" if self._row is None else self._row._id


class Database:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.is_open = False
        self._handles: dict[str, Collection] = {}

    def open(self) -> None:
        try:
            self.files.make(self.path)
        except Exception as e:
            raise QuarryError(Code.IO_ERROR, f"cannot open {self.path}: {e}") from e
        self.is_open = True

    def close(self) -> None:
        """Forgets the handles; everything, indexes too, is kept by the manifests."""
        self._handles.clear()
        self.is_open = False

    def _need_open(self) -> None:
        if not self.is_open:
            raise QuarryError(Code.IO_ERROR, "the database is closed")

    def create_collection(self, name: str) -> Collection:
        self._need_open()
        if not name or "/" in name or "__index__" in name or name.startswith((".", "_")):
            raise QuarryError(Code.INVALID_ARGUMENT, f"no name for a collection: {name!r}")
        if self.collection_exists(name):
            raise QuarryError(Code.INVALID_ARGUMENT, f"collection {name} exists already")
        own = Collection(self, name)
        own.create()
        self._handles[name] = own
        return own

    def drop_collection(self, name: str) -> None:
        self._need_open()
        if not self.collection_exists(name):
            raise QuarryError(Code.NOT_FOUND, f"no collection {name}")
        self._handles.pop(name, None)
        self.files.delete(f"{self.path}/{name}")

    def get_collection(self, name: str) -> Collection | None:
        self._need_open()
        if not self.collection_exists(name):
            return None
        return self._handles.setdefault(name, Collection(self, name))

    def collection_exists(self, name: str) -> bool:
        return bool(name) and self.files.exists(f"{self.path}/{name}/manifest.json")

    def collection_names(self) -> list[str]:
        self._need_open()
        return [n for n in self.files.folders(self.path) if self.collection_exists(n)]

    def collections(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.collection_names()], "collection string")

    def read_all_documents(self, name: str) -> list[dict]:
        own = self.get_collection(name)
        if own is None:
            raise QuarryError(Code.NOT_FOUND, f"no collection {name}")
        return own.read_all_documents()


def attempt(action) -> Status:
    """The status of an action, for callers that don't want exceptions."""
    return guarded(action)
