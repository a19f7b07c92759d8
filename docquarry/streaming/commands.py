"""The command interface: a request object in, response objects out."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import functions as F

from docquarry.functions import variants
from docquarry.sources.json_io import export_json
from docquarry.sources.store import Collection, Database
from docquarry.status import Code, QuarryError

SUCCESS = {"status": "success"}
MUTATING = frozenset({"create_collection", "delete_collection", "create_document", "delete_document", "create_index", "delete_index"})


def _text(request: dict, name: str) -> str:
    value = request.get(name)
    if not isinstance(value, str):
        raise QuarryError(Code.INVALID_ARGUMENT, f"the request needs the text {name}")
    return value


class Commands:
    """Answers requests on one database.  Failures are answers too: nothing raises."""

    def __init__(self, database: Database):
        self.database = database
        self.handlers = {
            "create_collection": self.create_collection,
            "delete_collection": self.delete_collection,
            "get_collections": self.get_collections,
            "create_document": self.create_document,
            "read_document": self.read_document,
            "delete_document": self.delete_document,
            "create_index": self.create_index,
            "delete_index": self.delete_index,
            "get_indexes": self.get_indexes,
            "find_documents": self.find_documents,
            "export_collection": self.export_collection,
        }

    def handle_text(self, payload: str | None) -> tuple[str, list[dict]]:
        """(request id, responses) of a request's text; an empty one has no response."""
        if payload is None or not payload.strip():
            return "", []
        try:
            request = json.loads(payload)
        except ValueError as e:
            return "", [{"status": "error", "message": f"Malformed request: {e}"}]
        return self.handle(request)

    def handle(self, request: Any) -> tuple[str, list[dict]]:
        request_id = ""
        try:
            if not isinstance(request, dict):
                raise QuarryError(Code.INVALID_ARGUMENT, "a request is an object")
            command = _text(request, "command")
            request_id = _text(request, "request_id")
            if command not in self.handlers:
                return request_id, [{"status": "error", "message": f"Unknown command: {command}"}]
            return request_id, self.handlers[command](request)
        except QuarryError as e:
            return request_id, [{"status": "error", "message": str(e)}]
        except Exception as e:  # a request must never end the bridge
            return request_id, [{"status": "error", "message": f"{type(e).__name__}: {e}"}]

    def _collection(self, request: dict) -> Collection:
        name = _text(request, "collection_name")
        own = self.database.get_collection(name)
        if own is None:
            raise QuarryError(Code.NOT_FOUND, f"Collection {name} is not found")
        return own

    def create_collection(self, request: dict) -> list[dict]:
        name = _text(request, "collection_name")
        self.database.create_collection(name)
        return [SUCCESS | {"message": f"Collection {name} created"}]

    def delete_collection(self, request: dict) -> list[dict]:
        name = _text(request, "collection_name")
        self.database.drop_collection(name)
        return [SUCCESS | {"message": f"Collection {name} deleted"}]

    def get_collections(self, request: dict) -> list[dict]:
        return [{"Collections": "".join(f"{n}," for n in self.database.collection_names())}]

    def create_document(self, request: dict) -> list[dict]:
        own = self._collection(request)
        doc_id = own.create_document(request.get("document_id") or "", request.get("content"))
        return [SUCCESS | {"docId": doc_id, "message": f"Document added to {own.name}"}]

    def read_document(self, request: dict) -> list[dict]:
        """One document by id, with the status in it; or all, or the first ``limit``, each a
        response of its own, and a status at the end."""
        own = self._collection(request)
        if "document_id" in request:
            return [own.read_document(_text(request, "document_id")) | SUCCESS]
        limit = request.get("limit")
        return [*own.read_all_documents(None if limit is None else int(limit)), dict(SUCCESS)]

    def delete_document(self, request: dict) -> list[dict]:
        own = self._collection(request)
        if "document_id" not in request:
            raise QuarryError(Code.INVALID_ARGUMENT, "the request needs the text document_id")
        doc_id = _text(request, "document_id")
        own.delete_document(doc_id)
        return [SUCCESS | {"docId": doc_id, "message": f"Document deleted from {own.name}"}]

    def create_index(self, request: dict) -> list[dict]:
        own, field = self._collection(request), _text(request, "field")
        own.create_index(field)
        return [SUCCESS | {"message": f"Index on {field} created"}]

    def delete_index(self, request: dict) -> list[dict]:
        own, field = self._collection(request), _text(request, "field")
        own.delete_index(field)
        return [SUCCESS | {"message": f"Index on {field} deleted"}]

    def get_indexes(self, request: dict) -> list[dict]:
        own = self._collection(request)
        return [{"collection": own.name, "indexList": "".join(f"{n}," for n in own.index_names())}]

    def find_documents(self, request: dict) -> list[dict]:
        """A response for each document, in the sequence of the results, and a status at the end."""
        view = self._collection(request).view()
        found = view.find_sorted(request.get("query"))
        last = dict(SUCCESS) if view.last_status.ok else {"status": "error", "message": view.last_status.message}
        return [*(variants.to_python(r.data) for r in found.select("data").toLocalIterator()), last]

    def export_collection(self, request: dict) -> list[dict]:
        own, folder = self._collection(request), _text(request, "dest_dir")
        export_json(own, folder)
        return [SUCCESS | {"message": f"Collection {own.name} exported to {folder}"}]


def responses_frame(spark, answers: list[tuple[str, list[dict]]]):
    """(request_id, msg_seq, payload): every response, numbered within its request."""
    rows = [(request_id, k, json.dumps(r, sort_keys=True, ensure_ascii=False)) for request_id, rs in answers for k, r in enumerate(rs)]
    return spark.createDataFrame(rows, "request_id string, msg_seq int, payload string").select("request_id", F.col("msg_seq"), "payload")
