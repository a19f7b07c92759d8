"""A walk through the commands: python examples/demo.py [folder]."""

from __future__ import annotations

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from docquarry.sources.store import Database  # noqa: E402
from docquarry.streaming.commands import Commands  # noqa: E402

GOODS = [
    ("lamp", {"title": "Desk lamp", "price": 24.5, "stock": 12, "room": "office", "parts": {"bulb": "E14"}}),
    ("sofa", {"title": "Sofa", "price": 640.0, "stock": 2, "room": "living", "colors": ["grey", "green"]}),
    ("rug", {"title": "Wool rug", "price": 180.0, "stock": 7, "room": "living"}),
    ("shelf", {"title": "Shelf", "price": 75.0, "stock": 30, "room": "office"}),
]


def steps(folder: str) -> list[dict]:
    own = {"collection_name": "goods"}
    found = [{"command": "create_collection", **own}]
    found += [{"command": "create_document", "document_id": k, "content": v, **own} for k, v in GOODS]
    found += [{"command": "create_index", "field": f, **own} for f in ("price", "room", "stock")]
    found += [{"command": "get_indexes", **own}, {"command": "get_collections"}, {"command": "read_document", "document_id": "sofa", **own}, {"command": "read_document", "limit": 2, **own}]
    for query in ({"$eq": {"room": "office"}}, {"$gt": {"price": 100.0}}, {"$lt": {"stock": 10}}, {"$and": [{"$eq": {"room": "living"}}, {"$lt": {"price": 200.0}}]}, {"$or": [{"$gt": {"stock": 20}}, {"$gt": {"price": 500.0}}]}, {"$orderBy": {"price": "desc"}}):
        found.append({"command": "find_documents", "query": query, **own})
    found += [{"command": "export_collection", "dest_dir": f"{folder}/out", **own}, {"command": "delete_document", "document_id": "rug", **own}, {"command": "delete_index", "field": "stock", **own}, {"command": "delete_collection", **own}]
    return found


def run(spark: SparkSession, folder: str) -> list[tuple[dict, list[dict]]]:
    database = Database(spark, f"{folder}/db")
    database.open()
    commands = Commands(database)
    return [(s, commands.handle(s | {"request_id": f"demo-{k}"})[1]) for k, s in enumerate(steps(folder))]


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="docquarry-demo-")
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for request, responses in run(spark, folder):
        print(">", json.dumps(request, ensure_ascii=False))
        for r in responses:
            print("  ", json.dumps(r, ensure_ascii=False))


if __name__ == "__main__":
    main()
