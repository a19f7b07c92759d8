"""A mixed load: python examples/load.py [operations] [workers].

40 % create, 30 % read, 20 % find, 10 % delete, over one collection, from a fixed seed; prints
the operations and the time of each kind.
"""

from __future__ import annotations

import json
import os
import random
import sys
import tempfile
import time
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from docquarry.sources.store import Database  # noqa: E402
from docquarry.streaming.commands import Commands  # noqa: E402

MIX = [("create_document", 40), ("read_document", 30), ("find_documents", 20), ("delete_document", 10)]
ROOMS = ("office", "living", "kitchen", "hall")


def request(r: random.Random, k: int) -> dict:
    command = r.choices([c for c, _ in MIX], [w for _, w in MIX])[0]
    own = {"command": command, "request_id": f"load-{k}", "collection_name": "load"}
    if command == "create_document":
        return own | {"document_id": f"d{k}", "content": {"price": round(r.uniform(10, 1000), 2), "room": r.choice(ROOMS), "stock": r.randint(1, 500)}}
    if command == "find_documents":
        low = round(r.uniform(10, 900), 2)
        queries = [{"$eq": {"room": r.choice(ROOMS)}}, {"$gt": {"price": low}}, {"$lt": {"price": low}}, {"$orderBy": {"price": "asc"}}, {"$and": [{"$gt": {"price": low}}, {"$eq": {"room": "hall"}}]}, {"$or": [{"$lt": {"stock": 50}}, {"$eq": {"room": "office"}}]}]
        return own | {"query": r.choice(queries)}
    return own | {"document_id": f"d{r.randrange(max(1, k))}"}


def run(spark: SparkSession, folder: str, operations: int, workers: int) -> dict[str, list[float]]:
    database = Database(spark, folder)
    database.open()
    own = database.create_collection("load")
    for field in ("price", "room", "stock"):
        own.create_index(field)
    commands, r = Commands(database), random.Random(7)
    took: dict[str, list[float]] = defaultdict(list)

    def one(req: dict) -> None:
        began = time.perf_counter()
        commands.handle(req)
        took[req["command"]].append(time.perf_counter() - began)

    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(one, [request(r, k) for k in range(operations)]))
    return took


def main() -> None:
    operations, workers = (int(x) for x in (*sys.argv[1:], *("100", "12")[len(sys.argv) - 1 :]))
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    took = run(spark, tempfile.mkdtemp(prefix="docquarry-load-"), operations, workers)
    spent = time.perf_counter() - began
    print(json.dumps({"operations": operations, "workers": workers, "seconds": round(spent, 2), "mean_ms": {k: round(1000 * sum(v) / len(v), 1) for k, v in sorted(took.items())}}))


if __name__ == "__main__":
    main()
