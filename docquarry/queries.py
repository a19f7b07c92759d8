"""Registered queries of the engine, one for each operator, and their SQL.

A row of a table is a document, its key as text is the id.  Queries run through the
same calls that users make; results project plain columns, and sequences project their
place, so that both sides can be compared without order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.document import Document
from docquarry.functions import variants as V
from docquarry.functions.ordering import shared_folder
from docquarry.operators.find import DocumentView
from docquarry.operators.update import compile_update
from docquarry.sources import json_io
from docquarry.sources.store import Database
from docquarry.streaming.commands import Commands, responses_frame

Query = Callable[[SparkSession, str], DataFrame]

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id"}
INDEXED = {
    "orders": {"o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey"},
    "customer": {"c_mktsegment", "c_acctbal", "c_nationkey", "c_name"},
    "part": {"p_size", "p_brand", "p_type", "p_retailprice"},
    "supplier": {"s_acctbal", "s_nationkey"},
    "events": {"ts", "event_type", "value", "k"},
    "nation": {"n_name"},
    "region": {"r_name"},
    "documents": {"lang"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(spark: SparkSession, sf_dir: str, name: str) -> DocumentView:
    """A table as documents with typed fields."""
    return DocumentView(table(spark, sf_dir, name), KEYS[name], INDEXED[name])


def nested(spark: SparkSession, sf_dir: str) -> DocumentView:
    """Events as VARIANT documents: props is a nested document, and k a field of its own only
    where it is even."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.from_json("props", "k long").alias("props"))
    rows = rows.withColumn("k", F.when(F.col("props.k") % 2 == 0, F.col("props.k")))
    return DocumentView(V.documents_from(rows, "event_id"), "_id", INDEXED["events"])


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# -- predicates --


def _find(name: str, source: str, query: Any, columns: list[str], where: str) -> None:
    """A query on typed fields with one operator, against a WHERE clause."""
    key = KEYS[source]
    _register(
        name,
        lambda spark, sf_dir: typed(spark, sf_dir, source).find(query).select(F.col(key).cast("string").alias("_id"), *columns),
        f"SELECT CAST({key} AS VARCHAR) AS _id, {', '.join(columns)} FROM {source} WHERE {where}",
    )


_find("eq_string", "orders", {"$eq": {"o_orderstatus": "F"}}, ["o_orderstatus", "o_totalprice"], "o_orderstatus = 'F'")
_find("eq_int", "part", {"$eq": {"p_size": 15}}, ["p_size", "p_name"], "p_size = 15")
_find("eq_double_literal_int_field", "part", {"$eq": {"p_size": 15.0}}, ["p_size"], "p_size = 15")
_find("eq_hash_literal", "part", {"$eq": {"p_brand": "Brand#2"}}, ["p_brand"], "p_brand = 'Brand#2'")
_find("eq_prefix_only", "part", {"$eq": {"p_brand": "Brand"}}, ["p_brand"], "p_brand = 'Brand'")
_find("eq_wrong_family", "part", {"$eq": {"p_size": "15"}}, ["p_size"], "false")
_find("gt_double", "orders", {"$gt": {"o_totalprice": 400000.0}}, ["o_totalprice"], "o_totalprice > 400000.0")
_find("gt_int_literal", "orders", {"$gt": {"o_totalprice": 400000}}, ["o_totalprice"], "o_totalprice > 400000.0")
_find("lt_double", "orders", {"$lt": {"o_totalprice": 5000.0}}, ["o_totalprice"], "o_totalprice < 5000.0")
_find("gt_string", "customer", {"$gt": {"c_mktsegment": "FURNITURE"}}, ["c_mktsegment"], "c_mktsegment > 'FURNITURE'")
_find("lt_string", "customer", {"$lt": {"c_mktsegment": "FURNITURE"}}, ["c_mktsegment"], "c_mktsegment < 'FURNITURE'")
_find("gt_timestamp", "events", {"$gt": {"ts": "2024-01-15T00:00:00"}}, ["event_type", "value"], "ts > TIMESTAMP '2024-01-15 00:00:00'")
_find("and_range", "orders", {"$and": [{"$gt": {"o_totalprice": 100000.0}}, {"$eq": {"o_orderstatus": "F"}}]}, ["o_orderstatus", "o_totalprice"], "o_totalprice > 100000.0 AND o_orderstatus = 'F'")
_find("and_three", "part", {"$and": [{"$gt": {"p_size": 10}}, {"$lt": {"p_size": 20}}, {"$gt": {"p_retailprice": 910.0}}]}, ["p_size", "p_retailprice"], "p_size > 10 AND p_size < 20 AND p_retailprice > 910.0")
_find("and_multi_op_item", "part", {"$and": [{"$gt": {"p_size": 10}, "$lt": {"p_size": 13}}]}, ["p_size"], "p_size > 10 AND p_size < 13")
_find("and_disjoint_then_match", "orders", {"$and": [{"$eq": {"o_orderstatus": "F"}}, {"$eq": {"o_orderstatus": "O"}}, {"$gt": {"o_totalprice": 1.0}}]}, ["o_orderstatus"], "o_orderstatus = 'F' AND o_orderstatus = 'O'")
_find("or_eq", "orders", {"$or": [{"$eq": {"o_orderstatus": "P"}}, {"$eq": {"o_orderpriority": "1-URGENT"}}]}, ["o_orderstatus", "o_orderpriority"], "o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'")
_find("or_range", "orders", {"$or": [{"$lt": {"o_totalprice": 3000.0}}, {"$gt": {"o_totalprice": 490000.0}}]}, ["o_totalprice"], "o_totalprice < 3000.0 OR o_totalprice > 490000.0")
_find("or_multi_op_item", "part", {"$or": [{"$eq": {"p_size": 1}, "$gt": {"p_retailprice": 1900.0}}]}, ["p_size", "p_retailprice"], "p_size = 1 OR p_retailprice > 1900.0")
_find("first_field_only", "orders", {"$eq": {"o_orderstatus": "F", "o_totalprice": 1.0}}, ["o_orderstatus"], "o_orderstatus = 'F'")
_find("unindexed_top_level", "orders", {"$eq": {"o_orderkey": 1}}, ["o_orderstatus"], "false")
_find("unindexed_in_and", "orders", {"$and": [{"$eq": {"o_orderkey": 1}}], "$gt": {"o_totalprice": 1.0}}, ["o_orderstatus"], "false")
_find("or_nested_refused", "orders", {"$or": [{"$and": [{"$eq": {"o_orderstatus": "F"}}]}]}, ["o_orderstatus"], "false")
_find("gt_empty_value", "orders", {"$gt": {"o_orderstatus": ""}}, ["o_orderstatus"], "false")
_find("empty_query", "orders", {}, ["o_orderstatus"], "false")
_find("unknown_operator", "orders", {"$gte": {"o_totalprice": 1.0}}, ["o_orderstatus"], "false")


def _several(name: str, source: str, query: Any, column: str, parts: list[str]) -> None:
    """Several operators on one level: their results follow one another."""
    key = KEYS[source]
    _register(
        name,
        lambda spark, sf_dir: typed(spark, sf_dir, source).find(query).select("op_seq", F.col(key).cast("string").alias("_id"), column),
        " UNION ALL ".join(f"SELECT {k} AS op_seq, CAST({key} AS VARCHAR) AS _id, {column} FROM {source} WHERE {w}" for k, w in enumerate(parts)),
    )


_several("multi_op_concat", "orders", {"$lt": {"o_totalprice": 450000.0}, "$gt": {"o_totalprice": 400000.0}}, "o_totalprice", ["o_totalprice > 400000.0", "o_totalprice < 450000.0"])
_several("eq_then_orderby_concat", "part", {"$eq": {"p_size": 7}, "$orderBy": {"p_size": "asc"}}, "p_size", ["p_size = 7", "p_size IS NOT NULL"])
_several("and_or_concat", "orders", {"$or": [{"$eq": {"o_orderstatus": "P"}}], "$and": [{"$eq": {"o_orderstatus": "F"}}]}, "o_orderstatus", ["o_orderstatus = 'F'", "o_orderstatus = 'P'"])


# -- order --


def _ordered(name: str, source: str, query: Any, column: str, where: str, order: str) -> None:
    key = KEYS[source]
    _register(
        name,
        lambda spark, sf_dir: typed(spark, sf_dir, source).find_numbered(query).select(F.col("ord").alias("rn"), F.col(key).cast("string").alias("_id"), column),
        f"SELECT ROW_NUMBER() OVER (ORDER BY {order}) AS rn, CAST({key} AS VARCHAR) AS _id, {column} FROM {source} WHERE {where}",
    )


_ordered("orderby_asc", "part", {"$orderBy": {"p_size": "asc"}}, "p_size", "p_size IS NOT NULL", "p_size, CAST(p_partkey AS VARCHAR)")
_ordered("orderby_desc", "orders", {"$orderBy": {"o_totalprice": "desc"}}, "o_totalprice", "o_totalprice IS NOT NULL", "o_totalprice DESC, CAST(o_orderkey AS VARCHAR) DESC")
_ordered("orderby_bad_dir", "customer", {"$orderBy": {"c_mktsegment": "upwards"}}, "c_mktsegment", "c_mktsegment IS NOT NULL", "c_mktsegment DESC, CAST(c_custkey AS VARCHAR) DESC")
_ordered("gt_sequence", "orders", {"$gt": {"o_totalprice": 400000.0}}, "o_totalprice", "o_totalprice > 400000.0", "o_totalprice, CAST(o_orderkey AS VARCHAR)")
_ordered("lt_sequence", "orders", {"$lt": {"o_totalprice": 5000.0}}, "o_totalprice", "o_totalprice < 5000.0", "o_totalprice DESC, CAST(o_orderkey AS VARCHAR) DESC")
_ordered("eq_sequence", "orders", {"$eq": {"o_orderstatus": "P"}}, "o_orderstatus", "o_orderstatus = 'P'", "CAST(o_orderkey AS VARCHAR)")

_register(
    "orderby_top_k",
    lambda spark, sf_dir: typed(spark, sf_dir, "orders").find_sorted({"$orderBy": {"o_totalprice": "desc"}}, limit=25).select(F.col("o_orderkey").cast("string").alias("_id"), "o_totalprice"),
    "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 25",
)


# -- documents as VARIANT --


def _variant(name: str, query: Any, where: str) -> None:
    number = lambda path: F.try_variant_get("data", path, "bigint")
    _register(
        name,
        lambda spark, sf_dir: nested(spark, sf_dir).find(query).select("_id", number("$.k").alias("k"), F.try_variant_get("data", "$.value", "double").alias("value"), "op_seq"),
        f"WITH e AS (SELECT CAST(event_id AS VARCHAR) AS _id, value, event_type, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events) SELECT _id, k, value, 0 AS op_seq FROM e WHERE {where}",
    )


_variant("variant_eq_string", {"$eq": {"event_type": "click"}}, "event_type = 'click'")
_variant("variant_gt_int", {"$gt": {"k": 90}}, "k > 90")
_variant("variant_lt_double", {"$lt": {"k": 10.5}}, "k < 10.5")
_variant("variant_wrong_family", {"$gt": {"k": "9"}}, "false")
_variant("variant_and", {"$and": [{"$gt": {"k": 50}}, {"$lt": {"value": 20.0}}]}, "k > 50 AND value < 20.0")
_variant("variant_or", {"$or": [{"$eq": {"k": 4}}, {"$gt": {"value": 95.0}}]}, "k = 4 OR value > 95.0")
_variant("orderby_missing_excluded", {"$orderBy": {"k": "asc"}}, "k IS NOT NULL")


# -- reads --


def _read(name: str, run: Callable[[DocumentView], DataFrame], tail: str) -> None:
    _register(
        name,
        lambda spark, sf_dir: run(typed(spark, sf_dir, "orders")).select(F.col("o_orderkey").cast("string").alias("_id"), "o_orderstatus", "o_totalprice"),
        f"SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderstatus, o_totalprice FROM orders {tail}",
    )


_read("point_read", lambda v: v.read("77"), "WHERE o_orderkey = 77")
_read("point_read_absent", lambda v: v.read("x"), "WHERE false")
_read("scan_default_limit_10", lambda v: v.scan(), "ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10")
_read("scan_limit_n", lambda v: v.scan(137), "ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 137")
_read("scan_all", lambda v: v.scan(None), "")
_read("cursor_seek", lambda v: v.scan(20, "123"), "WHERE CAST(o_orderkey AS VARCHAR) >= '123' ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 20")


# -- updates --

_EVENTS = "SELECT CAST(event_id AS VARCHAR) AS _id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS pk FROM events"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents with a nested document, an array, and a scalar."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.from_json("props", "k long").alias("props"))
    rows = rows.withColumn("tags", F.array("event_type", F.lit("x"))).withColumn("odd", F.when(F.col("props.k") % 2 == 1, F.lit("odd")))
    return V.documents_from(rows, "event_id")


def _update(name: str, update: Any, columns: dict[str, tuple[str, str]], sql: dict[str, str]) -> None:
    """columns: name -> (path, type) read from the updated document; sql: the same in SQL."""
    _register(
        name,
        lambda spark, sf_dir: _documents(spark, sf_dir).select("_id", compile_update(F.col("data"), update).alias("data")).select("_id", *(_plain(p, t).alias(c) for c, (p, t) in columns.items())),
        f"WITH e AS ({_EVENTS}) SELECT _id, {', '.join(f'{x} AS {c}' for c, x in sql.items())} FROM e",
    )


def _plain(path: str, kind: str) -> Column:
    if kind == "list":  # an array of strings as one text
        return F.array_join(F.try_variant_get("data", path, "array<string>"), "|")
    return F.try_variant_get("data", path, kind)


_update("update_set_top", {"$set": {"value": 1.5, "fresh": "yes"}}, {"value": ("$.value", "double"), "fresh": ("$.fresh", "string")}, {"value": "CAST(1.5 AS DOUBLE)", "fresh": "'yes'"})
_update("update_set_nested_existing", {"$set": {"props.k": -1}}, {"k": ("$.props.k", "bigint")}, {"k": "CAST(-1 AS BIGINT)"})
_update("update_set_nested_absent_noop", {"$set": {"props.none": 1, "gone.k": 2}}, {"k": ("$.props.k", "bigint"), "none": ("$.props.none", "bigint"), "gone": ("$.gone.k", "bigint")}, {"k": "pk", "none": "CAST(NULL AS BIGINT)", "gone": "CAST(NULL AS BIGINT)"})
_update("update_unset_top", {"$unset": {"value": "", "absent": ""}}, {"value": ("$.value", "double"), "event_type": ("$.event_type", "string")}, {"value": "CAST(NULL AS DOUBLE)", "event_type": "event_type"})
_update("update_unset_nested", {"$unset": {"props.k": "", "props.none": "", "gone.k": ""}}, {"k": ("$.props.k", "bigint"), "value": ("$.value", "double")}, {"k": "CAST(NULL AS BIGINT)", "value": "value"})
_update("update_push_array", {"$push": {"tags": "new"}}, {"tags": ("$.tags", "list")}, {"tags": "event_type || '|x|new'"})
_update("update_push_missing", {"$push": {"award": "first"}}, {"award": ("$.award", "string")}, {"award": "'first'"})
_update("update_push_scalar", {"$push": {"event_type": "more"}}, {"event_type": ("$.event_type", "list")}, {"event_type": "event_type || '|more'"})
_update("update_pull_array", {"$pull": {"tags": "click"}}, {"tags": ("$.tags", "list")}, {"tags": "CASE WHEN event_type = 'click' THEN 'x' ELSE event_type || '|x' END"})
_update("update_pull_scalar_eq", {"$pull": {"odd": "odd"}}, {"odd": ("$.odd", "string")}, {"odd": "CAST(NULL AS VARCHAR)"})
_update("update_pull_scalar_neq", {"$pull": {"odd": "even"}}, {"odd": ("$.odd", "string")}, {"odd": "CASE WHEN pk % 2 = 1 THEN 'even' END"})
_update(
    "update_op_order",
    {"$unset": {"value": ""}, "$set": {"value": 3, "odd": "set"}, "$push": {"tags": "p", "odd": "q"}, "$pull": {"tags": "x"}},
    {"value": ("$.value", "double"), "tags": ("$.tags", "list"), "odd": ("$.odd", "string")},
    {"value": "CAST(NULL AS DOUBLE)", "tags": "event_type || '|p'", "odd": "'set'"},
)


# -- the store --


def _scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/docquarry-{uuid.uuid4().hex}"


def _store(spark: SparkSession) -> Database:
    database = Database(spark, _scratch(spark))
    database.open()
    return database


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.documents_from(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("_id", F.try_variant_get("data", "$.o_orderstatus", "string").alias("o_orderstatus"), F.try_variant_get("data", "$.o_totalprice", "double").alias("o_totalprice"))


_ORDERS = "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderstatus, o_totalprice FROM orders"


def _upsert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _store(spark).create_collection("orders")
    own.put(_orders(spark, sf_dir))
    own.update_document("new-1", {"$set": {"o_orderstatus": "N"}}, upsert=True)
    own.update_document("77", {"$set": {"o_totalprice": 0.5}})
    return _shown(own.frame())


def _replace_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _store(spark).create_collection("orders")
    own.put(_orders(spark, sf_dir))
    changed = _orders(spark, sf_dir).where(F.try_variant_get("data", "$.o_orderstatus", "string") == "P")
    own.put(changed.select("_id", compile_update(F.col("data"), {"$set": {"o_orderstatus": "Q"}}).alias("data")))
    own.compact()
    return _shown(own.frame())


def _delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _store(spark).create_collection("orders")
    own.put(_orders(spark, sf_dir))
    own.delete_document("77")
    own.create_index("o_orderstatus")
    own.delete_where({"$eq": {"o_orderstatus": "F"}})
    return _shown(own.frame())


_register("upsert_new", _upsert_new, f"SELECT _id, o_orderstatus, CASE WHEN _id = '77' THEN 0.5 ELSE o_totalprice END AS o_totalprice FROM ({_ORDERS}) UNION ALL SELECT 'new-1', 'N', NULL")
_register("replace_existing", _replace_existing, f"SELECT _id, CASE WHEN o_orderstatus = 'P' THEN 'Q' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM ({_ORDERS})")
_register("delete_by_id", _delete_by_id, f"SELECT * FROM ({_ORDERS}) WHERE _id <> '77' AND o_orderstatus <> 'F'")


def _customers(spark: SparkSession, sf_dir: str):
    own = _store(spark).create_collection("customers")
    own.put(V.documents_from(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey"))
    return own


def _export_import_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers exported to one JSON array and imported into another collection."""
    own = _customers(spark, sf_dir)
    path = json_io.export_json_async(own, f"{own.database.path}-out").result()
    again = own.database.create_collection("again")
    json_io.import_json(again, path)
    return again.frame().select("_id", F.try_variant_get("data", "$.c_name", "string").alias("c_name"), F.try_variant_get("data", "$.c_acctbal", "double").alias("c_acctbal"))


def _import_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions imported as objects without ids: their places name them."""
    database = _store(spark)
    rows = sorted(table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect())
    path = f"{database.path}/in.json"
    database.files.write(path, json.dumps([{"r_name": r.r_name} for r in rows]))
    own = database.create_collection("regions")
    json_io.import_json(own, path)
    return own.frame().select("_id", F.try_variant_get("data", "$.r_name", "string").alias("r_name"))


def _list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _store(spark)
    for name in ("users", "orders", "gone"):
        database.create_collection(name)
    database.drop_collection("gone")
    return database.collections()


def _list_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _store(spark).create_collection("users")
    for field in ("name", "age", "mail", "age"):
        own.create_index(field)
    own.delete_index("mail")
    return own.indexes()


_register("export_import_roundtrip", _export_import_roundtrip, "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer")
_register("import_generated_ids", _import_generated_ids, "SELECT 'doc_' || CAST(ROW_NUMBER() OVER (ORDER BY r_regionkey) - 1 AS VARCHAR) AS _id, r_name FROM region")
_register("list_collections", _list_collections, "SELECT * FROM (VALUES ('orders'), ('users')) AS t(collection)")
_register("list_indexes", _list_indexes, "SELECT * FROM (VALUES ('users', 'age'), ('users', 'name')) AS t(collection, field)")


# -- databases, cursors, documents --


def _told(spark: SparkSession, *steps: Any) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in enumerate(steps)], "step int, told string")


def _nations(spark: SparkSession, sf_dir: str):
    own = _store(spark).create_collection("nations")
    own.put(V.documents_from(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey"))
    return own


def _walked(spark: SparkSession, cursor: Any, most: int) -> list[tuple[int, str, str]]:
    rows: list[tuple[int, str, str]] = []
    while cursor.is_valid() and len(rows) < most:
        rows.append((len(rows), cursor.current_id(), cursor.current()["n_name"]))
        cursor.next()
    return rows


_WALK = "place int, _id string, n_name string"
_NATIONS = "SELECT CAST(ROW_NUMBER() OVER (ORDER BY CAST(n_nationkey AS VARCHAR)) - 1 AS INTEGER) AS place, CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation"


def _cursor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, valid, next, current and id over a whole collection."""
    return spark.createDataFrame(_walked(spark, _nations(spark, sf_dir).cursor(), 10**9), _WALK)


def _cursor_seek_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = _nations(spark, sf_dir).cursor()
    cursor.seek("2")
    return spark.createDataFrame(_walked(spark, cursor, 4), _WALK)


def _cursor_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = _nations(spark, sf_dir).cursor()
    cursor.seek("zzz")
    past = cursor.is_valid()
    cursor.reset()
    return spark.createDataFrame(_walked(spark, cursor, 3 if not past else 0), _WALK)


_register("cursor_walk", _cursor_walk, _NATIONS)
_register("cursor_seek_walk", _cursor_seek_walk, f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY _id) - 1 AS INTEGER) AS place, _id, n_name FROM ({_NATIONS}) WHERE _id >= '2' ORDER BY _id LIMIT 4")
_register("cursor_reset", _cursor_reset, f"SELECT * FROM ({_NATIONS}) WHERE place < 3")


def _db_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, close and open again: what exists, and that indexes are kept."""
    database = Database(spark, _scratch(spark))
    before = database.is_open
    database.open()
    database.create_collection("users").create_index("age")
    opened, there, gone = database.is_open, database.collection_exists("users"), database.collection_exists("none")
    database.close()
    closed = database.is_open
    database.open()
    return _told(spark, before, opened, there, gone, closed, database.is_open, database.get_collection("users").index_names(), database.get_collection("none"))


_register("db_states", _db_states, "SELECT * FROM (VALUES (0, 'False'), (1, 'True'), (2, 'True'), (3, 'False'), (4, 'False'), (5, 'True'), (6, '[''age'']'), (7, 'None')) AS t(step, told)")


def _db_read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database's own reading of a collection: ten documents by id."""
    own = _nations(spark, sf_dir)
    return spark.createDataFrame([(d["_id"], d["n_name"]) for d in own.database.read_all_documents("nations")], "_id string, n_name string")


def _engine_get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).frame().select("_id", F.try_variant_get("data", "$.n_name", "string").alias("n_name"))


_register("db_read_all", _db_read_all, f"SELECT _id, n_name FROM ({_NATIONS}) WHERE place < 10")
_register("engine_get_all", _engine_get_all, f"SELECT _id, n_name FROM ({_NATIONS})")


def _generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an id get one of their own, which is in the document too."""
    own = _store(spark).create_collection("c")
    names = [r.r_name for r in table(spark, sf_dir, "region").collect()]
    ids = own.create_documents([("", {"name": n}) for n in names])
    inside = F.try_variant_get("data", "$._id", "string") == F.col("_id")
    return own.frame().select(F.try_variant_get("data", "$.name", "string").alias("r_name"), F.length("_id").alias("long"), inside.alias("inside"), F.lit(len(set(ids))).alias("ids"))


_register("generated_ids", _generated_ids, "SELECT r_name, CAST(12 AS INTEGER) AS long, true AS inside, CAST((SELECT COUNT(*) FROM region) AS INTEGER) AS ids FROM region")


def _accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's fields read and set, and its JSON there and back."""
    rows = []
    for r in table(spark, sf_dir, "region").collect():
        one = Document(str(r.r_regionkey), {"name": r.r_name})
        one.set_value("size", {"n": len(r.r_name)})
        again = Document.from_json(one.id, one.to_json())
        rows.append((again.id, again.get_value("name"), again.get_value("size")["n"], again.has_field("size"), again.has_field("none"), one.to_json()))
    return spark.createDataFrame(rows, "_id string, r_name string, n int, has boolean, hasnt boolean, json string")


_register("accessors", _accessors, """SELECT CAST(r_regionkey AS VARCHAR) AS _id, r_name, CAST(length(r_name) AS INTEGER) AS n, true AS has, false AS hasnt, '{"name": "' || r_name || '", "size": {"n": ' || length(r_name) || '}}' AS json FROM region""")


# -- commands --


def _cmd_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _customers(spark, sf_dir)
    own.create_index("c_acctbal")
    answers = [Commands(own.database).handle_text(json.dumps({"command": "find_documents", "request_id": "r1", "collection_name": "customers", "query": {"$lt": {"c_acctbal": -900.0}}}))]
    rows = responses_frame(spark, answers)
    got = F.from_json("payload", "_id string, c_name string, c_acctbal double, status string")
    return rows.select("request_id", "msg_seq", got.alias("p")).select("request_id", "msg_seq", "p.c_name", "p.c_acctbal", "p.status")


_register(
    "cmd_find",
    _cmd_find,
    "WITH f AS (SELECT * FROM customer WHERE c_acctbal < -900.0) SELECT 'r1' AS request_id, CAST(ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) DESC) - 1 AS INTEGER) AS msg_seq, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS status FROM f UNION ALL SELECT 'r1', CAST((SELECT COUNT(*) FROM f) AS INTEGER), NULL, NULL, 'success'",
)

_LOG = [
    {"command": "create_collection", "request_id": "a", "collection_name": "c"},
    {"command": "create_document", "request_id": "b", "collection_name": "c", "document_id": "d1", "content": {"v": 1}},
    {"command": "read_document", "request_id": "c", "collection_name": "c", "document_id": "d1"},
    {"command": "create_index", "request_id": "d", "collection_name": "c", "field": "v"},
    {"command": "get_indexes", "request_id": "e", "collection_name": "c"},
    {"command": "get_collections", "request_id": "f"},
    {"command": "delete_document", "request_id": "g", "collection_name": "c", "document_id": "d1"},
    {"command": "read_document", "request_id": "h", "collection_name": "c"},
    {"command": "delete_index", "request_id": "i", "collection_name": "c", "field": "v"},
    {"command": "delete_collection", "request_id": "j", "collection_name": "c"},
    {"command": "rewind", "request_id": "k"},
    {"command": "read_document", "request_id": "l"},
    {"command": "create_collection"},
    "",
]


def _cmd_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of commands in order with their whole responses; an unknown one, two without what they
    need and an empty one among them."""
    commands = Commands(_store(spark))
    return responses_frame(spark, [commands.handle_text(r if isinstance(r, str) else json.dumps(r)) for r in _LOG])


_ANSWERS = [
    ("a", {"message": "Collection c created", "status": "success"}),
    ("b", {"docId": "d1", "message": "Document added to c", "status": "success"}),
    ("c", {"_id": "d1", "status": "success", "v": 1}),
    ("d", {"message": "Index on v created", "status": "success"}),
    ("e", {"collection": "c", "indexList": "v,"}),
    ("f", {"Collections": "c,"}),
    ("g", {"docId": "d1", "message": "Document deleted from c", "status": "success"}),
    ("h", {"status": "success"}),
    ("i", {"message": "Index on v deleted", "status": "success"}),
    ("j", {"message": "Collection c deleted", "status": "success"}),
    ("k", {"message": "Unknown command: rewind", "status": "error"}),
    ("l", {"message": "the request needs the text collection_name", "status": "error"}),
    ("", {"message": "the request needs the text request_id", "status": "error"}),
]
_register("cmd_log", _cmd_log, "SELECT * FROM (VALUES " + ", ".join(f"('{i}', 0, '{json.dumps(a)}')" for i, a in _ANSWERS) + ") AS t(request_id, msg_seq, payload)")


def _cmd_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are no JSON, or no objects: an error each, without a request's id."""
    commands = Commands(_store(spark))
    rows = responses_frame(spark, [commands.handle_text(t) for t in ("{", "[1]", "7", '{"command": 3, "request_id": "x"}', "   ")])
    return rows.select("request_id", "msg_seq", F.get_json_object("payload", "$.status").alias("status"), (F.length(F.get_json_object("payload", "$.message")) > 0).alias("says"))


_register("cmd_malformed", _cmd_malformed, "SELECT '' AS request_id, CAST(0 AS INTEGER) AS msg_seq, 'error' AS status, true AS says FROM range(4)")


def _cmd_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command's file, read back."""
    own = _nations(spark, sf_dir)
    folder = f"{own.database.path}-out"
    _, answers = Commands(own.database).handle({"command": "export_collection", "request_id": "x", "collection_name": "nations", "dest_dir": folder})
    got = json_io.read_array(own, f"{folder}/nations.json")
    return got.select("pos", F.try_variant_get("value", "$._id", "string").alias("_id"), F.try_variant_get("value", "$.n_name", "string").alias("n_name"), F.lit(answers[-1]["status"]).alias("status"))


_register("cmd_export", _cmd_export, f"SELECT place AS pos, _id, n_name, 'success' AS status FROM ({_NATIONS})")


def _import_lines_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with repeated ids, no ids and broken lines: the last of an id counts."""
    own = _store(spark).create_collection("lines")
    names = sorted((r.r_regionkey, r.r_name) for r in table(spark, sf_dir, "region").collect())
    lines = [json.dumps({"_id": str(k), "v": v}) for v in ("old", "new") for k, _ in names] + ['{"v": 1}', "{", '{"_id": 5}', "[]"]
    own.files.write(f"{own.database.path}/in.jsonl", "\n".join(lines))
    told = json_io.import_lines(own, f"{own.database.path}/in.jsonl")
    return own.frame().select("_id", F.try_variant_get("data", "$.v", "string").alias("v"), F.lit(told["imported"]).alias("imported"), F.lit(told["skipped"]).alias("skipped"))


_register("import_lines_last", _import_lines_last, "SELECT CAST(r_regionkey AS VARCHAR) AS _id, 'new' AS v, CAST(2 * (SELECT COUNT(*) FROM region) AS INTEGER) AS imported, CAST(4 AS INTEGER) AS skipped FROM region")


# -- the mixed load --

STRESS: list[Any] = [
    {"$orderBy": {"o_totalprice": "desc"}},
    {"$gt": {"o_totalprice": 250000.0}},
    {"$eq": {"o_orderstatus": "F"}},
    {"$lt": {"o_custkey": 300}},
    {"$and": [{"$gt": {"o_totalprice": 100000.0}}, {"$lt": {"o_totalprice": 250000.0}}]},
    {"$or": [{"$eq": {"o_orderpriority": "1-URGENT"}}, {"$lt": {"o_totalprice": 20000.0}}]},
]
_STRESS_SQL = ["true", "o_totalprice > 250000.0", "o_orderstatus = 'F'", "o_custkey < 300", "o_totalprice > 100000.0 AND o_totalprice < 250000.0", "o_orderpriority = '1-URGENT' OR o_totalprice < 20000.0"]


def _stress_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, found = typed(spark, sf_dir, "orders"), None
    for k, query in enumerate(STRESS):
        part = view.find(query).select(F.lit(k).alias("query"), F.col("o_orderkey").cast("string").alias("_id"))
        found = part if found is None else found.unionAll(part)
    return found


_register("stress_mix", _stress_mix, " UNION ALL ".join(f"SELECT {k} AS query, CAST(o_orderkey AS VARCHAR) AS _id FROM orders WHERE {w}" for k, w in enumerate(_STRESS_SQL)))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
