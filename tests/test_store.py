import json

import pytest
from products import INDEXED, PRODUCTS

from docquarry.sources import json_io, store
from docquarry.status import Code, QuarryError


def ids(*numbers):
    return [f"prod{n:03d}" for n in numbers]


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    db = store.Database(spark, str(tmp_path_factory.mktemp("db")))
    db.open()
    return db


@pytest.fixture(scope="module")
def products(database):
    own = database.create_collection("products")
    own.create_documents(PRODUCTS.items())
    for f in INDEXED:
        own.create_index(f)
    return own


@pytest.fixture
def scratch(database, request):
    name = "s" + str(abs(hash(request.node.name)))
    own = database.create_collection(name)
    yield own
    database.drop_collection(name)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ({"$eq": {"category": "Electronics"}}, ids(1, 2)),
        ({"$eq": {"category": "Electron"}}, []),
        ({"$eq": {"available": False}}, ids(4)),
        ({"$eq": {"stock": 45.0}}, ids(1, 10)),
        ({"$gt": {"price": 100.0}}, ids(6, 12, 11, 5, 13, 2, 1)),
        ({"$gt": {"price": 100}}, ids(6, 12, 11, 5, 13, 2, 1)),
        ({"$lt": {"price": 100.0}}, ids(8, 3, 14, 7, 10, 9, 4)),
        ({"$gt": {"price": "100"}}, []),
        ({"$and": [{"$eq": {"category": "Electronics"}}, {"$eq": {"available": True}}]}, ids(1, 2)),
        ({"$or": [{"$eq": {"category": "Books"}}, {"$eq": {"category": "Food"}}]}, ids(3, 4)),
        ({"$and": [{"$gt": {"price": 100.0}}, {"$gt": {"rating": 4.5}}]}, ids(1, 6, 11, 13)),
        ({"$and": [{"$gt": {"price": 100.0}, "$lt": {"price": 140.0}}]}, ids(6, 12)),
        ({"$or": [{"$lt": {"price": 50.0}}, {"$gt": {"stock": 200}}]}, ids(3, 4, 7, 9, 10, 12, 14)),
        ({"$and": [{"$eq": {"category": "Books"}}, {"$eq": {"category": "Food"}}, {"$eq": {"available": True}}]}, []),
        ({"$lt": {"price": 20.0}, "$gt": {"price": 1000.0}}, ids(1, 4)),
        ({"$eq": {"category": "Food"}, "$orderBy": {"stock": "desc"}}, ids(4, 12, 4, 2, 7, 9, 6, 14, 3, 8, 10, 1, 5, 11, 13)),
        ({"$eq": {"category": "Food", "available": True}}, [p for p in PRODUCTS if PRODUCTS[p]["available"]]),
        ({"$eq": {"brand": "Umbra"}}, []),
        ({"$gt": {"price": None}}, []),
        ({"$gt": {"category": ""}}, []),
        ({"$eq": {"price": {"a": 1}}}, []),
        ({"$and": [{"$eq": {"brand": "Umbra"}}, {"$gt": {"price": 1.0}}]}, []),
        ({"$and": [{"$or": []}]}, []),
        ({"$and": []}, []),
        ({"$nothing": {"price": 1}}, []),
        ({}, []),
    ],
)
def test_find(products, query, expected):
    assert products.find_document(query) == expected


def test_order_by(products):
    up = products.find_document({"$orderBy": {"price": "asc"}})
    assert len(up) == 14 and (up[0], up[-1]) == ("prod004", "prod001")
    down = products.find_document({"$orderBy": {"price": "anything"}})
    # ties stand by id in the same direction
    assert down == list(reversed(up)) and down.index("prod012") < down.index("prod006")


def test_and_with_an_unindexed_field_empties_the_query(products):
    assert products.find_document({"$and": [{"$eq": {"brand": "x"}}], "$gt": {"price": 1.0}}) == []
    assert products.last_status.code is Code.INVALID_ARGUMENT
    assert products.find_document({"$eq": {"brand": "x"}, "$gt": {"price": 1000.0}}) == ["prod001"]
    with pytest.raises(QuarryError):
        products.find({"$lt": {"brand": "x"}}, strict=True)


def test_sorted_numbered_and_limited(products):
    view = products.view()
    rows = sorted(view.find_numbered({"$lt": {"price": 40.0}}).collect(), key=lambda r: r.ord)
    assert [(r._id, r.ord) for r in rows] == list(zip(ids(7, 10, 9, 4), range(1, 5), strict=True))
    assert [r._id for r in view.find_sorted({"$orderBy": {"rating": "desc"}}, limit=2).collect()] == ids(7, 10)


def test_null_missing_and_mixed_types(scratch):
    scratch.create_index("f")
    scratch.create_documents([("a", {"f": None}), ("b", {"f": 5}), ("c", {"f": 5.0}), ("d", {"f": "5"}), ("e", {}), ("g", {"f": True}), ("h", {"f": 2**40}), ("i", {"f": "true"})])
    assert scratch.find_document({"$eq": {"f": None}}) == ["a"]
    assert scratch.find_document({"$eq": {"f": 5}}) == ["b", "c"]
    assert scratch.find_document({"$eq": {"f": True}}) == ["g"]
    assert scratch.find_document({"$gt": {"f": 4}}) == ["b", "c", "h"] or scratch.find_document({"$gt": {"f": 4}}) == ["c", "b", "h"]
    assert scratch.find_document({"$orderBy": {"f": "asc"}})[0] == "a"
    assert "e" not in scratch.find_document({"$orderBy": {"f": "desc"}})
    with pytest.raises(QuarryError) as e:
        scratch.create_document("z", {"f": [1]})
    assert e.value.status.code is Code.INVALID_ARGUMENT


def test_create_replace_read_delete(scratch):
    assert len(scratch.create_document("", {"x": 1})) == 12
    scratch.create_documents(PRODUCTS.items())
    scratch.create_document("prod005", {"name": "Headphones", "price": 129.99})
    got = scratch.read_document("prod005")
    assert got == {"_id": "prod005", "name": "Headphones", "price": 129.99}
    scratch.delete_document("prod005")
    for missing in (lambda: scratch.read_document("prod005"), lambda: scratch.delete_document("prod005")):
        with pytest.raises(QuarryError) as e:
            missing()
        assert e.value.status.code is Code.NOT_FOUND
    scratch.compact()
    scratch.vacuum()
    assert scratch.frame().count() == 14
    assert len(scratch.read_all_documents()) == 10
    assert [d["_id"] for d in scratch.read_all_documents(None)][-1] == "prod014"


def test_updates(scratch):
    scratch.create_documents(PRODUCTS.items())
    scratch.update_document("prod001", {"$set": {"price": 1.5, "new": [1, {"a": None}], "specs.ram": "32GB", "specs.gpu": "no", "no.where": 1, "dimensions.height": 2.0}})
    got = scratch.read_document("prod001")
    assert got["price"] == 1.5 and got["new"] == [1, {"a": None}] and got["specs"] == {"processor": "i7", "ram": "32GB", "storage": "512GB"} and "no" not in got and got["dimensions"]["height"] == 2.0
    scratch.update_document("prod001", {"$unset": {"stock": "", "specs.ram": "", "specs.no.x": "", "tags.0": ""}})
    got = scratch.read_document("prod001")
    assert "stock" not in got and got["specs"] == {"processor": "i7", "storage": "512GB"} and got["tags"] == ["thin", "office"]
    scratch.update_document("prod001", {"$push": {"tags": "premium", "awards": "Best", "specs": {"storage": "2 GB"}, "price": [3]}})
    got = scratch.read_document("prod001")
    assert got["tags"] == ["thin", "office", "premium"] and got["awards"] == "Best" and got["price"] == [1.5, [3]]
    assert got["specs"] == [{"processor": "i7", "storage": "512GB"}, {"storage": "2 GB"}]
    scratch.update_document("prod001", {"$set": {"n": [1, 1.0, "1", {"a": 1}, None]}})
    scratch.update_document("prod001", {"$pull": {"tags": "thin", "awards": "Worst", "name": "Laptop", "nothing": 1, "n": 1}})
    got = scratch.read_document("prod001")
    assert got["tags"] == ["office", "premium"] and got["awards"] == "Worst" and "name" not in got and got["n"] == ["1", {"a": 1}, None]
    scratch.update_document("prod002", {"$set": {"reviews.0.rating": 1, "reviews.7.rating": 9}, "$pull": {"colors": "black"}, "$push": {"colors": "red"}, "$unset": {"features": ""}, "$odd": {"a": 1}})
    got = scratch.read_document("prod002")
    assert got["reviews"][0]["rating"] == 1 and got["colors"] == ["red"] and "features" not in got
    with pytest.raises(QuarryError):
        scratch.update_document("absent", {"$set": {"a": 1}})
    scratch.update_document("absent", {"$set": {"a": 1}}, upsert=True)
    assert scratch.read_document("absent") == {"_id": "absent", "a": 1}


def test_bulk_update_and_delete(scratch):
    scratch.create_documents(PRODUCTS.items())
    scratch.create_index("price")
    scratch.update_where({"$gt": {"price": 300.0}}, {"$set": {"dear": True}})
    assert sum("dear" in d for d in scratch.read_all_documents(None)) == 3
    scratch.delete_where({"$lt": {"price": 300.0}})
    assert scratch.frame().count() == 3


def test_indexes_survive_reopening(spark, database, products):
    again = store.Database(spark, database.path)
    again.open()
    assert again.get_collection("products").index_names() == sorted(INDEXED)
    products.create_index("brand")
    products.create_index("brand")
    products.delete_index("brand")
    with pytest.raises(QuarryError):
        products.delete_index("brand")
    with pytest.raises(QuarryError) as e:
        products.create_index("features")
    assert e.value.status.code is Code.CORRUPTION
    again.close()
    assert not again.is_open and database.is_open


def test_collections(database):
    before = database.collection_names()
    database.create_collection("one")
    for name in ("one", "", "a/b", "a__index__b"):
        assert store.attempt(lambda n=name: database.create_collection(n)).code is Code.INVALID_ARGUMENT
    assert database.collection_names() == sorted([*before, "one"])
    database.drop_collection("one")
    assert database.get_collection("one") is None
    assert store.attempt(lambda: database.drop_collection("one")).code is Code.NOT_FOUND


def test_cursor(products):
    c = products.cursor()
    seen = []
    while c.is_valid():
        seen.append(c.current_id())
        c.next()
    assert seen == sorted(PRODUCTS) and c.current_id() == ""
    with pytest.raises(QuarryError):
        c.current()
    c.seek("prod0115")
    assert c.current_id() == "prod012"
    c.reset()
    assert c.current()["name"] == "Laptop"


def test_export_then_import(products, scratch, tmp_path):
    path = json_io.export_json_async(products, str(tmp_path / "out")).result()
    with open(path.removeprefix("file:")) as f:
        text = f.read()
    assert [d["_id"] for d in json.loads(text)] == sorted(PRODUCTS) and text.startswith('[\n    {\n        "_id"')
    assert json_io.import_json(scratch, path) == {"imported": 14, "skipped": 0}
    assert scratch.read_document("prod004")["price"] == 15.99


def test_import_rules(scratch, tmp_path):
    def file(text):
        p = tmp_path / f"{abs(hash(text))}.json"
        p.write_text(text)
        return str(p)

    assert json_io.import_json(scratch, file('[{"a": 1}, 5, {"_id": "x", "v": 1}, {"_id": "x", "v": 2}, {"b": 2}]')) == {"imported": 4, "skipped": 1}
    assert sorted((d["_id"], d.get("v")) for d in scratch.read_all_documents(None)) == [("doc_0", None), ("doc_4", None), ("x", 2)]
    for text, code in (('{"a": 1}', Code.NOT_SUPPORTED), ("[{", Code.INTERNAL_ERROR), ('[{"_id": 5}]', Code.INTERNAL_ERROR)):
        assert store.attempt(lambda t=text: json_io.import_json(scratch, file(t))).code is code
    assert store.attempt(lambda: json_io.import_json(scratch, str(tmp_path / "none.json"))).code is Code.IO_ERROR
    assert json_io.import_json(scratch, file("[]")) == {"imported": 0, "skipped": 0}


def test_indexed_fields_hold_no_objects_whatever_the_write(spark, tmp_path):
    from docquarry.sources import json_io
    from docquarry.sources.store import Database
    from docquarry.status import Code, QuarryError

    database = Database(spark, str(tmp_path / "db"))
    database.open()
    own = database.create_collection("c")
    own.create_documents([("a", {"v": 1}), ("b", {"v": 2})])
    own.create_index("v")
    (tmp_path / "in.json").write_text('[{"_id": "c", "v": 3}, {"_id": "d", "v": {"x": 1}}]')
    (tmp_path / "in.jsonl").write_text('{"_id": "c", "v": [1]}')
    bad = spark.sql("SELECT 'c' AS _id, parse_json('{\"v\": [1]}') AS data")
    for write in (lambda: own.put(bad), lambda: own.update_where({"$eq": {"v": 1}}, {"$set": {"v": {"y": 2}}}), lambda: own.update_document("a", {"$push": {"v": 5}}), lambda: json_io.import_json(own, str(tmp_path / "in.json")), lambda: json_io.import_lines(own, str(tmp_path / "in.jsonl"))):
        with pytest.raises(QuarryError) as e:
            write()
        assert e.value.status.code is Code.INVALID_ARGUMENT
    assert {r._id for r in own.frame().collect()} == {"a", "b"}


def test_repeated_ids_need_an_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from docquarry.sources.store import Database
    from docquarry.status import QuarryError

    database = Database(spark, str(tmp_path / "db"))
    database.open()
    own = database.create_collection("c")
    rows = spark.createDataFrame([("a", '{"v": 1}', 1), ("a", '{"v": 2}', 2)], "_id string, t string, k int").select("_id", F.parse_json("t").alias("data"), "k")
    with pytest.raises(QuarryError):
        own.put(rows)
    own.put(rows, F.col("k"))
    assert own.read_document("a")["v"] == 2


def test_two_drivers_do_not_lose_a_commit(spark, tmp_path):
    from docquarry.sources import store
    from docquarry.status import Code, QuarryError

    one, other = (store.Database(spark, str(tmp_path / "db")) for _ in range(2))
    one.open()
    other.open()
    a = one.create_collection("c")
    b = other.get_collection("c")
    stale = b._manifest()
    a.create_document("x", {"v": 1})
    with pytest.raises(QuarryError) as e:
        b._swap(stale)
    assert e.value.status.code is Code.IO_ERROR
    claimed = f"{a.path}/.claim-{a._manifest()['version'] + 1:08d}"
    assert a.files.claim(claimed) and not a.files.claim(claimed)
    with pytest.raises(QuarryError):
        b.create_document("y", {"v": 2})
    a.files.delete(claimed)
    b.create_document("y", {"v": 2})
    assert {r._id for r in a.frame().collect()} == {"x", "y"}
