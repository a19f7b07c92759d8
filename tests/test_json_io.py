import json
import random

import pytest

from docquarry.sources import json_cuts, json_io, store
from docquarry.status import Code


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    db = store.Database(spark, str(tmp_path_factory.mktemp("db")))
    db.open()
    return db


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return "".join(rnd.choice('ab,"\\[]{}\n:é ') for _ in range(rnd.randrange(9)))
    if kind < 4:
        return (None, rnd.randrange(99), rnd.random())[kind - 1]
    some = [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return some if kind == 4 else {f"{k},": v for k, v in enumerate(some)}


def test_cuts_wherever_blocks_begin():
    rnd = random.Random(7)
    for _ in range(2000):
        want = [value(rnd) for _ in range(rnd.randrange(6))]
        text = rnd.choice(["", " \n"]) + json.dumps(want, indent=rnd.choice([None, 4]), ensure_ascii=rnd.random() < 0.5) + rnd.choice(["", "\n", ' x,[1],"2'])
        blocks, often = [b""], rnd.choice([0.1, 0.5, 1])
        for part in text.encode().split(b","):
            blocks[-1] += part + b","
            if rnd.random() < often:
                blocks.append(b"")
        blocks = [b for b in blocks if b]
        starts, ended = json_cuts.starts((json_cuts.effect(b, False), json_cuts.effect(b, True)) for b in blocks)
        assert ended and json_cuts.opens(blocks[0])
        got = {}
        for b, s in zip(blocks, starts, strict=False):
            for k, whole, part in json_cuts.cut(b, s):
                assert k not in got or not whole
                got[k] = got.get(k, b"") + part
        assert [json.loads(got[k]) for k in range(len(got))] == want


@pytest.fixture
def tiny_splits(spark):
    own = {"spark.sql.files.maxPartitionBytes": "50", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_import_of_an_array_in_many_splits(database, tiny_splits, tmp_path):
    rnd = random.Random(3)
    want = [{"_id": f"é{k}", "v": value(rnd), "t": 'a,"[]{}\\,' * rnd.randrange(20)} for k in range(30)]
    for k, indent in enumerate((None, 4)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(want, indent=indent, ensure_ascii=False))
        own = database.create_collection(f"many{k}")
        assert json_io.import_json(own, str(path)) == {"imported": 30, "skipped": 0}
        assert own.read_all_documents(None) == sorted(want, key=lambda d: d["_id"])


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("", Code.INTERNAL_ERROR),
        ("[1,]", Code.INTERNAL_ERROR),
        ("[,1]", Code.INTERNAL_ERROR),
        ("[1,,2]", Code.INTERNAL_ERROR),
        ("[1}", Code.INTERNAL_ERROR),
        ("[{]}", Code.INTERNAL_ERROR),
        ('[1,"a]', Code.INTERNAL_ERROR),
        ("[1 2]", Code.INTERNAL_ERROR),
        ("1,[2]", Code.INTERNAL_ERROR),
        ('"[1]"', Code.NOT_SUPPORTED),
        (" ,[2]", Code.INTERNAL_ERROR),
    ],
)
def test_texts_that_are_no_array(database, tmp_path, text, code):
    (tmp_path / "in.json").write_text(text)
    own = database.get_collection("wrong") or database.create_collection("wrong")
    assert store.attempt(lambda: json_io.import_json(own, str(tmp_path / "in.json"))).code is code
    assert own.frame().isEmpty()


def test_values_of_an_array(database, tmp_path):
    (tmp_path / "in.json").write_text(' [null, "x,y" ,{"a" : [1.5, {}]}\n, [ ]]]')
    own = database.create_collection("values")
    got = json_io.read_array(own, str(tmp_path / "in.json")).selectExpr("pos", "to_json(value)").collect()
    assert sorted(map(tuple, got)) == [(0, "null"), (1, '"x,y"'), (2, '{"a":[1.5,{}]}'), (3, "[]")]


def test_export_sends_no_documents_to_the_driver(spark, database, tmp_path):
    rnd = random.Random(5)
    want = [{"_id": f"d{k:02d}", "n": [k, {"b": None}], "t": "".join(rnd.choices("abcdefgh, \n\"é", k=60_000))} for k in range(40)]
    own = database.create_collection("large")
    own.create_documents((d["_id"], d) for d in reversed(want))
    own.delete_document("d07")
    live, limit = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    live.set(limit, "300k")
    try:
        path = json_io.export_json(own, str(tmp_path / "out"))
    finally:
        live.remove(limit)
    with open(path) as f:
        assert f.read() == json.dumps([d for d in want if d["_id"] != "d07"], indent=4, sort_keys=True, ensure_ascii=False) + "\n"
    assert [p.name for p in (tmp_path / "out").iterdir() if p.suffix != ".crc"] == ["large.json"]


def test_export_of_nothing(database, tmp_path):
    own = database.create_collection("nothing")
    own.create_document("a", {})
    own.delete_document("a")
    path = json_io.export_json(own, str(tmp_path))
    with open(path) as f:
        assert f.read() == "[\n]\n"
    assert json_io.import_json(own, path) == {"imported": 0, "skipped": 0}
