"""Random queries and updates over documents of mixed types against plain evaluators."""

import copy
import random

import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docquarry.document import Document, same
from docquarry.functions import variants as V
from docquarry.operators.find import DocumentView
from docquarry.operators.update import compile_update
from docquarry.plans.query import parse
from docquarry.status import QuarryError

VALUES = [None, True, False, 0, 1, 5, -3, 2.5, 1.0, -0.5, 1e300, 2**53 + 1, 2**60, "", "a", "ab", "5", "true", "é"]
FIELDS = ["f", "g", "a.b"]


def documents():
    r = random.Random(7)
    made = []
    for k in range(80):
        made.append((f"d{k:02d}", {f: r.choice(VALUES) for f in FIELDS if r.random() < 0.8}))
    return made


DOCUMENTS = documents()


def family(v):
    return "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text"


def holds(doc, op, field, value):
    if field not in doc or family(doc[field]) != family(value):
        return False
    own = doc[field]
    if value is None:
        return op == "$eq"
    return own == value if op == "$eq" else own > value if op == "$gt" else own < value


def evaluate(query):
    found = []
    for op in sorted(query):
        body = query[op]
        tests = [(o, *next(iter(item[o].items()))) for item in body for o in sorted(item)] if isinstance(body, list) else [(op, *next(iter(body.items())))]
        usable = [t for t in tests if t[0] == "$eq" or t[2] not in (None, "")]
        if len(usable) < len(tests):
            if isinstance(body, list):
                return []
            continue
        if tests:
            some = any if op == "$or" else all
            found += [i for i, d in DOCUMENTS if some(holds(d, *t) for t in tests)]
    return sorted(found)


leaf = st.tuples(st.sampled_from(["$eq", "$gt", "$lt"]), st.sampled_from(FIELDS), st.sampled_from(VALUES))
one = leaf.map(lambda t: {t[0]: {t[1]: t[2]}})
several = st.lists(one, min_size=1, max_size=3)
query = st.one_of(one, several.map(lambda x: {"$and": x}), several.map(lambda x: {"$or": x}), st.tuples(one, several).map(lambda t: t[0] | {"$or": t[1]}))


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(queries=st.lists(query, min_size=5, max_size=5))
def test_find(spark, queries):
    frame = spark.createDataFrame([(i, V.encode(d)) for i, d in DOCUMENTS], "_id string, text string").selectExpr("_id", "parse_json(text) AS data")
    view = DocumentView(frame, "_id", set(FIELDS))
    parts = None
    for k, q in enumerate(queries):
        part = view.find(q).selectExpr(f"{k} AS q", "_id")
        parts = part if parts is None else parts.unionAll(part)
    got = [[] for _ in queries]
    for r in parts.collect():
        got[r.q].append(r._id)
    assert [sorted(g) for g in got] == [evaluate(q) for q in queries]


def updated(doc, update):
    own = Document("x", copy.deepcopy(doc))
    own.apply_update(update)
    return own.data


field = st.sampled_from(["f", "g", "h"])
target = st.sampled_from(["f", "g", "h", "n.x", "n.y.z", "n.list.1.q", "n.list.0", "f.x", "h.3.x", "n.none.x"])
scalar = st.sampled_from([v for v in VALUES if v != 1e300 and v != 2**60 and v != 2**53 + 1])
update = st.fixed_dictionaries({}, optional={"$pull": st.dictionaries(field, scalar, max_size=2), "$push": st.dictionaries(field, scalar, max_size=2), "$set": st.dictionaries(target, scalar, max_size=2), "$unset": st.dictionaries(target, st.just(""), max_size=2)})


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(changes=st.lists(update, min_size=3, max_size=3))
def test_update(spark, changes):
    from pyspark.sql import functions as F

    docs = [(i, d | {"h": [d.get("f"), 1, "a", True], "n": {"x": d.get("g"), "y": {"z": 1}, "list": [5, {"q": 2}]}}) for i, d in DOCUMENTS[:25]]
    frame = spark.createDataFrame([(i, V.encode(d)) for i, d in docs], "_id string, text string").selectExpr("_id", "parse_json(text) AS data")
    rows = frame.select("_id", *(compile_update(F.col("data"), c).alias(f"c{k}") for k, c in enumerate(changes))).collect()
    for r in rows:
        for k, c in enumerate(changes):
            assert V.to_python(r[f"c{k}"]) == updated(dict(docs)[r._id], c)


def test_parse_keeps_the_order_of_names():
    tree = parse({"$orderBy": {"f": "asc"}, "$eq": {"f": 1}, "$and": [{"$eq": {"f": 1}}]}, {"f"})
    assert [type(n).__name__ for _, n in tree.nodes] == ["All", "Cmp", "OrderBy"] and [p for p, _ in tree.nodes] == [0, 1, 2]


def test_document_on_the_driver():
    own = Document.from_json("d", '{"b": 1, "a": [1, {"x": null}]}')
    assert own.has_field("a") and own.get_value("b") == 1 and own.to_json() == '{"a": [1, {"x": null}], "b": 1}'
    own.set_value("b", 2)
    assert own.get_value("b") == 2
    with pytest.raises(QuarryError):
        own.get_value("none")
    for text in ("[1]", "{"):
        with pytest.raises(QuarryError):
            Document.from_json("d", text)
    assert same({"a": [1, 2.0]}, {"a": [1.0, 2]}) and not same(True, 1) and not same([1], [1, 2])
