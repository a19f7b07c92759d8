import json

import pytest
from products import PRODUCTS

from docquarry.sources.store import Database
from docquarry.streaming import bridge
from docquarry.streaming.commands import Commands


@pytest.fixture
def database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.open()
    return db


def say(commands, command, **fields):
    return commands.handle_text(json.dumps({"command": command, "request_id": "r", **fields}))[1]


def test_every_command(database, tmp_path):
    c = Commands(database)
    ok = {"status": "success"}
    assert say(c, "create_collection", collection_name="p")[0].items() >= ok.items()
    assert say(c, "create_collection", collection_name="p")[0]["status"] == "error"
    assert say(c, "get_collections") == [{"Collections": "p,"}]
    for k in ("prod001", "prod004"):
        assert say(c, "create_document", collection_name="p", document_id=k, content=PRODUCTS[k])[0]["docId"] == k
    made = say(c, "create_document", collection_name="p", document_id="", content={"price": 1})[0]
    assert len(made["docId"]) == 12
    assert say(c, "delete_document", collection_name="p", document_id=made["docId"])[0]["docId"] == made["docId"]
    assert say(c, "delete_document", collection_name="p", document_id="none")[0]["status"] == "error"
    got = say(c, "read_document", collection_name="p", document_id="prod004")
    assert len(got) == 1 and got[0]["name"] == "Coffee" and got[0]["status"] == "success"
    assert say(c, "read_document", collection_name="p", document_id="none")[0]["status"] == "error"
    assert [r.get("_id") for r in say(c, "read_document", collection_name="p")] == ["prod001", "prod004", None]
    assert [r.get("_id") for r in say(c, "read_document", collection_name="p", limit=1)] == ["prod001", None]
    assert say(c, "create_index", collection_name="p", field="price")[0].items() >= ok.items()
    assert say(c, "get_indexes", collection_name="p") == [{"collection": "p", "indexList": "price,"}]
    assert [r.get("_id") for r in say(c, "find_documents", collection_name="p", query={"$orderBy": {"price": "desc"}})] == ["prod001", "prod004", None]
    assert say(c, "find_documents", collection_name="p", query={"$eq": {"name": "x"}})[-1]["status"] == "error"
    assert say(c, "export_collection", collection_name="p", dest_dir=str(tmp_path / "out"))[0].items() >= ok.items()
    with open(tmp_path / "out" / "p.json") as f:
        assert len(json.load(f)) == 2
    assert say(c, "delete_index", collection_name="p", field="price")[0].items() >= ok.items()
    assert say(c, "get_indexes", collection_name="p")[0]["indexList"] == ""
    assert say(c, "delete_collection", collection_name="p")[0].items() >= ok.items()
    for command in ("read_document", "find_documents", "create_document", "create_index", "get_indexes", "export_collection"):
        assert say(c, command, collection_name="p")[0]["status"] == "error"


def test_bad_requests(database):
    c = Commands(database)
    assert c.handle_text("") == ("", []) and c.handle_text(None) == ("", []) and c.handle_text("  ") == ("", [])
    for text in ("{", "[]", "5", '{"request_id": "r"}', '{"command": 1, "request_id": "r"}'):
        assert c.handle_text(text)[1][0]["status"] == "error"
    assert say(c, "update_document")[0]["message"].startswith("Unknown command")


def lines(path, rows):
    path.write_text("\n".join(json.dumps({"seq": s, "topic": t, "payload": p if isinstance(p, str) else json.dumps(p)}) for s, t, p in rows))


def test_replay_of_a_command_log(spark, database, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    topic = bridge.REQUEST_TOPIC
    first = [
        (3, topic, {"command": "read_document", "request_id": "c", "collection_name": "p", "document_id": "d"}),
        (1, topic, {"command": "create_collection", "request_id": "a", "collection_name": "p"}),
        (2, topic, {"command": "create_document", "request_id": "b", "collection_name": "p", "document_id": "d", "content": {"v": 1}}),
        (2, topic, {"command": "create_document", "request_id": "b", "collection_name": "p", "document_id": "d", "content": {"v": 1}}),
        (4, "other/topic", {"command": "delete_collection", "request_id": "x", "collection_name": "p"}),
        (5, topic, ""),
        (6, topic, "{broken"),
    ]
    lines(inbox / "1.json", first)
    out, place = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        q = bridge.start_bridge(database, bridge.request_stream(spark, str(inbox)), out, place, once=True)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    lines(inbox / "2.json", [(7, topic, {"command": "create_document", "request_id": "b", "collection_name": "p", "document_id": "d", "content": {"v": 9}}), (8, topic, {"command": "read_document", "request_id": "d", "collection_name": "p", "document_id": "d"})])
    run()
    every = [(r.request_id, json.loads(r.payload)) for r in bridge.read_responses(spark, out).collect()]
    rows = dict(every)
    assert set(rows) == {"a", "b", "c", "d", ""}
    # every message is answered, one that comes again too
    assert sum(i == "b" for i, _ in every) == 3
    assert rows["c"]["v"] == 1 and rows["d"]["v"] == 9 and rows[""]["status"] == "error"
    # a batch that has run is left alone
    run()
    assert bridge.read_responses(spark, out).count() == len(every)
