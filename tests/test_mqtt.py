import json
import socket
import struct
import threading

import pytest

from docquarry.sources.files import Files
from docquarry.sources.store import Database
from docquarry.status import QuarryError
from docquarry.streaming import bridge, mqtt


class Broker(threading.Thread):
    """Takes one client: acknowledges all, delivers requests once subscribed, keeps what is published."""

    def __init__(self, requests, refuse=False):
        super().__init__(daemon=True)
        self.requests, self.refuse, self.published, self.acknowledged, self.connect = requests, refuse, [], [], b""
        self.server = socket.create_server(("127.0.0.1", 0))
        self.port = self.server.getsockname()[1]
        self.start()

    def run(self):
        sock, _ = self.server.accept()
        try:
            while True:
                kind, flags, body = mqtt.read_packet(sock)
                if kind == mqtt.CONNECT:
                    self.connect = body
                    sock.sendall(mqtt.packet(mqtt.CONNACK, 0, bytes([0, 5 if self.refuse else 0])))
                elif kind == mqtt.SUBSCRIBE:
                    sock.sendall(mqtt.packet(mqtt.SUBACK, 0, body[:2] + b"\1"))
                    for k, r in enumerate(self.requests):
                        sock.sendall(mqtt.packet(mqtt.PUBLISH, 2, mqtt._string(bridge.REQUEST_TOPIC) + struct.pack(">H", k + 1) + r.encode()))
                elif kind == mqtt.PUBLISH:
                    topic, payload, identifier = mqtt.Client._publication(flags, body)
                    self.published.append((topic, payload))
                    sock.sendall(mqtt.packet(mqtt.PUBACK, 0, struct.pack(">H", identifier)))
                elif kind == mqtt.PUBACK:
                    self.acknowledged.append(struct.unpack(">H", body)[0])
                elif kind == mqtt.PINGREQ:
                    sock.sendall(mqtt.packet(mqtt.PINGRESP, 0, b""))
                elif kind == mqtt.DISCONNECT:
                    return
        except (QuarryError, OSError):
            return


def test_requests_travel_to_the_database_and_back(spark, tmp_path):
    requests = [
        {"command": "create_collection", "request_id": "a", "collection_name": "p"},
        {"command": "create_document", "request_id": "b", "collection_name": "p", "document_id": "d", "content": {"text": "é" * 300}},
        {"command": "read_document", "request_id": "c", "collection_name": "p"},
    ]
    broker = Broker([json.dumps(r) for r in requests])
    client = mqtt.Client("127.0.0.1", broker.port, "quarry", "user", "word")
    assert b"MQTT" in broker.connect and broker.connect.endswith(b"\0\6quarry\0\4user\0\4word")
    mqtt.subscribe_requests(client)
    inbox = str(tmp_path / "in")
    files = Files(spark)
    files.make(inbox)
    assert mqtt.receive(client, files, inbox, 2.0) == 3
    db = Database(spark, str(tmp_path / "db"))
    q = bridge.start_bridge(db, bridge.request_stream(spark, inbox), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    rows = bridge.read_responses(spark, str(tmp_path / "out")).orderBy("request_id", "msg_seq").collect()
    assert mqtt.publish_responses(client, rows) == 4
    client.close()
    broker.join(5)
    assert broker.acknowledged == [1, 2, 3]
    assert [t for t, _ in broker.published] == [f"{bridge.RESPONSE_TOPIC}/{r}" for r in "abcc"]
    assert json.loads(broker.published[2][1])["text"] == "é" * 300


def test_refusals():
    with pytest.raises(QuarryError):
        mqtt.Client("127.0.0.1", Broker([], refuse=True).port)
    with pytest.raises(QuarryError):
        mqtt.Client("127.0.0.1", 9)
    for size in (0, 127, 128, 16_384, 70_000):
        a, b = socket.socketpair()
        threading.Thread(target=a.sendall, args=(mqtt.packet(3, 2, b"x" * size),), daemon=True).start()
        assert mqtt.read_packet(b) == (3, 2, b"x" * size)


def test_publishing_is_tried_again(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from docquarry.streaming import mqtt

    monkeypatch.setattr(mqtt, "PUBLISH_WAIT", 0)
    sent, fails = [], [2]

    class Flaky:
        def publish(self, topic, payload):
            if fails[0]:
                fails[0] -= 1
                raise OSError("gone")
            sent.append((topic, payload))

    rows = [SimpleNamespace(request_id="a", payload="1"), SimpleNamespace(request_id="", payload="2")]
    assert mqtt.publish_responses(Flaky(), rows, "t") == 2 and sent == [("t/a", "1"), ("t", "2")]
    fails[0] = 3
    with pytest.raises(OSError):
        mqtt.publish_responses(Flaky(), rows, "t")
