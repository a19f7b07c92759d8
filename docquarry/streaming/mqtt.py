"""Requests and responses over an MQTT 3.1.1 broker, with delivery at least once.

``receive`` spools requests into the folder that the stream reads: a request is acknowledged to the
broker only after its file is in place, so it is either redelivered or kept.
``publish_responses`` sends each response to its request's topic and waits for the broker's
acknowledgement.  Only the standard library is needed.
"""

from __future__ import annotations

import json
import socket
import ssl
import struct
import time
import uuid
from collections.abc import Iterable

from docquarry.sources.files import Files
from docquarry.status import Code, QuarryError
from docquarry.streaming.bridge import REQUEST_TOPIC, RESPONSE_TOPIC

CONNECT, CONNACK, PUBLISH, PUBACK, SUBSCRIBE, SUBACK, PINGREQ, PINGRESP, DISCONNECT = 1, 2, 3, 4, 8, 9, 12, 13, 14


def _string(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">H", len(raw)) + raw


def packet(kind: int, flags: int, body: bytes) -> bytes:
    """A control packet: type and flags, the body's length in groups of seven bits, the body."""
    size, length = len(body), bytearray()
    while True:
        size, low = divmod(size, 128)
        length.append(low | (128 if size else 0))
        if not size:
            return bytes([kind << 4 | flags]) + bytes(length) + body


def read_packet(sock: socket.socket) -> tuple[int, int, bytes]:
    """(type, flags, body) of the next packet."""

    def exactly(n: int) -> bytes:
        parts = bytearray()
        while len(parts) < n:
            got = sock.recv(n - len(parts))
            if not got:
                raise QuarryError(Code.IO_ERROR, "the broker closed the connection")
            parts += got
        return bytes(parts)

    head = exactly(1)[0]
    size = shift = 0
    while True:
        byte = exactly(1)[0]
        size |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return head >> 4, head & 15, exactly(size)
        if shift > 21:
            raise QuarryError(Code.CORRUPTION, "a packet's length is malformed")


class Client:
    """A blocking connection to a broker."""

    def __init__(self, host: str, port: int = 1883, client_id: str = "", user: str | None = None, password: str | None = None, tls: ssl.SSLContext | None = None, keep_alive: int = 60, timeout: float = 30.0):
        try:
            sock = socket.create_connection((host, port), timeout)
            self.sock = tls.wrap_socket(sock, server_hostname=host) if tls else sock
        except OSError as e:
            raise QuarryError(Code.IO_ERROR, f"no broker at {host}:{port}: {e}") from e
        self.keep_alive, self.timeout, self.next_id = keep_alive, timeout, 0
        self.waiting: list[tuple[str, str, int]] = []  # publications that came while another packet was awaited
        # the session stays on the broker only if it has a name
        flags = (0 if client_id else 2) | (128 if user is not None else 0) | (64 if password is not None else 0)
        body = _string("MQTT") + bytes([4, flags]) + struct.pack(">H", keep_alive) + _string(client_id)
        body += b"".join(_string(x) for x in (user, password) if x is not None)
        self.sock.sendall(packet(CONNECT, 0, body))
        kind, _, answer = read_packet(self.sock)
        if kind != CONNACK or answer[1]:
            raise QuarryError(Code.IO_ERROR, f"the broker refused the connection ({answer[1] if len(answer) > 1 else kind})")

    def _identifier(self) -> int:
        self.next_id = self.next_id % 65535 + 1
        return self.next_id

    def _await(self, wanted: int, identifier: int) -> bytes:
        while True:
            kind, flags, body = read_packet(self.sock)
            if kind == PUBLISH:
                self.waiting.append(self._publication(flags, body))
            elif kind == wanted and struct.unpack_from(">H", body)[0] == identifier:
                return body

    @staticmethod
    def _publication(flags: int, body: bytes) -> tuple[str, str, int]:
        size, = struct.unpack_from(">H", body)
        topic, at, identifier = body[2 : 2 + size].decode(), 2 + size, 0
        if flags >> 1 & 3:
            identifier, = struct.unpack_from(">H", body, at)
            at += 2
        return topic, body[at:].decode("utf-8", "replace"), identifier

    def subscribe(self, topic: str) -> None:
        identifier = self._identifier()
        self.sock.sendall(packet(SUBSCRIBE, 2, struct.pack(">H", identifier) + _string(topic) + b"\1"))
        if self._await(SUBACK, identifier)[2] > 2:
            raise QuarryError(Code.IO_ERROR, f"the broker refused the subscription to {topic}")

    def publish(self, topic: str, payload: str) -> None:
        """Returns once the broker has the message."""
        identifier = self._identifier()
        self.sock.sendall(packet(PUBLISH, 2, _string(topic) + struct.pack(">H", identifier) + payload.encode()))
        self._await(PUBACK, identifier)

    def poll(self, seconds: float) -> tuple[str, str, int] | None:
        """The next publication (topic, payload, identifier), or None after so many seconds."""
        if self.waiting:
            return self.waiting.pop(0)
        until = time.monotonic() + seconds
        try:
            while (left := until - time.monotonic()) > 0:
                self.sock.settimeout(min(left, self.keep_alive / 2))
                try:
                    first = self.sock.recv(1, socket.MSG_PEEK) if not isinstance(self.sock, ssl.SSLSocket) else b"?"
                    if not first:
                        raise QuarryError(Code.IO_ERROR, "the broker closed the connection")
                    if first != b"?":
                        self.sock.settimeout(self.timeout)
                    kind, flags, body = read_packet(self.sock)
                except TimeoutError:
                    self.sock.sendall(packet(PINGREQ, 0, b""))
                    continue
                if kind == PUBLISH:
                    return self._publication(flags, body)
        finally:
            self.sock.settimeout(self.timeout)
        return None

    def acknowledge(self, identifier: int) -> None:
        if identifier:
            self.sock.sendall(packet(PUBACK, 0, struct.pack(">H", identifier)))

    def close(self) -> None:
        try:
            self.sock.sendall(packet(DISCONNECT, 0, b""))
        finally:
            self.sock.close()


def receive(client: Client, files: Files, inbox: str, seconds: float, most: int = 1000) -> int:
    """Spools requests that come within some seconds into the inbox and returns their number.
    One file holds up to ``most`` of them; ``seq`` is the time of arrival in microseconds, made
    unique."""
    until, total, last = time.monotonic() + seconds, 0, 0
    while (left := until - time.monotonic()) > 0:
        lines, identifiers = [], []
        while len(lines) < most and (got := client.poll(left if not lines else 0.05)):
            topic, payload, identifier = got
            last = max(last + 1, time.time_ns() // 1000)
            lines.append(json.dumps({"seq": last, "topic": topic, "payload": payload}))
            identifiers.append(identifier)
            left = max(0.0, until - time.monotonic())
        if lines:
            # hidden until complete: the stream skips names that begin with a dot
            name = f"{last}-{uuid.uuid4().hex[:8]}.json"
            files.write(f"{inbox}/.{name}", "\n".join(lines))
            files.rename(f"{inbox}/.{name}", f"{inbox}/{name}")
            for identifier in identifiers:
                client.acknowledge(identifier)
            total += len(lines)
    return total


#: How often a response is published before its failure is raised, and seconds between.
PUBLISH_TRIES, PUBLISH_WAIT = 3, 0.2


def publish_responses(client: Client, responses: Iterable, topic: str = RESPONSE_TOPIC) -> int:
    """Publishes rows (request_id, msg_seq, payload) in the order they come; one that fails is
    tried again."""
    n = 0
    for r in responses:
        for left in reversed(range(PUBLISH_TRIES)):
            try:
                client.publish(f"{topic}/{r.request_id}" if r.request_id else topic, r.payload)
                break
            except OSError:
                if not left:
                    raise
                time.sleep(PUBLISH_WAIT)
        n += 1
    return n


def subscribe_requests(client: Client, topic: str = REQUEST_TOPIC) -> None:
    client.subscribe(topic)
