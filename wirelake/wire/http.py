"""HTTP/1.x messages of one direction of a connection, and WebSocket frames after an upgrade."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

MOST_BODY = 4096
_METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "CONNECT", "TRACE")
_REQUEST = re.compile(rb"^(" + "|".join(_METHODS).encode() + rb") (\S+) (HTTP/1\.[01])$")
_RESPONSE = re.compile(rb"^(HTTP/1\.[01]) (\d{3})(?: (.*))?$")


@dataclass
class Message:
    first: tuple
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""
    size: int = 0
    complete: bool = True
    at: int = 0  # where it begins, and where the next one would
    end: int = 0


def inflate(body: bytes, encoding: str, most: int = MOST_BODY) -> bytes:
    """A compressed body, no more than ``most`` bytes of it; what isn't compressed stays."""
    kind = encoding.strip().lower()
    if kind not in ("gzip", "x-gzip", "deflate"):
        return body[:most]
    for bits in ((31,) if "gzip" in kind else (15, -15)):
        try:
            return zlib.decompressobj(bits).decompress(body, most)
        except zlib.error:
            continue
    return body[:most]


def _chunks(data: bytes, at: int) -> tuple[bytes, int, bool]:
    out = bytearray()
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            return bytes(out), len(data), False
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return bytes(out), len(data), False
        at = end + 2
        if size == 0:
            stop = data.find(b"\r\n\r\n", at - 2)
            return bytes(out), (stop + 4 if stop >= 0 else len(data)), stop >= 0
        out += data[at : at + size]
        if at + size + 2 > len(data):
            return bytes(out), len(data), False
        at += size + 2


def messages(data: bytes, heads: list[bool] | None = None) -> list[Message]:
    """Messages in order. ``heads``: for responses, whether the k-th answers a HEAD, so has no
    body. Interim responses but 101 are skipped; after a 101 the rest is its body."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        lines = data[at:end].split(b"\r\n")
        request, response = _REQUEST.match(lines[0]), _RESPONSE.match(lines[0])
        if not request and not response:
            break
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, colon, value = line.partition(b":")
            if colon:
                key = name.decode("latin-1").strip().lower()
                text = value.decode("utf-8", "replace").strip()
                headers[key] = f"{headers[key]}, {text}" if key in headers else text
        start, at = at, end + 4
        if request:
            m = Message(("request", request[1].decode(), request[2].decode("utf-8", "replace"), request[3].decode()), headers)
        else:
            code = int(response[2])
            m = Message(("response", code, (response[3] or b"").decode("utf-8", "replace"), response[1].decode()), headers)
            if 100 <= code < 200 and code != 101:
                continue
        m.at, m.end = start, at
        if response and int(response[2]) == 101:
            m.body, at = data[at:], len(data)
            out.append(m)
            break
        answered = sum(x.first[0] == "response" for x in out)
        bare = response and (int(response[2]) in (204, 304) or (heads is not None and answered < len(heads) and heads[answered]))
        if bare:
            pass
        elif "chunked" in headers.get("transfer-encoding", "").lower():
            m.body, at, m.complete = _chunks(data, at)
        elif headers.get("content-length", "").isdigit():
            size = int(headers["content-length"])
            m.body, m.complete = data[at : at + size], at + size <= len(data)
            at += size
        elif response:
            m.body, at = data[at:], len(data)
        m.size, m.end = len(m.body), at
        m.body = inflate(m.body, headers.get("content-encoding", ""))
        out.append(m)
    return out


# Names of WebSocket opcodes.
OPCODES = {0: "continuation", 1: "text", 2: "binary", 8: "close", 9: "ping", 10: "pong"}


def frames(data: bytes, preview: int = 256, most: int = 8 << 20) -> list[dict]:
    """WebSocket frames: opcode, length, the first bytes unmasked, and a close frame's code and
    reason. A frame over ``most`` bytes ends the stream."""
    out, at = [], 0
    while at + 2 <= len(data):
        opcode, length, masked = data[at] & 15, data[at + 1] & 127, data[at + 1] >> 7
        head = at + 2
        if length >= 126:
            width = 2 if length == 126 else 8
            if head + width > len(data):
                break
            length, head = int.from_bytes(data[head : head + width], "big"), head + width
        key = data[head : head + 4] if masked else b""
        head += len(key)
        if length > most or head + length > len(data) or opcode not in OPCODES:
            break
        raw = data[head : head + min(length, preview)]
        if key:
            raw = bytes(b ^ key[i % 4] for i, b in enumerate(raw))
        frame = {"opcode": OPCODES[opcode], "length": length, "preview": raw, "at": at}
        if opcode == 8 and length >= 2:
            frame |= {"code": int.from_bytes(raw[:2], "big"), "reason": raw[2:].decode("utf-8", "replace")}
        out.append(frame)
        at = head + length
    return out
