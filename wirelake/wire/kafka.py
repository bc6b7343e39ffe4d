"""Kafka request and response headers."""

from __future__ import annotations

# Api keys by name, and the first version of each with flexible headers.
KEYS = {0: "Produce", 1: "Fetch", 2: "ListOffsets", 3: "Metadata", 8: "OffsetCommit", 9: "OffsetFetch", 10: "FindCoordinator", 11: "JoinGroup", 12: "Heartbeat", 13: "LeaveGroup", 14: "SyncGroup", 17: "SaslHandshake", 18: "ApiVersions", 19: "CreateTopics", 20: "DeleteTopics", 22: "InitProducerId"}
FLEXIBLE = {0: 9, 1: 12, 2: 6, 3: 9, 8: 8, 9: 6, 10: 3, 11: 6, 12: 4, 13: 4, 14: 4, 18: 3, 19: 5, 20: 4, 22: 2}


def _framed(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big", signed=True)
        if size < 4 or at + 4 + size > len(data):
            break
        out.append((at, data[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def _string(raw: bytes, at: int) -> tuple[str, int]:
    size = int.from_bytes(raw[at : at + 2], "big", signed=True)
    if size < 0:
        return "", at + 2
    return raw[at + 2 : at + 2 + size].decode("utf-8", "replace"), at + 2 + size


def requests(data: bytes) -> list[dict]:
    """Requests in order: key, version, correlation id, client, first topic of older layouts."""
    out = []
    for start, raw in _framed(data):
        key, version = (int.from_bytes(raw[k : k + 2], "big", signed=True) for k in (0, 2))
        client, at = _string(raw, 8) if len(raw) > 9 else ("", len(raw))
        topic = ""
        if version < FLEXIBLE.get(key, 1 << 15):
            if key == 0:
                if version >= 3:
                    _, at = _string(raw, at)
                topic = _string(raw, at + 10)[0] if int.from_bytes(raw[at + 6 : at + 10], "big", signed=True) > 0 else ""
            elif key == 3 and int.from_bytes(raw[at : at + 4], "big", signed=True) > 0:
                topic = _string(raw, at + 4)[0]
            elif key == 1:
                at += 12 + (4 if version >= 3 else 0) + (1 if version >= 4 else 0) + (8 if version >= 7 else 0)
                topic = _string(raw, at + 4)[0] if int.from_bytes(raw[at : at + 4], "big", signed=True) > 0 else ""
        name = KEYS.get(key, f"Api{key}")
        out.append({"at": start, "apiKey": name, "apiVersion": version, "correlationId": int.from_bytes(raw[4:8], "big", signed=True), "clientId": client, "topic": topic, "summary": f"{name.upper()}{f' topic={topic}' if topic else ''} (v{version})"})
    return out


def responses(data: bytes, asked: dict[int, tuple[str, int]]) -> list[dict]:
    """Responses in order with the first error code, where the request's layout is known."""
    out = []
    for start, raw in _framed(data):
        number = int.from_bytes(raw[:4], "big", signed=True)
        name, version = asked.get(number, ("", 0))
        code = 0
        if name == "Produce" and version < 9 and len(raw) > 12:
            topic, at = _string(raw, 8)
            code = int.from_bytes(raw[at + 8 : at + 10], "big", signed=True)
        elif name in ("Heartbeat", "LeaveGroup", "SyncGroup", "JoinGroup") and version < FLEXIBLE[{v: k for k, v in KEYS.items()}[name]]:
            at = 4 + (4 if version >= 1 else 0)
            code = int.from_bytes(raw[at : at + 2], "big", signed=True)
        elif name == "ApiVersions":
            code = int.from_bytes(raw[4:6], "big", signed=True)
        out.append({"at": start, "correlationId": number, "apiKey": name, "errorCode": code, "status": "error" if code else "success"})
    return out
