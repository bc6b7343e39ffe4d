"""MySQL commands and their results."""

from __future__ import annotations

# Commands by number.
COMMANDS = {1: "QUIT", 2: "INIT_DB", 3: "QUERY", 14: "PING", 22: "STMT_PREPARE", 23: "STMT_EXECUTE", 25: "STMT_CLOSE"}
_SILENT = ("QUIT", "STMT_CLOSE")
_SSL = 0x0800


def packets(data: bytes) -> list[tuple[int, bytes, int]]:
    """(sequence number, content, place) of the complete packets."""
    out, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 3], "little")
        if at + 4 + size > len(data):
            break
        out.append((data[at + 3], data[at + 4 : at + 4 + size], at))
        at += 4 + size
    return out


def _number(raw: bytes, at: int) -> int:
    """A length-encoded integer; 0 where it is cut."""
    if at >= len(raw):
        return 0
    width = {0xFC: 2, 0xFD: 3, 0xFE: 8}.get(raw[at])
    return raw[at] if width is None else int.from_bytes(raw[at + 1 : at + 1 + width], "little")


def requests(data: bytes) -> list[dict]:
    """Commands in order, up to a switch to TLS."""
    out = []
    for number, raw, start in packets(data):
        if number == 1 and not out and len(raw) == 32 and int.from_bytes(raw[:2], "little") & _SSL:
            break  # what follows is encrypted
        if number or not raw or raw[0] not in COMMANDS:
            continue
        name = COMMANDS[raw[0]]
        text = raw[1:].decode("utf-8", "replace") if name in ("QUERY", "STMT_PREPARE", "INIT_DB") else str(int.from_bytes(raw[1:5], "little")) if name.startswith("STMT") else ""
        out.append({"at": start, "command": name, "query": text, "answered": name not in _SILENT})
    return out


def responses(data: bytes, commands: list[str]) -> list[dict]:
    """One result for each answered command: rows of a result set, or a code and message."""
    out, at = [], 0
    flow = [p for p in packets(data)]
    while at < len(flow) and flow[at][0] != 1:
        at += 1  # the greeting
    for name in commands:
        while at < len(flow) and flow[at][0] != 1:
            at += 1
        if at >= len(flow):
            break
        _, raw, start = flow[at]
        at += 1
        mark = raw[0] if raw else 0
        if mark == 0xFF:
            text = raw[3:]
            text = text[6:] if text[:1] == b"#" else text
            out.append({"at": start, "errorCode": int.from_bytes(raw[1:3], "little"), "errorMessage": text.decode("utf-8", "replace"), "rowCount": 0, "status": "error"})
            continue
        rows, ends = 0, 0
        if mark == 0 or name in ("PING", "INIT_DB"):
            out.append({"at": start, "errorCode": 0, "errorMessage": "", "rowCount": _number(raw, 1) if name in ("QUERY", "STMT_EXECUTE") else 0, "status": "success"})
            continue
        columns = _number(raw, 0)
        seen = 0
        while at < len(flow) and flow[at][0] != 1 or (at < len(flow) and ends < 2 and flow[at][0] == 1 and seen > 250):
            raw = flow[at][1]
            at += 1
            if raw[:1] == b"\xfe" and len(raw) < 9:
                ends += 1
                if ends == 2 or seen > columns:
                    break
            else:
                seen += 1
                rows += seen > columns
        out.append({"at": start, "errorCode": 0, "errorMessage": "", "rowCount": rows, "status": "success"})
    return out
