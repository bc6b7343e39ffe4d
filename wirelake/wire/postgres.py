"""PostgreSQL messages: simple and extended queries, rows, errors."""

from __future__ import annotations

from collections import OrderedDict, deque

STATEMENTS = 256
# Names of common type ids.
TYPES = {16: "bool", 17: "bytea", 20: "int8", 21: "int2", 23: "int4", 25: "text", 700: "float4", 701: "float8", 1042: "bpchar", 1043: "varchar", 1082: "date", 1114: "timestamp", 1184: "timestamptz", 1700: "numeric", 2950: "uuid", 114: "json", 3802: "jsonb"}
FIELDS = {"S": "severity", "C": "code", "M": "message", "D": "detail", "H": "hint", "W": "where"}


def records(data: bytes, client: bool) -> list[tuple[str, bytes, int]]:
    """(type, content, place) of the complete messages; a start-up message has type ''."""
    out, at = [], 0
    while at + 4 < len(data):
        if client and not out and data[at] == 0:
            size, kind, head = int.from_bytes(data[at : at + 4], "big"), "", at + 4
        else:
            size, kind, head = int.from_bytes(data[at + 1 : at + 5], "big"), chr(data[at]), at + 5
        end = head + size - 4
        if size < 4 or end > len(data):
            break
        out.append((kind, data[head:end], at))
        at = end
    return out


def _text(raw: bytes, at: int = 0) -> tuple[str, int]:
    end = raw.find(b"\0", at)
    end = len(raw) if end < 0 else end
    return raw[at:end].decode("utf-8", "replace"), end + 1


def requests(data: bytes) -> list[dict]:
    """Queries in order: text, statement, portal and parameters."""
    out, statements, portals = [], OrderedDict(), {}
    for kind, raw, start in records(data, True):
        if kind == "Q":
            out.append({"at": start, "query": _text(raw)[0], "statementName": "", "portal": "", "params": []})
        elif kind == "P":
            name, at = _text(raw)
            statements[name] = _text(raw, at)[0]
            statements.move_to_end(name)
            if len(statements) > STATEMENTS:
                statements.popitem(last=False)
        elif kind == "B":
            portal, at = _text(raw)
            name, at = _text(raw, at)
            word = lambda k: int.from_bytes(raw[k : k + 2], "big")
            formats = [word(at + 2 + 2 * k) for k in range(word(at))]
            at += 2 + 2 * len(formats)
            count, params = word(at), []
            at += 2
            for k in range(count):
                size = int.from_bytes(raw[at : at + 4], "big", signed=True)
                at += 4
                if size < 0:
                    params.append("NULL")
                    continue
                form = formats[k] if k < len(formats) > 1 else formats[0] if formats else 0
                piece = raw[at : at + size]
                params.append("\\x" + piece.hex() if form else piece.decode("utf-8", "replace"))
                at += size
            portals[portal] = (name, params)
        elif kind == "E":
            portal = _text(raw)[0]
            name, params = portals.get(portal, ("", []))
            out.append({"at": start, "query": statements.get(name, ""), "statementName": name, "portal": portal, "params": params})
    return out


def responses(data: bytes) -> list[dict]:
    """Completions and errors in order, each with the rows and columns before it."""
    out, rows, columns, status = [], 0, [], deque()
    for kind, raw, start in records(data, False):
        if kind == "T":
            columns, at = [], 2
            for _ in range(int.from_bytes(raw[:2], "big")):
                name, at = _text(raw, at)
                oid = int.from_bytes(raw[at + 6 : at + 10], "big")
                columns.append({"name": name, "typeOid": oid, "type": TYPES.get(oid, f"oid{oid}")})
                at += 18
        elif kind == "D":
            rows += 1
        elif kind in "CI":
            tag = _text(raw)[0] if kind == "C" else ""
            out.append({"at": start, "summary": f"{tag} ({rows} rows)" if rows else tag, "tag": tag, "rowCount": rows or (int(tag.split()[-1]) if tag and tag.split()[-1].isdigit() else 0), "columns": columns, "status": "success"})
            status.append(out[-1])
            rows, columns = 0, []
        elif kind == "E":
            error, at = {}, 0
            while at < len(raw) and raw[at]:
                value, nxt = _text(raw, at + 1)
                if (name := FIELDS.get(chr(raw[at]))) is not None:
                    error[name] = value
                at = nxt
            out.append({"at": start, "summary": f"{error.get('message', '')} ({error.get('code', '')})", "error": error, "rowCount": 0, "columns": [], "status": "error"})
            status.append(out[-1])
            rows, columns = 0, []
        elif kind == "Z":
            while status:
                status.popleft()["txStatus"] = chr(raw[0])
    return out
