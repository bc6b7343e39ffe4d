"""MongoDB messages with a bounded reader of their documents."""

from __future__ import annotations

import struct

MOST_FIELDS = 256
_SIZES = {0x01: 8, 0x07: 12, 0x08: 1, 0x09: 8, 0x0A: 0, 0x10: 4, 0x11: 8, 0x12: 8, 0x13: 16, 0x06: 0, 0xFF: 0, 0x7F: 0}


def fields(raw: bytes) -> dict:
    """The first scalar members of a document; nested ones are passed over."""
    out, at, end = {}, 4, min(int.from_bytes(raw[:4], "little"), len(raw))
    while at < end - 1 and len(out) < MOST_FIELDS:
        kind, stop = raw[at], raw.find(b"\0", at + 1)
        if not kind or stop < 0:
            break
        name, at = raw[at + 1 : stop].decode("utf-8", "replace"), stop + 1
        if kind in (0x02, 0x0D, 0x0E):
            size = int.from_bytes(raw[at : at + 4], "little")
            out[name], at = raw[at + 4 : at + 3 + size].decode("utf-8", "replace"), at + 4 + size
        elif kind in (0x03, 0x04):
            out[name], at = None, at + max(int.from_bytes(raw[at : at + 4], "little"), 5)
        elif kind == 0x05:
            out[name], at = None, at + 5 + int.from_bytes(raw[at : at + 4], "little")
        elif kind in _SIZES:
            piece = raw[at : at + _SIZES[kind]]
            if len(piece) < _SIZES[kind]:
                break
            out[name] = struct.unpack("<d", piece)[0] if kind == 0x01 else bool(piece[0]) if kind == 0x08 else int.from_bytes(piece, "little", signed=True) if kind in (0x10, 0x12) else None
            at += _SIZES[kind]
        else:
            break
    return out


def messages(data: bytes) -> list[dict]:
    """Messages in order: number, the number they answer, and the leading document's members."""
    out, at = [], 0
    while at + 16 <= len(data):
        size, number, answers, kind = struct.unpack("<iiii", data[at : at + 16])
        if size < 16 or at + size > len(data):
            break
        raw, body = data[at + 16 : at + size], None
        if kind == 2013 and len(raw) > 5 and raw[4] == 0:
            body = fields(raw[5:])
        elif kind == 2004:
            stop = raw.find(b"\0", 4)
            body = fields(raw[stop + 9 :]) if stop >= 0 else {}
            body.setdefault("$db", raw[4:stop].decode("utf-8", "replace").split(".")[0])
        elif kind == 1:
            body = fields(raw[20:])
        if body is not None:
            name = next(iter(body), "")
            ok = body.get("ok", 1) in (1, 1.0, True) and "$err" not in body
            out.append({"at": at, "number": number, "answers": answers, "command": name, "collection": body[name] if isinstance(body.get(name), str) else "", "database": body.get("$db") or "", "ok": ok, "errmsg": body.get("errmsg") or body.get("$err") or "", "status": "success" if ok else "error"})
        at += size
    return out
