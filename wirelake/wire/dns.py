"""DNS messages."""

from __future__ import annotations

import ipaddress

# Record types, classes and response codes.
TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 64: "SVCB", 65: "HTTPS", 255: "ANY"}
CLASSES = {1: "IN", 3: "CH", 4: "HS", 255: "ANY"}
CODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET", 8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE"}


def _name(data: bytes, at: int) -> tuple[str, int]:
    labels, end, hops = [], None, 0
    while True:
        size = data[at]
        if size & 0xC0 == 0xC0:
            end = end or at + 2
            at = (size & 0x3F) << 8 | data[at + 1]
            hops += 1
            if hops > 64:
                raise ValueError("a loop of pointers")
            continue
        at += 1
        if not size:
            return ".".join(labels), end or at
        labels.append(data[at : at + size].decode("utf-8", "replace"))
        at += size


def _data(data: bytes, kind: int, at: int, size: int) -> str:
    raw = data[at : at + size]
    if kind in (1, 28) and size in (4, 16):
        return str(ipaddress.ip_address(raw))
    if kind in (2, 5, 12):
        return _name(data, at)[0]
    if kind == 15:
        return f"{int.from_bytes(raw[:2], 'big')} {_name(data, at + 2)[0]}"
    if kind == 33:
        weights = [int.from_bytes(raw[k : k + 2], "big") for k in (0, 2, 4)]
        return f"{weights[0]} {weights[1]} {weights[2]} {_name(data, at + 6)[0]}"
    if kind == 16:
        texts, k = [], 0
        while k < size:
            texts.append(raw[k + 1 : k + 1 + raw[k]].decode("utf-8", "replace"))
            k += 1 + raw[k]
        return " ".join(texts)
    return raw.hex()


def parse(data: bytes) -> dict | None:
    """One message as a record, None if it is none."""
    try:
        word = lambda k: int.from_bytes(data[k : k + 2], "big")
        if len(data) < 12:
            return None
        flags, at, questions, sections = word(2), 12, [], []
        for _ in range(word(4)):
            name, at = _name(data, at)
            questions.append({"name": name, "type": TYPES.get(word(at), f"TYPE{word(at)}"), "class": CLASSES.get(word(at + 2), f"CLASS{word(at + 2)}")})
            at += 4
        for k in (6, 8, 10):
            records = []
            for _ in range(word(k)):
                name, at = _name(data, at)
                kind, ttl, size = word(at), int.from_bytes(data[at + 4 : at + 8], "big"), word(at + 8)
                records.append({"name": name, "type": TYPES.get(kind, f"TYPE{kind}"), "ttl": ttl, "data": _data(data, kind, at + 10, size)})
                at += 10 + size
            sections.append(records)
        addresses = [a["data"] for a in sections[0] if a["type"] in ("A", "AAAA")]
        code = CODES.get(flags & 15, f"RCODE{flags & 15}")
        return {
            "id": word(0), "response": bool(flags >> 15), "authoritative": bool(flags >> 10 & 1), "recursionAvailable": bool(flags >> 7 & 1), "rcode": code,
            "questions": questions, "answers": sections[0], "authority": sections[1], "additional": sections[2],
            "question": questions[0]["name"] if questions else "", "answer": addresses[0] if addresses else "", "status": "success" if code == "NOERROR" else "error",
        }
    except (IndexError, ValueError):
        return None
