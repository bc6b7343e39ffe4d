"""AMQP 0-9-1: the methods that say something about traffic, with their contents."""

from __future__ import annotations

# Classes, and the methods that are shown, by class and number.
CLASSES = {10: "Connection", 20: "Channel", 40: "Exchange", 50: "Queue", 60: "Basic"}
METHODS = {(10, 50): "Close", (20, 10): "Open", (20, 40): "Close", (40, 10): "Declare", (40, 20): "Delete", (50, 10): "Declare", (50, 20): "Bind", (50, 40): "Delete",
           (60, 20): "Consume", (60, 40): "Publish", (60, 50): "Return", (60, 60): "Deliver", (60, 71): "GetOk", (60, 80): "Ack", (60, 120): "Nack"}
_CONTENT = ("Publish", "Return", "Deliver", "GetOk")
# Properties of a content header in order of their bits, with how each is written.
_PROPERTIES = (("contentType", "s"), ("contentEncoding", "s"), ("headers", "t"), ("deliveryMode", "b"), ("priority", "b"), ("correlationId", "s"), ("replyTo", "s"), ("expiration", "s"), ("messageId", "s"))
MOST_BODY = 4096


def frames(data: bytes):
    """(type, channel, content, place) of the complete frames."""
    at = 8 if data.startswith(b"AMQP") else 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 3 : at + 7], "big")
        end = at + 7 + size
        if end >= len(data) or data[end] != 0xCE:
            return
        yield data[at], int.from_bytes(data[at + 1 : at + 3], "big"), data[at + 7 : end], at
        at = end + 1


class _Reader:
    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at

    def number(self, size: int) -> int:
        self.at += size
        return int.from_bytes(self.raw[self.at - size : self.at], "big")

    def text(self, width: int = 1) -> str:
        size = self.number(width)
        self.at += size
        return self.raw[self.at - size : self.at].decode("utf-8", "replace")


def methods(data: bytes) -> list[dict]:
    """The shown methods of one direction in order, contents assembled per channel."""
    out, open_ = [], {}
    for kind, channel, raw, start in frames(data):
        if kind == 1 and len(raw) >= 4:
            group, number = int.from_bytes(raw[:2], "big"), int.from_bytes(raw[2:4], "big")
            name = METHODS.get((group, number))
            if name is None:
                continue
            r, m = _Reader(raw, 4), {"class": CLASSES[group], "method": name, "channel": channel, "status": "success", "body": b"", "at": start}
            if name == "Publish":
                r.number(2)
                m |= {"exchange": r.text(), "routingKey": r.text()}
            elif name == "Return":
                m |= {"replyCode": r.number(2), "replyText": r.text(), "exchange": r.text(), "routingKey": r.text(), "status": "error"}
            elif name == "Deliver":
                m |= {"consumer": r.text(), "deliveryTag": r.number(8), "redelivered": bool(r.number(1)), "exchange": r.text(), "routingKey": r.text()}
            elif name == "GetOk":
                m |= {"deliveryTag": r.number(8), "redelivered": bool(r.number(1)), "exchange": r.text(), "routingKey": r.text()}
            elif name in ("Ack", "Nack"):
                m |= {"deliveryTag": r.number(8), "status": "warning" if name == "Nack" else "success"}
            elif name == "Close":
                code = r.number(2)
                m |= {"replyCode": code, "replyText": r.text(), "status": "error" if code >= 300 else "success"}
            elif group == 40:
                r.number(2)
                m |= {"exchange": r.text()}
            elif group == 50:
                r.number(2)
                m |= {"queue": r.text()}
                if name == "Bind":
                    m |= {"exchange": r.text(), "routingKey": r.text()}
            elif name == "Consume":
                r.number(2)
                m |= {"queue": r.text()}
            out.append(m)
            if name in _CONTENT:
                open_[channel] = [m, None]
        elif kind == 2 and channel in open_ and len(raw) >= 14:
            r = _Reader(raw, 4)
            open_[channel][1] = r.number(8)
            bits = r.number(2)
            for k, (name, how) in enumerate(_PROPERTIES):
                if bits >> (15 - k) & 1:
                    if how == "s":
                        open_[channel][0][name] = r.text()
                    elif how == "b":
                        open_[channel][0][name] = r.number(1)
                    else:
                        r.at += r.number(4)
            open_[channel][0]["size"] = open_[channel][1]
        elif kind == 3 and channel in open_ and open_[channel][1] is not None:
            m, left = open_[channel]
            m["body"] = (m["body"] + raw)[:MOST_BODY]
            open_[channel][1] = left - len(raw)
            if open_[channel][1] <= 0:
                del open_[channel]
    return out
