"""The serialisation protocol of Redis and Valkey, versions 2 and 3."""

from __future__ import annotations

from .preview import shown

MOST_DEPTH, MOST_ITEMS, MOST_ARGS = 64, 1 << 20, 64


class Short(Exception):
    """The value isn't complete."""


class Bad(Exception):
    """The bytes are no value."""


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\r\n", at)
    if end < 0:
        raise Short
    return data[at:end], end + 2


def value(data: bytes, at: int = 0, depth: int = 0):
    """((kind, content), next position); kinds are the marks of the protocol, 'inline' for a bare
    command line."""
    if depth > MOST_DEPTH:
        raise Bad
    if at >= len(data):
        raise Short
    kind = chr(data[at])
    if kind not in "+-:$*_#,(!=%~>|":
        if depth:
            raise Bad
        line, at = _line(data, at)
        return ("inline", [("$", w) for w in line.split()]), at
    line, at = _line(data, at + 1)
    if kind in "+-:,(#_":
        return (kind, line), at
    try:
        size = int(line)
    except ValueError:
        raise Bad from None
    if size < 0:
        return (kind, None), at
    if kind in "$!=":
        if at + size + 2 > len(data):
            raise Short
        return (kind, data[at : at + size]), at + size + 2
    if size > MOST_ITEMS:
        raise Bad
    items = []
    for _ in range(size * (2 if kind in "%|" else 1)):
        item, at = value(data, at, depth + 1)
        items.append(item)
    return (kind, items), at


def placed(data: bytes) -> list[tuple[int, tuple]]:
    """(place, value) of all complete values; attributes are dropped from in front of theirs."""
    out, at = [], 0
    while at < len(data):
        try:
            start = at
            item, at = value(data, at)
        except (Short, Bad):
            break
        if item[0] != "|":
            out.append((start, item))
    return out


def values(data: bytes) -> list:
    return [v for _, v in placed(data)]


def command(item) -> tuple[str, list[str]] | None:
    """(name, arguments) of a request, at most MOST_ARGS of them."""
    kind, content = item
    if kind not in ("*", "inline") or not content:
        return None
    words = [shown(c or b"") if not isinstance(c, list) else "" for _, c in content]
    return words[0].upper(), words[1 : MOST_ARGS + 1]


# What kinds of replies are called.
KINDS = {"+": "simple", "-": "error", ":": "integer", "$": "bulk", "*": "array", "_": "null", "#": "boolean", ",": "double", "(": "bignumber", "!": "error", "=": "verbatim", "%": "map", "~": "set", ">": "push"}


def reply(item) -> tuple[str, str, str]:
    """(summary, kind, status) of a response."""
    kind, content = item
    status = "error" if kind in "-!" else "success"
    if content is None or kind == "_":
        return "(nil)", "null", status
    if kind == ":":
        return f"(integer) {content.decode()}", "integer", status
    if kind == "#":
        return {b"t": "true", b"f": "false"}.get(content, content.decode("latin-1")), "boolean", status
    if isinstance(content, list):
        count = len(content) // (2 if kind == "%" else 1)
        return f"({KINDS[kind]}) {count} items", KINDS[kind], status
    if kind == "=":
        content = content[4:]
    return shown(content), KINDS.get(kind, "inline"), status
