"""Bytes as text that can be shown."""

from __future__ import annotations

import codecs
import unicodedata

MOST_HEX = 32


def printable(data: bytes, cut: bool = False) -> str | None:
    """The text of UTF-8 without control characters but tab and line ends; None for other bytes.
    ``cut``: the data may end within a character."""
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(data, not cut)
    except UnicodeDecodeError:
        return None
    plain = text.isprintable() or not any(unicodedata.category(c) == "Cc" and c not in "\t\n\r" or c == "\ufffd" for c in text)
    return text if plain else None


def shown(data: bytes, size: int | None = None) -> str:
    """Printable text as it is, other bytes as the first of them in hex, with the number of all where
    there are more. ``size``: that number, where ``data`` was cut."""
    size = len(data) if size is None else size
    text = printable(data, size > len(data))
    if text is not None:
        return text
    return f"\\x{data[:MOST_HEX].hex()}" + (f"… ({size} bytes)" if size > MOST_HEX else "")
