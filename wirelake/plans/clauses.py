"""Help for writing filters: clauses from what a user points at, and what may come next."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .fields import catalogue, find

_PLAIN = re.compile(r"[^ \t\n()=!<>\"',]+")
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|0[xX][0-9a-fA-F]+|[+-]?Infinity"
_KEYWORDS = ("and", "or", "not", "contains", "matches", "startswith", "in")


def literal(value: str) -> str:
    """A value as a filter spells it: bare if that is safe, else quoted."""
    if _PLAIN.fullmatch(value) and value.lower() not in _KEYWORDS:
        return value
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def endpoint(side: str, workload: str = "", name: str = "", namespace: str = "", ip: str = "") -> str:
    """The condition for one end, by the best name it has."""
    what, value = next(((k, v) for k, v in (("workload", workload), ("name", name), ("ip", ip)) if v), ("ip", ""))
    clause = f"{side}.{what} == {literal(value)}"
    return f"{clause} and {side}.namespace == {literal(namespace)}" if namespace and what != "ip" else clause


def conversation(src: dict, dst: dict) -> str:
    """The condition for both ends, in either direction."""
    one = lambda a, b: f"({endpoint('src', **a)} and {endpoint('dst', **b)})"
    return f"{one(src, dst)} or {one(dst, src)}"


def group(by: str, key: str) -> str:
    """The condition for a row of a summary."""
    if by == "namespace":
        return f"namespace == {literal(key)}"
    if by == "workload":
        space, slash, name = key.rpartition("/")
        ends = [endpoint(s, workload=name, namespace=space) if slash else f"{s}.workload == {literal(key)} or {s}.name == {literal(key)} or {s}.ip == {literal(key)}" for s in ("src", "dst")]
        return " or ".join(f"({e})" for e in ends)
    return f"{by} == {literal(key)}"


def expects(source: str) -> tuple[str, list[str]]:
    """What the text of an unfinished filter wants next, with proposals: ('field', names),
    ('operator', …), ('value', []) or ('boolean', …)."""
    words = re.findall(r"\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?|==|!=|>=|<=|[<>(),]|[^ \t\n()=!<>\"',]+", source)
    open_word = bool(source) and source[-1] not in " \t\n" and bool(words)
    part = words.pop() if open_word and words[-1] not in "(),<>" and words[-1] not in ("==", "!=", ">=", "<=") else ""
    before = words[-1] if words else ""
    if before in ("==", "!=", ">=", "<=", "<", ">") or before.lower() in ("contains", "matches", "startswith", "in"):
        return "value", []
    if not before or before == "(" or before.lower() in ("and", "or", "not"):
        return "field", [n for n in catalogue() if n.lower().startswith(part.lower())]
    field = find(before)
    if field is not None and (len(words) < 2 or words[-2] not in ("==", "!=", ">=", "<=", "<", ">")):
        from .fields import OPERATORS

        return "operator", [o for o in OPERATORS[field.kind] if o.startswith(part.lower())]
    return "boolean", [w for w in ("and", "or") if w.startswith(part.lower())]


@dataclass(frozen=True)
class Caret:
    """Where a caret is in an unfinished filter. ``expects``: field, operator, value or boolean; ``prefix``: what
    is typed of it up to the caret, quotes and escapes removed; ``quoted``: inside a quote; ``field``: the one
    that an operator or a value belongs to; ``start``, ``end``: what a proposal would replace."""

    expects: str
    prefix: str
    quoted: bool
    field: str | None
    start: int
    end: int


_LEXEME = re.compile(r"""(?P<open>\()|(?P<close>\))|(?P<quote>"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z))|(?P<sign>==|!=|>=|<=|[<>=!])|(?P<word>[^ \t\n()=!<>"']+)""", re.S)


def context_at(source: str, caret: int) -> Caret:
    """What is expected where the caret is. Nothing is an error: quotes may be open, operators half typed.

    A lexeme is current while the caret is past its start and not past its end. The ones before it, back to
    the last connective or opening parenthesis, are the clause so far: nothing wants a field; one word, which
    is over, an operator; a word and an operator a value; anything else a connective.
    """
    found = []
    for m in _LEXEME.finditer(source):
        kind, low = m.lastgroup, m[0].lower()
        if kind == "word":
            kind = "link" if low in ("and", "or", "not") else "sign" if low in ("contains", "matches", "startswith", "in") else "number" if re.fullmatch(_NUMBER, m[0]) else "word"
        found.append((kind, m[0], m.start(), m.end()))
    current = next((f for f in found if f[2] < caret <= f[3]), None)
    before = [f for f in found if (f[3] <= caret if current is None else f[3] <= current[2])]
    begin = max((i + 1 for i, f in enumerate(before) if f[0] in ("link", "open")), default=0)
    kinds = [f[0] for f in before[begin:]]
    field = before[begin][1] if kinds in (["word"], ["word", "sign"]) else None
    expects = {(): "field", ("word",): "operator", ("word", "sign"): "value"}.get(tuple(kinds), "boolean")
    if current is None:
        return Caret(expects, "", False, field, caret, caret)
    kind, text, start, end = current
    typed = source[start:caret]
    if kind != "quote":
        return Caret(expects, typed, False, field, start, end)
    closed = re.fullmatch(r"(.)(?:\\.|(?!\1)[^\\])*\1", text, re.S) is not None
    inner = typed[1:-1] if closed and caret == end else typed[1:]
    return Caret(expects, re.sub(r"\\(.?)", r"\1", inner, flags=re.S), not (closed and caret == end), field, start, end)
