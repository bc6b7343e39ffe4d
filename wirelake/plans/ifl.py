"""The filter language: text to tokens, tokens to a tree, tree to a Spark condition.

The compiled condition is built of built-in expressions only (a network prefix of IPv6 is the one
exception), and conditions on bare columns stay bare, so Catalyst can push them to the scan.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields

# Bounds of a filter.
MOST_BYTES, MOST_DEPTH, MOST_LIST, MOST_PATTERN = 4096, 64, 64, 256
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TOKEN = re.compile(r"""(?P<space>[ \t\n]+)|(?P<punct>[(),])|(?P<op>==|!=|>=|<=|<|>)|(?P<quote>["'])|(?P<word>[^ \t\n()=!<>"',]+)|(?P<bad>.)""", re.S)


class FilterError(ValueError):
    """The text is not a filter."""


@dataclass(frozen=True)
class Word:
    """A bare token: the entry's salient text contains it."""

    text: str


@dataclass(frozen=True)
class Test:
    """A comparison of a field; ``values`` has one value unless ``op`` is ``in``."""

    field: fields.Field
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Many:
    """``and`` or ``or`` of two or more parts."""

    how: str
    parts: tuple


def parse_float(word: str) -> float | None:
    """A number as the language writes them (no blanks, no suffixes), else None."""
    if not re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+|[+-]?(?:inf|infinity|nan)", word, re.I):
        return None
    value = float.fromhex(word) if "x" in word.lower() else float(word)
    if value in (float("inf"), float("-inf")) and "inf" not in word.lower():
        return None  # out of range is an error
    return value


def tokenize(source: str) -> list[tuple[str, str]]:
    """(kind, text) pairs; kinds: ( ) , op string number ident and or not."""
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, value, at = m.lastgroup, m.group(), m.end()
        if kind == "bad":
            raise FilterError(f"unexpected character {value!r}")
        if kind == "quote":
            chars = []
            while at < len(source) and source[at] != value:
                at += source[at] == "\\" and at + 1 < len(source)
                chars.append(source[at])
                at += 1
            if at >= len(source):
                raise FilterError("unterminated string")
            out.append(("string", "".join(chars)))
            at += 1
        elif kind == "punct":
            out.append((value, value))
        elif kind == "op":
            out.append(("op", value))
        elif kind == "word":
            low = value.lower()
            if low in ("and", "or", "not"):
                out.append((low, value))
            elif low in ("contains", "matches", "startswith", "in"):
                out.append(("op", low))
            else:
                out.append(("ident" if parse_float(value) is None else "number", value))
    return out


class _Parser:
    def __init__(self, tokens):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else "end"

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise FilterError("the filter ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self, how: str, part):
        parts = [part()]
        while self.peek() == how:
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Many(how, tuple(parts))

    def either(self):
        return self.chain("or", lambda: self.chain("and", self.unary))

    def nested(self, inner):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise FilterError("the filter is nested too deep")
        node = inner()
        self.depth -= 1
        return node

    def unary(self):
        if self.peek() == "not":
            self.take()
            return Not(self.nested(self.unary))
        kind, value = self.take()
        if kind == "(":
            node = self.nested(self.either)
            if self.peek() != ")":
                raise FilterError("expected ')'")
            self.take()
            return node
        if kind == "ident" and self.peek() == "op":
            return self.test(value)
        if kind in ("ident", "string", "number"):
            return Word(value)
        raise FilterError(f"unexpected {value!r}")

    def test(self, name: str) -> Test:
        op = self.take()[1]
        values = self.list() if op == "in" else (self.take()[1],)
        if op == "matches":
            check_pattern(values[0])
        field = fields.find(name)
        if field is None:
            raise FilterError(f"unknown field {name!r}")
        if op in ("<", "<=", ">", ">=") and parse_float(values[0]) is None:
            raise FilterError(f"{op} needs a number, not {values[0]!r}")
        return Test(field, op, values)

    def list(self) -> tuple[str, ...]:
        if self.peek() != "(":
            raise FilterError("expected '(' after in")
        self.take()
        values = []
        while True:
            kind, value = self.take()
            if kind not in ("string", "number", "ident"):
                raise FilterError(f"expected a value, not {value!r}")
            values.append(value)
            if len(values) > MOST_LIST:
                raise FilterError("the list is too long")
            kind, value = self.take()
            if kind == ")":
                return tuple(values)
            if kind != ",":
                raise FilterError(f"expected ',' or ')', not {value!r}")


def parse(source: str):
    """The tree of a filter; None for an empty one, which matches everything."""
    source = source.strip()
    if not source:
        return None
    if len(source.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        raise FilterError("the filter is too long")
    parser = _Parser(tokenize(source))
    tree = parser.either()
    if parser.at < len(parser.tokens):
        raise FilterError(f"unexpected {parser.tokens[parser.at][1]!r} at the end")
    return tree


# --- patterns --------------------------------------------------------------------------------


def java_pattern(pattern: str) -> str:
    """A pattern of linear-time syntax as Java reads it: '.' excludes the newline only, '$' means
    the very end outside of classes, quotes, named groups and POSIX classes are respelled."""
    out, at, inside = [], 0, None  # inside: where the open class began
    while at < len(pattern):
        c = pattern[at]
        if inside is None and pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at)
            end = len(pattern) if end < 0 else end
            out += [f"\\{x}" if not x.isalnum() and x.isascii() and x.isprintable() and x != " " else x for x in pattern[at + 2 : end]]
            at = end + 2
            continue
        if c == "\\":
            out.append({"\\z": "\\z", "\\C": "[\\s\\S]"}.get(pattern[at : at + 2], pattern[at : at + 2]))
            at += 2
            continue
        if pattern.startswith("(?P<", at):
            out.append("(?<")
            at += 4
            continue
        if m := re.match(r"\[:(\^?)(\w+):\]", pattern[at:]):
            name = {"word": "w", "alnum": "p{Alnum}", "alpha": "p{Alpha}", "digit": "p{Digit}", "lower": "p{Lower}", "upper": "p{Upper}", "space": "p{Space}", "punct": "p{Punct}", "xdigit": "p{XDigit}", "blank": "p{Blank}", "cntrl": "p{Cntrl}", "graph": "p{Graph}", "print": "p{Print}", "ascii": "p{ASCII}"}.get(m[2])
            if not name:
                raise FilterError(f"unknown class {m[0]}")
            out.append("\\" + (name.replace("p{", "P{") if m[1] else name))
            at += m.end()
            continue
        if inside is None and c == "[":
            inside = at + pattern.startswith("[^", at) + 1
        elif inside is not None and c == "]" and at > inside - 1 and at != inside:
            inside = None
        elif inside is not None and c in "[&" or (c == "]" and at == inside):
            out.append("\\" + c)  # plain in a class
            at += 1
            continue
        out.append("\\z" if c == "$" and inside is None and "(?m" not in pattern else c)
        at += 1
    return "(?d)" + "".join(out)


def check_pattern(pattern: str) -> None:
    if len(pattern.encode("utf-8", "surrogatepass")) > MOST_PATTERN:
        raise FilterError("the pattern is too long")
    bare = re.sub(r"\\Q.*?(\\E|$)", "", re.sub(r"\\\\", "", pattern), flags=re.S)
    if re.search(r"\(\?(?:[=!>]|<[=!]|\w*U)|\\[1-9]|\\k<|[*+?}]\+", re.sub(r"\\[^1-9kZ]", "", bare)):
        raise FilterError(f"invalid pattern {pattern!r}")
    plain = java_pattern(pattern)[4:].replace("(?<", "(?P<").replace("\\z", "\\Z")
    plain = re.sub(r"\\[pP](\{\w+\}|\w)", "a", plain)
    try:
        re.compile(plain)
    except re.error as e:
        raise FilterError(f"invalid pattern {pattern!r}: {e}") from e


# --- network prefixes --------------------------------------------------------------------------


def parse_network(value: str):
    """A network in strict prefix notation, else None."""
    address, slash, bits = value.partition("/")
    if not slash or not re.fullmatch(r"0|[1-9]\d{0,2}", bits) or "%" in address:
        return None
    try:
        return ipaddress.ip_network(value, strict=False)
    except ValueError:
        return None


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^(?:::ffff:)?{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def in_network(value: Column, network) -> Column:
    """Whether an address lies in a network, as arithmetic for IPv4; false for other text."""
    if network.version == 4:
        octet = lambda k: F.regexp_extract(F.lower(value), _IPV4, k).try_cast("bigint")
        number = octet(1) * (1 << 24) + octet(2) * (1 << 16) + octet(3) * (1 << 8) + octet(4)
        free = 32 - network.prefixlen
        return F.lower(value).rlike(_IPV4) & F.coalesce(F.shiftright(number, free) == F.lit(int(network.network_address) >> free), F.lit(False))

    from ..functions.addresses import in_network_v6

    return in_network_v6(value, network)


# --- compiler ----------------------------------------------------------------------------------


def _compare(value: Column, op: str, number: float) -> Column:
    lit = F.lit(number)
    plain = {"<": value < lit, "<=": value <= lit, ">": value > lit, ">=": value >= lit}[op]
    if number != number:
        return F.lit(False)
    return plain


def _relational(test: Test) -> Column:
    number = parse_float(test.values[0])
    field = test.field
    if field.numeric:
        value = F.col(field.path)
        bare = _compare(value, test.op, int(number) if number == int(number) and abs(number) < 2**53 else number) if abs(number) != float("inf") and number == number else _compare(value.cast("double"), test.op, number)
        if field_is_double(field):
            bare = bare & ~F.isnan(value)
        zero_fits = {"<": 0 < number, "<=": 0 <= number, ">": 0 > number, ">=": 0 >= number}[test.op]
        if field.path == "response.mysql.errorCode":
            return bare & (value != 0)
        if not zero_fits:
            return bare  # a missing value can't fit either, so the column stays bare
        absent = F.col(field.guards[-1]).isNotNull() & value.isNull() if field.guards else value.isNull()
        return bare | absent
    parts = []
    for side in field.sides():
        read = F.when(side.rlike(_DECIMAL), side.cast("double")).when(F.lower(side).rlike(r"^\+?(inf|infinity)$"), F.lit(float("inf"))).when(F.lower(side).rlike(r"^-(inf|infinity)$"), F.lit(float("-inf")))
        parts.append(F.coalesce(_compare(read, test.op, number), F.lit(False)))
    return _any(parts)


def field_is_double(field: fields.Field) -> bool:
    from ..schema import field_type

    return field_type(field.path).simpleString() == "double"


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _match(value: Column, op: str, want: tuple[str, ...]) -> Column:
    if op in ("==", "!=") and (network := parse_network(want[0])) is not None:
        return in_network(value, network)
    if op in ("==", "!=", "in"):
        low = [w.lower() for w in want]
        return F.lower(value) == low[0] if len(low) == 1 else F.lower(value).isin(low)
    if op == "contains":
        return F.contains(F.lower(value), F.lit(want[0].lower()))
    if op == "startswith":
        return F.startswith(F.lower(value), F.lit(want[0].lower()))
    return value.rlike(java_pattern(want[0]))


def _node(node) -> Column:
    if isinstance(node, Word):
        return F.contains(fields.haystack(), F.lit(node.text.lower()))
    if isinstance(node, Not):
        return ~F.coalesce(_node(node.of), F.lit(False))
    if isinstance(node, Many):
        parts = [_node(p) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.how == "and" else out | p
        return out
    if node.op in ("<", "<=", ">", ">="):
        return _relational(node)
    hit = _any([_match(side, node.op, node.values) for side in node.field.sides()])
    return ~hit if node.op == "!=" else hit


def condition_of(parts: tuple) -> Column:
    """The condition that some trees of filters all hold."""
    return _node(parts[0] if len(parts) == 1 else Many("and", tuple(parts)))


def where(source: str) -> Column | None:
    """The condition of a filter, for use under ``filter``; None matches everything."""
    tree = parse(source)
    return None if tree is None else _node(tree)


def flag(source: str) -> Column:
    """The condition as a column that is never null."""
    condition = where(source)
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
