"""Scalar functions over text, headers, bytes and flags, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
# Query parameters and headers whose values are never shown.
SECRET_PARAMETERS = "access_token api_key apikey auth client_secret password refresh_token secret session_token sig signature token".split()
SECRET_HEADERS = "authorization proxy-authorization cookie set-cookie x-api-key x-auth-token".split()
# Names of well-known ports.
PORTS = {
    22: "ssh", 25: "smtp", 110: "pop3", 143: "imap", 443: "https", 587: "smtp", 853: "dns-tls", 1433: "mssql", 2181: "zookeeper", 2379: "etcd",
    3306: "mysql", 3389: "rdp", 5432: "postgres", 5672: "amqp", 6379: "redis", 8883: "mqtt", 9042: "cassandra", 9092: "kafka", 11211: "memcached", 27017: "mongodb",
}


def collapsed(s: Column) -> Column:
    """Runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"[\x09-\x0D\x20]+", " "))


def human_bytes(n: Column) -> Column:
    """B, KB or MB, in steps of 1024, with one decimal from KB on."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", F.bround(n / F.lit(1024.0), 1))).otherwise(F.format_string("%.1f MB", F.bround(n / F.lit(float(1 << 20)), 1)))


def port_label(protocol: Column, port: Column) -> Column:
    """'proto name' of a well-known port, else 'proto/port'."""
    names = F.create_map(*[x for p, n in PORTS.items() for x in (F.lit(p), F.lit(n))])
    name = F.try_element_at(names, port.cast("int"))
    return F.when(name.isNotNull(), F.concat_ws(" ", protocol, name)).otherwise(F.concat_ws("/", protocol, port.cast("string")))


def truncated(s: Column, most: int) -> Column:
    """At most so many bytes, cut between characters, with an ellipsis where cut."""
    whole = F.octet_length(s) <= most
    prefix = F.left(s, F.lit(most))
    over = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: F.octet_length(F.left(prefix, F.lit(most) - k)) <= most)
    return F.when(whole, s).otherwise(F.concat(F.left(prefix, F.lit(most) - F.element_at(over, 1)), F.lit("…")))


def query_of(url: Column) -> Column:
    """The part of a URL after '?', before '#'; null without one."""
    return F.nullif(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))


def _parameters(query: Column) -> tuple[Column, Column]:
    """(name, value) structs of a query string, decoded, and whether all of it is well formed:
    every name and value decodes, and nothing is parted by ';'."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))
    pairs = F.transform(parts, lambda p, i: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"), i.alias("place"), F.try_url_decode(value(p)).alias("value")))
    return pairs, ~F.contains(query, F.lit(";")) & F.forall(pairs, lambda p: p["name"].isNotNull() & p["value"].isNotNull())


def query_map(url: Column, secrets=SECRET_PARAMETERS) -> Column:
    """Parameters of a URL, repeated ones joined by ', ', with secret ones redacted; empty if any
    part is malformed."""
    query = query_of(url)
    pairs, fine = _parameters(query)
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    joined = lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]), ", ")
    shown = F.transform(names, lambda n: F.struct(n.alias("key"), F.when(F.lower(n).isin(secrets), F.lit(REDACTED)).otherwise(joined(n)).alias("value")))
    return F.when(query.isNotNull() & fine, F.map_from_entries(shown)).otherwise(F.create_map().cast("map<string,string>"))


def query_escaped(s: Column) -> Column:
    """Percent-encoding of a query component: letters, digits and ``-_.~`` stay, a space is '+'."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def redacted_url(url: Column, secrets=SECRET_PARAMETERS) -> Column:
    """A URL without the values of secret parameters, whose names are decoded before they are compared.

    With one among them the query is written anew, in order of names, each secret one once; a query that
    isn't well formed is hidden whole, since no name in it can be relied on; any other URL stays as it is.
    """
    query = query_of(url)
    pairs, fine = _parameters(query)
    secret = lambda p: F.lower(p["name"]).isin(secrets)
    first = lambda p: F.forall(pairs, lambda other: (other["name"] != p["name"]) | (other["place"] >= p["place"]))
    kept = F.array_sort(F.filter(pairs, lambda p: ~secret(p) | first(p)))
    written = F.array_join(F.transform(kept, lambda p: F.concat(query_escaped(p["name"]), F.lit("="), query_escaped(F.when(secret(p), F.lit(REDACTED)).otherwise(p["value"])))), "&")
    path = F.concat(F.substring_index(url, "?", 1), F.lit("?"))
    return F.when(query.isNull(), url).when(~fine, F.concat(path, query_escaped(F.lit(REDACTED)))).when(F.exists(pairs, secret), F.concat(path, written)).otherwise(url)


def redacted_headers(headers: Column, secrets=SECRET_HEADERS) -> Column:
    """Headers with the values of secret ones replaced, names kept."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(secrets), F.lit(REDACTED)).otherwise(v))


def redacted_command(command: Column, args: Column) -> Column:
    """Arguments of a key-value store's command with credentials replaced."""
    name = F.upper(command)
    every = F.transform(args, lambda _: F.lit(REDACTED))
    auth = F.exists(args, lambda a: F.upper(a) == "AUTH")
    at = F.array_position(F.transform(args, lambda a: F.upper(a)), "AUTH")
    hello = F.transform(args, lambda a, i: F.when((i >= at) & (i < at + 2), F.lit(REDACTED)).otherwise(a))
    setting = (F.upper(F.get(args, 0)) == "SET") & F.exists(args, lambda a: F.lower(a).isin("requirepass", "masterauth"))
    pairs = F.transform(args, lambda a, i: F.when((i >= 2) & (i % 2 == 0) & F.lower(F.get(args, i - 1)).isin("requirepass", "masterauth"), F.lit(REDACTED)).otherwise(a))
    return F.when(name == "AUTH", every).when((name == "HELLO") & auth, hello).when((name == "CONFIG") & setting, F.when(F.size(args) % 2 == 0, every).otherwise(pairs)).otherwise(args)


def redacted_parameters(params: Column) -> Column:
    """As many parameters, none shown."""
    return F.transform(params, lambda _: F.lit(REDACTED))


def trace_id(headers: Column) -> Column:
    """The id of a trace: that of traceparent, else x-request-id, else x-correlation-id."""
    value = lambda name: F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))
    parent = F.lower(F.regexp_extract(F.lower(value("traceparent")), r"^[0-9a-f]{2}-([0-9a-f]{32})-[0-9a-f]{16}-[0-9a-f]{2}", 1))
    parent = F.when(parent != "0" * 32, parent)
    pick = [F.nullif(c, F.lit("")) for c in (parent, value("x-request-id"), value("x-correlation-id"))]
    return F.coalesce(*pick, F.lit(""))


def status_of_code(code: Column) -> Column:
    return F.when(code >= 500, "error").when(code >= 400, "warning").otherwise("success")


def hex_dump(data: Column) -> Column:
    """Sixteen bytes a line: offset, bytes in hex in two halves, and printable characters."""
    count = F.ceil(F.length(data) / 16.0).cast("int")

    def line(i):
        chunk = F.substring(data, i * 16 + 1, F.lit(16))
        digits = F.rpad(F.lower(F.hex(chunk)), F.lit(32), F.lit(" "))
        pair = lambda k: F.substring(digits, F.lit(2 * k + 1), F.lit(2))
        half = lambda a: F.concat_ws(" ", *[pair(k) for k in range(a, a + 8)])
        shown = F.regexp_replace(F.decode(chunk, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
        return F.concat(F.lpad(F.lower(F.hex(i * 16)), 8, "0"), F.lit("  "), half(0), F.lit("  "), half(8), F.lit("  |"), shown, F.lit("|"))

    lines = F.transform(F.sequence(F.lit(0), count - 1), line)
    return F.when(count > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def hex_undump(dump: Column) -> Column:
    """The bytes of a hex dump."""
    lines = F.transform(F.split(dump, "\n"), lambda s: F.regexp_replace(F.substring(s, 10, 50), "[^0-9a-fA-F]", ""))
    return F.unhex(F.array_join(lines, ""))


def csv_field(s: Column) -> Column:
    """Quoted if it holds a comma, quote or line break."""
    s = F.coalesce(s.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def curl(method: Column, url: Column, headers: Column, body: Column) -> Column:
    """A shell command that repeats a request, without headers that belong to one hop."""
    # Headers of one hop.
    hop = "connection keep-alive proxy-connection te trailer transfer-encoding upgrade host content-length".split()
    quoted = lambda s: F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    kept = F.filter(F.array_sort(F.map_entries(headers)), lambda h: ~F.lower(h["key"]).isin(hop))
    flags = F.transform(kept, lambda h: F.concat(F.lit("-H "), quoted(F.concat(h["key"], F.lit(": "), h["value"]))))
    data = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("--data-raw "), quoted(body)))
    return F.concat_ws(" ", F.lit("curl -X"), method, quoted(url), F.nullif(F.array_join(flags, " "), F.lit("")), data)
