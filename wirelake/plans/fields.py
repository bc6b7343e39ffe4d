"""The catalogue of filter fields: names, aliases, types and how each is read from an entry.

An absent plain member reads as its zero value, a member of an absent sub-object as empty text;
there are no nulls in the filter language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ENTRY, field_type, text

# Canonical name, type ('*': counted as a facet), path in an entry, aliases.
_CATALOGUE = """
protocol enum* protocol
status enum* status
node string* node
elapsedMs number elapsedMs elapsed latency
namespace string* : ns
src.name string* src.name
src.namespace string* src.namespace src.ns
src.workload string* src.workload
dst.name string* dst.name
dst.namespace string* dst.namespace dst.ns
dst.workload string* dst.workload
src.ip string* src.ip
dst.ip string* dst.ip
src.port number src.port
dst.port number* dst.port
http.method enum* request.method request.method method
response.status number* statusCode http.status status.code statuscode
request.host string* request.host http.host host
request.path freetext request.path http.path path
dns.question freetext request.question question
dns.answer freetext response.answer answer
redis.command enum* request.command command
postgres.query freetext request.query query sql
request.body freetext request.body
response.body freetext response.body
bytes number request.bytes
packets number request.packets
flags string* request.flags
summary freetext :
trace.id freetext traceId traceid
http.version enum* request.http.version
response.contenttype string* : content-type contenttype
dns.rcode enum* response.dns.rcode
dns.type enum* :
redis.db number* request.redis.dbIndex
redis.reply freetext response.redis.reply
postgres.error string* response.postgres.error.code pg.code
postgres.statement string* request.postgres.statementName
postgres.txstatus enum* response.postgres.txStatus
mysql.command enum* request.mysql.command
mysql.error number* response.mysql.errorCode
mongo.collection string* request.mongo.collection
mongo.command enum* request.mongo.command
kafka.topic string* request.kafka.topic
kafka.apikey enum* request.kafka.apiKey
l4.ttl number* l4.ttl
l4.retransmits number l4.retransmits
l4.window number l4.window
l4.mss number* l4.mss
l4.rttms number l4.rttMs
l4.durationms number l4.durationMs
l4.clientbytes number l4.clientBytes
l4.serverbytes number l4.serverBytes
tls.sni string* l4.tls.sni
amqp.class enum* request.class
amqp.method enum* :
amqp.exchange string* request.exchange exchange
amqp.routingkey string* request.routingKey amqp.routing-key routingkey routing-key
amqp.queue string* request.queue queue
amqp.deliverytag number request.deliveryTag deliverytag
amqp.correlationid freetext request.correlationId amqp.correlation-id
amqp.replyto string* request.replyTo amqp.reply-to
ws.opcode enum* request.wsOpcode
redis.pipelinedepth number* request.redis.pipelineDepth
postgres.portal string* request.postgres.portal
dns.authoritative enum* response.dns.authoritative
dns.recursionavailable enum* response.dns.recursionAvailable dns.recursionavl
request.size number request.size
response.size number response.size size
postgres.rowcount number response.rowCount rowcount
http.ttfbms number response.http.ttfbMs
l4.srcmac string l4.srcMac
l4.dstmac string l4.dstMac
l4.ipversion enum* l4.ipVersion
l4.ipflags string* l4.ipFlags
l4.clienttcpflags string* l4.clientTcpFlags
l4.servertcpflags string* l4.serverTcpFlags
l4.seqstart number l4.seqStart
l4.ackstart number l4.ackStart
l4.clientpackets number l4.clientPackets
l4.serverpackets number l4.serverPackets
"""

# What enum facets list even where no entry has it.
STATIC = {
    "protocol": "http dns redis valkey postgres mysql mongodb kafka tcp udp icmp amqp ws",
    "status": "success warning error",
    "postgres.txstatus": "I T E",
    "amqp.class": "Connection Channel Exchange Queue Basic",
    "ws.opcode": "text binary close ping pong continuation",
    "dns.authoritative": "true false",
    "dns.recursionavailable": "true false",
    "l4.ipversion": "4 6",
}
# Operators that a type advertises.
OPERATORS = {
    "enum": ["==", "!=", "in"],
    "number": ["==", "!=", ">", "<", ">=", "<=", "in"],
    "string": ["==", "!=", "contains", "matches", "startswith", "in"],
    "freetext": ["==", "!=", "contains", "matches", "startswith"],
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    tracked: bool
    path: str | None

    def text(self) -> Column:
        """The value as text, empty where absent."""
        return _SPECIAL[self.name]() if self.path is None else _rendered(self.path)

    def sides(self) -> list[Column]:
        """The values that a condition may match: both ends for ``namespace``, else one."""
        return [text("src.namespace"), text("dst.namespace")] if self.name == "namespace" else [self.text()]

    @property
    def numeric(self) -> bool:
        return self.path is not None and isinstance(field_type(self.path), T.NumericType)

    @property
    def guards(self) -> list[str]:
        """Sub-objects without which the field is absent."""
        parts = (self.path or "").split(".")
        outer = [".".join(parts[:k]) for k in range(1, len(parts))]
        return [p for p in outer if p not in ("src", "dst", "request", "response")]


def _plain_double(path: str) -> Column:
    """Shortest decimal rendering without an exponent or a trailing '.0'."""
    v = F.col(path)
    plain = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(v.cast("string"), r"\.0$", "")
    return F.when(F.contains(v.cast("string"), F.lit("E")), plain).otherwise(short)


def _rendered(path: str) -> Column:
    kind, v = field_type(path), F.col(path)
    guards = Field("", "", False, path).guards
    if isinstance(kind, T.StringType):
        return F.coalesce(v, F.lit(""))
    shown = _plain_double(path) if isinstance(kind, T.DoubleType) else v.cast("string")
    zero = "false" if isinstance(kind, T.BooleanType) else "0"
    if path == "response.mysql.errorCode":  # zero means no error
        return F.when(v != 0, shown).otherwise(F.lit(""))
    if not guards:
        return F.coalesce(shown, F.lit(zero))
    return F.when(F.col(guards[-1]).isNotNull(), F.coalesce(shown, F.lit(zero))).otherwise(F.lit(""))


def _either(first: str, second: str) -> Column:
    return F.when(text(first) != "", F.col(first)).otherwise(text(second))


_SPECIAL = {
    "namespace": lambda: _either("src.namespace", "dst.namespace"),
    "summary": lambda: F.concat(text("request.summary"), F.lit(" "), text("response.summary")),
    "response.contenttype": lambda: _either("response.contentType", "request.contentType"),
    "dns.type": lambda: F.coalesce(F.get(F.col("request.dns.questions"), 0).getField("type"), F.lit("")),
    "amqp.method": lambda: F.when(F.col("protocol") == "amqp", text("request.method")).otherwise(F.lit("")),
}


@dataclass(frozen=True)
class Header(Field):
    """A member of the request's or response's header map."""

    def text(self) -> Column:
        side, name = self.path.split("|", 1)
        return F.coalesce(F.try_element_at(F.col(f"{side}.headers"), F.lit(name)), F.lit(""))

    @property
    def numeric(self) -> bool:
        return False

    @property
    def guards(self) -> list[str]:
        return []


@lru_cache(maxsize=1)
def catalogue() -> dict[str, Field]:
    """Canonical name to field, in catalogue order."""
    out = {}
    for line in _CATALOGUE.split("\n"):
        if line:
            name, kind, path = line.split()[:3]
            out[name] = Field(name, kind.rstrip("*"), kind.endswith("*"), None if path == ":" else path)
    return out


@lru_cache(maxsize=1)
def _by_any_name() -> dict[str, Field]:
    named = {}
    for line in _CATALOGUE.split("\n"):
        if line:
            name, _, _, *aliases = line.split()
            named |= {a.lower(): catalogue()[name] for a in (name, *aliases)}
    return named


def find(name: str) -> Field | None:
    """The field of a name or alias in any case, or of a header family; None if unknown."""
    low = name.lower()
    for side in ("request", "response"):
        prefix = f"{side}.header."
        if low.startswith(prefix):
            return Header(low, "string", False, f"{side}|{low[len(prefix) :]}") if len(low) > len(prefix) else None
    return _by_any_name().get(low)


def haystack() -> Column:
    """What a bare word is searched in: salient members, lower-cased and joined by spaces."""
    always = "protocol node src.ip src.name dst.ip dst.name request.summary request.method request.path request.host request.question request.command request.query response.summary"
    some = lambda path: F.when(text(path) != "", F.col(path))
    amqp = [text(f"request.{m}") for m in ("exchange", "routingKey", "queue")]
    return F.lower(
        F.concat_ws(
            " ",
            *[text(p) for p in always.split()],
            some("request.http.contentType"),
            F.when(F.size("response.dns.answers") > 0, F.array_join(F.transform("response.dns.answers", lambda a: F.coalesce(a.getField("data"), F.lit(""))), " ")),
            some("request.postgres.statementName"),
            F.when(F.concat(*amqp) != "", F.concat_ws(" ", *amqp)),
            some("l4.tls.sni"),
            some("request.kafka.topic"),
        )
    )


assert all(f.path is None or field_type(f.path) is not None for f in catalogue().values()) and ENTRY
