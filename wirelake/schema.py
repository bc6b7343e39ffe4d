"""The one fact row: an application-layer interaction, request paired with response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENDPOINT = "struct<ip: string, port: int, name: string, namespace: string, workload: string>"
_RR = "array<struct<name: string, type: string, ttl: bigint, data: string>>"
_PAYLOAD = f"""struct<
  summary: string, headers: map<string, string>, body: string, size: bigint,
  method: string, path: string, host: string, statusCode: int, question: string, answer: string,
  command: string, query: string, rowCount: bigint, exchange: string, routingKey: string, queue: string,
  deliveryTag: decimal(20,0), class: string, correlationId: string, replyTo: string, messageId: string,
  packets: bigint, bytes: bigint, flags: string, wsOpcode: string, contentType: string, truncated: boolean,
  raw: struct<data: binary, hex: string, bytes: bigint, truncated: boolean>,
  http: struct<version: string, query: map<string, string>, contentType: string, ttfbMs: bigint>,
  dns: struct<id: int, questions: array<struct<name: string, type: string, class: string>>,
    answers: {_RR}, authority: {_RR}, additional: {_RR},
    rcode: string, authoritative: boolean, recursionAvailable: boolean>,
  redis: struct<args: array<string>, reply: string, replyType: string, dbIndex: int, pipelineDepth: int, attributes: map<string, string>>,
  postgres: struct<statementName: string, portal: string, params: array<string>,
    columns: array<struct<name: string, typeOid: int, type: string>>, tag: string,
    error: struct<severity: string, code: string, message: string, detail: string, hint: string, where: string>, txStatus: string>,
  mysql: struct<command: string, errorCode: int, errorMessage: string>,
  mongo: struct<command: string, collection: string, database: string, ok: boolean, errmsg: string>,
  kafka: struct<apiKey: string, apiVersion: int, topic: string, clientId: string, errorCode: int, correlationId: int>>"""
_L4 = """struct<srcMac: string, dstMac: string, ipVersion: int, ttl: int, ipFlags: string, clientTcpFlags: string,
  serverTcpFlags: string, seqStart: bigint, ackStart: bigint, window: int, mss: int, retransmits: int, rttMs: double,
  durationMs: bigint, clientBytes: bigint, serverBytes: bigint, clientPackets: bigint, serverPackets: bigint,
  headerHex: string, tls: struct<sni: string, alpn: string, version: string, cipher: string>>"""
DDL = f"""id string, protocol string, timestamp timestamp, elapsedMs bigint, node string, nodeIp string,
  src {_ENDPOINT}, dst {_ENDPOINT}, request {_PAYLOAD}, response {_PAYLOAD},
  status string, statusCode int, l4 {_L4}, seq bigint, traceId string"""

_PLAIN = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "decimal(20,0)": T.DecimalType(20, 0)}


def _parts(s: str) -> list[str]:
    """Split at commas outside of brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(s[last:i])
            last = i + 1
    return [p.strip() for p in (*out, s[last:])]


def _type(s: str) -> T.DataType:
    """A type in the notation above; needs no session, unlike Spark's own reader."""
    outer, _, inner = s.partition("<")
    if outer == "struct":
        fields = [p.partition(":") for p in _parts(inner[:-1])]
        return T.StructType([T.StructField(n.strip(), _type(t.strip())) for n, _, t in fields])
    if outer == "array":
        return T.ArrayType(_type(inner[:-1]))
    if outer == "map":
        return T.MapType(*map(_type, _parts(inner[:-1])))
    return _PLAIN[s]


_WHOLE = " ".join(DDL.split()).replace("< ", "<").replace(" >", ">")
ENTRY = T.StructType([T.StructField(n, _type(t)) for n, t in (p.split(" ", 1) for p in _parts(_WHOLE))])


def _fit(have: T.DataType | None, want: T.DataType, col: Column) -> Column:
    """``col`` as ``want``; members that a struct lacks become null."""
    if have is None:
        return F.lit(None).cast(want)
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        kinds = {f.name: f.dataType for f in have.fields}
        made = F.struct(*[_fit(kinds.get(f.name), f.dataType, col.getField(f.name) if f.name in kinds else col).alias(f.name) for f in want.fields])
        return F.when(col.isNotNull(), made)
    return col if have == want else col.cast(want)


def fitted(df: DataFrame) -> list[Column]:
    """The columns of an entry from those of ``df``; whatever it lacks is null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [_fit(kinds.get(f.name), f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in ENTRY.fields]


def conform(df: DataFrame, *also: str) -> DataFrame:
    """``df`` with exactly the columns of an entry; whatever it lacks is null, extras go but for those named."""
    return df.select(*fitted(df), *also)


def field_type(path: str) -> T.DataType:
    """Type of a dotted path inside an entry."""
    kind: T.DataType = ENTRY
    for part in path.split("."):
        kind = kind[part].dataType
    return kind


def text(path: str) -> Column:
    """A string member, absent ones as empty text."""
    return F.coalesce(F.col(path), F.lit(""))
