"""The ``events`` table as traffic of every protocol, with a value for every member that a field reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import conform
from .adapters import read_table

#: Path in an entry, and its value as an expression over ``n`` (event_id) and ``u`` (user_id) that
#: Spark and other SQL engines read alike.
VALUES = """
protocol | CASE n % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'amqp' WHEN 2 THEN 'postgres' WHEN 3 THEN 'dns' ELSE 'Kafka' END
status | CASE n % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'success' END
node | concat('rack-', u % 9)
elapsedMs | n % 901
src.name | CASE WHEN n % 3 = 0 THEN '' ELSE concat('cli-', u % 11) END
src.namespace | CASE WHEN n % 4 = 0 THEN '' ELSE concat('team-', u % 4) END
src.workload | concat('job-', u % 6)
dst.name | concat('svc-', n % 13)
dst.namespace | concat('area-', n % 3)
dst.workload | concat('app-', n % 8)
src.ip | CASE WHEN n % 2 = 0 THEN concat('2001:db8:', n % 7, '::', u % 100) ELSE concat('172.16.', n % 32, '.', u % 250) END
dst.ip | concat('192.168.', n % 5, '.7')
src.port | 30000 + n % 999
dst.port | 5000 + u % 12
request.method | CASE n % 3 WHEN 0 THEN 'PUT' WHEN 1 THEN 'Publish' ELSE 'DELETE' END
statusCode | 200 + n % 4 * 100
request.host | concat('h', u % 10, '.example.org')
request.path | concat('/v', n % 3, '/items/', u)
request.question | concat('q', u % 17, '.example.net')
response.answer | concat('203.0.113.', n % 200)
request.command | CASE n % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'HSET' ELSE 'DEL' END
request.query | concat('SELECT ', n % 40, ' FROM t', u % 5)
request.body | concat('{"k": ', n % 77, '}')
response.body | concat('done ', n % 55)
request.bytes | n % 5000
request.packets | n % 60
request.flags | CASE n % 2 WHEN 0 THEN 'SYN,ACK' ELSE 'PSH' END
request.summary | concat('ask ', n % 21)
response.summary | concat('told ', u % 19)
traceId | concat('trace-', n % 1000)
request.http.version | CASE n % 2 WHEN 0 THEN 'HTTP/1.1' ELSE 'HTTP/1.0' END
request.contentType | 'text/plain'
response.contentType | CASE WHEN n % 6 = 0 THEN '' ELSE 'application/json' END
response.dns.rcode | CASE n % 4 WHEN 0 THEN 'SERVFAIL' ELSE 'NOERROR' END
request.redis.dbIndex | n % 16
response.redis.reply | concat('reply ', n % 31)
response.postgres.error.code | concat('22P', lpad(CAST(n % 50 AS STRING), 2, '0'))
request.postgres.statementName | concat('stmt-', u % 14)
response.postgres.txStatus | CASE n % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'T' ELSE 'E' END
request.mysql.command | CASE n % 2 WHEN 0 THEN 'QUERY' ELSE 'PING' END
response.mysql.errorCode | n % 3 * 1045
request.mongo.collection | concat('orders_', u % 8)
request.mongo.command | CASE n % 2 WHEN 0 THEN 'find' ELSE 'insert' END
request.kafka.topic | concat('topic.', u % 15)
request.kafka.apiKey | CASE n % 2 WHEN 0 THEN 'FETCH' ELSE 'METADATA' END
l4.ttl | 32 + n % 3 * 32
l4.retransmits | n % 4
l4.window | n % 65000
l4.mss | 536 + n % 2 * 924
l4.rttMs | CAST(n % 50 AS DOUBLE) / 4
l4.durationMs | n % 7000
l4.clientBytes | n * 3
l4.serverBytes | n * 5
l4.tls.sni | concat('s', u % 20, '.example.com')
request.class | CASE n % 2 WHEN 0 THEN 'Basic' ELSE 'Queue' END
request.exchange | concat('ex-', n % 4)
request.routingKey | concat('key.', u % 30)
request.queue | concat('line-', n % 12)
request.deliveryTag | n * 7
request.correlationId | concat('corr-', n)
request.replyTo | concat('back-', u % 25)
request.wsOpcode | CASE n % 2 WHEN 0 THEN 'text' ELSE 'binary' END
request.redis.pipelineDepth | n % 9
request.postgres.portal | concat('portal-', u % 3)
response.dns.authoritative | n % 2 = 0
response.dns.recursionAvailable | n % 3 = 0
request.size | n % 800
response.size | n % 8000
response.rowCount | n % 120
response.http.ttfbMs | n % 300
l4.srcMac | concat('02:00:00:00:00:', lpad(CAST(u % 90 AS STRING), 2, '0'))
l4.dstMac | '02:00:00:00:01:01'
l4.ipVersion | 4 + n % 2 * 2
l4.ipFlags | CASE n % 2 WHEN 0 THEN 'DF' ELSE 'MF' END
l4.clientTcpFlags | CASE n % 2 WHEN 0 THEN 'SYN,ACK' ELSE 'SYN,ACK,FIN' END
l4.serverTcpFlags | CASE n % 3 WHEN 0 THEN 'RST' ELSE 'ACK' END
l4.seqStart | n * 1000
l4.ackStart | n * 2000
l4.clientPackets | n % 45
l4.serverPackets | n % 46
"""
#: Objects within an entry, and the number of events out of which one lacks the object.
ABSENT = {"l4": 3, "l4.tls": 4, "request.http": 5, "response.http": 6, "request.dns": 4, "response.dns": 7, "request.redis": 8, "response.redis": 9, "request.postgres": 10, "response.postgres": 11, "response.postgres.error": 3, "request.mysql": 4, "response.mysql": 5, "request.mongo": 6, "request.kafka": 7}


def values() -> dict[str, str]:
    """Path to expression."""
    return {p.strip(): e.strip() for p, _, e in (line.partition("|") for line in VALUES.strip().split("\n"))}


def varied_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry per event, in which some objects are absent."""
    tree: dict = {}
    for path, expression in values().items():
        *outer, last = path.split(".")
        node = tree
        for part in outer:
            node = node.setdefault(part, {})
        node[last] = F.expr(expression)
    questions = F.expr("array(named_struct('name', 'q', 'type', CASE WHEN n % 2 = 0 THEN 'MX' ELSE 'TXT' END, 'class', 'IN'))")
    tree["request"].setdefault("dns", {})["questions"] = questions
    tree["request"]["headers"] = F.expr("map('x-tenant', concat('tenant-', u % 5))")
    tree["response"]["headers"] = F.expr("map('server', concat('edge-', n % 6))")

    def built(node, path):
        if not isinstance(node, dict):
            return node
        made = F.struct(*[built(v, f"{path}.{k}".lstrip(".")).alias(k) for k, v in node.items()])
        return F.when(F.col("n") % ABSENT[path] != 0, made) if path in ABSENT else made

    events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.col("user_id").alias("u"), F.col("ts").cast("timestamp").alias("timestamp"))
    columns = [built(v, k).alias(k) for k, v in tree.items()]
    return conform(events.select(F.concat(F.lit("ev-"), "n").alias("id"), "timestamp", (F.col("n") + 1).alias("seq"), *columns))
