"""The registered queries of the traffic engine, and the SQL that must give the same rows."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Traffic
from .functions import text as fn
from .operators import compare, exporting, facets, flows, history, identity, pairing, stats
from .operators.summary import graph, label, map_edges, map_nodes, summary, timeline, top_view
from .plans import fields, ifl
from .schema import text
from .session import prepare, scratch_folder
from .sources import varied
from .sources.adapters import entries_of_events, events_as_entries, events_stream, from_json_lines, read_table, sales_as_entries, worker_frames

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The ``events`` table as flat traffic; the same columns as ``events_as_entries`` gives nested.
_FLAT = """
WITH e AS (SELECT 'ev-' || event_id AS id, event_id + 1 AS seq, ts, CAST(floor(value) AS BIGINT) AS ms,
  CASE event_type WHEN 'view' THEN 'http' WHEN 'click' THEN 'redis' WHEN 'purchase' THEN 'postgres' WHEN 'signup' THEN 'dns' ELSE 'tcp' END AS protocol,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'success' END AS status,
  CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END AS code,
  '10.0.1.' || (user_id % 250) AS sip, CASE user_id % 4 WHEN 0 THEN 'shop' WHEN 1 THEN 'platform' WHEN 2 THEN 'kube-system' ELSE '' END AS sns,
  CASE WHEN user_id % 7 = 0 THEN '' ELSE 'wl-' || (user_id % 16) END AS swl, '10.0.2.9' AS dip, 8000 + user_id % 3 AS dport,
  CASE event_type WHEN 'view' THEN 'shop' WHEN 'click' THEN 'platform' ELSE '' END AS dns,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS dwl,
  '/' || event_type || '/' || user_id AS path, CASE event_type WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'POST' ELSE '' END AS method,
  'user ' || user_id || ' ' || CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'success' END AS said, props, user_id, event_type
 FROM events),
l AS (SELECT *, CASE WHEN swl = '' THEN sip WHEN sns <> '' THEN sns || '/' || swl ELSE swl END AS src,
  CASE WHEN dwl = '' THEN dip WHEN dns <> '' THEN dns || '/' || dwl ELSE dwl END AS dst FROM e)
"""
_MEASURES = """count(*) AS count, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'warning') AS warnings,
 CAST(quantile_disc(ms, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(ms, 0.95) AS BIGINT) AS p95, max(ms) AS max"""
_SEEN = ", string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(prepare(spark), sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _flat_summary(df: DataFrame) -> DataFrame:
    return df.select("key", "count", "errors", "warnings", "p50", "p95", "max", F.array_join("protocols", ",").alias("protocols"), F.unix_micros("firstSeen").alias("first_us"), F.unix_micros("lastSeen").alias("last_us"))


# --- the filter language -----------------------------------------------------------------------

# Filter text and the same condition on the flat columns.
_FILTERS = {
    "filter_eq": ('protocol == "HTTP"', "lower(protocol) = 'http'"),
    "filter_neq_absent": ('dst.workload != "view"', "lower(dwl) <> 'view'"),
    "filter_case_fold": ('STATUS == "Error" or Http.Method == "post"', "lower(status) = 'error' OR lower(method) = 'post'"),
    "filter_numeric": ("elapsedMs >= 250 and response.status < 500", "ms >= 250 AND code < 500"),
    "filter_numeric_text": ("response.status == 503.0 or response.status == 404", "CAST(code AS VARCHAR) = '503.0' OR CAST(code AS VARCHAR) = '404'"),
    "filter_zero_value": ("bytes < 10 and not (l4.ttl < 10) and elapsedMs < 100", "ms < 100"),
    "filter_in": ("response.status in (404, 503)", "code IN (404, 503)"),
    "filter_contains": ('request.path contains "SIGNUP"', "contains(lower(path), 'signup')"),
    "filter_startswith": ('request.path startswith "/View"', "starts_with(lower(path), '/view')"),
    "filter_regex": ('request.path matches "^/(view|click)/[0-9]{2}$"', "regexp_matches(path, '^/(view|click)/[0-9]{2}$')"),
    "filter_cidr_v4": ('src.ip == "10.0.1.64/26" and dst.ip != "10.0.3.0/24"', "CAST(split_part(sip, '.', 4) AS INT) BETWEEN 64 AND 127"),
    "filter_namespace_any": ('namespace == "shop"', "sns = 'shop' OR dns = 'shop'"),
    "filter_namespace_none": ('ns != "shop"', "NOT (sns = 'shop' OR dns = 'shop')"),
    "filter_fulltext": ("purchase and 10.0.1.1", "contains(lower(path), 'purchase') AND contains(sip, '10.0.1.1')"),
    "filter_header": ('request.header.user-agent == "agent/3"', "user_id % 5 = 3"),
    "filter_whitespace": ("\tprotocol\n==  http\tand(elapsedMs>=100)\n", "protocol = 'http' AND ms >= 100"),
    "filter_header_number": ("request.header.x-load >= 25.5 and not request.header.x-load > 4e1", "event_id % 50 >= 25.5 AND NOT event_id % 50 > 40"),
    "filter_header_words": ("request.header.user-agent < 5 or status == error", "status = 'error'"),
    "filter_not_nested": ('not (status == "success" or not (elapsedMs > 100 and protocol != "dns"))', "NOT (status = 'success' OR NOT (ms > 100 AND protocol <> 'dns'))"),
}


def _filter_query(name: str, source: str, condition: str) -> None:
    def run(spark, sf_dir):
        entries = events_as_entries(spark, sf_dir)
        if "x-load" in source:
            load = F.create_map(F.lit("x-load"), ((F.col("seq") - 1) % 50).cast("string"))
            entries = entries.withColumn("request", F.col("request").withField("headers", F.map_concat("request.headers", load)))
        return history.matching(entries, source).select("id", "seq", "protocol", "status")

    run.__name__ = name
    query(f"{_FLAT} SELECT id, seq, protocol, status FROM (SELECT *, seq - 1 AS event_id FROM l) WHERE {condition}")(run)


for _name, (_source, _condition) in _FILTERS.items():
    _filter_query(_name, _source, _condition)


@query(f"{_FLAT} SELECT id, (code >= 500 OR lower(dwl) = 'click') AS hit FROM l")
def filter_projected(spark, sf_dir):
    return events_as_entries(spark, sf_dir).select("id", ifl.flag("response.status >= 500 or dst.workload == click").alias("hit"))


@query("SELECT event_id + 1 AS seq FROM events WHERE event_id % 2 = 0 AND event_id % 7 IN (2, 3)")
def filter_cidr_v6(spark, sf_dir):
    return varied.varied_entries(spark, sf_dir).filter(ifl.where('src.ip == "2001:db8:2::/47"')).select("seq")


# --- history -----------------------------------------------------------------------------------

_ROW = "id, seq, protocol, status, ms"


def _rows(df):
    return df.select("id", "seq", "protocol", "status", F.col("elapsedMs").alias("ms"))


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE status <> 'success' ORDER BY seq DESC LIMIT 200")
def latest_n(spark, sf_dir):
    return _rows(history.latest(events_as_entries(spark, sf_dir), 200, 'status != "success"'))


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE seq < 500 AND protocol = 'dns' ORDER BY seq DESC LIMIT 50")
def before_seq(spark, sf_dir):
    return _rows(history.before_seq(events_as_entries(spark, sf_dir), 500, 50, "protocol == dns"))


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE seq < 401 ORDER BY seq DESC LIMIT 30")
def before_id(spark, sf_dir):
    return _rows(history.before_id(events_as_entries(spark, sf_dir), "ev-400", 30))


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE id = 'ev-77'")
def point_lookup(spark, sf_dir):
    return _rows(history.by_id(events_as_entries(spark, sf_dir), "ev-77"))


@query(f"{_FLAT} SELECT {_ROW} FROM l ORDER BY ms DESC, seq DESC LIMIT 100")
def top_k_desc(spark, sf_dir):
    return _rows(history.top_k(events_as_entries(spark, sf_dir), "elapsedMs", limit=100))


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE protocol = 'http' ORDER BY ms, seq DESC LIMIT 25")
def top_k_asc(spark, sf_dir):
    return _rows(history.top_k(events_as_entries(spark, sf_dir), "elapsedMs", "asc", 25, 'protocol == "http"'))


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def time_range(spark, sf_dir):
    return _rows(history.matching(events_as_entries(spark, sf_dir), "", datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 6, 12, tzinfo=UTC)))


@query(f"{_FLAT} SELECT {_ROW} FROM (SELECT * FROM l WHERE protocol = 'redis' ORDER BY seq DESC LIMIT 500)")
def history_replay(spark, sf_dir):
    return _rows(history.replay(events_as_entries(spark, sf_dir), "protocol == redis"))


@query(f"{_FLAT} SELECT {_ROW} FROM l ORDER BY status DESC, seq DESC LIMIT 300")
def table_sort_status(spark, sf_dir):
    return _rows(history.sorted_table(events_as_entries(spark, sf_dir), "status", "desc", 300))


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE protocol <> 'tcp' ORDER BY ts, seq DESC LIMIT 120")
def table_sort_time(spark, sf_dir):
    return _rows(history.sorted_table(events_as_entries(spark, sf_dir), "time", "asc", 120, "protocol != tcp"))


@query(f"""{_FLAT}, n AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS r FROM l),
 s AS (SELECT *, sum(length(path)) OVER (ORDER BY seq DESC) AS used FROM n WHERE r <= 900) SELECT {_ROW} FROM s WHERE used <= 9000""")
def retention_view(spark, sf_dir):
    return _rows(history.retained(events_as_entries(spark, sf_dir), 900, 9000, F.octet_length("request.path")))


@query(f"""{_FLAT} SELECT id, seq, protocol, epoch_us(ts) AS at_us, src, dst, coalesce(props, '') AS summary, status, CAST(code AS INTEGER) AS statusCode, ms, said AS response
 FROM l ORDER BY seq DESC LIMIT 100""")
def compact_records(spark, sf_dir):
    df = history.compact(history.latest(events_as_entries(spark, sf_dir), 100))
    return df.select("id", "seq", "protocol", F.unix_micros("timestamp").alias("at_us"), "src", "dst", "summary", "status", "statusCode", F.col("elapsedMs").alias("ms"), "response")


# --- summaries ---------------------------------------------------------------------------------

_BOTH = "SELECT src AS key, * EXCLUDE (src, dst) FROM l WHERE src <> '' UNION ALL SELECT dst, * EXCLUDE (src, dst) FROM l WHERE dst <> '' AND dst <> src"


@query(f"{_FLAT}, k AS ({_BOTH}) SELECT key, {_MEASURES}{_SEEN} FROM k GROUP BY key ORDER BY count DESC, errors DESC, key LIMIT 50")
def summary_workload(spark, sf_dir):
    return _flat_summary(summary(events_as_entries(spark, sf_dir), "workload", 50))


@query(f"{_FLAT}, k AS ({_BOTH}) SELECT key, {_MEASURES}{_SEEN} FROM k WHERE status <> 'success' GROUP BY key")
def summary_filtered(spark, sf_dir):
    return _flat_summary(summary(events_as_entries(spark, sf_dir), "workload", None, 'status != "success"'))


@query(f"{_FLAT}, k AS ({_BOTH}) SELECT key, {_MEASURES}{_SEEN} FROM k GROUP BY key ORDER BY count(*) FILTER (status = 'error') / count(*) DESC, key LIMIT 12")
def top_view_errors(spark, sf_dir):
    return _flat_summary(top_view(events_as_entries(spark, sf_dir), sort="errRate", limit=12))


@query(f"{_FLAT}, k AS ({_BOTH}) SELECT key, {_MEASURES}{_SEEN} FROM k GROUP BY key ORDER BY p95, key LIMIT 12")
def top_view_p95(spark, sf_dir):
    return _flat_summary(top_view(events_as_entries(spark, sf_dir), sort="p95", order="asc", limit=12))


@query(f"{_FLAT}, k AS (SELECT sns AS key, * FROM l WHERE sns <> '' UNION ALL SELECT dns, * FROM l WHERE dns <> '' AND dns <> sns) SELECT key, {_MEASURES}{_SEEN} FROM k GROUP BY key")
def summary_namespace(spark, sf_dir):
    return _flat_summary(summary(events_as_entries(spark, sf_dir), "namespace", None))


@query(f"{_FLAT}, k AS (SELECT CAST(code AS VARCHAR) AS key, * FROM l) SELECT key, {_MEASURES}{_SEEN} FROM k GROUP BY key")
def summary_field(spark, sf_dir):
    return _flat_summary(summary(events_as_entries(spark, sf_dir), "response.status", None))


@query(f"{_FLAT}, k AS (SELECT CASE WHEN sns <> '' THEN sns ELSE dns END AS key, * FROM l) SELECT key, {_MEASURES}{_SEEN} FROM k WHERE key <> '' GROUP BY key")
def summary_ns_getter(spark, sf_dir):
    return _flat_summary(summary(events_as_entries(spark, sf_dir), "ns", None))


def _timeline_sql(first: str, last: str, bucket: int, condition: str = "TRUE") -> str:
    grid = lambda t: f"CAST(floor((epoch({t}) + 62135596800) / {bucket}) * {bucket} - 62135596800 AS BIGINT)"
    start, until = f"(SELECT {grid(f"TIMESTAMP '{first}'")})", f"CAST(epoch(TIMESTAMP '{last}') AS BIGINT)"
    return f"""{_FLAT}, b AS (SELECT unnest(range({start}, {until} + 1, {bucket})) AS s)
     SELECT s AS start_s, count(id) AS entries, count(id) FILTER (status = 'error') AS errors, count(id) FILTER (status = 'warning') AS warnings
     FROM b LEFT JOIN (SELECT * FROM l WHERE {condition} AND ts <= TIMESTAMP '{last}') ON {grid('ts')} = s GROUP BY s"""


def _timeline_rows(df):
    return df.select(F.unix_seconds("start").alias("start_s"), "entries", "errors", "warnings")


@query(_timeline_sql("2024-01-03 00:00:30", "2024-01-03 06:00:00", 60))
def timeline_60s(spark, sf_dir):
    return _timeline_rows(timeline(events_as_entries(spark, sf_dir), datetime(2024, 1, 3, 0, 0, 30, tzinfo=UTC), datetime(2024, 1, 3, 6, tzinfo=UTC), 60))


@query(_timeline_sql("2024-01-03 09:55:01", "2024-01-03 10:55:00", 7, "protocol = 'http'"))
def timeline_gap_fill(spark, sf_dir):
    return _timeline_rows(timeline(events_as_entries(spark, sf_dir), datetime(2024, 1, 3, 9, 55, 1, tzinfo=UTC), datetime(2024, 1, 3, 10, 55, tzinfo=UTC), 7, 'protocol == "http"'))


@query(f"{_FLAT} SELECT src, dst, {_MEASURES} FROM l WHERE src <> '' AND dst <> '' GROUP BY src, dst")
def graph_all(spark, sf_dir):
    return graph(events_as_entries(spark, sf_dir))


@query(f"{_FLAT} SELECT src, dst, {_MEASURES} FROM l WHERE swl = 'wl-3' OR dwl = 'wl-3' GROUP BY src, dst")
def graph_focus(spark, sf_dir):
    return graph(events_as_entries(spark, sf_dir), focus="wl-3")


@query("""SELECT a.n_name AS src, b.n_name AS dst, count(*) AS count, count(*) FILTER (l_returnflag = 'R') AS errors, count(*) FILTER (l_returnflag = 'A') AS warnings,
 CAST(quantile_disc(CAST(floor(l_quantity) AS BIGINT), 0.5) AS BIGINT) AS p50, CAST(quantile_disc(CAST(floor(l_quantity) AS BIGINT), 0.95) AS BIGINT) AS p95, CAST(max(floor(l_quantity)) AS BIGINT) AS max
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY ALL""")
def graph_sales(spark, sf_dir):
    return graph(sales_as_entries(spark, sf_dir))


_NEWEST = f"{_FLAT}, n AS (SELECT *, sip AS a, dip AS b FROM l ORDER BY seq DESC LIMIT 800)"


@query(f"{_NEWEST} SELECT node, sum(i)::BIGINT AS calls_in, sum(o)::BIGINT AS calls_out, sum(x)::BIGINT AS errors_in FROM (SELECT a AS node, 0 AS i, 1 AS o, 0 AS x FROM n UNION ALL SELECT b, 1, 0, CASE WHEN status = 'error' THEN 1 ELSE 0 END FROM n) GROUP BY node")
def client_map_nodes(spark, sf_dir):
    return map_nodes(events_as_entries(spark, sf_dir))


@query(f"{_NEWEST} SELECT a AS src, b AS dst, count(*) AS count, count(*) FILTER (status = 'error') AS errors, sum(ms)::BIGINT AS latency FROM n GROUP BY a, b")
def client_map_edges(spark, sf_dir):
    return map_edges(events_as_entries(spark, sf_dir))


# --- comparing ---------------------------------------------------------------------------------


@query(f"""{_FLAT}, k AS (SELECT *, ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09' AS b, ts BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-23' AS a FROM ({_BOTH})),
 g AS (SELECT key, count(*) FILTER (b) AS before_count, count(*) FILTER (b AND status = 'error') AS before_errors, CAST(coalesce(quantile_disc(ms, 0.95) FILTER (b), 0) AS BIGINT) AS before_p95,
  count(*) FILTER (a) AS after_count, count(*) FILTER (a AND status = 'error') AS after_errors, CAST(coalesce(quantile_disc(ms, 0.95) FILTER (a), 0) AS BIGINT) AS after_p95 FROM k WHERE a OR b GROUP BY key),
 r AS (SELECT *, CASE WHEN before_count > 0 THEN before_errors / before_count ELSE 0.0::DOUBLE END AS before_rate, CASE WHEN after_count > 0 THEN after_errors / after_count ELSE 0.0::DOUBLE END AS after_rate FROM g)
 SELECT key, before_rate, after_rate, after_rate - before_rate AS rate_delta, before_count, before_errors, before_p95, after_count, after_errors, after_p95,
  CASE WHEN before_count = 0 THEN 'appeared' WHEN after_count = 0 THEN 'disappeared' ELSE 'changed' END AS status,
  after_count - before_count AS count_delta, after_errors - before_errors AS errors_delta, after_p95 - before_p95 AS p95_delta FROM r""")
def diff_windows(spark, sf_dir):
    day = lambda d: datetime(2024, 1, d, tzinfo=UTC)
    return compare.diff(events_as_entries(spark, sf_dir), (day(2), day(9)), (day(16), day(23)), limit=None)


@query(f"""{_FLAT}, n AS (SELECT * FROM l WHERE status IN ('error', 'warning') ORDER BY seq DESC LIMIT 2000)
 SELECT protocol, dwl AS workload, status, CAST(code AS INTEGER) AS "statusCode", regexp_replace(said, '[0-9]+', '#', 'g') AS summary, count(*) AS count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  array_to_string(list(id ORDER BY seq DESC)[1:3], ',') AS ids FROM n GROUP BY ALL""")
def error_clusters(spark, sf_dir):
    df = compare.error_clusters(events_as_entries(spark, sf_dir), limit=None)
    return df.select("protocol", "workload", "status", "statusCode", "summary", "count", F.unix_micros("firstSeen").alias("first_us"), F.unix_micros("lastSeen").alias("last_us"), F.array_join("ids", ",").alias("ids"))


# --- facets ------------------------------------------------------------------------------------

# Fixed values of a domain, as in the catalogue.
_DOMAIN = "UNION ALL SELECT unnest(['http','dns','redis','valkey','postgres','mysql','mongodb','kafka','tcp','udp','icmp','amqp','ws']), 0"


@query(f"{_FLAT} SELECT value, max(c)::BIGINT AS count FROM (SELECT protocol AS value, count(*) AS c FROM l GROUP BY 1 {_DOMAIN}) GROUP BY value")
def facet_values(spark, sf_dir):
    return facets.field_values(events_as_entries(spark, sf_dir), "protocol")


@query(f"{_FLAT} SELECT swl AS value, count(*) AS count FROM l WHERE starts_with(swl, 'wl-1') GROUP BY swl ORDER BY count DESC, value LIMIT 5")
def facet_prefix(spark, sf_dir):
    return facets.field_values(events_as_entries(spark, sf_dir), "src.workload", "WL-1", 5)


_FACETS = {"protocol": "protocol", "status": "status", "namespace": "CASE WHEN sns <> '' THEN sns ELSE dns END", "src.namespace": "sns", "src.workload": "swl", "dst.namespace": "dns", "dst.workload": "dwl", "src.ip": "sip", "dst.ip": "dip", "dst.port": "CAST(dport AS VARCHAR)", "http.method": "method", "response.status": "CAST(code AS VARCHAR)"}


@query(f"{_FLAT}, f AS ({' UNION ALL '.join(f"SELECT '{k}' AS field, {v} AS value FROM l" for k, v in _FACETS.items())}), c AS (SELECT field, value, count(*) AS count FROM f WHERE value <> '' GROUP BY ALL) "
       "SELECT field, value, count, CAST(row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 50")
def facet_topn(spark, sf_dir):
    return facets.facet_snapshot(events_as_entries(spark, sf_dir))


@query(ORACLE_SQL["facet_topn"])
def facet_sketched(spark, sf_dir):
    """The same from sketches of every day, merged; no field has more values than counters."""
    days = events_as_entries(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    return facets.sketched_snapshot(facets.facet_sketches(days, ("day",)))


@query(f"{_FLAT} SELECT 'request' AS side, 'user-agent' AS name, count(*) AS count FROM l UNION ALL SELECT 'response', CASE WHEN event_type = 'view' THEN 'content-type' ELSE 'x-served-by' END, count(*) FROM l GROUP BY 2")
def header_facets(spark, sf_dir):
    return facets.header_facets(events_as_entries(spark, sf_dir))


# --- statistics --------------------------------------------------------------------------------


@query(f"{_FLAT} SELECT 'total' AS kind, '' AS name, count(*) AS count FROM l UNION ALL SELECT 'protocol', protocol, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM l GROUP BY 2")
def stats_totals(spark, sf_dir):
    return stats.totals(events_as_entries(spark, sf_dir))


@query(f"""{_FLAT}, w AS (SELECT unnest([5, 60, 300]) AS seconds), a AS (SELECT *, CAST(epoch(TIMESTAMP '2024-01-20 12:00:00') AS BIGINT) - least(CAST(floor(epoch(ts)) AS BIGINT), CAST(epoch(TIMESTAMP '2024-01-20 12:00:00') AS BIGINT)) AS age FROM l)
 SELECT CAST(seconds AS INTEGER) AS seconds, count(id) AS entries, count(id) FILTER (status = 'error') AS errors, count(id) / seconds AS per_second FROM w LEFT JOIN a ON age < seconds GROUP BY seconds""")
def rate_windows(spark, sf_dir):
    return stats.trailing_windows(events_as_entries(spark, sf_dir), datetime(2024, 1, 20, 12, tzinfo=UTC))


@query(f"""{_FLAT} SELECT 'wirelake_entries_total ' || count(*) AS line FROM l UNION ALL SELECT 'wirelake_entries_by_protocol_total{{protocol="' || protocol || '"}} ' || count(*) FROM l GROUP BY protocol
 UNION ALL SELECT 'wirelake_entries_by_status_total{{status="' || status || '"}} ' || count(*) FROM l GROUP BY status""")
def metrics_text(spark, sf_dir):
    return stats.exposition(stats.totals(events_as_entries(spark, sf_dir)))


@query("SELECT 'node-' || (user_id % 5) AS node, epoch_us(max(ts)) AS at_us, sum(event_id)::BIGINT AS entries, max_by(value, (ts, value)) > 100 AS connected FROM events GROUP BY 1")
def worker_registry(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    reports = e.select(F.concat(F.lit("node-"), F.col("user_id") % 5).alias("node"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("entries"), (F.col("value") > 100).alias("connected"))
    return stats.workers(reports, datetime(2024, 1, 30, tzinfo=UTC), 10**9).select("node", F.unix_micros("at").alias("at_us"), "entries", "connected")


@query("""WITH w AS (SELECT 'node-' || (user_id % 5) AS node, sum(event_id)::BIGINT AS n, max_by(value, (ts, value)) > 100 AS c, max(event_id) AS d FROM events GROUP BY 1)
 SELECT 'wirelake_worker_entries_total{node="' || node || '"} ' || n AS line FROM w UNION ALL SELECT 'wirelake_worker_connected{node="' || node || '"} ' || CAST(c AS INTEGER) FROM w UNION ALL SELECT 'wirelake_worker_ring_drops_total{node="' || node || '"} ' || d FROM w""")
def worker_metrics(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("node", F.concat(F.lit("node-"), F.col("user_id") % 5))
    w = e.groupBy("node").agg(F.sum("event_id").alias("entries"), (F.max_by("value", F.struct("ts", "value")) > 100).alias("connected"), F.max("event_id").alias("ringDrops"))
    return stats.worker_exposition(w)


#: What workers send: a frame per event, by kind of event; every 41st ends its connection.
_FRAMES = """CASE WHEN event_id % 41 = 0 THEN NULL
 WHEN event_type = 'signup' THEN '{"type": "hello", "hello": {"node": "node-' || user_id % 7 || '", "version": "1.' || event_id % 9 || '"}}'
 WHEN event_type = 'view' THEN '{"type": "entry", "entry": {"id": "e' || event_id || '"}}'
 WHEN event_type = 'click' THEN '{"type": "entryBatch", "entries": [{"id": "a"}, null, {"id": "b"}]}'
 WHEN event_type = 'error' THEN '{"type": "workerStats", "workerStats": {"dropped": ' || event_id || ', "captureLive": ' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "ringDrops": ' || user_id || '}}'
 ELSE '{"type": "stats"' END"""


@query("""WITH f AS (SELECT user_id AS conn, ts AS t, event_id AS place, user_id, CASE WHEN event_id % 41 = 0 THEN 'end' ELSE event_type END AS kind FROM events WHERE event_type <> 'purchase' OR event_id % 41 = 0),
 n AS (SELECT *, last_value(CASE WHEN kind = 'signup' THEN 'node-' || user_id % 7 END IGNORE NULLS) OVER (PARTITION BY conn ORDER BY t, place ROWS UNBOUNDED PRECEDING) AS node FROM f),
 g AS (SELECT node, arg_max((kind = 'signup'), (t, place)) FILTER (kind IN ('signup', 'end')) AS connected, '1.' || arg_max(place % 9, (t, place)) FILTER (kind = 'signup') AS version,
  epoch_us(max(t) FILTER (kind = 'signup')) AS connected_us, epoch_us(max(t) FILTER (kind <> 'end')) AS seen_us, CAST(sum(CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END) AS BIGINT) AS entries,
  arg_max(place, (t, place)) FILTER (kind = 'error') AS dropped, arg_max(user_id, (t, place)) FILTER (kind = 'error') AS ring FROM n WHERE node IS NOT NULL GROUP BY node)
 SELECT node, connected, version, connected_us, seen_us, entries, coalesce(dropped, -1) AS dropped, coalesce(ring, -1) AS ring, coalesce(ring % 2 = 0, FALSE) AS live FROM g WHERE connected OR seen_us >= epoch_us(TIMESTAMP '2024-01-30 20:00:00') - 21600000000""")
def worker_connections(spark, sf_dir):
    """The registry that frames of workers leave: greetings, entries, reports and ended connections."""
    frames = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("conn"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("place"), F.expr(_FRAMES).alias("value"))
    out = stats.registry(worker_frames(frames), datetime(2024, 1, 30, 20, tzinfo=UTC), 6 * 3600)
    return out.select("node", "connected", "version", F.unix_micros("connectedAt").alias("connected_us"), F.unix_micros("lastSeen").alias("seen_us"), "entries", F.coalesce("dropped", F.lit(-1)).alias("dropped"), F.coalesce("ringDrops", F.lit(-1)).alias("ring"), F.coalesce("captureLive", F.lit(False)).alias("live"))


# --- joins -------------------------------------------------------------------------------------


@query(f"""{_FLAT} SELECT id, CASE WHEN c_custkey IS NULL THEN '' ELSE c_name END AS src_name, CASE WHEN swl <> '' THEN swl WHEN c_custkey IS NULL THEN '' ELSE c_mktsegment END AS src_workload
 FROM l LEFT JOIN customer ON sip = '10.0.1.' || c_custkey""")
def enrichment_join(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    ids = c.select(F.concat(F.lit("10.0.1."), "c_custkey").alias("ip"), F.col("c_name").alias("name"), F.lit("sales").alias("namespace"), F.col("c_mktsegment").alias("workload"))
    out = identity.enrich(events_as_entries(spark, sf_dir), ids)
    return out.select("id", text("src.name").alias("src_name"), text("src.workload").alias("src_workload"))


@query("""WITH p AS (SELECT '10.9.' || (c_custkey % 200) AS ip, c_name AS name, 'ns' || (c_nationkey % 3) AS namespace, regexp_replace('app-' || c_nationkey || '-abc12', '-[a-z0-9]+$', '') AS workload, 0 AS r FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT '10.9.' || (s_suppkey * 7 % 400), s_name, 'svc', s_name, 1 FROM supplier)
 SELECT ip, name, namespace, workload FROM p QUALIFY row_number() OVER (PARTITION BY ip ORDER BY r, namespace, name) = 1""")
def identity_build(spark, sf_dir):
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    ip = lambda e: F.array(F.concat(F.lit("10.9."), e))
    pods = c.select(F.col("c_name").alias("name"), F.concat(F.lit("ns"), F.col("c_nationkey") % 3).alias("namespace"), ip(F.col("c_custkey") % 200).alias("ips"), (F.col("c_custkey") % 10 == 0).alias("hostNetwork"), F.lit("ReplicaSet").alias("ownerKind"), F.concat(F.lit("app-"), "c_nationkey", F.lit("-abc12")).alias("owner"))
    services = s.select(F.col("s_name").alias("name"), F.lit("svc").alias("namespace"), ip(F.col("s_suppkey") * 7 % 400).alias("ips"))
    return identity.build_identities(pods, services)


def _messages_of(e: DataFrame, *more: str) -> DataFrame:
    return e.select((F.col("user_id") % 40).alias("conn"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").isin("view", "click", "purchase").alias("is_request"), (F.col("event_id") % 50).alias("number"), *more)


def _messages(spark, sf_dir):
    return _messages_of(read_table(spark, sf_dir, "events"))


_MESSAGES = "m AS (SELECT user_id % 40 AS conn, ts, event_id AS seq, event_type IN ('view', 'click', 'purchase') AS is_request, event_id % 50 AS number FROM events)"


#: A month in a minute and a half, two thirds of it on one connection: requests expire, and queues overflow.
_RUSH = "rush AS (SELECT CASE WHEN user_id % 3 > 0 THEN 0 ELSE user_id % 40 END AS conn, epoch_us(ts) // 30000 AS us, event_id AS seq, event_type <> 'error' AS is_request FROM events)"


def _rush_columns(e: DataFrame, *more: str) -> DataFrame:
    us = F.expr("unix_micros(CAST(ts AS timestamp)) div 30000")
    return e.select(F.when(F.col("user_id") % 3 > 0, 0).otherwise(F.col("user_id") % 40).alias("conn"), F.timestamp_micros(us).alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("is_request"), *more)


def _fifo_sql(seconds: int, backlog: int, columns: str = "request_seq, response_seq, elapsed_ms, depth") -> str:
    """Queues by recursion: ``head`` is the number of the request that is next after each message."""
    return f"""WITH RECURSIVE {_RUSH}, p AS MATERIALIZED (SELECT *, row_number() OVER w AS n, sum(CAST(is_request AS INTEGER)) OVER (PARTITION BY conn ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS t,
  1 + coalesce(sum(CAST(is_request AS INTEGER)) OVER (PARTITION BY conn ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {seconds * 10**6 + 1} PRECEDING), 0) AS fresh FROM rush WINDOW w AS (PARTITION BY conn ORDER BY us, seq)),
 q AS (SELECT conn, n, us, seq, is_request, t, CAST(greatest(fresh, t - {backlog - 1}) AS BIGINT) AS first, CAST(greatest(fresh, t - {backlog}) AS BIGINT) AS kept FROM p),
 w AS (SELECT conn, 0::BIGINT AS n, 1::BIGINT AS head, NULL::BIGINT AS took, NULL::BIGINT AS depth FROM (SELECT DISTINCT conn FROM rush)
  UNION ALL SELECT q.conn, q.n, CASE WHEN q.is_request THEN greatest(w.head, q.first) ELSE least(greatest(w.head, q.first) + 1, q.t + 1) END,
   CASE WHEN NOT q.is_request AND greatest(w.head, q.first) <= q.t THEN greatest(w.head, q.first) END, CASE WHEN q.is_request THEN q.t - greatest(w.head, q.kept) END FROM w JOIN q ON q.conn = w.conn AND q.n = w.n + 1),
 m AS (SELECT q.*, w.took, w.depth FROM q JOIN w USING (conn, n)),
 pairs AS (SELECT a.conn, a.seq AS request_seq, b.seq AS response_seq, (b.us - a.us) // 1000 AS elapsed_ms, a.depth FROM m a JOIN m b ON a.conn = b.conn AND b.took = a.t WHERE a.is_request)
 SELECT conn, {columns} FROM pairs"""


@query(_fifo_sql(30, 1024))
def fifo_pairing(spark, sf_dir):
    return pairing.fifo_pairs(_rush_columns(read_table(spark, sf_dir, "events")))


@query(_fifo_sql(2, 16))
def fifo_pairing_short(spark, sf_dir):
    """The same with queues of 16 that forget after two seconds."""
    return pairing.fifo_pairs(_rush_columns(read_table(spark, sf_dir, "events")), 2, 16)


def _dns_sql(milliseconds: str) -> str:
    return f"""WITH {_MESSAGES}, t AS (SELECT *, sum(CASE WHEN is_request THEN 1 ELSE 0 END) OVER (PARTITION BY conn, number ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS turn FROM m)
 SELECT q.conn, q.number, q.seq AS request_seq, r.seq AS response_seq, (epoch_us(r.ts) - epoch_us(q.ts)) // 1000 AS elapsed_ms FROM t q JOIN (SELECT *, row_number() OVER (PARTITION BY conn, number, turn ORDER BY ts, seq) AS n FROM t WHERE NOT is_request) r
 ON q.conn = r.conn AND q.number = r.number AND q.turn = r.turn WHERE q.is_request AND r.n = 1 AND (epoch_us(r.ts) - epoch_us(q.ts)) // 1000 <= {milliseconds}"""


@query(_dns_sql("200000000"))
def dns_interval_pairing(spark, sf_dir):
    return pairing.keyed_pairs(_messages(spark, sf_dir), ["conn", "number"], 200_000)


@query(f"""WITH {_MESSAGES} SELECT a.conn, a.seq, coalesce(max(b.seq), -1) AS latest FROM m a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conn ORDER BY ts, seq) FROM m WHERE NOT is_request) b ON a.conn = b.conn AND b.ts <= a.ts
 AND b.ts = (SELECT max(c.ts) FROM m c WHERE NOT c.is_request AND c.conn = a.conn AND c.ts <= a.ts) WHERE a.is_request GROUP BY a.conn, a.seq""")
def l4_attach(spark, sf_dir):
    m = _messages(spark, sf_dir)
    snapshots = m.filter("not is_request").groupBy("conn", "ts").agg(F.max("seq").alias("latest"))
    return pairing.attach_latest(m.filter("is_request").select("conn", "ts", "seq"), snapshots, value="latest").select("conn", "seq", F.coalesce("latest", F.lit(-1)).alias("latest"))


_PACKETS = """p AS (SELECT user_id % 40 AS conn, ts, event_id AS seq, 40000 + user_id % 2 * 20000 AS sport, 50000 AS dport, CAST(floor(value) AS BIGINT) AS length,
 CAST(CASE event_type WHEN 'signup' THEN 17 WHEN 'view' THEN 24 WHEN 'error' THEN 2 WHEN 'click' THEN 18 ELSE 48 END AS INTEGER) AS flags,
 event_id % 700 + 800 AS mss, event_id % 60000 AS win FROM events)"""


def _packets_of(e: DataFrame, *more: str) -> DataFrame:
    return e.select((F.col("user_id") % 40).alias("conn"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("src"), (40000 + F.col("user_id") % 2 * 20000).alias("sport"), F.lit(50000).alias("dport"), F.floor("value").cast("bigint").alias("length"),
                       F.expr("CASE event_type WHEN 'signup' THEN 17 WHEN 'view' THEN 24 WHEN 'error' THEN 2 WHEN 'click' THEN 18 ELSE 48 END").alias("flags"), (F.col("event_id") % 700 + 800).alias("mss"), (F.col("event_id") % 60000).alias("window"), *more)


# Flags of one side by name.
_FLAGS = lambda side: "concat_ws(',', " + ", ".join(f"CASE WHEN coalesce(bit_or(flags) FILTER ({side}), 0) & {b} <> 0 THEN '{n}' END" for n, b in (("SYN", 2), ("ACK", 16), ("FIN", 1), ("RST", 4), ("PSH", 8), ("URG", 32))) + ")"


def _sessions_sql(columns: str) -> str:
    return f"""WITH {_PACKETS}, g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000, FALSE) AS gap, flags & 18 = 2 AS syn,
  coalesce(sum(CAST(flags & 5 <> 0 AS INTEGER)) OVER (PARTITION BY conn ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends FROM p WINDOW w AS (PARTITION BY conn ORDER BY ts, seq)),
 h AS (SELECT *, coalesce(max(CASE WHEN gap OR syn THEN ends END) OVER (PARTITION BY conn ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM g),
 s AS (SELECT *, CAST(sum(CAST(gap OR (syn AND ends > known) AS INTEGER)) OVER (PARTITION BY conn ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM h),
 c AS (SELECT *, coalesce(max(flags & 5 <> 0) OVER (PARTITION BY conn, session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS closed FROM s),
 z AS (SELECT conn, session, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS packets, sum(length)::BIGINT AS bytes, coalesce(sum(length) FILTER (sport >= dport), 0)::BIGINT AS client_bytes, count(*) FILTER (sport < dport) AS server_packets,
  coalesce(sum(length) FILTER (sport < dport), 0)::BIGINT AS server_bytes, count(*) FILTER (sport >= dport) AS client_packets, {_FLAGS('sport >= dport')} AS client_flags, {_FLAGS('sport < dport')} AS server_flags,
  max(mss) AS mss, max_by(win, (ts, seq)) AS window_size, coalesce((min(epoch_us(ts)) FILTER (flags & 18 = 18) - min(epoch_us(ts)) FILTER (flags & 18 = 2)) / 1000, -1e9) AS rtt_ms,
  coalesce(max_by(seq, (ts, seq)) FILTER (sport >= dport AND flags & 18 = 2), -1) AS seq_start, coalesce(max_by(seq, (ts, seq)) FILTER (sport < dport AND flags & 18 = 18), -1) AS ack_start
 FROM c WHERE NOT closed GROUP BY conn, session)
 SELECT conn, {columns} FROM z"""


@query(_sessions_sql("session, started_us, ended_us, packets, bytes, client_bytes, server_bytes, client_packets, server_packets, client_flags, server_flags, mss, window_size, rtt_ms, seq_start, ack_start"))
def flow_sessions(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    packets = _packets_of(e)
    out = flows.sessions(packets, 4 * 3600)
    return out.select("conn", "session", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "packets", "bytes", "client_bytes", "server_bytes", "client_packets", "server_packets", "client_flags", "server_flags", "mss", F.col("window").alias("window_size"), F.coalesce("rtt_ms", F.lit(-1e9)).alias("rtt_ms"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("seq_start", "ack_start")])


@query("""SELECT event_id, CASE WHEN a < b THEN a || '|' || b ELSE b || '|' || a END AS conn
 FROM (SELECT event_id, '10.0.1.' || user_id % 250 || ':' || (30000 + event_id % 9) AS a, '10.0.2.9:' || (8000 + user_id % 3) AS b FROM events)""")
def connection_keys(spark, sf_dir):
    """One key for both directions: every other event has its ends changed over."""
    n, user = F.col("event_id"), F.col("user_id")
    client, server = F.struct(F.concat(F.lit("10.0.1."), user % 250).alias("ip"), (30000 + n % 9).alias("port")), F.struct(F.lit("10.0.2.9").alias("ip"), (8000 + user % 3).alias("port"))
    ends = read_table(spark, sf_dir, "events").select("event_id", F.when(n % 2 == 0, client).otherwise(server).alias("a"), F.when(n % 2 == 0, server).otherwise(client).alias("b"))
    return ends.select("event_id", pairing.connection(F.col("a.ip"), F.col("a.port"), F.col("b.ip"), F.col("b.port")).alias("conn"))


# --- requests with parameters --------------------------------------------------------------------

_NOW = datetime(2024, 1, 30, tzinfo=UTC)


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE protocol = 'http' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY - INTERVAL 12 HOUR AND ts <= TIMESTAMP '2024-01-29 18:00:00' ORDER BY seq DESC LIMIT 10000")
def api_entries(spark, sf_dir):
    """Times as a duration and in RFC 3339, a limit beyond the largest."""
    return _rows(Traffic(events_as_entries(spark, sf_dir), now=_NOW).entries("protocol == http", "36h", "2024-01-29T20:00:00+02:00", "5000000"))


@query(f"""{_FLAT}, b AS (SELECT (TIMESTAMP '2024-01-29 23:45:00' + k * INTERVAL 1 MINUTE) AS t FROM range(16) r(k))
 SELECT epoch_us(t) AS start_us, count(seq) AS entries, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'warning') AS warnings FROM b LEFT JOIN l ON ts >= t AND ts < t + INTERVAL 1 MINUTE AND ts <= TIMESTAMP '2024-01-30' GROUP BY t""")
def timeline_defaults(spark, sf_dir):
    """Without parameters: the last quarter of an hour by minutes."""
    return Traffic(events_as_entries(spark, sf_dir), now=_NOW).timeline().select(F.unix_micros("start").alias("start_us"), "entries", "errors", "warnings")


@query(f"""{_FLAT}, c AS (SELECT kind, name, count(*) AS n, count(*) FILTER (name = 'dns' OR ts < TIMESTAMP '2024-01-10') AS was FROM (SELECT 'total' AS kind, '' AS name, ts FROM l UNION ALL SELECT 'protocol', protocol, ts FROM l UNION ALL SELECT 'status', status, ts FROM l) GROUP BY ALL)
 SELECT kind, name, greatest(n - was, 0) AS count FROM c WHERE kind <> 'protocol' OR n > was""")
def stats_baseline(spark, sf_dir):
    """Totals since a snapshot, in which all of one protocol had been seen."""
    entries = events_as_entries(spark, sf_dir)
    early = F.col("timestamp") < F.lit(datetime(2024, 1, 10, tzinfo=UTC))
    snapshot = stats.totals(entries.filter(early)).filter("name <> 'dns'").unionByName(stats.totals(entries).filter("name = 'dns'"))
    return stats.since_clear(stats.totals(entries), snapshot)


@query("SELECT h AS at_us, n FROM (SELECT epoch_us(date_trunc('hour', ts)) AS h, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 300)")
def stats_history(spark, sf_dir):
    """The newest 300 of a series of hourly samples."""
    points = read_table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp")).agg(F.count("*").alias("n"))
    return stats.stats_history(points).select(F.unix_micros("timestamp").alias("at_us"), "n")


# --- every field ---------------------------------------------------------------------------------

#: Fields that are put together from several members: their value in SQL.
_COMPOSED = {
    "namespace": "CASE WHEN {src.namespace} <> '' THEN {src.namespace} ELSE {dst.namespace} END",
    "summary": "{request.summary} || ' ' || {response.summary}",
    "response.contenttype": "CASE WHEN {response.contentType} <> '' THEN {response.contentType} ELSE {request.contentType} END",
    "dns.type": f"CASE WHEN n % {varied.ABSENT['request.dns']} = 0 THEN '' WHEN n % 2 = 0 THEN 'MX' ELSE 'TXT' END",
    "amqp.method": "CASE WHEN n % 5 = 1 THEN {request.method} ELSE '' END",
}


#: Where each other field lies in an entry.
_PATHS = {
    "protocol": "protocol", "status": "status", "node": "node", "elapsedMs": "elapsedMs", "src.name": "src.name", "src.namespace": "src.namespace",
    "src.workload": "src.workload", "dst.name": "dst.name", "dst.namespace": "dst.namespace", "dst.workload": "dst.workload", "src.ip": "src.ip",
    "dst.ip": "dst.ip", "src.port": "src.port", "dst.port": "dst.port", "http.method": "request.method", "response.status": "statusCode",
    "request.host": "request.host", "request.path": "request.path", "dns.question": "request.question", "dns.answer": "response.answer",
    "redis.command": "request.command", "postgres.query": "request.query", "request.body": "request.body", "response.body": "response.body",
    "bytes": "request.bytes", "packets": "request.packets", "flags": "request.flags", "trace.id": "traceId", "http.version": "request.http.version",
    "dns.rcode": "response.dns.rcode", "redis.db": "request.redis.dbIndex", "redis.reply": "response.redis.reply",
    "postgres.error": "response.postgres.error.code", "postgres.statement": "request.postgres.statementName",
    "postgres.txstatus": "response.postgres.txStatus", "mysql.command": "request.mysql.command", "mysql.error": "response.mysql.errorCode",
    "mongo.collection": "request.mongo.collection", "mongo.command": "request.mongo.command", "kafka.topic": "request.kafka.topic",
    "kafka.apikey": "request.kafka.apiKey", "l4.ttl": "l4.ttl", "l4.retransmits": "l4.retransmits", "l4.window": "l4.window", "l4.mss": "l4.mss",
    "l4.rttms": "l4.rttMs", "l4.durationms": "l4.durationMs", "l4.clientbytes": "l4.clientBytes", "l4.serverbytes": "l4.serverBytes",
    "tls.sni": "l4.tls.sni", "amqp.class": "request.class", "amqp.exchange": "request.exchange", "amqp.routingkey": "request.routingKey",
    "amqp.queue": "request.queue", "amqp.deliverytag": "request.deliveryTag", "amqp.correlationid": "request.correlationId",
    "amqp.replyto": "request.replyTo", "ws.opcode": "request.wsOpcode", "redis.pipelinedepth": "request.redis.pipelineDepth",
    "postgres.portal": "request.postgres.portal", "dns.authoritative": "response.dns.authoritative",
    "dns.recursionavailable": "response.dns.recursionAvailable", "request.size": "request.size", "response.size": "response.size",
    "postgres.rowcount": "response.rowCount", "http.ttfbms": "response.http.ttfbMs", "l4.srcmac": "l4.srcMac", "l4.dstmac": "l4.dstMac",
    "l4.ipversion": "l4.ipVersion", "l4.ipflags": "l4.ipFlags", "l4.clienttcpflags": "l4.clientTcpFlags", "l4.servertcpflags": "l4.serverTcpFlags",
    "l4.seqstart": "l4.seqStart", "l4.ackstart": "l4.ackStart", "l4.clientpackets": "l4.clientPackets", "l4.serverpackets": "l4.serverPackets",
}


def _sql_value(name: str) -> str:
    """A field of ``varied_entries`` as text, empty where it is absent, in SQL over n and u."""
    made = varied.values()

    def shown(path):
        parts = path.split(".")
        there = [f"n % {varied.ABSENT[p]} <> 0" for p in (".".join(parts[:k]) for k in range(1, len(parts))) if p in varied.ABSENT]
        value = f"CAST({made[path]} AS STRING)"
        if path == "l4.rttMs":
            value = f"regexp_replace({value}, '[.]0$', '')"
        if path == "response.mysql.errorCode":  # no error has no text
            value = f"CASE WHEN {made[path]} = 0 THEN '' ELSE {value} END"
        return f"(CASE WHEN {' AND '.join(there)} THEN {value} ELSE '' END)" if there else f"({value})"

    if name in _COMPOSED:
        sql = _COMPOSED[name]
        for path in made:
            sql = sql.replace("{" + path + "}", shown(path))
        return sql
    return shown(_PATHS[name])


_EVENTS = "FROM (SELECT event_id AS n, user_id AS u FROM events)"
_NAMES = sorted(_PATHS | _COMPOSED)


@query(f"SELECT n + 1 AS seq, {', '.join(f'{_sql_value(f)} AS {chr(34)}{f}{chr(34)}' for f in _NAMES)} {_EVENTS}")
def field_values(spark, sf_dir):
    """Every field of every entry, as text."""
    df = varied.varied_entries(spark, sf_dir)
    return df.select("seq", *[fields.find(f).text().alias(f) for f in _NAMES])


def _tests(name: str) -> list[tuple[str, str]]:
    """(operator, literal) pairs that a field is tested with."""
    if fields.catalogue()[name].numeric:
        return [(op, n) for op in ("==", "!=", "<", ">=") for n in ("0", "4", "1045", "500.5")]
    return [("==", "http"), ("!=", "GET"), ("contains", "a"), ("startswith", "S"), ("matches", "^[a-z]+-1$"), ("in", "(job-2, true, MX, Basic)")]


def _sql_test(name: str, op: str, literal: str) -> str:
    """The same test in SQL. Numbers that an object lacks pass no order; equality is that of texts."""
    v = _sql_value(name)
    sides = [f"CAST({varied.values()[p]} AS STRING)" for p in ("src.namespace", "dst.namespace")] if name == "namespace" else [v]
    any_of = lambda t: "(" + " OR ".join(t.format(f"lower({s})") for s in sides) + ")"
    low = literal.lower()
    if op in ("<", ">="):
        return f"({v} <> '' AND TRY_CAST({v} AS DOUBLE) {op} {literal})"
    if op == "matches":
        return "(" + " OR ".join(f"regexp_matches({s}, '{literal}')" for s in sides) + ")"
    if op == "in":
        return any_of("{} IN (" + ", ".join(f"'{x.strip()}'" for x in low.strip("()").split(",")) + ")")
    shape = {"==": "{} = '%s'", "!=": "{} = '%s'", "contains": "contains({}, '%s')", "startswith": "starts_with({}, '%s')"}[op] % low
    return f"NOT {any_of(shape)}" if op == "!=" else any_of(shape)


@query(" UNION ALL ".join(f"SELECT '{f} {op} {x}' AS test, count(*) FILTER ({_sql_test(f, op, x)}) AS matched {_EVENTS}" for f in _NAMES for op, x in _tests(f)))
def field_tests(spark, sf_dir):
    """How many entries pass each of some tests of every field, counted in one pass."""
    tests = [(f, op, x) for f in _NAMES for op, x in _tests(f)]
    row = varied.varied_entries(spark, sf_dir).agg(*[F.count_if(ifl.flag(f"{f} {op} {x if op == 'in' else chr(34) + x + chr(34)}")).alias(f"t{i}") for i, (f, op, x) in enumerate(tests)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f"{f} {op} {x}").alias("test"), F.col(f"t{i}").alias("matched")) for i, (f, op, x) in enumerate(tests)])).alias("r")).select("r.*")


@query(f"SELECT n + 1 AS seq {_EVENTS} WHERE n % 6 = 4 OR u % 5 = 3")
def filter_headers_both(spark, sf_dir):
    return varied.varied_entries(spark, sf_dir).filter(ifl.where('response.header.Server == "EDGE-4" or request.header.x-tenant startswith tenant-3')).select("seq")


# --- functions ---------------------------------------------------------------------------------


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS folded FROM documents")
def digit_normalize(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", compare.digits_folded(F.col("text")).alias("folded"))


# Queries of URLs, and what is shown of them.
_SECRETS = [
    ("'?b=2&token=' || page_id || '&a=1&Password=x%20y&a=' || page_id", "'?Password=%5BREDACTED%5D&a=1&a=' || page_id || '&b=2&token=%5BREDACTED%5D'"),
    ("'?a+b=/' || page_id || '&%74oken=' || page_id || '&api%5Fkey=1&token=2'", "'?a+b=%2F' || page_id || '&api_key=%5BREDACTED%5D&token=%5BREDACTED%5D'"),
    ("'?token=' || page_id || '&b=%zz'", "'?%5BREDACTED%5D'"),
    ("'?token=' || page_id || ';c=1'", "'?%5BREDACTED%5D'"),
    ("'?q=a+b&sort=' || page_id || '&tokens=%41'", "'?q=a+b&sort=' || page_id || '&tokens=%41'"),
]
_CASE = lambda k: "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(_SECRETS)) + " END"


@query(f"SELECT page_id, split_part(url, '?', 1) || {_CASE(1)} AS shown FROM pages")
def redact_query(spark, sf_dir):
    urls = read_table(spark, sf_dir, "pages").withColumn("url", F.expr(f"substring_index(url, '?', 1) || {_CASE(0)}"))
    return urls.select("page_id", fn.redacted_url(F.col("url")).alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN md5(CAST(event_id AS VARCHAR)) WHEN event_id % 3 = 1 THEN 'req-' || event_id ELSE '' END AS trace FROM events")
def trace_id(spark, sf_dir):
    n = F.col("event_id")
    headers = F.when(n % 3 == 0, F.create_map(F.lit("traceparent"), F.concat(F.lit("00-"), F.md5(n.cast("string")), F.lit("-00f067aa0ba902b7-01")))).when(n % 3 == 1, F.create_map(F.lit("x-request-id"), F.concat(F.lit("req-"), n))).otherwise(F.create_map(F.lit("accept"), F.lit("*")))
    return read_table(spark, sf_dir, "events").select("event_id", fn.trace_id(headers).alias("trace"))


@query("SELECT doc_id, CASE WHEN m < 1024 THEN m || ' B' WHEN m < 1048576 THEN printf('%.1f KB', m / 1024.0) ELSE printf('%.1f MB', m / 1048576.0) END AS size FROM (SELECT doc_id, n_chars * 4096 // (1 + doc_id % 4096) AS m FROM documents)")
def human_bytes(spark, sf_dir):
    """Sizes from bytes to megabytes, made from lengths."""
    size = F.expr("n_chars * 4096 div (1 + doc_id % 4096)")
    return read_table(spark, sf_dir, "documents").select("doc_id", fn.human_bytes(size).alias("size"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS text FROM documents")
def collapse_whitespace(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", fn.collapsed(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, text AS back, sha256(text) AS sha FROM conversations")
def hexdump_roundtrip(spark, sf_dir):
    back = fn.hex_undump(fn.hex_dump(F.col("text").cast("binary")))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", back.cast("string").alias("back"), F.sha2(back, 256).alias("sha"))


@query(f"{_FLAT} SELECT src, dst, count(*) AS count FROM l GROUP BY ALL")
def json_roundtrip(spark, sf_dir):
    lines = events_as_entries(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    return from_json_lines(lines).groupBy(label("src").alias("src"), label("dst").alias("dst")).agg(F.count("*").alias("count"))


@query(f"""{_FLAT} SELECT id, epoch_us(ts) AS at_us, protocol, status, CAST(code AS INTEGER) AS "statusCode", ms AS "elapsedMs", sip AS source, -1 AS "sourcePort", dip AS destination, CAST(dport AS INTEGER) AS "destinationPort", method, path, coalesce(props, '') AS request, said AS response
 FROM l""")
def csv_export(spark, sf_dir):
    """All entries; they have no source port, shown as -1."""
    df = exporting.csv_rows(events_as_entries(spark, sf_dir))
    return df.withColumn("at_us", F.unix_micros("timestamp")).withColumn("sourcePort", F.coalesce("sourcePort", F.lit(-1))).drop("timestamp")


@query("""WITH RECURSIVE p AS MATERIALIZED (SELECT user_id % 40 AS conn, event_id % 100 AS seq, event_id % 7 AS n, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id % 100, event_id % 7) AS r FROM events WHERE event_id % 7 > 0),
 w AS (SELECT conn, r, seq + n AS want, 0 AS again FROM p WHERE r = 1
  UNION ALL SELECT p.conn, p.r, CASE WHEN p.seq >= w.want THEN p.seq + p.n ELSE w.want END, w.again + CASE WHEN p.seq < w.want THEN 1 ELSE 0 END FROM w JOIN p ON p.conn = w.conn AND p.r = w.r + 1)
 SELECT c.conn, '10.0.0.1' AS src, 4000 AS sport, coalesce(max(again), 0)::BIGINT AS retransmits FROM (SELECT DISTINCT user_id % 40 AS conn FROM events) c LEFT JOIN w ON c.conn = w.conn GROUP BY c.conn""")
def retransmits(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return flows.retransmits(e.select((F.col("user_id") % 40).alias("conn"), F.col("ts"), F.lit("10.0.0.1").alias("src"), F.lit(4000).alias("sport"), (F.col("event_id") % 100).alias("seq"), (F.col("event_id") % 7).alias("length")))


@query("""WITH p AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'tcp' ELSE 'udp' END AS proto, CASE event_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 5432 ELSE 20000 + user_id END AS port FROM events),
 names AS (SELECT * FROM (VALUES (22, 'ssh'), (25, 'smtp'), (110, 'pop3'), (143, 'imap'), (443, 'https'), (587, 'smtp'), (853, 'dns-tls'), (1433, 'mssql'), (2181, 'zookeeper'), (2379, 'etcd'),
  (3306, 'mysql'), (3389, 'rdp'), (5432, 'postgres'), (5672, 'amqp'), (6379, 'redis'), (8883, 'mqtt'), (9042, 'cassandra'), (9092, 'kafka'), (11211, 'memcached'), (27017, 'mongodb')) AS t(port, name))
 SELECT event_id, CASE WHEN name IS NULL THEN proto || '/' || p.port ELSE proto || ' ' || name END AS label FROM p LEFT JOIN names ON p.port = names.port""")
def port_labels(spark, sf_dir):
    n, own = F.col("event_id") % 4, 20000 + F.col("user_id")
    port = F.when(n == 0, 443).when(n == 1, 5432).otherwise(own)
    return read_table(spark, sf_dir, "events").select("event_id", fn.port_label(F.when(n % 2 == 0, "tcp").otherwise("udp"), port).alias("label"))


@query("""SELECT event_id, 'accept=a/' || user_id || CASE WHEN event_id % 2 = 0 THEN ';Authorization=[REDACTED];x-api-key=[REDACTED]' ELSE ';Set-Cookie=[REDACTED]' END || ';x-tenant=t' || event_id AS shown FROM events""")
def redact_headers(spark, sf_dir):
    user, n = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    first, last = (F.lit("accept"), F.concat(F.lit("a/"), user)), (F.lit("x-tenant"), F.concat(F.lit("t"), n))
    even = F.create_map(*first, F.lit("Authorization"), F.concat(F.lit("Basic "), n), F.lit("x-api-key"), n, *last)
    odd = F.create_map(*first, F.lit("Set-Cookie"), F.concat(F.lit("k="), n), *last)
    shown = fn.redacted_headers(F.when(F.col("event_id") % 2 == 0, even).otherwise(odd))
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(F.map_entries(shown), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("shown"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN '[REDACTED] [REDACTED]' WHEN 'click' THEN '3 auth [REDACTED] [REDACTED] SETNAME c' || user_id WHEN 'purchase' THEN 'SET requirepass [REDACTED] dir /d' || user_id WHEN 'signup' THEN 'k' || user_id || ' ' || event_id ELSE 'GET masterauth' END AS args,
 '[REDACTED],[REDACTED]' AS params FROM events""")
def redact_commands(spark, sf_dir):
    """Arguments of commands that carry credentials or don't, and bound parameters."""
    e = read_table(spark, sf_dir, "events")
    kinds = [("view", "auth", "'bob', 'p' || event_id"), ("click", "HELLO", "'3', 'auth', 'bob', 'p' || event_id, 'SETNAME', 'c' || user_id"), ("purchase", "config", "'SET', 'requirepass', 'p' || event_id, 'dir', '/d' || user_id"), ("signup", "SETEX", "'k' || user_id, '' || event_id"), ("error", "CONFIG", "'GET', 'masterauth'")]
    case = lambda k, show: "CASE event_type " + " ".join(f"WHEN '{x[0]}' THEN {show(x[k])}" for x in kinds) + " END"
    args = fn.redacted_command(F.expr(case(1, lambda c: f"'{c}'")), F.expr(case(2, lambda a: f"array({a})")))
    return e.select("event_id", F.concat_ws(" ", args).alias("args"), F.array_join(fn.redacted_parameters(F.array(F.col("user_id").cast("string"), F.col("event_type"))), ",").alias("params"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 90 THEN text ELSE left(text, (SELECT max(k) FROM range(91) r(k) WHERE octet_length(encode(left(text, k))) <= 90)) || '…' END AS shown FROM documents""")
def truncate_text(spark, sf_dir):
    """Texts of four languages cut at 90 bytes, between characters."""
    return read_table(spark, sf_dir, "documents").select("doc_id", fn.truncated(F.col("text"), 90).alias("shown"))


@query(r"""SELECT event_id, 'curl -X POST ''http://10.0.2.9/' || event_type || '?n=' || user_id || ''' -H ''accept: a/' || user_id || ''' -H ''x-note: it' || '''\''''' || 's ' || event_id || '''' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' --data-raw ''' || props || '''' END AS command FROM events""")
def curl_commands(spark, sf_dir):
    n, user = F.col("event_id"), F.col("user_id")
    headers = F.create_map(F.lit("x-note"), F.concat(F.lit("it's "), n), F.lit("Host"), F.lit("h"), F.lit("accept"), F.concat(F.lit("a/"), user), F.lit("Content-Length"), F.lit("9"))
    url = F.concat(F.lit("http://10.0.2.9/"), F.col("event_type"), F.lit("?n="), user)
    return read_table(spark, sf_dir, "events").select("event_id", fn.curl(F.lit("POST"), url, headers, F.when(n % 3 == 0, "").otherwise(F.col("props"))).alias("command"))


@query("""WITH t AS (SELECT doc_id, hex(encode(left(text, 40))) AS h FROM documents), n AS (SELECT doc_id, CAST(r.k AS INTEGER) AS k, lower(substr(h, CAST(r.k * 32 + 1 AS INTEGER), 32)) AS d FROM t, range(11) r(k) WHERE r.k * 32 < length(h)),
 x AS (SELECT doc_id, k, list_transform(range(16), lambda i: CASE WHEN 2 * i < length(d) THEN substr(d, CAST(2 * i + 1 AS INTEGER), 2) ELSE '  ' END) AS p FROM n)
 SELECT doc_id, string_agg(lpad(lower(printf('%x', k * 16)), 8, '0') || '  ' || array_to_string(p[1:8], ' ') || '  ' || array_to_string(p[9:16], ' ') || '  |' || array_to_string(list_transform(list_filter(p, lambda y: y <> '  '), lambda y: CASE WHEN y >= '20' AND y <= '7e' THEN chr(CAST(('0x' || y) AS INTEGER)) ELSE '.' END), '') || '|', chr(10) ORDER BY k) AS dump FROM x GROUP BY doc_id""")
def hexdump_text(spark, sf_dir):
    """The dump itself, of the first 40 characters of every text."""
    dump = fn.hex_dump(F.left(F.col("text"), F.lit(40)).cast("binary"))
    return read_table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", dump.alias("dump"))


@query()
def demo_traffic(spark, sf_dir):
    from .sources.demo import demo_entries

    numbers = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("n"))
    return summary(demo_entries(spark, numbers=numbers), "protocol", None).select("key", "count", "errors", "warnings", "p50", "p95")


# --- streams -----------------------------------------------------------------------------------


def _run(stream: DataFrame, where: str, mode: str) -> None:
    """What there is now, appended or as the last complete table, under ``where``. State gets as many
    partitions as there are cores: they are fixed for as long as a stream lives."""
    spark, partitions = stream.sparkSession, "spark.sql.shuffle.partitions"
    write, before = "append" if mode == "append" else "overwrite", spark.conf.get(partitions)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").foreachBatch(lambda df, _: df.write.mode(write).parquet(f"{where}/rows"))
    spark.conf.set(partitions, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        query = run.trigger(availableNow=True).start()
    finally:
        spark.conf.set(partitions, before)
    query.awaitTermination()


def _settled(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and reads the result."""
    where = scratch_folder(spark, "stream")
    _run(stream, where, mode)
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")


def _arriving(spark: SparkSession, rows: DataFrame, at: str, job) -> DataFrame:
    """Runs ``job``, from a stream to a stream in append mode, over rows that arrive in the order of
    their column ``slice``, one micro-batch each, and reads what it appends. At the end a row with
    nothing but a time (column ``at``) of a year later tells that no more comes."""
    where = scratch_folder(spark, "arriving")
    schema = rows.drop("slice").schema
    spark.createDataFrame([], schema).write.parquet(f"{where}/in")
    stream = job(spark.readStream.schema(schema).parquet(f"{where}/in"))
    spark.createDataFrame([], stream.schema).write.parquet(f"{where}/rows")
    end = rows.agg((F.max(at) + F.expr("INTERVAL 1 YEAR")).alias(at)).select(*[F.col(at) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    for part in [*(rows.filter(F.col("slice") == k).drop("slice") for k in range(_SLICES)), end]:
        part.write.mode("append").parquet(f"{where}/in")
        _run(stream, where, "append")
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")


#: Events arrive up to a day late, in so many micro-batches of equal time.
_SLICES = 4
_SLICE = "CAST(greatest(0, least(3, ({us} + event_id * 7919 % 86400 * 1000000 - 1704067200000000) {div} 648000000000)) AS INTEGER)"
_SLICE_SQL = _SLICE.format(us="epoch_us(ts)", div="//")


def _sliced(e: DataFrame) -> DataFrame:
    return e.withColumn("slice", F.expr(_SLICE.format(us="unix_micros(CAST(ts AS timestamp))", div="div")))


#: Entries by slice, their times clamped to noon of the last day, and whether their second is over by
#: the watermark, which trails the newest time of the slices before by six hours.
_LATE = f"""{_FLAT}, c AS (SELECT protocol, status, {_SLICE_SQL} AS slice, least(ts, TIMESTAMP '2024-01-30 12:00:00') AS ts FROM (SELECT l.*, seq - 1 AS event_id FROM l)),
 s AS (SELECT k AS slice, (SELECT max(ts) FROM c WHERE slice < k) AS newest FROM range({_SLICES}) t(k)),
 m AS (SELECT c.*, coalesce(date_trunc('second', c.ts) + INTERVAL 1 SECOND <= s.newest - INTERVAL 6 HOUR, FALSE) AS late FROM c JOIN s USING (slice))"""
def _noon():
    """What the clock says while entries arrive; the row that ends the stream comes later."""
    return F.when(F.col("protocol").isNotNull(), F.lit(datetime(2024, 1, 30, 12, tzinfo=UTC)))




def _sliced_entries(spark, sf_dir) -> DataFrame:
    entries = events_as_entries(spark, sf_dir)
    return _sliced(entries.withColumn("event_id", F.col("seq") - 1).withColumn("ts", F.col("timestamp"))).select("id", "timestamp", "protocol", "status", "slice")


@query(f"{_LATE} SELECT epoch_us(date_trunc('second', ts)) AS second_us, protocol, count(*) AS entries, count(*) FILTER (status = 'error') AS errors FROM m WHERE NOT late GROUP BY ALL")
def stream_rates(spark, sf_dir):
    """Seconds given out once, by the watermark; some entries come too late, some from the future."""
    from .streaming.jobs import rates

    out = _arriving(spark, _sliced_entries(spark, sf_dir), "timestamp", lambda s: rates(s, 6 * 3600, _noon()))
    return out.filter("protocol IS NOT NULL").select(F.unix_micros("second").alias("second_us"), "protocol", "entries", "errors")


@query(f"{_LATE} SELECT protocol, count(*) AS late FROM m WHERE late GROUP BY protocol")
def stream_too_late(spark, sf_dir):
    from .streaming.jobs import too_late

    out = _arriving(spark, _sliced_entries(spark, sf_dir), "timestamp", lambda s: too_late(s, 6 * 3600, _noon()))
    return out.groupBy("protocol").agg(F.sum("late").alias("late"))


@query(f"{_FLAT} SELECT {_ROW} FROM l WHERE protocol = 'http' AND ms >= 100")
def stream_live_filter(spark, sf_dir):
    from .streaming.jobs import live

    return _settled(spark, _rows(live(events_stream(spark, sf_dir), "protocol == http and elapsedMs >= 100")), "append")


@query(ORACLE_SQL["facet_topn"])
def stream_facets(spark, sf_dir):
    """Sketches that a stream leaves behind, micro-batch by micro-batch, and a snapshot of them."""
    from .streaming.jobs import to_facet_sketches

    where = scratch_folder(spark, "facets")
    to_facet_sketches(events_stream(spark, sf_dir), f"{where}/sketches", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return facets.sketched_snapshot(spark.read.parquet(f"{where}/sketches"))


@query(f"{_FLAT} SELECT {_ROW}, '/' || event_type || '/' || user_id AS path FROM l")
def stream_rotating_export(spark, sf_dir):
    """Entries as JSON lines in files of 64 KiB, all of them kept, read back."""
    from .streaming.jobs import to_rotating_files

    where = scratch_folder(spark, "export")
    to_rotating_files(events_stream(spark, sf_dir), f"{where}/lines", f"{where}/state", 64 << 10, 0).trigger(availableNow=True).start().awaitTermination()
    back = from_json_lines(spark.read.text(f"{where}/lines"))
    return back.select("id", "seq", "protocol", "status", F.col("elapsedMs").alias("ms"), "request.path")


def _many_filters() -> list[tuple[str, str]]:
    """Two hundred filters and their conditions on the flat columns."""
    out = [(f'request.path == "/{k}/{n}"', f"lower(path) = '/{k}/{n}'") for n in range(20) for k in ("view", "click")]
    out += [(f"src.workload == WL-{n} and elapsedMs >= {m}", f"swl = 'wl-{n}' AND ms >= {m}") for n in range(16) for m in (100, 250, 400)]
    out += [(f"elapsedMs < {10 * n} and response.status in (503, 404) and src.namespace == shop", f"ms < {10 * n} AND code IN (503, 404) AND sns = 'shop'") for n in range(1, 33)]
    out += [(f"namespace == {s} and status != {t} and not request.path contains {n}", f"(sns = '{s}' OR dns = '{s}') AND status <> '{t}' AND NOT contains(path, '{n}')") for s in ("shop", "platform") for t in ("error", "success") for n in range(10)]
    out += [(f'src.ip == "10.0.1.{32 * n}/27" and elapsedMs > 50', f"CAST(split_part(sip, '.', 4) AS INT) BETWEEN {32 * n} AND {32 * n + 31} AND ms > 50") for n in range(8)]
    out += [(f"protocol == {p} or elapsedMs >= {m}", f"protocol = '{p}' OR ms >= {m}") for p in ("http", "dns", "tcp", "redis") for m in (200, 300, 400, 480)]
    out += [(f"/signup/{n}", f"contains(lower(path), '/signup/{n}')") for n in range(8)]
    return [*out, *out[-8:]]  # some subscribers share a filter


@query(_FLAT + ", h AS (" + " UNION ALL ".join(f"SELECT 's{i}' AS subscriber, count(*) AS entries, CAST(sum(seq) AS BIGINT) AS seqs FROM l WHERE {c}" for i, (_, c) in enumerate(_many_filters())) + ") SELECT * FROM h WHERE entries > 0")
def stream_many_filters(spark, sf_dir):
    """One stream that serves two hundred subscribers, each by its own filter."""
    from .streaming.feed import Feed, delivered

    feed = Feed({f"s{i}": f for i, (f, _) in enumerate(_many_filters())})
    sent = delivered(events_stream(spark, sf_dir), feed).select("subscriber", "seq")
    return _settled(spark, sent, "append").groupBy("subscriber").agg(F.count("*").alias("entries"), F.sum("seq").alias("seqs"))


#: Who asks for what with which of four parts of the entries, and what that is in SQL; the last is no filter.
_SWAPS = [
    (0, "a", "protocol == http", "protocol = 'http'"),
    (1, "b", "status == error", "status = 'error'"),
    (1, "a", "elapsedMs >= 250", "ms >= 250"),
    (2, "a", "protocol == dns and elapsedMs < 100", "protocol = 'dns' AND ms < 100"),
    (2, "b", "(status == error", None),
    (3, "b", "src.namespace == shop", "sns = 'shop'"),
]


def _swaps_sql() -> str:
    part, seen, out = "(SELECT l.*, (seq - 1) * 4 // (SELECT max(seq) FROM l) AS part FROM l)", {}, []
    for k in range(4):
        for _, who, _, condition in (s for s in _SWAPS if s[0] == k and s[3]):
            seen[who] = condition
            out.append(f"(SELECT '{who}' AS subscriber, {k} AS part, TRUE AS replayed, seq FROM {part} WHERE part < {k} AND ({condition}) ORDER BY seq DESC LIMIT 500)")
        out += [f"SELECT '{who}', {k}, FALSE, seq FROM {part} WHERE part = {k} AND ({condition})" for who, condition in seen.items()]
    return f"{_FLAT}, s AS ({' UNION ALL '.join(out)}) SELECT subscriber, CAST(part AS BIGINT) AS part, replayed, seq FROM s"


@query(_swaps_sql())
def stream_filter_swap(spark, sf_dir):
    """Two subscribers that change their filters between four parts of the entries; one sends what is no filter."""
    from .streaming.feed import Switchboard

    where = scratch_folder(spark, "switchboard")
    events = read_table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id") + 1).scalar()
    rows = events.withColumns({"part": (F.col("event_id") * 4 / last).cast("bigint"), "subscriber": F.lit(None).cast("string"), "filter": F.lit(None).cast("string")})
    asked = spark.createDataFrame([(k, s, f, i - 1) for i, (k, s, f, _) in enumerate(_SWAPS)], "part long, subscriber string, filter string, event_id long")
    rows = rows.unionByName(asked, allowMissingColumns=True)
    schema, board = rows.drop("part").schema, Switchboard(spark, where)
    spark.createDataFrame([], schema).write.parquet(f"{where}/in")
    # a part lies together in the table, and so in few files; dealt out while rows are narrow, every core gets some
    came = spark.readStream.schema(schema).parquet(f"{where}/in").repartition(spark.sparkContext.defaultParallelism, "event_id")
    stream = entries_of_events(came, "subscriber", "filter")
    for k in range(4):
        rows.filter(F.col("part") == k).drop("part").write.mode("append").parquet(f"{where}/in")
        board.start(stream, availableNow=True).awaitTermination()
    return board.sent().select("subscriber", F.col("batch").cast("bigint").alias("part"), "replayed", "seq")


@query(_fifo_sql(30, 1024))
def stream_pairing(spark, sf_dir):
    """Queues as state: requests expire by event time, messages arrive out of order."""
    from .streaming.ordered import pair_in_order, with_timers

    with_timers(spark)
    e = _sliced(read_table(spark, sf_dir, "events"))
    return _arriving(spark, _rush_columns(e, "slice"), "ts", lambda s: pair_in_order(s, late="4 seconds"))


@query(_dns_sql("200000000"))
def stream_dns_pairing(spark, sf_dir):
    """The latest request of a number as state, for 200,000 seconds."""
    from .streaming.ordered import pair_by_number, with_timers

    with_timers(spark)
    rows = _messages_of(_sliced(read_table(spark, sf_dir, "events")), "slice")
    return _arriving(spark, rows, "ts", lambda s: pair_by_number(s, ["conn", "number"], 200_000, "25 hours"))


@query(_sessions_sql("started_us, ended_us, packets, bytes, client_bytes, server_bytes, client_packets, server_packets, client_flags, server_flags, mss, window_size, rtt_ms"))
def stream_flow_sessions(spark, sf_dir):
    """Sessions as state, given out at a FIN or RST or by a timer after four idle hours."""
    from .streaming.ordered import sessions, with_timers

    with_timers(spark)
    rows = _packets_of(_sliced(read_table(spark, sf_dir, "events")), "slice")
    out = _arriving(spark, rows, "ts", lambda s: sessions(s, 4 * 3600, "25 hours"))
    return out.withColumn("rtt_ms", F.coalesce("rtt_ms", F.lit(-1e9))).withColumnRenamed("window", "window_size")


@query(f"""WITH r AS (SELECT conn, CAST(conn % 3 AS VARCHAR) AS src, seq % 2 AS sport, us, seq % 5 AS seq, seq % 3 AS length FROM (SELECT user_id % 40 AS conn, epoch_us(ts) // 500000 AS us, event_id AS seq FROM events)),
 l AS (SELECT *, lag(us) OVER w AS us_, lag(seq) OVER w AS seq_, lag(length) OVER w AS length_ FROM r WINDOW w AS (PARTITION BY conn, src, sport ORDER BY us, seq, length))
 SELECT conn, src, sport, us, seq, length FROM l WHERE NOT coalesce(length > 0 AND seq = seq_ AND length = length_ AND us - us_ <= 5000, FALSE)""")
def stream_repeats(spark, sf_dir):
    """Packets seen twice within five milliseconds are dropped; a month in five seconds, so many are."""
    from .streaming.ordered import with_timers, without_repeats

    with_timers(spark)
    n, conn = F.col("event_id"), F.col("user_id") % 40
    us = F.expr("unix_micros(CAST(ts AS timestamp)) div 500000")
    rows = _sliced(read_table(spark, sf_dir, "events")).select(conn.alias("conn"), (conn % 3).cast("string").alias("src"), (n % 2).alias("sport"), F.timestamp_micros(us).alias("ts"), (n % 5).alias("seq"), (n % 3).alias("length"), "slice")
    return _arriving(spark, rows, "ts", lambda s: without_repeats(s, late="1 second"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["summary_workload"](spark, sf_dir)
