"""Checks of nesting and decoding: every query builds OTLP lines from a whole table, decodes
them and projects the columns its rule is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleskein.functions import wire
from teleskein.functions.values import time_to_nanos
from teleskein.functions.render import attributes_text, parse_attributes
from teleskein.operators.decode import decode
from teleskein.operators.encode import UNROUTED, encode, split_by_signal, write_routed
from teleskein.plans import mapping as m
from teleskein.schemas import SIGNALS
from teleskein.session import scratch_dir
from teleskein.sources.jsonl import scan_all

NOW = "2024-06-01 12:00:00"
NOW_COLUMN = f"timestamp_ntz'{NOW}'"


def shown(rows: DataFrame) -> DataFrame:
    """Maps as text, since maps cannot be compared."""
    return rows.withColumn("attributes", attributes_text("attributes"))


def _variant(column: Column) -> Column:
    """A scalar as VARIANT, so that one field can hold several types."""
    return column.cast("variant")


def _variant_of(struct: Column) -> Column:
    return F.to_variant_object(struct)


def _attr(key: str, **value: Column) -> Column:
    """An attribute whose value holds the given parts."""
    body = F.struct(*[c.alias(n) for n, c in value.items()])
    return F.struct(F.lit(key).alias("key"), _variant_of(body).alias("value"))


def one_record_lines(
    rows: DataFrame, signal: str, record: Column, resource: Column | None = None, naming=str
) -> DataFrame:
    """Each row as a line of its own; ``record`` is the span, metric or log record."""
    resources, scopes, records = (naming(k) for k in wire.KEYS[signal])
    scope = F.struct(F.array(record).alias(records))
    parts = [F.array(scope).alias(scopes)]
    if resource is not None:
        parts.insert(0, resource.alias("resource"))
    body = F.struct(F.array(F.struct(*parts)).alias(resources))
    return rows.select(F.to_json(body).alias("value"))


def _nanos(time: str = "ts") -> Column:
    return time_to_nanos(m.ntz(F.col(time)))


def _time() -> Column:
    return _nanos().cast("string").alias("timeUnixNano")


def _log(*parts: Column) -> Column:
    return F.struct(_time(), *parts)


def _event_id() -> Column:
    return F.col("event_id").cast("string").alias("traceId")


# --- whole signals ---


def _round_trip(signal: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(decode(encode(m.ROWS[signal](spark, sf_dir), signal), signal).rows)

    return run


def _round_trip_sql(signal: str) -> str:
    date = "CAST(start_time AS DATE) AS date" if signal == "traces" else "date"
    return f"SELECT {m.columns_sql(signal, date=False)}, {date} FROM ({m.SQL[signal]})"


# --- single rules ---


def d04_alias_snake(spark, sf_dir):
    e = m.read(spark, sf_dir, "events")
    record = F.struct(
        _nanos().alias("time_unix_nano"),
        F.col("event_type").alias("severity_text"),
        F.lit(9).alias("severity_number"),
        F.struct(F.col("event_type").alias("string_value")).alias("body"),
        F.col("event_id").cast("string").alias("trace_id"),
    )
    lines = one_record_lines(e, "logs", record, naming=wire.snake)
    return decode(lines, "logs").rows.select(
        "timestamp", "severity", "severity_number", "body", "service_name", "trace_id", "span_id"
    )


D04 = """SELECT ts AS timestamp, event_type AS severity, CAST(9 AS INTEGER) AS severity_number,
event_type AS body, 'unknown' AS service_name, CAST(event_id AS VARCHAR) AS trace_id,
CAST(NULL AS VARCHAR) AS span_id FROM events"""


def d05_nano_time(spark, sf_dir):
    """End times sent as text, as integers, as zero, as words, before 1970 and absent."""
    e = m.read(spark, sf_dir, "events")
    k, ns = F.col("event_id") % 7, _nanos()
    end = (
        F.when(k == 0, _variant(ns.cast("string")))
        .when(k == 1, _variant(ns))
        .when(k == 2, _variant(F.lit("0")))
        .when(k == 3, _variant(F.lit("soon")))
        .when(k == 4, _variant(-F.expr("(event_id + 1) * 1000000000")))
        .when(k == 5, _variant(F.expr("-(event_id * 1000000000 + 5)")))
    )
    record = F.struct(_event_id(), ns.alias("startTimeUnixNano"), end.alias("endTimeUnixNano"))
    rows = decode(one_record_lines(e, "traces", record), "traces").rows
    return rows.select("trace_id", "start_time", "end_time", "duration_ns")


D05 = """SELECT CAST(event_id AS VARCHAR) AS trace_id, ts AS start_time,
CASE event_id % 7 WHEN 0 THEN ts WHEN 1 THEN ts
  WHEN 4 THEN TIMESTAMP '1970-01-01' - to_seconds(event_id + 1) END AS end_time,
CASE event_id % 7 WHEN 4 THEN -(event_id + 1) * 1000000000 - epoch_us(ts) * 1000
  ELSE CAST(0 AS BIGINT) END AS duration_ns FROM events"""


def d06_log_time_fallback(spark, sf_dir):
    e = m.read(spark, sf_dir, "events")
    k, ns = F.col("event_id") % 3, _nanos()
    record = F.struct(
        F.when(k == 0, ns.cast("string")).when(k == 1, "0").alias("timeUnixNano"),
        F.when(k == 1, ns.cast("string")).alias("observedTimeUnixNano"),
        _event_id(),
    )
    rows = decode(one_record_lines(e, "logs", record), "logs", now=F.expr(NOW_COLUMN)).rows
    return rows.select("trace_id", "timestamp", "date")


D06 = f"""SELECT CAST(event_id AS VARCHAR) AS trace_id,
CASE WHEN event_id % 3 < 2 THEN ts ELSE TIMESTAMP '{NOW}' END AS timestamp,
CAST(CASE WHEN event_id % 3 < 2 THEN ts ELSE TIMESTAMP '{NOW}' END AS DATE) AS date FROM events"""


def d07_duration(spark, sf_dir):
    rows = m.traces(spark, sf_dir)
    rows = rows.withColumn("end_time", F.when(F.col("kind") != 3, F.col("end_time")))
    out = decode(encode(rows, "traces"), "traces").rows
    return out.groupBy("kind", "status_code").agg(
        F.count(F.lit(1)).alias("spans"),
        F.sum("duration_ns").alias("total_ns"),
        F.count_if(F.col("duration_ns") < 0).alias("negative"),
    )


D07 = f"""SELECT kind, status_code, COUNT(*) AS spans,
CAST(SUM(CASE WHEN kind = 3 THEN 0 ELSE duration_ns END) AS BIGINT) AS total_ns,
CAST(COUNT(*) FILTER (kind <> 3 AND duration_ns < 0) AS BIGINT) AS negative
FROM ({m.TRACES_SQL}) GROUP BY kind, status_code"""


def d08_any_value_text(spark, sf_dir):
    """Text, whole numbers as number and as text, booleans, doubles, nothing, and precedence."""
    e = m.read(spark, sf_dir, "events")
    i, v = F.col("event_id"), F.col("value")
    record = _log(
        _event_id(),
        F.array(
            _attr("text", stringValue=F.col("event_type"), intValue=i),
            _attr("int", intValue=i, boolValue=F.lit(True)),
            _attr("int_text", intValue=i.cast("string")),
            _attr("bool", boolValue=i % 2 == 0, doubleValue=v),
            _attr("double", doubleValue=v),
            _attr("whole", doubleValue=i.cast("double")),
            _attr("large", doubleValue=(i + 1).cast("double") * 1e9),
            _attr("list", intValue=F.array(i)),
            _attr("none", other=i),
        ).alias("attributes"),
    )
    a = F.col("attributes")
    names = ["text", "int", "int_text", "bool", "double", "whole", "large", "list", "none"]
    rows = decode(one_record_lines(e, "logs", record), "logs").rows
    return rows.select("trace_id", *[a[n].alias(f"{n}_value") for n in names])


D08 = """SELECT CAST(event_id AS VARCHAR) AS trace_id, event_type AS text_value,
CAST(event_id AS VARCHAR) AS int_value, CAST(event_id AS VARCHAR) AS int_text_value,
CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS bool_value,
regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS double_value,
CAST(event_id AS VARCHAR) AS whole_value, CAST((event_id + 1) * 1000000000 AS VARCHAR) AS large_value,
'' AS list_value, '' AS none_value FROM events"""


def d09_service_name(spark, sf_dir):
    """No resource, no attributes, a null value first, an empty text, a number."""
    e = m.read(spark, sf_dir, "events")
    i = F.col("event_id")
    k = i % 6
    svc = F.concat(F.lit("svc-"), k.cast("string"))

    def named(value: Column) -> Column:
        return F.struct(F.lit("service.name").alias("key"), value.alias("value"))

    def res(*attrs: Column) -> Column:
        return _variant_of(F.struct(F.array(*attrs).alias("attributes")))

    def of(**value: Column) -> Column:
        return _variant_of(F.struct(*[c.alias(n) for n, c in value.items()]))

    other = F.struct(F.lit("host").alias("key"), of(stringValue=F.lit("h")).alias("value"))
    resource = (
        F.when(k == 1, _variant_of(F.struct(F.lit("x").alias("schema"))))
        .when(k == 2, res(named(F.parse_json(F.lit("null"))), other, named(of(stringValue=svc))))
        .when(k == 3, res(named(of(stringValue=F.lit("")))))
        .when(k == 4, res(other, named(of(intValue=i)), named(of(stringValue=svc))))
        .when(k == 5, res(other))
    )
    lines = one_record_lines(e, "logs", _log(_event_id()), resource=resource)
    return decode(lines, "logs").rows.select("trace_id", "service_name")


D09 = """SELECT CAST(event_id AS VARCHAR) AS trace_id, CASE event_id % 6 WHEN 2 THEN 'svc-2'
WHEN 3 THEN '' WHEN 4 THEN CAST(event_id AS VARCHAR) ELSE 'unknown' END AS service_name FROM events"""


def d10_attr_flatten(spark, sf_dir):
    """A repeated key keeps its last value, a null value is empty, no list is an empty map."""
    e = m.read(spark, sf_dir, "events")
    i = F.col("event_id").cast("string")
    null = F.parse_json(F.lit("null"))
    attrs = F.when(
        F.col("event_id") % 4 != 3,
        F.array(
            _attr("a", stringValue=F.lit("first")),
            _attr("b", stringValue=F.col("event_type")),
            F.struct(F.lit("gone").alias("key"), null.alias("value")),
            _attr("a", stringValue=i),
        ),
    )
    lines = one_record_lines(e, "logs", _log(_event_id(), attrs.alias("attributes")))
    return shown(decode(lines, "logs").rows).select("trace_id", "attributes")


D10 = """SELECT CAST(event_id AS VARCHAR) AS trace_id, CASE WHEN event_id % 4 = 3 THEN '{}' ELSE
'{"a":"' || CAST(event_id AS VARCHAR) || '","b":"' || event_type || '","gone":""}' END AS attributes FROM events"""


def _metric_lines(e: DataFrame, kind: str, point: Column, *extra: Column) -> DataFrame:
    body = F.struct(F.array(point).alias("dataPoints"), *extra)
    record = F.struct(
        F.col("event_type").alias("name"),
        F.when(F.col("event_id") % 2 == 0, "ms").alias("unit"),
        body.alias(kind),
    )
    return one_record_lines(e, "metrics", record)


def d11_point_value(spark, sf_dir):
    """The double; else an integer as number or text; else numeric text; else 0."""
    e = m.read(spark, sf_dir, "events")
    i, v = F.col("event_id"), F.col("value")
    k = i % 6
    as_int = (
        F.when(k == 0, _variant(i))
        .when(k == 1, _variant(i.cast("string")))
        .when(k == 2, _variant(v.cast("string")))
        .when(k == 3, _variant(F.lit("much")))
        .when(k == 4, _variant(i % 2 == 0))
    )
    point = F.struct(_time(), as_int.alias("asInt"), F.when(k == 5, v).alias("asDouble"))
    rows = decode(_metric_lines(e, "gauge", point), "metrics").rows
    return rows.select("timestamp", "metric_name", "value")


D11 = """SELECT ts AS timestamp, event_type AS metric_name, CAST(CASE event_id % 6 WHEN 0 THEN event_id
WHEN 1 THEN event_id WHEN 2 THEN value WHEN 5 THEN value ELSE 0 END AS DOUBLE) AS value FROM events"""

_TYPED_COLUMNS = [
    "metric_name",
    "metric_type",
    "value",
    "timestamp",
    "aggregation_temporality",
    "is_monotonic",
    "unit",
]


def d12_sum(spark, sf_dir):
    e = m.read(spark, sf_dir, "events")
    point = F.struct(_time(), F.col("value").alias("asDouble"))
    lines = _metric_lines(
        e,
        "sum",
        point,
        F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 3).cast("int")).alias("aggregationTemporality"),
        (F.col("event_id") % 2 == 0).alias("isMonotonic"),
    )
    return decode(lines, "metrics").rows.select(*_TYPED_COLUMNS)


D12 = """SELECT event_type AS metric_name, 'sum' AS metric_type, value, ts AS timestamp,
CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS INTEGER) AS aggregation_temporality,
event_id % 2 = 0 AS is_monotonic, CASE WHEN event_id % 2 = 0 THEN 'ms' END AS unit FROM events"""


def d13_gauge(spark, sf_dir):
    e = m.read(spark, sf_dir, "events")
    point = F.struct(_time(), F.col("value").alias("asDouble"))
    return decode(_metric_lines(e, "gauge", point), "metrics").rows.select(*_TYPED_COLUMNS)


D13 = """SELECT event_type AS metric_name, 'gauge' AS metric_type, value, ts AS timestamp,
CAST(NULL AS INTEGER) AS aggregation_temporality, CAST(NULL AS BOOLEAN) AS is_monotonic,
CASE WHEN event_id % 2 = 0 THEN 'ms' END AS unit FROM events"""


def d14_histogram_sum(spark, sf_dir):
    """The point's sum or 0; count, buckets and bounds play no part."""
    e = m.read(spark, sf_dir, "events")
    point = F.struct(
        _time(),
        F.lit("3").alias("count"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("sum"),
        F.array(F.lit("1"), F.lit("2")).alias("bucketCounts"),
        F.array(F.col("value")).alias("explicitBounds"),
    )
    lines = _metric_lines(e, "histogram", point, F.lit(1).alias("aggregationTemporality"))
    return decode(lines, "metrics").rows.select(*_TYPED_COLUMNS)


D14 = """SELECT event_type AS metric_name, 'histogram' AS metric_type,
CASE WHEN event_id % 4 <> 0 THEN value ELSE 0.0 END AS value, ts AS timestamp,
CAST(1 AS INTEGER) AS aggregation_temporality, CAST(NULL AS BOOLEAN) AS is_monotonic,
CASE WHEN event_id % 2 = 0 THEN 'ms' END AS unit FROM events"""


def d15_unsupported_kinds(spark, sf_dir):
    """Summaries give no rows and no error; gauges in other lines do."""
    e = m.read(spark, sf_dir, "events")
    body = F.struct(F.array(F.struct(_time(), F.col("value").alias("asDouble"))).alias("dataPoints"))
    kept = F.col("event_id") % 2 == 0
    record = F.struct(
        F.col("event_type").alias("name"),
        F.when(kept, body).alias("gauge"),
        F.when(~kept, body).alias("summary"),
    )
    decoded = decode(one_record_lines(e, "metrics", record), "metrics")
    return decoded.rows.groupBy("metric_name").agg(F.count(F.lit(1)).alias("points"))


D15 = """SELECT event_type AS metric_name, COUNT(*) AS points FROM events WHERE event_id % 2 = 0 GROUP BY event_type"""


def d16_span_defaults(spark, sf_dir):
    e = m.read(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    record = F.struct(
        F.when(k == 0, F.col("event_id").cast("string")).alias("traceId"),
        F.when(k == 1, "").when(k == 2, "p").alias("parentSpanId"),
        F.when(k == 1, F.col("event_type")).alias("name"),
        F.when(k == 2, 3).alias("kind"),
        _nanos().alias("startTimeUnixNano"),
        F.when(k == 2, F.struct(F.lit(1).alias("code"))).alias("status"),
    )
    rows = decode(one_record_lines(e, "traces", record), "traces").rows
    return rows.select("start_time", "trace_id", "span_id", "parent_span_id", "name", "kind", "status_code")


D16 = """SELECT ts AS start_time, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS trace_id,
'' AS span_id, CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'p' END AS parent_span_id,
CASE WHEN event_id % 3 = 1 THEN event_type ELSE '' END AS name,
CAST(CASE WHEN event_id % 3 = 2 THEN 3 ELSE 0 END AS INTEGER) AS kind,
CAST(CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS status_code FROM events"""


def d17_log_ids(spark, sf_dir):
    e = m.read(spark, sf_dir, "events")
    k, i = F.col("event_id") % 3, F.col("event_id").cast("string")
    record = _log(
        F.when(k == 0, i).when(k == 1, "").alias("traceId"),
        F.when(k == 1, i).when(k == 2, "").alias("spanId"),
    )
    return decode(one_record_lines(e, "logs", record), "logs").rows.select("timestamp", "trace_id", "span_id")


D17 = """SELECT ts AS timestamp, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS trace_id,
CASE WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) END AS span_id FROM events"""


def d18_body_text(spark, sf_dir):
    """No body is NULL; lists and maps are empty text. Bodies are whole documents."""
    d = m.read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    body = (
        F.when(k == 0, _variant_of(F.struct(F.col("text").alias("stringValue"))))
        .when(k == 1, _variant_of(F.struct(F.struct(F.array(F.col("text")).alias("values")).alias("arrayValue"))))
        .when(k == 2, _variant_of(F.struct(F.col("n_chars").alias("intValue"))))
    )
    record = F.struct(
        F.lit("1710000000000000000").alias("timeUnixNano"),
        body.alias("body"),
        F.col("doc_id").cast("string").alias("traceId"),
    )
    return decode(one_record_lines(d, "logs", record), "logs").rows.select("trace_id", "body")


D18 = """SELECT CAST(doc_id AS VARCHAR) AS trace_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN ''
WHEN 2 THEN CAST(n_chars AS VARCHAR) END AS body FROM documents"""


def d19_metric_passthrough(spark, sf_dir):
    e = m.read(spark, sf_dir, "events")
    point = F.struct(_time(), F.col("value").alias("asDouble"))
    rows = decode(_metric_lines(e, "gauge", point), "metrics").rows
    return rows.groupBy("metric_name", "unit").agg(F.count(F.lit(1)).alias("points"))


D19 = """SELECT event_type AS metric_name, CASE WHEN event_id % 2 = 0 THEN 'ms' END AS unit,
COUNT(*) AS points FROM events GROUP BY 1, 2"""


def d20_date_derive(spark, sf_dir):
    rows = decode(encode(m.metrics(spark, sf_dir), "metrics"), "metrics").rows
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("points"))


D20 = "SELECT CAST(ts AS DATE) AS date, COUNT(*) AS points FROM events GROUP BY 1"


def d21_attributes_read_back(spark, sf_dir):
    """Stored JSON text to a map; unreadable text gives NULL."""
    e = m.read(spark, sf_dir, "events")
    cut = F.col("props").substr(F.lit(1), F.length("props") - 1)
    stored = F.when(F.col("event_id") % 5 == 0, cut).otherwise(F.col("props"))
    return e.select("event_id", parse_attributes(stored)["k"].alias("k"))


D21 = """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN regexp_extract(props, '[0-9]+') END AS k FROM events"""


# --- lines: rejects, blanks, routing, sink ---


def _damaged(spark, sf_dir) -> DataFrame:
    """One log line per event, most of them damaged in one way or another."""
    e = m.read(spark, sf_dir, "events")
    good = one_record_lines(
        e.withColumn("i", F.col("event_id")),
        "logs",
        _log(F.lit("INFO").alias("severityText"), F.lit(9).alias("severityNumber"), _event_id()),
    ).withColumn("kind", F.regexp_extract("value", r'"traceId":"([0-9]+)"', 1).cast("bigint") % 12)
    v, k = F.col("value"), F.col("kind")
    changed = (
        F.when(k == 1, F.concat(v, F.lit(" xyz")))
        .when(k == 2, F.regexp_replace(v, '"INFO"', "5"))
        .when(k == 3, F.regexp_replace(v, '"severityNumber":9', '"severityNumber":1.5'))
        .when(k == 4, F.regexp_replace(v, '"logRecords"', '"records"'))
        .when(k == 5, F.regexp_replace(v, '"severityText":', '"severity_text":null,"severityText":'))
        .when(k == 6, F.substring(v, 1, 40))
        .when(k == 7, F.concat(v, F.lit(","), v))
        .when(k == 8, F.concat(F.lit("  "), v, F.lit(" \t")))
        .when(k == 9, F.regexp_replace(v, '"severityText":', '"severityText":"X","severityText":'))
        .when(k == 10, F.lit("   "))
        .when(k == 11, F.regexp_replace(v, '"severityNumber":9', '"severityNumber":9,"unknown":[{"name":1}]'))
        .otherwise(v)
    )
    return good.select(changed.alias("value"))


def s03_blank_lines(spark, sf_dir):
    decoded = decode(_damaged(spark, sf_dir), "logs")
    rows = decoded.rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("part"), "n")
    rejects = decoded.rejects.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejects").alias("part"), "n")
    return rows.unionByName(rejects)


S03 = """SELECT 'rows' AS part, COUNT(*) AS n FROM events WHERE event_id % 12 IN (0, 8, 11)
UNION ALL SELECT 'rejects' AS part, COUNT(*) AS n FROM events WHERE event_id % 12 NOT IN (0, 8, 10, 11)"""


def s04_reject_malformed(spark, sf_dir):
    rows = decode(_damaged(spark, sf_dir), "logs").rows
    return rows.select("timestamp", "trace_id", "severity", "severity_number")


S04 = """SELECT ts AS timestamp, CAST(event_id AS VARCHAR) AS trace_id, 'INFO' AS severity,
CAST(9 AS INTEGER) AS severity_number FROM events WHERE event_id % 12 IN (0, 8, 11)"""


def s06_missing_time(spark, sf_dir):
    """Quarantine: points without a valid time are set apart, the others are kept."""
    e = m.read(spark, sf_dir, "events")
    time = F.when(F.col("event_id") % 5 != 0, _nanos().cast("string")).alias("timeUnixNano")
    point = F.struct(time, F.col("value").alias("asDouble"))
    decoded = decode(_metric_lines(e, "gauge", point), "metrics", on_missing_time="quarantine")

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))

    return part(decoded.rows, "rows").unionByName(part(decoded.timeless, "timeless"))


S06 = """SELECT event_type AS metric_name, COUNT(*) AS n,
CASE WHEN event_id % 5 = 0 THEN 'timeless' ELSE 'rows' END AS part FROM events GROUP BY 1, 3"""


def s07_sink_batches(spark, sf_dir):
    """Records per service over all batches, and whether any batch is over its size."""
    lines = encode(m.logs(spark, sf_dir), "logs", records_per_line=64)
    body = F.from_json(
        "value",
        "resourceLogs array<struct<resource:struct<attributes:array<struct<value:struct<stringValue:string>>>>,"
        "scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string>>>>>>",
    )
    one = lines.select(body["resourceLogs"][0].alias("r")).select(
        F.col("r")["resource"]["attributes"][0]["value"]["stringValue"].alias("service_name"),
        F.size(F.col("r")["scopeLogs"][0]["logRecords"]).cast("bigint").alias("size"),
    )
    return one.groupBy("service_name").agg(
        F.sum("size").alias("records"), (F.max("size") <= 64).alias("within_limit")
    )


S07 = f"""SELECT service_name, COUNT(*) AS records, TRUE AS within_limit FROM ({m.LOGS_SQL}) GROUP BY service_name"""


def _mixed_lines(spark, sf_dir) -> DataFrame:
    lines = None
    for signal in SIGNALS:
        part = encode(m.ROWS[signal](spark, sf_dir), signal)
        lines = part if lines is None else lines.unionByName(part)
    return lines


def _with_strays(spark, sf_dir) -> DataFrame:
    """Mixed lines, and for each event a line that belongs to no signal."""
    stray = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit("}")))
    stray = F.coalesce(stray, F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return _mixed_lines(spark, sf_dir).unionByName(m.read(spark, sf_dir, "events").select(stray.alias("value")))


def s08_signal_routing(spark, sf_dir):
    """A mixed line table routed to a folder per kind in one pass, then decoded and counted;
    lines of no kind have a folder too."""
    root = scratch_dir(spark, "routed")
    write_routed(_with_strays(spark, sf_dir), root, compression="gzip")
    rest = spark.read.text(f"{root}/signal={UNROUTED}")
    out = rest.groupBy(F.lit(None).cast("string").alias("service_name")).agg(F.count(F.lit(1)).alias("n"))
    out = out.withColumn("signal", F.lit(UNROUTED))
    for signal, decoded in scan_all(spark, root).items():
        part = decoded.rows.groupBy("service_name").agg(F.count(F.lit(1)).alias("n"))
        part = part.withColumn("signal", F.lit(signal))
        out = out.unionByName(part)
    return out


def s08_split(spark, sf_dir):
    """A mixed line table taken apart: rows of each kind, and lines of none."""
    out = None
    for signal, lines in split_by_signal(_with_strays(spark, sf_dir)).items():
        rows = lines if signal == UNROUTED else decode(lines, signal).rows
        part = rows.agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(signal).alias("signal"), "n")
        out = part if out is None else out.unionByName(part)
    return out


S08 = " UNION ALL ".join(
    f"SELECT service_name, COUNT(*) AS n, '{s}' AS signal FROM ({m.SQL[s]}) GROUP BY service_name" for s in SIGNALS
) + " UNION ALL SELECT CAST(NULL AS VARCHAR) AS service_name, COUNT(*) AS n, 'unrouted' AS signal FROM events"

S08_SPLIT = " UNION ALL ".join(f"SELECT '{s}' AS signal, COUNT(*) AS n FROM ({m.SQL[s]})" for s in SIGNALS)
S08_SPLIT += " UNION ALL SELECT 'unrouted' AS signal, COUNT(*) AS n FROM events"

QUERIES = {
    "d01_traces_unnest": (_round_trip("traces"), _round_trip_sql("traces")),
    "d02_metrics_unnest": (_round_trip("metrics"), _round_trip_sql("metrics")),
    "d03_logs_unnest": (_round_trip("logs"), _round_trip_sql("logs")),
    "d04_alias_snake": (d04_alias_snake, D04),
    "d05_nano_time": (d05_nano_time, D05),
    "d06_log_time_fallback": (d06_log_time_fallback, D06),
    "d07_duration": (d07_duration, D07),
    "d08_any_value_text": (d08_any_value_text, D08),
    "d09_service_name": (d09_service_name, D09),
    "d10_attr_flatten": (d10_attr_flatten, D10),
    "d11_point_value": (d11_point_value, D11),
    "d12_sum": (d12_sum, D12),
    "d13_gauge": (d13_gauge, D13),
    "d14_histogram_sum": (d14_histogram_sum, D14),
    "d15_unsupported_kinds": (d15_unsupported_kinds, D15),
    "d16_span_defaults": (d16_span_defaults, D16),
    "d17_log_ids": (d17_log_ids, D17),
    "d18_body_text": (d18_body_text, D18),
    "d19_metric_passthrough": (d19_metric_passthrough, D19),
    "d20_date_derive": (d20_date_derive, D20),
    "d21_attributes_read_back": (d21_attributes_read_back, D21),
    "s03_blank_lines": (s03_blank_lines, S03),
    "s04_reject_malformed": (s04_reject_malformed, S04),
    "s06_missing_time": (s06_missing_time, S06),
    "s07_sink_batches": (s07_sink_batches, S07),
    "s08_signal_routing": (s08_signal_routing, S08),
    "s08_split": (s08_split, S08_SPLIT),
}
