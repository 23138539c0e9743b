"""The test tables seen as telemetry, in Spark and in SQL.

``events`` supplies metric points and log records, ``lineitem`` supplies spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleskein.schemas import TABLES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ntz(time: Column) -> Column:
    return time.cast("timestamp_ntz")


def service(key: Column, n: int) -> Column:
    return F.concat(F.lit("svc-"), (key % n).cast("string"))


def _conform(rows: DataFrame, signal: str) -> DataFrame:
    fields = [f for f in TABLES[signal].fields if f.name != "date"]
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def with_date(rows: DataFrame, signal: str) -> DataFrame:
    time = "start_time" if signal == "traces" else "timestamp"
    return rows.withColumn("date", F.to_date(time))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.col("event_id") % 3
    rows = e.select(
        F.col("event_type").alias("metric_name"),
        F.when(kind == 0, "sum").when(kind == 1, "gauge").otherwise("histogram").alias("metric_type"),
        F.col("value"),
        ntz(F.col("ts")).alias("timestamp"),
        service(F.col("user_id"), 10).alias("service_name"),
        F.when(kind != 1, 2).alias("aggregation_temporality"),
        F.when(kind == 0, True).alias("is_monotonic"),
        F.lit("1").alias("unit"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"),
    )
    return with_date(_conform(rows, "metrics"), "metrics")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    odd = F.col("event_id") % 2 == 1
    rows = e.select(
        ntz(F.col("ts")).alias("timestamp"),
        F.when(failed, "ERROR").otherwise("INFO").alias("severity"),
        F.when(failed, 17).otherwise(9).alias("severity_number"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("body"),
        service(F.col("user_id"), 10).alias("service_name"),
        F.when(odd, F.lpad(F.col("event_id").cast("string"), 32, "0")).alias("trace_id"),
        F.when(odd, F.lpad(F.col("event_id").cast("string"), 16, "0")).alias("span_id"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"),
    )
    return with_date(_conform(rows, "logs"), "logs")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    begin = ntz(F.col("l_shipdate"))
    finish = begin + F.expr("interval '1' second") * F.col("l_quantity").cast("bigint")
    returned = F.col("l_returnflag") == "R"
    rows = li.select(
        F.lpad(F.col("l_orderkey").cast("string"), 32, "0").alias("trace_id"),
        F.lpad(F.concat(F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")), 16, "0").alias(
            "span_id"
        ),
        F.when(F.col("l_linenumber") > 1, F.lpad(F.col("l_orderkey").cast("string"), 16, "0")).alias(
            "parent_span_id"
        ),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"),
        (F.col("l_linenumber") % 6).alias("kind"),
        F.when(returned, finish).otherwise(begin).alias("start_time"),
        F.when(returned, begin).otherwise(finish).alias("end_time"),
        (F.when(returned, -1).otherwise(1) * F.col("l_quantity").cast("bigint") * 1_000_000_000).alias(
            "duration_ns"
        ),
        F.when(returned, 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("status_code"),
        service(F.col("l_suppkey"), 20).alias("service_name"),
        F.create_map(
            F.lit("linestatus"), F.col("l_linestatus"), F.lit("tax"), F.col("l_tax").cast("string")
        ).alias("attributes"),
    )
    return with_date(_conform(rows, "traces"), "traces")


ROWS = {"traces": traces, "metrics": metrics, "logs": logs}

# The same mappings as SQL, for the checks. Attributes are JSON text with keys in order.
METRICS_SQL = """
SELECT event_type AS metric_name,
       CASE event_id % 3 WHEN 0 THEN 'sum' WHEN 1 THEN 'gauge' ELSE 'histogram' END AS metric_type,
       value, ts AS timestamp, 'svc-' || CAST(user_id % 10 AS VARCHAR) AS service_name,
       CAST(CASE WHEN event_id % 3 <> 1 THEN 2 END AS INTEGER) AS aggregation_temporality,
       CASE WHEN event_id % 3 = 0 THEN TRUE END AS is_monotonic,
       '1' AS unit, '{"k":"' || regexp_extract(props, '[0-9]+') || '"}' AS attributes,
       CAST(ts AS DATE) AS date, event_id
FROM events"""

LOGS_SQL = """
SELECT ts AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
       CAST(CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS INTEGER) AS severity_number,
       event_type || ' ' || CAST(event_id AS VARCHAR) AS body,
       'svc-' || CAST(user_id % 10 AS VARCHAR) AS service_name,
       CASE WHEN event_id % 2 = 1 THEN lpad(CAST(event_id AS VARCHAR), 32, '0') END AS trace_id,
       CASE WHEN event_id % 2 = 1 THEN lpad(CAST(event_id AS VARCHAR), 16, '0') END AS span_id,
       '{"k":"' || regexp_extract(props, '[0-9]+') || '"}' AS attributes,
       CAST(ts AS DATE) AS date, event_id
FROM events"""

TRACES_SQL = """
SELECT lpad(CAST(l_orderkey AS VARCHAR), 32, '0') AS trace_id,
       lpad(CAST(l_partkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR), 16, '0') AS span_id,
       CASE WHEN l_linenumber > 1 THEN lpad(CAST(l_orderkey AS VARCHAR), 16, '0') END AS parent_span_id,
       'part-' || CAST(l_partkey AS VARCHAR) AS name,
       CAST(l_linenumber % 6 AS INTEGER) AS kind,
       CASE WHEN l_returnflag = 'R' THEN l_shipdate + to_seconds(CAST(l_quantity AS BIGINT))
            ELSE l_shipdate END AS start_time,
       CASE WHEN l_returnflag = 'R' THEN l_shipdate
            ELSE l_shipdate + to_seconds(CAST(l_quantity AS BIGINT)) END AS end_time,
       CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) * 1000000000 AS duration_ns,
       CAST(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS INTEGER) AS status_code,
       'svc-' || CAST(l_suppkey % 20 AS VARCHAR) AS service_name,
       '{"linestatus":"' || l_linestatus || '","tax":"' || CAST(l_tax AS VARCHAR) || '"}' AS attributes,
       CAST(l_shipdate AS DATE) AS date
FROM lineitem"""

SQL = {"traces": TRACES_SQL, "metrics": METRICS_SQL, "logs": LOGS_SQL}


def columns_sql(signal: str, date: bool = True) -> str:
    return ", ".join(c for c in TABLES[signal].fieldNames() if date or c != "date")
