"""Scans, aggregates, time expressions, rendering, encoding and retention on small fixtures."""

from __future__ import annotations

import json
import random
import struct
import time
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from teleskein.functions import render, timeexpr, values
from teleskein.operators.decode import decode
from teleskein.operators.encode import encode, route, write_routed
from teleskein.operators.retention import cutoff_time, prune
from teleskein.operators.scan import QueryOptions, aggregate_metric, scan_logs, scan_metrics, scan_traces
from teleskein.schemas import TABLES
from teleskein.session import CLEANUP
from teleskein.sources import jsonl, paths
from teleskein.tables import SignalStore

DAY = datetime(2024, 3, 9)


def rows(spark, signal, data):
    schema = TABLES[signal]
    time = "start_time" if signal == "traces" else "timestamp"
    full = [tuple({**{f.name: None for f in schema}, **d, "date": d[time].date()}[f.name] for f in schema) for d in data]
    return spark.createDataFrame(full, schema)


def span(service, hour, seconds=1, **more):
    start = DAY + timedelta(hours=hour)
    base = dict(trace_id="t", span_id="s", name="n", kind=1, start_time=start, end_time=start + timedelta(seconds=seconds))
    return {**base, "duration_ns": seconds * 10**9, "status_code": 0, "service_name": service, "attributes": {}, **more}


@pytest.fixture(scope="module")
def traces(spark):
    return rows(spark, "traces", [span("svc-b", 17, 2, kind=2, parent_span_id="p"), span("svc-a", 16)])


@pytest.fixture(scope="module")
def metrics(spark):
    point = dict(metric_name="http.requests", metric_type="sum", value=42.0, timestamp=DAY, service_name="svc-a")
    return rows(spark, "metrics", [{**point, "aggregation_temporality": 2, "is_monotonic": True, "unit": "1"}])


@pytest.fixture(scope="module")
def logs(spark):
    return rows(spark, "logs", [dict(timestamp=DAY, severity="INFO", severity_number=9, body="hi", service_name="svc-a")])


def services(df):
    return [r.service_name for r in df.collect()]


def test_scans(traces, metrics, logs):
    assert services(scan_traces(traces)) == ["svc-a", "svc-b"]
    assert services(scan_traces(traces, QueryOptions(service="svc-a"))) == ["svc-a"]
    assert services(scan_traces(traces, QueryOptions(service="SVC-A"))) == []
    assert services(scan_traces(traces, QueryOptions(limit=1))) == ["svc-a"]
    assert services(scan_traces(traces, QueryOptions(limit=0))) == ["svc-a", "svc-b"]
    at = DAY + timedelta(hours=16)
    assert services(scan_traces(traces, QueryOptions(since=at, until=at))) == ["svc-a"]
    assert services(scan_traces(traces, QueryOptions(since=at + timedelta(microseconds=1)))) == ["svc-b"]
    assert scan_traces(traces).columns == [f for f in TABLES["traces"].fieldNames() if f != "date"]
    assert scan_metrics(metrics).first().value == 42.0
    assert scan_logs(logs).first().body == "hi"


def test_aggregate(metrics):
    row = aggregate_metric(metrics, "http.requests").first()
    assert (row.metric_name, row.service_name, row["count"], row.avg, row.min, row.max) == ("http.requests", None, 1, 42.0, 42.0, 42.0)
    none = aggregate_metric(metrics, "absent", QueryOptions(service="x")).collect()
    assert [tuple(r) for r in none] == [("absent", "x", 0, None, None, None)]


def test_options_from_text(traces):
    now = DAY + timedelta(hours=18)
    assert services(scan_traces(traces, QueryOptions.parse(since="90m", now=now))) == ["svc-b"]
    assert services(scan_traces(traces, QueryOptions.parse(until="2024-03-09T17:00:00+01:00", now=now))) == ["svc-a"]
    with pytest.raises(Exception, match="cannot parse"):
        scan_traces(traces, QueryOptions.parse(since="yesterday", now=now)).collect()


def test_duration_text():
    assert timeexpr.duration("7d") == timedelta(days=7)
    assert timeexpr.duration(" 24h ") == timedelta(hours=24)
    assert timeexpr.duration("-30m") == timedelta(minutes=-30)
    assert timeexpr.duration("60s") == timedelta(seconds=60)
    for wrong in ("", "5", "1.5h", "1h30m", "500ms", "1w", "h"):
        with pytest.raises(ValueError):
            timeexpr.duration(wrong)


def test_interval_settings():
    texts = {"2m": 120, "30s": 30, "500ms": 0.5, "1h": 3600, "1.5m": 90, "invalid": 120, "1.5ms": 120, "": 120}
    assert {t: timeexpr.interval_seconds(t) for t in texts} == texts
    timeouts = {"1s": 1, "5s": 5, "500ms": 0.5, "invalid": 1, "0.5s": 0.5, "2m": 1}
    assert {t: timeexpr.batch_timeout_seconds(t) for t in timeouts} == timeouts
    assert timeexpr.trigger_text(120) == "120000 milliseconds"


def test_time_expression(spark):
    texts = ["2024-01-15T10:30:00Z", "2024-01-15T10:30:00.123456789+02:00", "1h", "2024-01-15", "2024-13-01T00:00:00Z", "2024-01-15 10:30:00z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    now = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    got = [r.at for r in df.select("id", timeexpr.parse_time(F.col("t"), now).alias("at")).orderBy("id").collect()]
    assert got == [
        datetime(2024, 1, 15, 10, 30),
        datetime(2024, 1, 15, 8, 30, 0, 123456),
        datetime(2024, 1, 31, 23),
        None,
        None,
        datetime(2024, 1, 15, 10, 30),
    ]


def test_double_text_is_plain_and_short(spark):
    random.seed(7)
    numbers = [0.0, -0.0, 1.0, 1e16, 1e17, 1e-5, 123456.789, 0.001, 9999999.5, 2.0**-44, 1234567890123456.7]
    numbers += [random.uniform(-1e9, 1e9) for _ in range(500)]
    numbers += [round(random.uniform(0, 1e12), 3) for _ in range(500)]
    numbers += [random.random() * 10 ** random.randint(-30, 16) for _ in range(500)]
    numbers += [random.uniform(-1, 1) * 10 ** random.randint(17, 36) for _ in range(2000)] + [7.580405169937588e17, 2.0**63, 1e22]

    def plain(x):
        text = format(Decimal(repr(x)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text

    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    wrong = [(r.x, r.t) for r in df.select("x", values.double_text(F.col("x")).alias("t")).collect() if r.t != plain(r.x)]
    assert wrong == []


def test_any_double_text_reads_back_as_itself(spark):
    random.seed(3)
    numbers = [struct.unpack("d", random.randbytes(8))[0] for _ in range(1000)]
    numbers = [x for x in numbers if x == x and abs(x) != float("inf")]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for r in df.select("x", values.double_text(F.col("x")).alias("t")).collect():
        assert float(r.t) == r.x and "e" not in r.t.lower()


def test_json_results(traces, metrics, logs):
    second = json.loads(render.json_lines(scan_traces(traces)).collect()[1].value)
    assert second["start_time"] == "2024-03-09T17:00:00" and second["parent_span_id"] == "p"
    assert second["attributes"] == {}
    open_span = traces.withColumn("end_time", F.lit(None).cast("timestamp_ntz"))
    first = json.loads(render.json_lines(scan_traces(open_span)).first().value)
    assert first["end_time"] is None and "parent_span_id" not in first
    silent = logs.withColumn("body", F.lit(None).cast("string"))
    record = json.loads(render.json_lines(scan_logs(silent)).first().value)
    assert record["body"] is None and "trace_id" not in record
    total = json.loads(render.json_lines(aggregate_metric(metrics, "absent")).first().value)
    assert total == {"metric_name": "absent", "count": 0}


def test_time_text(spark):
    texts = ["2024-01-01 00:00:00", "2024-01-01 00:00:00.5", "2024-01-01 00:00:00.123456"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in df.select(render.time_text(F.col("t"))).collect()] == [
        "2024-01-01T00:00:00",
        "2024-01-01T00:00:00.500",
        "2024-01-01T00:00:00.123456",
    ]


@pytest.mark.parametrize("signal", ["traces", "metrics", "logs"])
def test_decode_of_encode_is_identity(spark, traces, metrics, logs, signal):
    given = {"traces": traces, "metrics": metrics, "logs": logs}[signal]
    given = given.withColumn("attributes", F.expr("map('k', 'v \"quoted\" \\n', 'ü', '')"))
    many = given.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("_n")
    lines = encode(many, signal, records_per_line=3)
    back = decode(lines, signal).rows
    assert sorted(map(str, back.collect())) == sorted(map(str, many.collect()))
    assert {r.signal for r in route(lines).collect()} == {signal}


def test_one_hot_service_fills_bounded_batches(spark, metrics):
    many = spark.range(0, 5000, 1, 3).select(F.lit("hot").alias("service_name"))
    logs = many.selectExpr(
        "timestamp_ntz'2024-01-01' as timestamp", "'I' as severity", "1 as severity_number", "'b' as body",
        "service_name", "'t' as trace_id", "'s' as span_id", "map('a','b') as attributes", "date'2024-01-01' as date",
    )
    sizes = [len(json.loads(r.value)["resourceLogs"][0]["scopeLogs"][0]["logRecords"]) for r in encode(logs, "logs", 100).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 100


def test_routing_of_odd_lines(spark):
    lines = ['{"resource_spans":[]}', '{"other":{"resourceLogs":[]}}', "junk", '{"resourceLogs":1}', "", " \t", '{"resourceLogs":[],"resourceSpans":[]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, value string")
    got = [(r.id, r.signal) for r in route(df).orderBy("id", "signal").collect()]
    assert got == [(0, "traces"), (1, "unrouted"), (2, "unrouted"), (3, "logs"), (6, "logs"), (6, "traces")]


def old_store(spark):
    store = SignalStore(spark)
    early, late = datetime(2024, 1, 1), datetime(2024, 12, 1)
    store.append("traces", rows(spark, "traces", [span("svc-a", 0, start_time=early), span("svc-a", 0, start_time=late)]))
    point = dict(metric_name="m", metric_type="gauge", value=1.0, timestamp=early, service_name="svc-a")
    store.append("metrics", rows(spark, "metrics", [point]))
    store.append("logs", rows(spark, "logs", [dict(timestamp=early, service_name="svc-a")]))
    return store


def test_prune(spark):
    store, cutoff = old_store(spark), datetime(2024, 6, 1)
    dry = prune(store, cutoff, dry_run=True).collect()
    assert [tuple(r) for r in dry] == [(s, None, 1, "2024-06-01T00:00:00") for s in ("traces", "metrics", "logs")]
    assert store.table("traces").count() == 2
    store.append("traces", rows(spark, "traces", [span("svc-b", 0, start_time=datetime(2024, 1, 1))]))
    assert [r.deleted for r in prune(store, cutoff, service="svc-a").collect()] == [1, 1, 1]
    assert sorted(services(store.table("traces"))) == ["svc-a", "svc-b"]
    assert [r.deleted for r in prune(store, cutoff).collect()] == [1, 0, 0]
    assert [r.deleted for r in prune(store, cutoff).collect()] == [0, 0, 0]
    assert services(store.table("traces")) == ["svc-a"]


def test_prune_keeps_rows_at_the_cutoff(spark):
    store = SignalStore(spark)
    at = datetime(2024, 6, 1, 12)
    points = [dict(timestamp=at + timedelta(microseconds=d), service_name="s", body=str(d)) for d in (-1, 0, 1)]
    store.append("logs", rows(spark, "logs", points))
    prune(store, at)
    assert sorted(r.body for r in store.table("logs").collect()) == ["0", "1"]


def test_cutoff_arguments():
    now = datetime(2024, 6, 1)
    assert cutoff_time(older_than="7d", now=now) == datetime(2024, 5, 25)
    assert cutoff_time(all_rows=True, now=now) == now + timedelta(hours=1)
    for wrong in ({}, {"older_than": "7d", "all_rows": True}, {"older_than": "soon"}):
        with pytest.raises(ValueError):
            cutoff_time(**wrong)


def test_tables_are_made_once_and_open_to_sql(spark, tmp_path):
    root = str(tmp_path / "store")
    store = SignalStore(spark, root)
    store.append("logs", rows(spark, "logs", [dict(timestamp=DAY, service_name="a", attributes={"k": "v"})]))
    store = SignalStore(spark, root)
    got = store.sql("SELECT service_name, attributes['k'] AS k, date FROM logs LIMIT 5").collect()
    assert [tuple(r) for r in got] == [("a", "v", DAY.date())]
    names = [r[0] for r in store.sql("SHOW TABLES").select("tableName").collect()]
    assert {"traces", "metrics", "logs", "ingest_cursors"} <= set(names)
    columns = store.columns().filter("table_name = 'traces'").orderBy("ordinal_position").collect()
    assert [r.column_name for r in columns] == TABLES["traces"].fieldNames()
    assert store.sql("SELECT count(*) FROM traces").first()[0] == 0
    with pytest.raises(Exception, match="must not be NULL"):
        store.append("logs", rows(spark, "logs", [dict(timestamp=DAY, service_name="a")]).withColumn("service_name", F.lit(None).cast("string")))


def test_scan_prunes_partitions_and_pushes_filters(spark, tmp_path):
    store = SignalStore(spark, str(tmp_path / "store"))
    store.append("metrics", rows(spark, "metrics", [
        dict(metric_name="m", metric_type="gauge", value=1.0, timestamp=DAY + timedelta(days=d), service_name="s") for d in range(4)
    ]))
    options = QueryOptions(service="s", since=DAY + timedelta(days=2))
    df = aggregate_metric(store.table("metrics"), "m", options)
    assert df.first()["count"] == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "EqualTo(metric_name,m)" in plan
    assert "ReadSchema: struct<metric_name:string,value:double,timestamp:timestamp_ntz,service_name:string>" in plan


def test_compressed_lines_take_little_disk_and_leave_no_shuffle_files(spark, tmp_path):
    logs = rows(spark, "logs", [dict(timestamp=DAY + timedelta(seconds=k), severity="INFO", severity_number=9, body=f"b{k}", service_name="a", attributes={}) for k in range(3000)])
    size, before = {}, spark.conf.get(CLEANUP)
    first = spark._jsc.sc().newShuffleId()
    for compression in (None, "gzip"):
        root = str(tmp_path / f"{compression}")
        jsonl.write_rows(logs, root, "logs", compression=compression)
        back = jsonl.scan_all(spark, root)["logs"].rows
        assert sorted(r.body for r in back.collect()) == sorted(f"b{k}" for k in range(3000))
        size[compression] = sum(paths.sizes(root).values())
    assert size["gzip"] < size[None] / 4
    last, end = spark._jsc.sc().newShuffleId(), time.time() + 10

    def left():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = [files.apply(k).getName() for k in range(files.size())]
        return [n for n in found if n.startswith("shuffle_") and first < int(n.split("_")[1]) < last]

    while left() and time.time() < end:
        time.sleep(0.2)
    assert last > first + 2 and not left() and spark.conf.get(CLEANUP) == before


def test_routed_lines_are_compressed(spark, tmp_path):
    lines = spark.createDataFrame([(f'{{"resourceLogs":[{{"x":{k % 7}}}]}}',) for k in range(2000)] + [("stray",)], "value string")
    size = {}
    for compression in (None, "gzip"):
        root = str(tmp_path / f"{compression}")
        write_routed(lines, root, compression=compression)
        assert jsonl.read_lines(spark, root, "logs").count() == 2000
        assert [r.value for r in spark.read.text(f"{root}/signal=unrouted").collect()] == ["stray"]
        size[compression] = sum(paths.sizes(root).values())
    assert size["gzip"] < size[None] / 4
