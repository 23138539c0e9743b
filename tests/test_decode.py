"""Which lines are accepted, and what accepted lines decode to."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from teleskein.operators.decode import decode, utc_now

T0 = 1710000000000000000
AT = datetime(2024, 3, 9, 16)

SPAN = '{"resourceSpans":[{"scopeSpans":[{"spans":[%s]}]}]}'
LOG = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[%s]}]}]}'
METRIC = '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[%s]}]}]}'


def frame(spark, lines):
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "id int, value string")


def accepted_ids(spark, signal, lines, **options):
    options.setdefault("on_missing_time", "quarantine")
    decoded = decode(frame(spark, lines), signal, keep=("id",), now=F.expr("timestamp_ntz'2024-01-01'"), **options)
    kept = {r.id for r in decoded.rows.select("id").collect()} | {r.id for r in decoded.timeless.select("id").collect()}
    refused = {r.id for r in decoded.rejects.select("id").collect()}
    assert not kept & refused
    return kept, refused


def check(spark, signal, cases, **options):
    kept, refused = accepted_ids(spark, signal, [line for line, _ in cases], **options)
    wrong = [
        (line, good)
        for i, (line, good) in enumerate(cases)
        if (good == "rows" and i not in kept)
        or (good == "rejected" and i not in refused)
        or (good == "nothing" and (i in kept or i in refused))
    ]
    assert wrong == []


def test_log_lines(spark):
    ok, bad, none = "rows", "rejected", "nothing"
    record = '{"timeUnixNano":"1710000000000000000","severityNumber":9}'
    good = LOG % record
    check(
        spark,
        "logs",
        [
            (good, ok),
            ("", none),
            (" \t 　", none),
            ("  " + good + " \r", ok),
            ("not json", bad),
            ("null", bad),
            ("7", bad),
            ("[]", bad),
            ("{}", bad),
            (good + " xyz", bad),
            (good + good, bad),
            (good + "," + good, bad),
            (good + "}", bad),
            (good + "],[1", bad),
            (good[:-1], bad),
            (good.replace('"', "'"), bad),
            ('{"resourceLogs":null}', bad),
            ('{"resourceLogs":{}}', bad),
            ('{"resourceLogs":[]}', none),
            ('{"resourceLogs":[null]}', bad),
            ('{"resourceLogs":[{}]}', bad),
            ('{"resourceLogs":[{"scopeLogs":[]}]}', none),
            ('{"resourceLogs":[{"scopeLogs":[{}]}]}', bad),
            ('{"resourceLogs":[{"scopeLogs":[{"logRecords":[]}]}]}', none),
            ('{"resource_logs":[{"scope_logs":[{"log_records":[%s]}]}]}' % record, ok),
            ('{"resourceLogs":[],"resource_logs":[]}', bad),
            (LOG % '{"severityNumber":"9"}', bad),
            (LOG % '{"severityNumber":1.5}', bad),
            (LOG % '{"severityNumber":3000000000}', bad),
            (LOG % '{"severityNumber":null}', ok),
            (LOG % '{"severityText":9}', bad),
            (LOG % '{"severityText":{}}', bad),
            (LOG % '{"severityText":null,"body":null}', ok),
            (LOG % '{"traceId":"a","trace_id":"b"}', bad),
            (LOG % '{"traceId":null,"trace_id":"b"}', bad),
            (LOG % '{"traceId":"a","spanId":"b","span_id":"b"}', bad),
            (LOG % '{"traceId":"a"},{"trace_id":"b"}', ok),
            (LOG % '{"severityText":"A","severityText":"B"}', bad),
            (LOG % '{"unknown":{"name":1,"key":[2]},"severityText":"A"}', ok),
            (LOG % '{"body":{"stringValue":5}}', bad),
            (LOG % '{"body":{"boolValue":"true"}}', bad),
            (LOG % '{"body":{"doubleValue":"1"}}', bad),
            (LOG % '{"body":{"doubleValue":NaN}}', bad),
            (LOG % '{"body":{"doubleValue":1e400}}', bad),
            (LOG % '{"body":{"doubleValue":1e20}}', ok),
            (LOG % '{"body":{"intValue":[1,{"a":true}]}}', ok),
            (LOG % '{"body":"text"}', bad),
            (LOG % '{"attributes":[{"key":"a"}]}', ok),
            (LOG % '{"attributes":[{"key":"a","value":null}]}', ok),
            (LOG % '{"attributes":[{"value":{}}]}', bad),
            (LOG % '{"attributes":[{"key":null}]}', bad),
            (LOG % '{"attributes":[{"key":5}]}', bad),
            (LOG % '{"attributes":[null]}', bad),
            (LOG % '{"attributes":{}}', bad),
            (LOG % '{"s\\u0065verityText":5}', bad),
            (LOG % ('{"a":1},' + record), ok),
        ],
    )


def test_nano_forms(spark):
    forms = {
        '"1710000000000000000"': "rows",
        "1710000000000000000": "rows",
        "0": "rows",
        "null": "rows",
        '"soon"': "rows",
        '""': "rows",
        "9223372036854775807": "rows",
        "9223372036854775808": "rejected",
        "1.5": "rejected",
        "1e3": "rejected",
        "true": "rejected",
        "{}": "rejected",
        "[]": "rejected",
    }
    check(spark, "traces", [(SPAN % ('{"startTimeUnixNano":%s}' % n), good) for n, good in forms.items()])


def test_metric_lines(spark):
    ok, bad, none = "rows", "rejected", "nothing"
    check(
        spark,
        "metrics",
        [
            (METRIC % '{"name":"m","gauge":{"dataPoints":[{"asDouble":1}]}}', ok),
            (METRIC % '{"name":"m","gauge":{"data_points":[{"as_double":1}]}}', ok),
            (METRIC % '{"gauge":{"dataPoints":[{"asDouble":1}]}}', bad),
            (METRIC % '{"name":null}', bad),
            (METRIC % '{"name":7,"gauge":{"dataPoints":[]}}', bad),
            (METRIC % '{"name":"m","gauge":{}}', bad),
            (METRIC % '{"name":"m","sum":{"dataPoints":null}}', bad),
            (METRIC % '{"name":"m","sum":{"dataPoints":[null]}}', bad),
            (METRIC % '{"name":"m","sum":null}', none),
            (METRIC % '{"name":"m","exponentialHistogram":{"dataPoints":[{"scale":1}]}}', none),
            (METRIC % '{"name":"m","gauge":{"dataPoints":[{"asDouble":"1"}]}}', bad),
            (METRIC % '{"name":"m","gauge":{"dataPoints":[{"asInt":{"a":1}}]}}', ok),
            (METRIC % '{"name":"m","gauge":{"dataPoints":[{"sum":"not read here"}]}}', ok),
            (METRIC % '{"name":"m","histogram":{"dataPoints":[{"sum":"x"}]}}', bad),
            (METRIC % '{"name":"m","sum":{"dataPoints":[],"isMonotonic":"true"}}', bad),
            (METRIC % '{"name":"m","sum":{"dataPoints":[],"aggregationTemporality":2.0}}', bad),
            (METRIC % '{"name":"m","unit":5}', bad),
        ],
    )


def test_lax_mode_takes_trailing_text_but_not_wrong_types(spark):
    good = LOG % '{"severityText":"A"}'
    check(
        spark,
        "logs",
        [(good, "rows"), (good + " xyz", "rows"), (LOG % '{"severityNumber":"9"}', "rejected"), ("{", "rejected")],
        strict=False,
    )


def one(spark, signal, line, **options):
    return decode(frame(spark, [line]), signal, **options).rows.first().asDict()


def test_span(spark):
    row = one(
        spark,
        "traces",
        json.dumps(
            {
                "resourceSpans": [
                    {
                        "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "my-svc"}}]},
                        "scopeSpans": [
                            {
                                "spans": [
                                    {
                                        "traceId": "abc",
                                        "spanId": "def",
                                        "name": "test-span",
                                        "kind": 1,
                                        "startTimeUnixNano": T0 + 999,
                                        "endTimeUnixNano": str(T0 + 10**9),
                                        "attributes": [
                                            {"key": "http.method", "value": {"stringValue": "GET"}},
                                            {"key": "http.status", "value": {"intValue": 200}},
                                        ],
                                    }
                                ]
                            }
                        ],
                    }
                ]
            }
        ),
    )
    assert row == {
        "trace_id": "abc",
        "span_id": "def",
        "parent_span_id": None,
        "name": "test-span",
        "kind": 1,
        "start_time": AT,
        "end_time": AT + timedelta(seconds=1),
        "duration_ns": 10**9 - 999,
        "status_code": 0,
        "service_name": "my-svc",
        "attributes": {"http.method": "GET", "http.status": "200"},
        "date": AT.date(),
    }


def test_points_in_order_of_kind(spark):
    point = '{"timeUnixNano":"%d",%s}'
    line = METRIC % (
        '{"name":"m","unit":"1","histogram":{"dataPoints":[%s],"aggregationTemporality":1},'
        '"gauge":{"dataPoints":[%s]},"sum":{"dataPoints":[%s,%s],"aggregationTemporality":2,"isMonotonic":true}}'
        % (point % (T0, '"sum":2.5,"count":"3"'), point % (T0, '"asInt":"1"'), point % (T0, '"asDouble":42.0'), point % (T0, '"asInt":7'))
    )
    rows = decode(frame(spark, [line]), "metrics").rows.collect()
    assert [(r.metric_type, r.value, r.aggregation_temporality, r.is_monotonic, r.unit) for r in rows] == [
        ("sum", 42.0, 2, True, "1"),
        ("sum", 7.0, 2, True, "1"),
        ("gauge", 1.0, None, None, "1"),
        ("histogram", 2.5, 1, None, "1"),
    ]


POINTS = [
    ('"asInt":"1e3"', 1000.0),
    ('"asInt":" 1"', 0.0),
    ('"asInt":"1d"', 0.0),
    ('"asInt":"+.5"', 0.5),
    ('"asInt":"-inf"', float("-inf")),
    ('"asInt":true', 0.0),
    ('"asInt":"true"', 0.0),
    ('"asInt":1.25', 1.25),
    ('"asInt":18446744073709551615', 18446744073709551615.0),
    ('"asInt":null', 0.0),
    ('"asDouble":2,"asInt":3', 2.0),
]


def values_in_order(spark, signal, lines, column):
    rows = decode(frame(spark, lines), signal, keep=("id",)).rows.select("id", column).collect()
    return [value for _, value in sorted(rows)]


def test_point_value(spark):
    line = '{"name":"m","gauge":{"dataPoints":[{"timeUnixNano":"%d",%s}]}}'
    lines = [METRIC % (line % (T0, sent)) for sent, _ in POINTS]
    assert values_in_order(spark, "metrics", lines, "value") == [value for _, value in POINTS]


TEXTS = [
    ('{"stringValue":"x","intValue":1}', "x"),
    ('{"stringValue":""}', ""),
    ('{"intValue":200}', "200"),
    ('{"intValue":"0200"}', "0200"),
    ('{"intValue":true}', ""),
    ('{"intValue":[1]}', ""),
    ('{"intValue":null,"boolValue":false}', "false"),
    ('{"intValue":1.50}', "1.5"),
    ('{"intValue":1.0}', "1.0"),
    ('{"intValue":1e20}', "1e20"),
    ('{"intValue":1e-7}', "1e-7"),
    ('{"intValue":123456.75e4}', "1234567500.0"),
    ('{"intValue":18446744073709551615}', "18446744073709551615"),
    ('{"boolValue":true,"doubleValue":1}', "true"),
    ('{"doubleValue":1}', "1"),
    ('{"doubleValue":1.0}', "1"),
    ('{"doubleValue":-0.0}', "-0"),
    ('{"doubleValue":0.25}', "0.25"),
    ('{"doubleValue":1e20}', "100000000000000000000"),
    ('{"doubleValue":1e-7}', "0.0000001"),
    ('{"doubleValue":12345678.9}', "12345678.9"),
    ('{"doubleValue":5.684341886080802e-14}', "0.00000000000005684341886080802"),
    ('{"arrayValue":{"values":[]}}', ""),
    ("{}", ""),
]


def test_value_text(spark):
    lines = [LOG % ('{"timeUnixNano":"%d","body":%s}' % (T0, value)) for value, _ in TEXTS]
    assert values_in_order(spark, "logs", lines, "body") == [text for _, text in TEXTS]


def test_log_time_and_ids(spark):
    now = datetime(2024, 6, 1, 12)
    lines = [
        LOG % ('{"observedTimeUnixNano":"%d"}' % T0),
        LOG % '{"traceId":"","spanId":"s"}',
        LOG % ('{"timeUnixNano":%d,"observedTimeUnixNano":1}' % (T0 + 10**9)),
    ]
    rows = decode(frame(spark, lines), "logs", now=F.lit(str(now)).cast("timestamp_ntz"), keep=("id",)).rows
    got = {r.id: (r.timestamp, r.trace_id, r.span_id, r.body) for r in rows.collect()}
    assert got == {
        0: (AT, None, None, None),
        1: (now, None, "s", None),
        2: (AT + timedelta(seconds=1), None, None, None),
    }


def test_default_now_is_utc(spark):
    from datetime import timezone

    row = one(spark, "logs", LOG % "{}")
    assert abs(row["timestamp"] - datetime.now(timezone.utc).replace(tzinfo=None)) < timedelta(minutes=5)
    assert spark.range(1).select(utc_now()).first()[0] is not None


@pytest.mark.parametrize(("start", "end", "duration"), [(T0, T0 - 5, -5), (T0, 0, 0), (-2 * 10**9, T0, T0 + 2 * 10**9), (-5, T0, 0)])
def test_duration(spark, start, end, duration):
    line = SPAN % ('{"startTimeUnixNano":%d,"endTimeUnixNano":"%d"}' % (start, end))
    decoded = decode(frame(spark, [line]), "traces", on_missing_time="quarantine")
    row = decoded.rows.first() or decoded.timeless.first()
    assert row.duration_ns == duration


def test_missing_time_fails_by_default(spark):
    with pytest.raises(Exception, match="no valid start_time"):
        decode(frame(spark, [SPAN % "{}"]), "traces").rows.collect()


def test_repeated_attribute_keeps_last(spark):
    attrs = '[{"key":"a","value":{"intValue":1}},{"key":"b"},{"key":"a","value":{"intValue":"2"}}]'
    row = one(spark, "traces", SPAN % ('{"startTimeUnixNano":%d,"attributes":%s}' % (T0, attrs)))
    assert row["attributes"] == {"a": "2", "b": ""}


def test_bad_utf8_is_rejected(spark):
    good = LOG % '{"severityText":"A"}'
    lines = frame(spark, [good, good])
    broken = lines.withColumn(
        "value",
        F.when(F.col("id") == 1, F.concat(F.col("value").cast("binary"), F.expr("X'ff'")).cast("string")).otherwise(
            F.col("value")
        ),
    )
    decoded = decode(broken, "logs", keep=("id",))
    assert [r.id for r in decoded.rows.collect()] == [0]
    assert [r.id for r in decoded.rejects.select("id").collect()] == [1]


def test_parse_is_not_repeated(spark):
    """One typed parse, one careful parse and one syntax check in the plan of the rows."""
    rows = decode(frame(spark, [LOG % "{}"]), "logs").rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and plan.count("try_parse_json(") <= 1


def test_a_line_beyond_the_variant_limit_is_judged_by_its_records(spark, tmp_path):
    from teleskein.operators.decode import decode

    record = '{"timeUnixNano":"1710000000000000000","body":{"stringValue":"' + "x" * 1000 + '"}}'
    records = ",".join([record] * 133_000)
    good = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[' + records + "]}]}]}"
    bad = good[:-5] + ',{"body":{"stringValue":"a"},"body":{"stringValue":"b"}}' + good[-5:]
    wrong = good + " trailing"
    (tmp_path / "good.txt").write_text(good + "\n")
    (tmp_path / "bad.txt").write_text(bad + "\n" + wrong + "\n")
    decoded = decode(spark.read.text(str(tmp_path / "good.txt")), "logs")
    assert decoded.rows.count() == 133_000 and decoded.rejects.count() == 0
    refused = decode(spark.read.text(str(tmp_path / "bad.txt")), "logs")
    assert refused.rejects.count() == 2 and refused.rows.count() == 0
