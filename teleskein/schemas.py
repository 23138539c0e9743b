"""Column layout of the three signal tables and of the cursor table."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNALS = ("traces", "metrics", "logs")

# The time column each signal is filtered, sorted and pruned on.
TIME_COLUMN = {"traces": "start_time", "metrics": "timestamp", "logs": "timestamp"}


def _field(name: str, kind: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)


_TEXT, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_TIME, _DATE = T.TimestampNTZType(), T.DateType()
_ATTRIBUTES = T.MapType(T.StringType(), T.StringType())

TRACES = T.StructType(
    [
        _field("trace_id", _TEXT, False),
        _field("span_id", _TEXT, False),
        _field("parent_span_id", _TEXT),
        _field("name", _TEXT, False),
        _field("kind", _INT),
        _field("start_time", _TIME, False),
        _field("end_time", _TIME),
        _field("duration_ns", _LONG),
        _field("status_code", _INT),
        _field("service_name", _TEXT, False),
        _field("attributes", _ATTRIBUTES),
        _field("date", _DATE, False),
    ]
)

METRICS = T.StructType(
    [
        _field("metric_name", _TEXT, False),
        _field("metric_type", _TEXT, False),
        _field("value", T.DoubleType()),
        _field("timestamp", _TIME, False),
        _field("service_name", _TEXT, False),
        _field("aggregation_temporality", _INT),
        _field("is_monotonic", T.BooleanType()),
        _field("unit", _TEXT),
        _field("attributes", _ATTRIBUTES),
        _field("date", _DATE, False),
    ]
)

LOGS = T.StructType(
    [
        _field("timestamp", _TIME, False),
        _field("severity", _TEXT),
        _field("severity_number", _INT),
        _field("body", _TEXT),
        _field("service_name", _TEXT, False),
        _field("trace_id", _TEXT),
        _field("span_id", _TEXT),
        _field("attributes", _ATTRIBUTES),
        _field("date", _DATE, False),
    ]
)

TABLES = {"traces": TRACES, "metrics": METRICS, "logs": LOGS}

INGEST_CURSORS = T.StructType(
    [_field("file_path", _TEXT, False), _field("byte_offset", _LONG, False)]
)


def check_signal(signal: str) -> str:
    if signal not in TABLES:
        raise ValueError(f"unknown signal {signal!r}; expected one of {', '.join(SIGNALS)}")
    return signal
