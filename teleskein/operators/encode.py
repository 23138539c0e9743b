"""Flat signal rows to OTLP/JSON lines, and routing of mixed lines to their signal.

Rows are gathered into export batches of at most ``records_per_line`` records. A batch is a
run of neighbouring rows of one input partition, so its size is bounded whatever the data
holds: a service that owns a third of all rows just fills more batches. Rows are numbered by
their place in the partition; give ``encode`` a DataFrame that reads tables or files, whose
partitions come out in the same order if a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleskein.functions import wire
from teleskein.functions.values import int_div, time_to_nanos
from teleskein.schemas import SIGNALS, check_signal
from teleskein.session import scratch_dir, shuffles_dropped

# Records per export batch, the collector's default batch size.
RECORDS_PER_LINE = 1024

SCOPE_NAME = "teleskein"


def _nano_text(time: Column) -> Column:
    return time_to_nanos(time).cast("string")


def _text_value(text: Column) -> Column:
    return F.when(text.isNotNull(), F.struct(text.alias("stringValue")))


def _key_values(attributes: Column) -> Column:
    return F.transform(
        F.map_entries(attributes),
        lambda e: F.struct(e["key"].alias("key"), _text_value(e["value"]).alias("value")),
    )


def _span() -> Column:
    start, end = F.col("start_time"), F.col("end_time")
    return F.struct(
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"),
        F.col("name").alias("name"),
        F.col("kind").alias("kind"),
        _nano_text(start).alias("startTimeUnixNano"),
        _nano_text(end).alias("endTimeUnixNano"),
        F.struct(F.col("status_code").alias("code")).alias("status"),
        _key_values(F.col("attributes")).alias("attributes"),
    )


def _log_record() -> Column:
    return F.struct(
        _nano_text(F.col("timestamp")).alias("timeUnixNano"),
        F.col("severity").alias("severityText"),
        F.col("severity_number").alias("severityNumber"),
        _text_value(F.col("body")).alias("body"),
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        _key_values(F.col("attributes")).alias("attributes"),
    )


def _point() -> Column:
    is_histogram = F.col("metric_type") == "histogram"
    return F.struct(
        _key_values(F.col("attributes")).alias("attributes"),
        _nano_text(F.col("timestamp")).alias("timeUnixNano"),
        F.when(~is_histogram, F.col("value")).alias("asDouble"),
        F.when(is_histogram, F.col("value")).alias("sum"),
    )


def _metric(points: Column) -> Column:
    kind = F.col("metric_type")
    temporality = F.col("aggregation_temporality").alias("aggregationTemporality")
    return F.struct(
        F.col("metric_name").alias("name"),
        F.col("unit").alias("unit"),
        F.when(
            kind == "sum",
            F.struct(
                points.alias("dataPoints"), temporality, F.col("is_monotonic").alias("isMonotonic")
            ),
        ).alias("sum"),
        F.when(kind == "gauge", F.struct(points.alias("dataPoints"))).alias("gauge"),
        F.when(kind == "histogram", F.struct(points.alias("dataPoints"), temporality)).alias(
            "histogram"
        ),
    )


# Kind of the lines that hold none of the root lists.
UNROUTED = "unrouted"


def _line(signal: str, records: Column) -> Column:
    resources, scopes, record_key = wire.KEYS[signal]
    service = F.struct(
        F.lit("service.name").alias("key"),
        F.struct(F.col("service_name").alias("stringValue")).alias("value"),
    )
    scope = F.struct(
        F.struct(F.lit(SCOPE_NAME).alias("name")).alias("scope"), records.alias(record_key)
    )
    resource = F.struct(
        F.struct(F.array(service).alias("attributes")).alias("resource"),
        F.array(scope).alias(scopes),
    )
    return F.to_json(F.struct(F.array(resource).alias(resources)))


def encode(rows: DataFrame, signal: str, records_per_line: int = RECORDS_PER_LINE) -> DataFrame:
    """One column ``value``: a compact JSON export batch per row."""
    if records_per_line < 1:
        raise ValueError("records_per_line must be at least 1")
    check_signal(signal)
    batched = rows.withColumn("_batch", int_div(F.monotonically_increasing_id(), records_per_line))
    batch = ["_batch", "service_name"]
    # Gathering lists saves no volume before a shuffle, so flat rows are shuffled first and
    # nested and gathered behind it.
    if signal == "metrics":
        identity = ["metric_name", "metric_type", "unit", "aggregation_temporality", "is_monotonic"]
        points = (
            batched.repartition(*batch)  # serves both groupings below
            .groupBy(*batch, *identity)
            .agg(F.collect_list(_point()).alias("_points"))
        )
        grouped = points.groupBy(*batch).agg(
            F.collect_list(_metric(F.col("_points"))).alias("_records")
        )
    else:
        record = _span() if signal == "traces" else _log_record()
        grouped = (
            batched.repartition(*batch).groupBy(*batch).agg(F.collect_list(record).alias("_records"))
        )
    return grouped.select(_line(signal, F.col("_records")).alias("value"))


def route(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add ``signal`` to a mixed line table: the kind whose root list the line holds.

    A line with several root lists comes once for each; one with none, also if it is no JSON,
    is ``unrouted``. Blank lines hold nothing and are left out. The test reads only the
    top-level keys.
    """
    keys = F.coalesce(F.json_object_keys(F.col(line)), F.array().cast("array<string>"))
    kinds = F.array_compact(
        F.array(*[F.when(F.arrays_overlap(keys, F.array(*map(F.lit, wire.spellings(wire.KEYS[s][0])))), s) for s in SIGNALS])
    )
    signal = F.explode(F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit(UNROUTED))))
    return lines.filter(F.col(line).rlike(r"\S")).select("*", signal.alias("signal"))


def split_by_signal(lines: DataFrame, line: str = "value") -> dict[str, DataFrame]:
    """The line tables of a mixed one: one per signal, and ``unrouted``.

    The routed lines are written once to the scratch folder; each table reads its part.
    """
    root = scratch_dir(lines.sparkSession, "split")
    with shuffles_dropped(lines.sparkSession):
        route(lines, line).write.partitionBy("signal").parquet(root)
    schema = T.StructType([*lines.schema.fields, T.StructField("signal", T.StringType())])
    routed = lines.sparkSession.read.schema(schema).parquet(root)
    return {s: routed.filter(F.col("signal") == s).drop("signal") for s in (*SIGNALS, UNROUTED)}


def write_routed(lines: DataFrame, root: str, line: str = "value", compression: str | None = None) -> None:
    """Append mixed lines to one folder per signal, ``<root>/signal=<kind>``, in one pass;
    unrouted ones go to a folder of their own. ``compression="gzip"`` as in ``write_lines``."""
    routed = route(lines, line).select(F.col(line).alias("value"), "signal")
    options = {"compression": compression} if compression else {}
    with shuffles_dropped(lines.sparkSession):
        routed.write.mode("append").options(**options).partitionBy("signal").text(root)
