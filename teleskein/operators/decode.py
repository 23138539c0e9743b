"""OTLP/JSON lines to flat signal rows.

Per line: parse once, decide whether the whole line is accepted, then unnest with
generators. No shuffle and no Python code run on the way; a task holds one line at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleskein.functions import values, wire
from teleskein.functions.cache import built_once
from teleskein.functions.wire import pick
from teleskein.schemas import TABLES, TIME_COLUMN, check_signal

# What counts as blank at the ends of a line (Unicode white space).
BLANKS = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

ON_MISSING_TIME = ("fail", "quarantine")


@dataclass(frozen=True)
class Decoded:
    """``rows`` in the table layout; ``rejects`` are refused lines; ``timeless`` are records
    without a valid time (only filled in quarantine mode)."""

    rows: DataFrame
    rejects: DataFrame
    timeless: DataFrame


def _marked_document(line: Column) -> Column:
    """The line as VARIANT inside an array that ends in a mark derived from the line.

    NULL for anything but JSON and for an object that repeats a key. Text after the first
    JSON value shows as a further element, and text that closes the array early cannot supply
    the mark.
    """
    return F.try_parse_json(
        F.concat(F.lit("["), line, F.lit(","), F.xxhash64(line).cast("string"), F.lit("]"))
    )


def _is_one_value(document: Column, line: Column) -> Column:
    return F.coalesce(
        (F.try_variant_get(document, "$[1]", "bigint") == F.xxhash64(line))
        & F.try_variant_get(document, "$[2]", "variant").isNull(),
        F.lit(False),
    )


# A VARIANT has a greatest size; lines over this many bytes that make none are judged in parts.
LONG_LINE = 16 << 20


def _long_line_ok(line: Column, signal: str) -> Column:
    """What the VARIANT of a line tells, for a line too long to make one: it is one JSON value,
    and no object repeats a key. Records are judged one by one; what stands around them is
    short. Field types are left to the parse with VARIANT leaves."""
    resources, scopes, records = wire.KEYS[signal]

    def lists(text: Column, key: str) -> Column:
        names = wire.spellings(key)
        parsed = F.from_json(text, ", ".join(f"`{n}` array<string>" for n in names))
        return F.concat(*[F.coalesce(parsed[n], F.array().cast("array<string>")) for n in names])

    def unique(text: Column) -> Column:
        keys = F.json_object_keys(text)
        return F.size(F.array_distinct(keys)) == F.size(keys)

    def whole(text: Column) -> Column:
        return text.isNull() | (F.octet_length(text) > LONG_LINE) | F.try_parse_json(text).isNotNull()

    def around(text: Column, key: str, child: str, inner) -> Column:
        return unique(text) & whole(F.from_json(text, f"{key} string")[key]) & F.forall(lists(text, child), inner)

    marked = F.concat(F.lit("["), line, F.lit(","), F.xxhash64(line).cast("string"), F.lit("]"))
    one = (F.json_array_length(marked) == 2) & (F.get_json_object(marked, "$[1]") == F.xxhash64(line).cast("string"))
    ok = one & unique(line) & F.forall(
        lists(line, resources), lambda r: around(r, "resource", scopes, lambda s: around(s, "scope", records, whole))
    )
    return F.coalesce(F.is_valid_utf8(line) & ok, F.lit(False))


def accept_lines(lines: DataFrame, signal: str, line: str = "value", strict: bool = True) -> DataFrame:
    """Add ``_resources``: the parsed resource list of an accepted line, else NULL.

    ``strict=False`` trusts the producer: one typed parse, which checks structure, integers,
    booleans and numbers but takes trailing text, repeated keys and a number where text is due.
    """
    check_signal(signal)
    text = F.col(line)
    # Trimming by a character set is slow, so lines that plainly need none are let through.
    bare = text.startswith("{") & text.endswith("}")
    # Blank lines are not filtered here: a filter would be moved below whatever makes the
    # lines and repeat that work. They parse to nothing and are no rejects either.
    trimmed = lines.withColumn(line, F.when(bare, text).otherwise(F.btrim(text, F.lit(BLANKS))))
    plain = F.from_json(text, wire.line_schema(signal), wire.JSON_OPTIONS)
    if not strict:
        parsed = trimmed.withColumn("_plain", F.when(F.is_valid_utf8(text), plain))
        return parsed.select(*lines.columns, _plain_result(signal).alias("_resources"))

    careful = F.from_json(text, wire.line_schema(signal, variant_leaves=True), wire.JSON_OPTIONS)
    document = F.col("_document")
    shape = F.schema_of_variant(F.try_variant_get(document, "$[0]", "variant"))
    parsed = (
        trimmed.withColumn("_document", F.when(F.is_valid_utf8(text), _marked_document(text)))
        .withColumn("_shape", F.when(_is_one_value(document, text), shape))
        .withColumn("_long", F.when(document.isNull() & (F.octet_length(text) > LONG_LINE), _long_line_ok(text, signal)))
        .withColumn("_doubtful", F.when(F.col("_long"), True).otherwise(wire.doubtful(F.col("_shape"), signal)))
        .withColumns(
            {
                "_plain": F.when(~F.col("_doubtful"), plain),
                "_careful": F.when(F.col("_doubtful"), careful),
            }
        )
    )
    accepted = F.when(F.col("_plain").isNotNull(), _plain_result(signal)).when(
        F.col("_careful").isNotNull(), _careful_result(signal)
    )
    return parsed.select(*lines.columns, accepted.alias("_resources"))


@built_once
def _plain_result(signal: str) -> Column:
    """The resource list of the typed parse ``_plain``, if the line is acceptable."""
    root, parsed = wire.ENVELOPES[signal], F.col("_plain")
    ok = parsed[wire.CORRUPT].isNull() & wire.typed_ok(root, parsed)
    return F.when(ok, pick(parsed, wire.KEYS[signal][0]))


@built_once
def _careful_result(signal: str) -> Column:
    """The same from the VARIANT-leaf parse ``_careful``."""
    root, parsed = wire.ENVELOPES[signal], F.col("_careful")
    resources = wire.KEYS[signal][0]
    ok = parsed[wire.CORRUPT].isNull() & wire.variant_ok(root, parsed)
    return F.when(ok, wire.variant_to_typed(root.fields[resources], pick(parsed, resources)))


@built_once
def _service_name(resource: str) -> Column:
    return values.service_name(F.col(resource)["resource"]["attributes"])


@built_once
def _attributes(record: str) -> Column:
    return values.attribute_map(F.col(record)["attributes"])


@built_once
def _body_text(record: str) -> Column:
    body = F.col(record)["body"]
    return F.when(body.isNotNull(), values.any_value_text(body))


def _unnest(accepted: DataFrame, signal: str, keep: list[str]) -> DataFrame:
    """One row per record: ``service_name`` and the record in ``_r``."""
    _, scopes, records = wire.KEYS[signal]
    resource = F.col("_resource")
    record_list = F.flatten(
        F.transform(pick(resource, scopes), lambda scope: pick(scope, records))
    )
    return (
        accepted.select(*keep, F.explode_outer("_resources").alias("_resource"))
        .select(
            *keep,
            _service_name("_resource").alias("service_name"),
            record_list.alias("_records"),
        )
        .select(*keep, "service_name", F.explode_outer("_records").alias("_r"))
        .filter(F.col("_r").isNotNull())
    )


def _trace_rows(records: DataFrame, keep: list[str], now: Column) -> DataFrame:
    r = F.col("_r")
    timed = records.select(
        "*",
        values.nano_instant(pick(r, "startTimeUnixNano")).alias("_start"),
        values.nano_instant(pick(r, "endTimeUnixNano")).alias("_end"),
    )
    start, end = F.col("_start"), F.col("_end")
    return timed.select(
        *keep,
        F.coalesce(pick(r, "traceId"), F.lit("")).alias("trace_id"),
        F.coalesce(pick(r, "spanId"), F.lit("")).alias("span_id"),
        pick(r, "parentSpanId").alias("parent_span_id"),
        F.coalesce(r["name"], F.lit("")).alias("name"),
        F.coalesce(r["kind"], F.lit(0)).alias("kind"),
        values.instant_to_time(start).alias("start_time"),
        values.instant_to_time(end).alias("end_time"),
        values.span_duration(start, end).alias("duration_ns"),
        F.coalesce(r["status"]["code"], F.lit(0)).alias("status_code"),
        "service_name",
        _attributes("_r").alias("attributes"),
    )


def _metric_rows(records: DataFrame, keep: list[str], now: Column) -> DataFrame:
    m = F.col("_r")

    def number_points(kind: str) -> Column:
        return pick(m[kind], "dataPoints")

    # Histogram points take the shape of number points, their sum as the value.
    histogram_points = F.transform(
        number_points("histogram"),
        lambda d: F.struct(
            d["attributes"].alias("attributes"),
            d["timeUnixNano"].alias("timeUnixNano"),
            d["time_unix_nano"].alias("time_unix_nano"),
            F.lit(None).cast("string").alias("asInt"),
            F.lit(None).cast("string").alias("as_int"),
            d["sum"].alias("asDouble"),
            F.lit(None).cast("double").alias("as_double"),
        ),
    )

    def family(kind: str, points: Column, temporality: Column, monotonic: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("metric_type"),
            points.alias("points"),
            temporality.cast("int").alias("temporality"),
            monotonic.cast("boolean").alias("monotonic"),
        )

    families = F.array(
        family(
            "sum",
            number_points("sum"),
            pick(m["sum"], "aggregationTemporality"),
            pick(m["sum"], "isMonotonic"),
        ),
        family("gauge", number_points("gauge"), F.lit(None), F.lit(None)),
        family(
            "histogram",
            histogram_points,
            pick(m["histogram"], "aggregationTemporality"),
            F.lit(None),
        ),
    )
    f, d = F.col("_f"), F.col("_d")
    return (
        records.select(
            *keep,
            "service_name",
            m["name"].alias("metric_name"),
            m["unit"].alias("unit"),
            F.explode(families).alias("_f"),
        )
        .select(
            *keep,
            "service_name",
            "metric_name",
            "unit",
            f["metric_type"].alias("metric_type"),
            f["temporality"].alias("aggregation_temporality"),
            f["monotonic"].alias("is_monotonic"),
            F.explode_outer(f["points"]).alias("_d"),
        )
        .filter(d.isNotNull())
        .select(
            *keep,
            "metric_name",
            "metric_type",
            values.point_value(pick(d, "asDouble"), pick(d, "asInt")).alias("value"),
            values.instant_to_time(values.nano_instant(pick(d, "timeUnixNano"))).alias("timestamp"),
            "service_name",
            "aggregation_temporality",
            "is_monotonic",
            "unit",
            _attributes("_d").alias("attributes"),
        )
    )


def _log_rows(records: DataFrame, keep: list[str], now: Column) -> DataFrame:
    r = F.col("_r")

    def id_or_null(name: str) -> Column:
        return F.nullif(pick(r, name), F.lit(""))

    instant = F.coalesce(
        values.nano_instant(pick(r, "timeUnixNano")),
        values.nano_instant(pick(r, "observedTimeUnixNano")),
    )
    return records.select(
        *keep,
        F.coalesce(values.instant_to_time(instant), now).alias("timestamp"),
        pick(r, "severityText").alias("severity"),
        pick(r, "severityNumber").alias("severity_number"),
        _body_text("_r").alias("body"),
        "service_name",
        id_or_null("traceId").alias("trace_id"),
        id_or_null("spanId").alias("span_id"),
        _attributes("_r").alias("attributes"),
    )


def rejected(line: str = "value") -> Column:
    """On the output of :func:`accept_lines`: the line is refused, and not just blank."""
    return F.col("_resources").isNull() & (F.coalesce(F.col(line), F.lit("")) != "")


def _rejected(accepted: DataFrame, line: str) -> DataFrame:
    """Lines that were not accepted.

    A plain filter would be moved below the parse and repeat it for every use of its result;
    a generator is not.
    """
    refused = F.when(rejected(line), F.array(F.lit(True)))
    kept = [c for c in accepted.columns if c != "_resources"]
    marked = accepted.select(*kept, F.explode_outer(refused).alias("_refused"))
    return marked.filter(F.col("_refused").isNotNull()).drop("_refused")


_ROWS = {"traces": _trace_rows, "metrics": _metric_rows, "logs": _log_rows}


def utc_now() -> Column:
    """The query's start time as a zone-free UTC timestamp."""
    return F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
    )


def decode(
    lines: DataFrame,
    signal: str,
    *,
    line: str = "value",
    now: Column | None = None,
    strict: bool = True,
    on_missing_time: str = "fail",
    keep: tuple[str, ...] = (),
) -> Decoded:
    """Decode a DataFrame of lines into the rows of one signal table.

    ``now`` is the time given to log records that carry none. ``on_missing_time`` says what
    happens to a span or point without a valid time: ``fail`` the job, or ``quarantine`` it.
    ``keep`` names input columns to carry along.
    """
    if on_missing_time not in ON_MISSING_TIME:
        raise ValueError(f"on_missing_time must be one of {ON_MISSING_TIME}")
    return decode_accepted(
        accept_lines(lines, signal, line, strict),
        signal,
        line=line,
        now=now,
        on_missing_time=on_missing_time,
        keep=keep,
    )


def decode_accepted(
    accepted: DataFrame,
    signal: str,
    *,
    line: str = "value",
    now: Column | None = None,
    on_missing_time: str = "fail",
    keep: tuple[str, ...] = (),
) -> Decoded:
    """The second half of :func:`decode`, on the output of :func:`accept_lines`."""
    time = TIME_COLUMN[signal]
    kept = list(keep)
    records = _unnest(accepted, signal, kept)
    flat = _ROWS[signal](records, kept, utc_now() if now is None else now)
    fails = on_missing_time == "fail"
    timed = flat if fails else flat.filter(F.col(time).isNotNull())
    if fails:
        complaint = F.raise_error(F.lit(f"{signal}: a record has no valid {time}"))
        timed = flat.withColumn(time, F.coalesce(F.col(time), complaint.cast("timestamp_ntz")))
    timed = timed.withColumn("date", F.to_date(time))
    rejects = _rejected(accepted, line)
    timeless = flat.filter(F.lit(False) if fails else F.col(time).isNull())
    return Decoded(timed.select(*kept, *TABLES[signal].fieldNames()), rejects, timeless)
