"""Filtered, time-ordered scans over the signal tables and the metric aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleskein.functions import timeexpr
from teleskein.manifest import Content
from teleskein.schemas import SIGNALS, TABLES, TIME_COLUMN, check_signal


@dataclass(frozen=True)
class QueryOptions:
    """What a scan or aggregate is restricted to; unset means unrestricted.

    ``since`` and ``until`` are zone-free UTC times and both inclusive. A ``limit`` of 0 is no
    limit.
    """

    service: str | None = None
    since: datetime | Column | None = None
    until: datetime | Column | None = None
    limit: int | None = None

    @classmethod
    def parse(
        cls,
        service: str | None = None,
        since: str | None = None,
        until: str | None = None,
        limit: int | None = None,
        now: datetime | Column | None = None,
    ) -> "QueryOptions":
        """From text: times are RFC 3339 or a duration before ``now``, e.g. ``24h``."""
        from teleskein.operators.decode import utc_now

        at = utc_now() if now is None else _time(now)

        def bound(text: str | None) -> Column | None:
            if text is None:
                return None
            return timeexpr.require(timeexpr.parse_time(F.lit(text), at), F.lit(text), "time")

        return cls(service, bound(since), bound(until), limit)


def _time(value: datetime | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def restrict(rows: DataFrame, signal: str, options: QueryOptions) -> DataFrame:
    """Apply the options' predicates.

    Tables are partitioned by ``date``, which the optimizer cannot derive from the time
    column, so each time bound brings the date bound it implies: partitions outside it are
    not read. :func:`scan_store` keeps a store from listing them.
    """
    time = F.col(TIME_COLUMN[check_signal(signal)])
    if options.service is not None:
        rows = rows.filter(F.col("service_name") == options.service)
    if options.since is not None:
        since = _time(options.since)
        rows = rows.filter((F.col("date") >= F.to_date(since)) & (time >= since))
    if options.until is not None:
        until = _time(options.until)
        rows = rows.filter((F.col("date") <= F.to_date(until)) & (time <= until))
    return rows


def resolved(spark, options: QueryOptions) -> QueryOptions:
    """The options with bounds that are expressions of constants replaced by their values."""
    bounds = {k: v for k, v in (("since", options.since), ("until", options.until)) if isinstance(v, Column)}
    if not bounds:
        return options
    one = spark.createDataFrame([(0,)], "x int").select(*[v.cast("timestamp_ntz").alias(k) for k, v in bounds.items()])
    return replace(options, **one.first().asDict())


# Columns that settle the order of rows with equal times, so that limits are repeatable.
TIE_BREAK = {
    "traces": ["trace_id", "span_id", "name", "service_name", "end_time", "kind", "status_code", "parent_span_id"],
    "metrics": ["metric_name", "metric_type", "service_name", "value", "unit"],
    "logs": ["service_name", "severity_number", "body", "trace_id", "span_id"],
}


def scan(rows: DataFrame, signal: str, options: QueryOptions = QueryOptions()) -> DataFrame:
    """The signal's columns except ``date``, ascending by time.

    With a limit the plan keeps only the first n rows of each partition before merging;
    without one it is a range-partitioned sort.
    """
    columns = [c for c in TABLES[signal].fieldNames() if c != "date"]
    order = [TIME_COLUMN[signal], *TIE_BREAK[signal]]
    # Then all that is left, a map by its sorted entries: only equal rows remain tied.
    order += [
        F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else f.name
        for f in TABLES[signal].fields
        if f.name in columns and f.name not in order
    ]
    ordered = restrict(rows, signal, options).select(*columns).orderBy(*order)
    if options.limit is not None and options.limit > 0:
        return ordered.limit(options.limit)
    return ordered


def scan_store(store, signal: str, options: QueryOptions = QueryOptions()) -> DataFrame:
    """A scan of a store's table: folders that the manifest's statistics rule out are not
    listed, and with a limit no dates beyond those that give enough rows are read."""
    options = resolved(store.spark, options)
    content = store.selected(signal, options.since, options.until, options.service)
    if options.limit is not None and options.limit > 0:
        content = _enough(store, signal, options, content)
    return scan(store.raw(signal, content=content), signal, options)


def _enough(store, signal: str, options: QueryOptions, content: Content) -> Content:
    """The earliest dates that hold ``limit`` rows.

    Where statistics settle how many rows of a date qualify (no bound cuts through it, one
    service, nothing deleted) they are added up; other dates are counted, in runs of growing
    length, up to the rows still wanted.
    """
    by_date: dict[str, dict] = {}
    for (batch, date), stats in content.folders.items():
        by_date.setdefault(date, {})[batch, date] = stats

    def known(date: str) -> int | None:
        total = 0
        for (batch, _), stats in by_date[date].items():
            alone = options.service is None or stats.first == stats.last == options.service
            if not alone or not stats.within(options.since, options.until) or content.deleted_from(batch):
                return None
            total += stats.rows
        return total

    chosen: dict = {}
    dates, wanted, run = sorted(by_date), options.limit, 1
    while dates and wanted > 0:
        count = known(dates[0])
        taken = dates[: 1 if count is not None else run]
        part = {k: s for d in taken for k, s in by_date[d].items()}
        if count is None:
            rows = restrict(store.raw(signal, content=Content(part, content.deletions)), signal, options)
            count, run = rows.select(F.lit(1)).limit(wanted).count(), 2 * run
        chosen.update(part)
        dates, wanted = dates[len(taken) :], wanted - count
    return Content(chosen, content.deletions)


def count_store(store, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Rows of each table: from the manifest, but for batches with pending deletions."""
    counts = []
    for signal in signals:
        content = store.content(signal)
        read = {k: s for k, s in content.folders.items() if content.deleted_from(k[0])}
        known = sum(s.rows for k, s in content.folders.items() if k not in read)
        rows = store.raw(signal, content=Content(read, content.deletions)).count() if read else 0
        counts.append((signal, known + rows))
    return store.spark.createDataFrame(counts, "signal string, rows bigint")


def scan_traces(rows: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
    return scan(rows, "traces", options)


def scan_metrics(rows: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
    return scan(rows, "metrics", options)


def scan_logs(rows: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
    return scan(rows, "logs", options)


def _measures(value: str = "value") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def aggregate_metric(
    rows: DataFrame, metric_name: str, options: QueryOptions = QueryOptions()
) -> DataFrame:
    """Count, average, minimum and maximum of one metric; always exactly one row.

    No match gives a count of 0 and NULL measures. A limit plays no part.
    """
    chosen = restrict(rows.filter(F.col("metric_name") == metric_name), "metrics", options)
    return chosen.agg(*_measures()).select(
        F.lit(metric_name).alias("metric_name"),
        F.lit(options.service).cast("string").alias("service_name"),
        "count",
        "avg",
        "min",
        "max",
    )


def aggregate_metrics_by_name(
    rows: DataFrame, options: QueryOptions = QueryOptions()
) -> DataFrame:
    """The same measures for every metric and service in one pass."""
    return restrict(rows, "metrics", options).groupBy("metric_name", "service_name").agg(*_measures())


def count_rows(tables: dict[str, DataFrame], predicate: Column | None = None) -> DataFrame:
    """Row count per table: one row each, in the given order of names."""
    counts = None
    for name, rows in tables.items():
        kept = rows if predicate is None else rows.filter(predicate)
        one = kept.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("signal"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts
