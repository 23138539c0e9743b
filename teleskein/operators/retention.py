"""Deleting old rows: dry run, deletion, service scope and the report.

A folder wholly before the cutoff is dropped without being read, and counted by the manifest.
Of others only those whose statistics allow for expired rows are read, for the count. Nothing
is written anew: readers subtract what is older than the cutoff (and of the service) from the
batches concerned until :meth:`SignalStore.compact` writes that out. Readers switch by one
record; :meth:`SignalStore.vacuum` deletes the files.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleskein.functions.timeexpr import duration
from teleskein.manifest import Content, Deletion
from teleskein.schemas import SIGNALS, TIME_COLUMN
from teleskein.tables import SignalStore

REPORT = "signal string, service_name string, deleted bigint, cutoff string"
CUTOFF_FORMAT = "%Y-%m-%dT%H:%M:%S"
# Names of the records of prunes begin with this.
PRUNED = "pruned-"
# "All" means everything up to this far ahead of now.
ALL_MARGIN = timedelta(hours=1)


def expired(signal: str, cutoff: Column, service: str | None = None) -> Column:
    """Strictly older than the cutoff (and of the service). Dates bring partition pruning."""
    old = (F.col("date") <= F.to_date(cutoff)) & (F.col(TIME_COLUMN[signal]) < cutoff)
    return old if service is None else old & (F.col("service_name") == service)


def cutoff_time(
    older_than: str | None = None, all_rows: bool = False, now: datetime | None = None
) -> datetime:
    """Exactly one of a duration and ``all_rows`` must be given."""
    if all_rows and older_than is not None:
        raise ValueError("give either older_than or all_rows, not both")
    if not all_rows and older_than is None:
        raise ValueError("one of older_than and all_rows has to be given")
    at = now or datetime.now(timezone.utc).replace(tzinfo=None)
    return at + ALL_MARGIN if all_rows else at - duration(older_than)


def _literal(cutoff: datetime) -> Column:
    return F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")


def count_expired(
    tables: dict[str, DataFrame], cutoff: datetime, service: str | None = None
) -> DataFrame:
    """The report of a dry run over any tables of the signal layout: nothing is deleted."""
    report = None
    for order, (signal, rows) in enumerate(tables.items()):
        one = (
            rows.filter(expired(signal, _literal(cutoff), service))
            .agg(F.count(F.lit(1)).alias("deleted"))
            .select(
                F.lit(order).alias("_order"),
                F.lit(signal).alias("signal"),
                F.lit(service).cast("string").alias("service_name"),
                "deleted",
                F.lit(cutoff.strftime(CUTOFF_FORMAT)).alias("cutoff"),
            )
        )
        report = one if report is None else report.unionByName(one)
    return report.orderBy("_order").drop("_order")


def survivors(rows: DataFrame, signal: str, cutoff: datetime, service: str | None = None) -> DataFrame:
    """What a prune leaves of a table."""
    return rows.filter(~expired(signal, _literal(cutoff), service))


def prune(
    store: SignalStore, cutoff: datetime, service: str | None = None, dry_run: bool = False
) -> DataFrame:
    """Delete rows older than ``cutoff``; three report rows in order traces, metrics, logs.

    Cursors are left alone: pruned rows do not come back with the next ingest. A failure
    leaves a signal either as it was or pruned; running it again finishes the work.
    """
    spark = store.spark
    report = []
    for signal in SIGNALS:
        version = store.state.version
        found = _expired_folders(store, signal, version, cutoff, service)
        report.append((signal, service, found.deleted, cutoff.strftime(CUTOFF_FORMAT)))
        if dry_run or not found.deleted:
            continue
        store.log_prune(signal, cutoff.isoformat(sep=" "), service, store.last_batch_number(signal))
        deletions = [Deletion(cutoff.isoformat(sep=" "), service, tuple(sorted(found.batches)))] if found.batches else []
        store.record(signal, f"{PRUNED}{uuid.uuid4().hex}", {}, found.whole, version, deletions)
    return spark.createDataFrame(report, REPORT)


def prune_older_than(store: SignalStore, text: str, **options) -> DataFrame:
    return prune(store, cutoff_time(older_than=text), **options)


def prune_all(store: SignalStore, **options) -> DataFrame:
    return prune(store, cutoff_time(all_rows=True), **options)


@dataclass
class Expired:
    """Folders that go as wholes, batches of which a part goes, and the rows of both."""

    whole: set[tuple[str, str]]
    batches: set[str]
    deleted: int


def _expired_folders(store: SignalStore, signal: str, version: str, cutoff: datetime, service: str | None) -> Expired:
    """By statistics where they settle it; the rest is read, one count for each batch."""
    content = store.content(signal, version, until=cutoff.date().isoformat())
    last = cutoff - timedelta(microseconds=1)
    whole, rest, deleted = set(), {}, 0
    for key, stats in content.folders.items():
        if stats.apart(None, last, service):
            continue
        alone = service is None or stats.first == stats.last == service
        if alone and (stats.within(None, last) or key[1] < cutoff.date().isoformat()):
            whole.add(key)
            # With deletions pending the count is what readers still see.
            if content.deleted_from(key[0]):
                rest[key] = stats
            else:
                deleted += stats.rows
        else:
            rest[key] = stats
    if not rest:
        return Expired(whole, set(), deleted)
    rows = store.raw(signal, version, only=set(rest), content=Content(rest, content.deletions))
    counts = rows.filter(expired(signal, _literal(cutoff), service)).groupBy("ingest_batch", "date").agg(F.count(F.lit(1)).alias("n"))
    parts = {(r["ingest_batch"], str(r["date"])): r["n"] for r in counts.collect()}
    return Expired(whole, {b for b, d in parts if (b, d) not in whole}, deleted + sum(parts.values()))
