"""The signal tables as Parquet folders on shared storage.

``<root>/<version>/<signal>/ingest_batch=B/date=D/*.parquet``

Every write goes to an ``ingest_batch`` of its own and replaces just that, so a repeated
write leaves the table as one write does. The current version and cursor epoch are the
newest record of ``<root>/_state``; a record appears whole, so clearing and rebuilding switch
readers over in one step.

``_manifest`` says which folders are read, with statistics (:mod:`teleskein.manifest`). A record
appears whole after its batch is written, so compaction and pruning switch readers in one step
too, and a scan lists only folders that can hold rows of its dates, times and service.
:meth:`SignalStore.vacuum` folds the records and deletes folders that are not read.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleskein.manifest import Content, Deletion, Manifest, Stats, folder_stats
from teleskein.schemas import INGEST_CURSORS, SIGNALS, TABLES, check_signal
from teleskein.session import scratch_dir, shuffles_dropped
from teleskein.sources import paths

# Names of merged batches begin with this.
MERGED = "merged-"


@dataclass(frozen=True)
class State:
    sequence: int
    version: str
    epoch: str


class SwitchedMeanwhile(RuntimeError):
    """Another writer made a record of the same number first; nothing was changed."""


class SignalStore:
    """Opened tables. ``root=None`` makes a throw-away store in the scratch folder."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = paths.checked(spark, root or scratch_dir(spark, "store")).rstrip("/")
        self._manifests: dict[tuple[str, str], Manifest] = {}
        self.create()

    # --- layout ---

    def create(self) -> None:
        """Make what is missing; safe to repeat."""
        if self._states() is None:
            with contextlib.suppress(SwitchedMeanwhile):  # made by another one: as good
                self._add_state(State(0, "v0", "e0"))
        for signal in SIGNALS:
            paths.make_dir(self.table_path(signal))

    def _states(self) -> State | None:
        numbers = paths.names(f"{self.root}/_state")
        return State(**paths.read_json(f"{self.root}/_state/{numbers[-1]}.json")) if numbers else None

    def _add_state(self, state: State) -> None:
        if not paths.create_json(self.spark, f"{self.root}/_state", f"{state.sequence:012d}", asdict(state)):
            raise SwitchedMeanwhile("another writer has switched this store meanwhile")

    @property
    def state(self) -> State:
        return self._states()

    def switch(self, version: str | None = None, epoch: str | None = None) -> State:
        """Make another version or cursor epoch the current one. Of two writers that switch
        from the same state one fails, with nothing changed."""
        old = self.state
        new = State(old.sequence + 1, version or old.version, epoch or old.epoch)
        for signal in SIGNALS:
            paths.make_dir(self.table_path(signal, new.version))
        self._add_state(new)
        return new

    def table_path(self, signal: str, version: str | None = None) -> str:
        return f"{self.root}/{version or self.state.version}/{check_signal(signal)}"

    def checkpoint_path(self, signal: str, epoch: str | None = None) -> str:
        return f"{self.root}/_checkpoints/{epoch or self.state.epoch}/{signal}"

    def positions_path(self, signal: str, epoch: str | None = None) -> str:
        return f"{self.root}/_positions/{epoch or self.state.epoch}/{signal}"

    # --- manifest ---

    def manifest(self, signal: str, version: str | None = None) -> Manifest:
        key = version or self.state.version, check_signal(signal)
        if key not in self._manifests:
            self._manifests[key] = Manifest(self.spark, f"{self.root}/_manifest/{key[0]}/{key[1]}")
        return self._manifests[key]

    def record(
        self, signal: str, batch: str, folders: dict[str, Stats], hides: Iterable[tuple[str, str]] = (), version: str | None = None,
        deletions: Iterable[Deletion] = (),
    ) -> None:
        """Switch readers: ``batch`` is read from now on, the folders in ``hides`` are not, and
        ``deletions`` are subtracted."""
        self.manifest(signal, version).add(batch, folders, hides, deletions)

    def folders(self, signal: str, version: str | None = None) -> set[tuple[str, str]]:
        """The (batch, date) folders that are read."""
        return set(self.content(signal, version).folders)

    def content(self, signal: str, version: str | None = None, since: str | None = None, until: str | None = None) -> Content:
        """Folders of the dates with their statistics, and deletions not yet written out."""
        return self.manifest(signal, version).content(since, until)

    # --- reading ---

    def raw(
        self, signal: str, version: str | None = None, since: str | None = None, until: str | None = None,
        only: set[tuple[str, str]] | None = None, content: Content | None = None,
    ) -> DataFrame:
        """The table with its ``ingest_batch`` column; dates outside ``since`` to ``until``
        (text, inclusive) are not even listed, nor are folders other than ``only``. ``content``
        is what the manifest said, where the caller has asked it already."""
        from teleskein.operators.retention import expired

        version = version or self.state.version
        schema = T.StructType(
            [*TABLES[check_signal(signal)].fields, T.StructField("ingest_batch", T.StringType())]
        )
        content = content or self.content(signal, version, since, until)
        chosen = [(b, d) for b, d in content.folders if (since or d) <= d <= (until or d) and (only is None or (b, d) in only)]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        table = self.table_path(signal, version)
        found = [f"{table}/ingest_batch={b}/date={d}" for b, d in sorted(chosen)]
        rows = self.spark.read.schema(schema).option("basePath", table).parquet(*found)
        present = {b for b, _ in chosen}
        for deletion in content.deletions:
            batches = sorted(present.intersection(deletion.batches))
            # Only batches that have folders up to the cutoff's date can hold such rows.
            if any(b in batches and d <= deletion.cutoff[:10] for b, d in chosen):
                cutoff = F.lit(deletion.cutoff).cast("timestamp_ntz")
                rows = rows.filter(~(expired(signal, cutoff, deletion.service) & F.col("ingest_batch").isin(batches)))
        return rows

    def selected(
        self, signal: str, since: datetime | None = None, until: datetime | None = None, service: str | None = None
    ) -> Content:
        """What can hold rows of the times (both inclusive) and the service, by statistics."""
        dates = [None if t is None else t.date().isoformat() for t in (since, until)]
        content = self.content(signal, None, *dates)
        kept = {k: s for k, s in content.folders.items() if not s.apart(since, until, service)}
        return Content(kept, content.deletions)

    def table(self, signal: str, since: str | None = None, until: str | None = None) -> DataFrame:
        return self.raw(signal, None, since, until).select(*TABLES[signal].fieldNames())

    def cursors(self) -> DataFrame:
        """``ingest_cursors``: committed byte offset per followed file."""
        from teleskein.streaming.ingest import committed_offsets

        epoch = self.state.epoch
        parts = [committed_offsets(self.spark, self.checkpoint_path(s, epoch), self.positions_path(s, epoch)) for s in SIGNALS]
        found = [p for p in parts if p is not None]
        if not found:
            return self.spark.createDataFrame([], INGEST_CURSORS)
        out = found[0]
        for p in found[1:]:
            out = out.unionByName(p)
        return out

    def register_views(self) -> None:
        """``traces``, ``metrics``, ``logs`` and ``ingest_cursors`` for SQL."""
        for signal in SIGNALS:
            self.table(signal).createOrReplaceTempView(signal)
        self.cursors().createOrReplaceTempView("ingest_cursors")

    def sql(self, query: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(query)

    def columns(self) -> DataFrame:
        """Table and column names in order, one row per column."""
        rows = [
            (name, position, field.name, field.dataType.simpleString(), field.nullable)
            for name, schema in {**TABLES, "ingest_cursors": INGEST_CURSORS}.items()
            for position, field in enumerate(schema.fields, 1)
        ]
        return self.spark.createDataFrame(
            rows,
            "table_name string, ordinal_position int, column_name string, data_type string, nullable boolean",
        )

    # --- writing ---

    def append(
        self, signal: str, rows: DataFrame, batch: str | None = None, version: str | None = None, hides: Iterable[tuple[str, str]] = ()
    ) -> str:
        """Add rows as one ingest batch; a batch of the same name is replaced. Folders in
        ``hides`` stop being read at the moment the batch starts to be.

        Rows are spread by ``date`` before the write so that files are few and full; a date
        too large for one task is split by the adaptive planner, which leaves no task with a
        whole hot date.
        """
        batch = batch or f"load-{uuid.uuid4().hex}"
        self.add_batch(signal, rows, batch, version, hides)
        return batch

    def add_batch(
        self, signal: str, rows: DataFrame, batch: str, version: str | None = None, hides: Iterable[tuple[str, str]] = ()
    ) -> dict[str, Stats]:
        """The same for a named batch; what each of its dates holds, by the written footers."""
        fields = TABLES[check_signal(signal)].fields
        named = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        for f in fields:
            if not f.nullable:
                refusal = F.raise_error(F.lit(f"{signal}.{f.name} must not be NULL")).cast(f.dataType)
                named = named.withColumn(f.name, F.coalesce(F.col(f.name), refusal))
        target = f"{self.table_path(signal, version)}/ingest_batch={batch}"
        with shuffles_dropped(rows.sparkSession):
            (
                named.hint("rebalance", F.col("date"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "static")
                .option("compression", "zstd")
                .partitionBy("date")
                .parquet(target)
            )
        written = folder_stats(self.spark, target, signal)
        self.record(signal, batch, written, hides, version)
        return written

    def batch_count(self, signal: str, batch: str, version: str | None = None) -> int:
        """Rows of one ingest batch as it was written, by the manifest."""
        return sum(s.rows for (b, _), s in self.content(signal, version).folders.items() if b == batch)

    def batches(self, signal: str) -> list[str]:
        """Names of the ingest batches that are read."""
        return sorted({b for b, _ in self.folders(signal)})

    def compact(self, signal: str, batches: list[str] | None = None) -> str | None:
        """Merge the folders of each date that has several (of ``batches``, if named) into one,
        and write out deletions.

        Readers see either the old folders or the merged ones, never both.
        """
        version = self.state.version
        content = self.content(signal, version)
        by_date: dict[str, list[str]] = {}
        for batch, date in content.folders:
            if batches is None or batch in batches:
                by_date.setdefault(date, []).append(batch)
        chosen = {
            (b, d) for d, found in by_date.items() for b in found
            if len(found) > 1 or any(b in x.batches and d <= x.cutoff[:10] for x in content.deletions)
        }
        if not chosen:
            return None
        rows = self.raw(signal, version, only=chosen, content=content)
        return self.append(signal, rows, f"{MERGED}{uuid.uuid4().hex}", version, chosen)

    def vacuum(self) -> None:
        """Fold the records, and delete what nothing reads any more: old versions, hidden
        folders, entries about batches that cannot be written again."""
        state = self.state
        for name in paths.children(self.root):
            if name.startswith("v") and name != state.version:
                paths.drop_dir(f"{self.root}/{name}")
                paths.drop_dir(f"{self.root}/_manifest/{name}")
        for signal in SIGNALS:
            manifest, last = self.manifest(signal, state.version), self.last_batch_number(signal)
            manifest.fold()
            for batch, date in manifest.waste():
                paths.drop_dir(f"{self.table_path(signal)}/ingest_batch={batch}/date={date}")
            for name, entry in paths.get_json(f"{self.root}/_prunes").items():
                if entry["signal"] == signal and (entry["epoch"] != state.epoch or entry["upto"] < last):
                    paths.drop_file(f"{self.root}/_prunes/{name}.json")
        records = sorted(n for n in paths.children(f"{self.root}/_state") if n.endswith(".json") and not n.startswith("."))
        for name in records[:-1]:
            paths.drop_file(f"{self.root}/_state/{name}")

    def last_batch_number(self, signal: str) -> int:
        """Highest streaming batch of the current epoch written so far; -1 if none."""
        return self.manifest(signal).last_number(f"{self.state.epoch}-")

    # --- clearing ---

    def clear_signal_tables(self) -> None:
        """Empty the three tables; cursors stay."""
        self._switched(lambda: self.switch(version=f"v{self.state.sequence + 1}-{uuid.uuid4().hex[:8]}"))

    def clear_cursors(self) -> None:
        """Forget how far files were read; rows stay."""
        self._switched(lambda: self.switch(epoch=f"e{self.state.sequence + 1}-{uuid.uuid4().hex[:8]}"))

    @staticmethod
    def _switched(switch, tries: int = 20) -> None:
        """Clearing does not depend on the state before, so it is tried again."""
        for _ in range(tries):
            with contextlib.suppress(SwitchedMeanwhile):
                switch()
                return
        switch()

    # --- prune log ---

    def log_prune(self, signal: str, cutoff: str, service: str | None, upto: int) -> None:
        entry = {"signal": signal, "cutoff": cutoff, "service": service, "epoch": self.state.epoch, "upto": upto}
        paths.put_json(f"{self.root}/_prunes", f"{time.time_ns()}-{uuid.uuid4().hex[:8]}", entry)

    def without_pruned(self, signal: str, rows: DataFrame, number: int, epoch: str) -> DataFrame:
        """Leave out what was pruned after ingest batch ``number`` had first been written.

        Only a batch that is written again meets such entries; without this a repeat of the
        last batch would bring pruned rows back.
        """
        from teleskein.operators.retention import expired

        for entry in paths.get_json(f"{self.root}/_prunes").values():
            if entry["signal"] == signal and entry["epoch"] == epoch and entry["upto"] >= number:
                cutoff = F.lit(entry["cutoff"]).cast("timestamp_ntz")
                rows = rows.filter(~expired(signal, cutoff, entry["service"]))
        return rows
