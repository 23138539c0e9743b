"""Incremental ingest: follow the signal folders and append decoded rows exactly once.

One streaming query per signal. The query's offset log is the cursor: rows of micro-batch N
go to a table batch named after N, which a repeat replaces, so rows and cursor never
disagree after a failure.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from teleskein.functions.timeexpr import interval_seconds, trigger_text
from teleskein.operators.decode import accept_lines, decode_accepted, rejected, utc_now
from teleskein.schemas import SIGNALS, check_signal
from teleskein.sources import paths, tail
from teleskein.sources.jsonl import signal_dir
from teleskein.sources.tail import TailSource
from teleskein.tables import SignalStore

log = logging.getLogger(__name__)


@dataclass
class IngestReport:
    """Rows added per signal."""

    traces: int = 0
    metrics: int = 0
    logs: int = 0
    rejected: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.traces + self.metrics + self.logs

    def __str__(self) -> str:
        return f"{self.traces} traces, {self.metrics} metrics, {self.logs} logs"

    def add(self, signal: str, rows: int, rejected: int = 0) -> None:
        setattr(self, signal, getattr(self, signal) + rows)
        self.rejected[signal] = self.rejected.get(signal, 0) + rejected

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.traces, self.metrics, self.logs, self.total)],
            "traces bigint, metrics bigint, logs bigint, total bigint",
        )


# --- offsets as Spark keeps them in the checkpoint ---


def _numbers(folder: str) -> list[int]:
    return sorted(int(n) for n in paths.children(folder) if n.isdigit())


def logged_version(checkpoint: str, committed: bool = False) -> int:
    """The source's version at the newest logged (or newest committed) micro-batch."""
    numbers = _numbers(f"{checkpoint}/{'commits' if committed else 'offsets'}")
    if not numbers:
        return 0
    text = paths.read_text(f"{checkpoint}/offsets/{numbers[-1]}").splitlines()[-1]
    return 0 if text == "-" else json.loads(text)["version"]


def committed_offsets(spark: SparkSession, checkpoint: str, positions: str) -> DataFrame | None:
    """File path and byte offset of every followed file, read by tasks from the newest snapshot
    and the deltas since."""
    version = logged_version(checkpoint, committed=True)
    files = [f"{positions}/{n}" for n in tail.position_files(positions, version)] if version else []
    if not files:
        return None
    lines = spark.read.schema("path string, begin bigint, end bigint").json(files)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"-(\d+)\.jsonl$", 1)
    newest = lines.select("path", "end", number.alias("number")).groupBy("path").agg(F.max_by("end", "number").alias("end"))
    return newest.select(F.col("path").alias("file_path"), F.col("end").alias("byte_offset"))


# --- one query per signal ---


@dataclass(frozen=True)
class IngestOptions:
    """``max_bytes`` bounds a micro-batch (0: all there is), the rest follows in the next ones;
    ``keep_rejects`` stores refused lines beside the tables; ``final_line`` takes a file's last
    line without its newline if it is whole JSON; ``isolate`` puts lines aside that make their
    micro-batch fail, instead of failing it."""

    max_bytes: int = 64 << 30
    final_line: bool = False
    split_bytes: int = 64 << 20
    strict: bool = True
    on_missing_time: str = "fail"
    keep_rejects: bool = True
    isolate: bool = False


def tail_lines(
    spark: SparkSession, folder: str, options: IngestOptions, positions: str, version: int = 0
) -> DataFrame:
    """The followed lines as a stream: ``file``, ``value`` and the micro-batch's time."""
    # Python workers get the source itself, so they need no copy of this package.
    for module in (tail, paths):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(TailSource)
    return (
        spark.readStream.format(TailSource.name())
        .option("path", folder)
        .option("max_bytes", options.max_bytes)
        .option("split_bytes", options.split_bytes)
        .option("final_line", options.final_line)
        .option("positions", positions)
        .option("version", version)
        .load()
        .select(
            "file",
            F.col("line").cast("string").alias("value"),
            # Fixed per micro-batch and logged with it: a repeat sees the same time.
            utc_now().alias("ingested_at"),
        )
    )


# Probes after which the search for lines that fail is given up.
MOST_PROBES = 400
# Halvings after which the search keeps the lines of its range on disk.
KEEP_EVERY = 4


def failing_hashes(lines: DataFrame, fails: Callable[[DataFrame], bool], most: int = MOST_PROBES) -> list[tuple[int, int]] | None:
    """Ranges of the lines' hashes such that all lines in them fail, each by itself.

    The hash range is halved until a part that fails holds equal lines only, so a bad line
    costs some two probes for each doubling of the lines. A part counts as bad if it fails
    twice: what fails once may be the cluster's fault. None where nothing fails, or too much.
    """
    found: list[tuple[int, int]] = []
    probes = 0

    def bad(part: DataFrame) -> bool:
        nonlocal probes
        probes += 1
        if probes > most:
            raise TimeoutError
        return fails(part.drop("line_hash"))

    def search(hashed: DataFrame, low: int, high: int, known: bool, depth: int = 0) -> bool:
        """Whether lines in the range fail; ``known``: they must, as a wider range does."""
        part = hashed.filter(F.col("line_hash").between(low, high))
        if not depth or depth % KEEP_EVERY:
            return halved(part, low, high, known, depth)
        # A small share of the lines by now; further probes need not read the files.
        part = part.persist(StorageLevel.DISK_ONLY)
        try:
            return halved(part, low, high, known, depth)
        finally:
            part.unpersist()

    def halved(part: DataFrame, low: int, high: int, known: bool, depth: int) -> bool:
        several = len(part.select("line_hash").distinct().limit(2).collect())
        if several == 0 or not (known and several > 1 or bad(part)):
            return False
        if several == 1:
            if bad(part):  # by itself once more
                found.append((low, high))
            return True
        middle = (low + high) // 2
        left = search(part, low, middle, False, depth + 1)
        return search(part, middle + 1, high, not left, depth + 1) or left

    try:
        search(lines.withColumn("line_hash", F.xxhash64("value")), -(2**63), 2**63 - 1, False)
    except TimeoutError:
        return None
    return found or None


def _write_batch(
    store: SignalStore,
    signal: str,
    options: IngestOptions,
    version: str,
    epoch: str,
    report: Callable[[int, int], None],
):
    def write(lines: DataFrame, number: int) -> None:
        # The lines are not kept: a copy of them takes more disk than the table that they make,
        # and is needed only where lines are refused or fail. Then the files are read again.
        try:
            write_lines(lines, number)
        except Exception:
            if not options.isolate:
                raise
            bad = failing_hashes(lines, fails)
            if bad is None:
                raise
            put_aside(lines, bad, number)

    def decode(lines: DataFrame):
        accepted = accept_lines(lines, signal, strict=options.strict)
        return accepted, lambda seen: decode_accepted(
            seen, signal, now=F.col("ingested_at"), on_missing_time=options.on_missing_time, keep=("ingested_at",)
        )

    def fails(lines: DataFrame) -> bool:
        accepted, decoded = decode(lines)
        try:
            decoded(accepted).rows.write.format("noop").mode("overwrite").save()
        except Exception:
            return True
        return False

    def put_aside(lines: DataFrame, bad: list[tuple[int, int]], number: int) -> None:
        hit = F.lit(False)
        for low, high in bad:
            hit = hit | F.xxhash64("value").between(low, high)
        target = f"{store.root}/_poisoned/{version}/{signal}/ingest_batch={epoch}-{number}"
        lines.filter(hit).select("file", "value").write.mode("overwrite").parquet(target)
        log.error("lines of %s that cannot be decoded were put aside: %s", signal, target)
        write_lines(lines.filter(~hit), number)

    def write_lines(lines: DataFrame, number: int) -> None:
        batch = f"{epoch}-{number}"
        seen = Observation()
        accepted, decoded_from = decode(lines)
        decoded = decoded_from(accepted.observe(seen, F.count_if(rejected()).alias("rejected")))
        rows = store.without_pruned(signal, decoded.rows, number, epoch)
        written = store.add_batch(signal, rows, batch, version)
        refused = seen.get["rejected"] or 0
        if options.keep_rejects and refused:
            decoded.rejects.select("file", "value").write.mode("overwrite").parquet(
                f"{store.root}/_rejects/{version}/{signal}/ingest_batch={batch}"
            )
        if options.on_missing_time == "quarantine":
            decoded.timeless.drop("ingested_at").write.mode("overwrite").parquet(
                f"{store.root}/_timeless/{version}/{signal}/ingest_batch={batch}"
            )
        report(sum(s.rows for s in written.values()), refused)

    return write


def start_signal(
    store: SignalStore,
    root: str,
    signal: str,
    options: IngestOptions = IngestOptions(),
    trigger: dict | None = None,
    report: Callable[[int, int], None] = lambda rows, rejected: None,
    version: str | None = None,
    epoch: str | None = None,
) -> StreamingQuery | None:
    """Start following a signal's folder; None where the folder does not exist."""
    folder = signal_dir(paths.checked(store.spark, root), check_signal(signal))
    if not paths.exists(folder):
        return None
    state = store.state
    version, epoch = version or state.version, epoch or state.epoch
    checkpoint = store.checkpoint_path(signal, epoch)
    lines = tail_lines(store.spark, folder, options, store.positions_path(signal, epoch), logged_version(checkpoint))
    return (
        lines.writeStream.foreachBatch(_write_batch(store, signal, options, version, epoch, report))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_new(
    store: SignalStore,
    root: str,
    options: IngestOptions = IngestOptions(),
    version: str | None = None,
    epoch: str | None = None,
) -> IngestReport:
    """Ingest what was added since the last time, all three signals at once."""
    report = IngestReport()

    def run(signal: str) -> StreamingQuery | None:
        def add(rows: int, rejected: int) -> None:
            report.add(signal, rows, rejected)

        return start_signal(store, root, signal, options, None, add, version, epoch)

    def version_of(signal: str) -> int:
        return logged_version(store.checkpoint_path(signal, epoch))

    def more(signal: str, before: int) -> bool:
        now = version_of(signal)
        if not options.max_bytes or now == before:
            return False
        offsets = tail.Positions(store.positions_path(signal, epoch), now).offsets
        found = paths.sizes(signal_dir(root, signal))
        return any(size > offsets.get(path, 0) for path, size in found.items())

    waiting = list(SIGNALS)
    while waiting:
        before = {s: version_of(s) for s in waiting}
        started = {s: run(s) for s in waiting}
        failures = []
        for query in filter(None, started.values()):
            try:
                query.awaitTermination()
            except Exception as failure:  # the other signals still finish
                failures.append(failure)
        if failures:
            raise failures[0]
        # With a cap per micro-batch, go on until a run finds nothing more.
        waiting = [s for s in waiting if more(s, before[s])]
    return report


def rebuild(store: SignalStore, root: str, options: IngestOptions = IngestOptions()) -> IngestReport:
    """Ingest everything again from byte 0, complete last lines included, into a new version,
    then switch readers to it."""
    # Names of its own: of two rebuilds at a time neither writes into the other's folders.
    own = f"{store.state.sequence + 1}-{uuid.uuid4().hex[:8]}"
    version, epoch = f"v{own}", f"e{own}"
    for signal in SIGNALS:
        paths.make_dir(store.table_path(signal, version))
    report = ingest_new(store, root, replace(options, final_line=True), version, epoch)
    store.switch(version=version, epoch=epoch)
    return report


class PeriodicIngest:
    """Ingest at the start and then at an interval, one query per signal.

    A failed query is logged and started again by a watching thread; it resumes at its cursor,
    and from then on puts lines aside that make a micro-batch fail (``_poisoned`` beside the
    tables), so that one bad line does not hold up the rest. What fails again waits twice as
    long each time, up to ``MOST_WAIT`` intervals. Folders that appear later are followed from
    then on.
    """

    MOST_WAIT = 32

    def __init__(
        self,
        store: SignalStore,
        root: str,
        interval: str = "2m",
        enabled: bool = True,
        options: IngestOptions = IngestOptions(),
    ) -> None:
        self.store, self.root, self.options = store, root, options
        self.seconds = interval_seconds(interval)
        self.trigger = {"processingTime": trigger_text(self.seconds)}
        self.report = IngestReport()
        self.queries: dict[str, StreamingQuery] = {}
        self.restarts = 0
        # Failures of a signal since its last micro-batch that was written, and when to try again.
        self.failures: dict[str, int] = dict.fromkeys(SIGNALS, 0)
        self._due: dict[str, float] = dict.fromkeys(SIGNALS, 0.0)
        self._stopped, self._lock = threading.Event(), threading.Lock()
        if enabled:
            self.check()
            self._watch = threading.Thread(target=self._ticks, name="periodic-ingest", daemon=True)
            self._watch.start()

    def _ticks(self) -> None:
        while not self._stopped.wait(self.seconds):
            try:
                self.check()
            except Exception:  # the next tick tries again
                log.exception("periodic ingest could not start a query")

    def check(self) -> None:
        """Start what is not running: at first, after a failure, or once a folder appears."""
        with self._lock:
            for signal in SIGNALS:
                query = self.queries.get(signal)
                if self._stopped.is_set() or (query is not None and query.isActive):
                    continue
                if query is not None and query.exception() is not None:
                    log.error("ingest of %s failed, starting again: %s", signal, query.exception())
                    del self.queries[signal]
                    self.failures[signal] += 1
                    wait = min(self.MOST_WAIT, 2 ** (self.failures[signal] - 1)) - 1
                    self._due[signal] = time.monotonic() + wait * self.seconds
                if time.monotonic() >= self._due[signal]:
                    self._start(signal)

    def _start(self, signal: str) -> None:
        def add(rows: int, rejected: int) -> None:
            self.failures[signal] = 0
            self.report.add(signal, rows, rejected)

        failed = self.failures[signal] > 0
        options = replace(self.options, isolate=self.options.isolate or failed)
        started = start_signal(self.store, self.root, signal, options, self.trigger, add)
        if started is not None:
            self.restarts += failed
            self.queries[signal] = started

    def drain(self, timeout: float = 300.0) -> None:
        """Return once all that the files hold now is ingested; failed queries are waited for,
        ``timeout`` seconds at most, in which the time that micro-batches take does not count."""
        end = time.monotonic() + timeout
        while True:
            begun = time.monotonic()
            with self._lock:
                waiting = [s for s in SIGNALS if paths.exists(signal_dir(self.root, s)) and s not in self.queries]
                running = list(self.queries.values())
            try:
                for query in running:
                    query.processAllAvailable()
                if not waiting and all(q.isActive for q in running):
                    return
            except Exception:  # the watching thread starts it again
                log.info("a query failed while its end was waited for")
            end += time.monotonic() - begun
            if time.monotonic() > end:
                raise TimeoutError(f"periodic ingest of {self.root} did not come to an end")
            time.sleep(min(1.0, self.seconds))

    def stop(self) -> None:
        self._stopped.set()
        with self._lock:
            for query in self.queries.values():
                query.stop()
