from __future__ import annotations

import json
from datetime import datetime

import pytest

from teleskein.operators.retention import prune
from teleskein.streaming.ingest import IngestOptions, PeriodicIngest, ingest_new, rebuild
from teleskein.tables import SignalStore

START = 1710000000000000000


def span_line(name="op", service="svc-a", start=START, **more):
    span = {"traceId": "t1", "spanId": "s1", "name": name, "startTimeUnixNano": str(start), **more}
    return json.dumps(
        {
            "resourceSpans": [
                {
                    "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]},
                    "scopeSpans": [{"spans": [span]}],
                }
            ]
        }
    )


def log_line(body="hello"):
    record = {"timeUnixNano": str(START), "body": {"stringValue": body}}
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record]}]}]})


def append(root, signal, text):
    folder = root / signal
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / f"{signal}.jsonl", "a") as out:
        out.write(text)


def names(store):
    return sorted(r["name"] for r in store.table("traces").collect())


@pytest.fixture()
def place(spark, tmp_path):
    return SignalStore(spark, str(tmp_path / "store")), tmp_path / "in"


def test_append_resume_and_partial_line(place):
    store, root = place
    append(root, "traces", span_line("a") + "\n")
    assert ingest_new(store, str(root)).traces == 1
    assert ingest_new(store, str(root)).total == 0
    second = span_line("b")
    append(root, "traces", second[:30])
    assert ingest_new(store, str(root)).total == 0
    append(root, "traces", second[30:] + "\n" + "\n  \n")
    append(root, "logs", log_line() + "\nnot json\n")
    report = ingest_new(SignalStore(store.spark, store.root), str(root))
    assert (report.traces, report.logs, report.total) == (1, 1, 2)
    assert report.rejected["logs"] == 1
    assert str(report) == "1 traces, 0 metrics, 1 logs"
    assert names(store) == ["a", "b"]
    cursors = {r.file_path: r.byte_offset for r in store.cursors().collect()}
    assert cursors[str(root / "traces" / "traces.jsonl")] == (root / "traces" / "traces.jsonl").stat().st_size


def test_truncated_file_starts_over(place):
    store, root = place
    append(root, "traces", span_line("a") + "\n" + span_line("b") + "\n")
    ingest_new(store, str(root))
    (root / "traces" / "traces.jsonl").write_text(span_line("c") + "\n")
    assert ingest_new(store, str(root)).traces == 1
    assert names(store) == ["a", "b", "c"]


def test_rebuild_and_clearing(place):
    store, root = place
    append(root, "traces", span_line("a") + "\n")
    ingest_new(store, str(root))
    store.clear_signal_tables()
    assert names(store) == [] and store.cursors().count() == 1
    assert ingest_new(store, str(root)).total == 0
    assert rebuild(store, str(root)).traces == 1
    assert names(store) == ["a"]
    store.clear_cursors()
    assert store.cursors().count() == 0 and names(store) == ["a"]
    assert ingest_new(store, str(root)).traces == 1
    assert names(store) == ["a", "a"]


def test_prune_then_ingest_brings_nothing_back(place):
    store, root = place
    append(root, "traces", span_line("a") + "\n" + span_line("b", start=START + 86_400_000_000_000) + "\n")
    ingest_new(store, str(root))
    report = prune(store, datetime(2024, 3, 10, 12), dry_run=True).collect()
    assert [r.deleted for r in report] == [1, 0, 0] and names(store) == ["a", "b"]
    prune(store, datetime(2024, 3, 10, 12))
    assert names(store) == ["b"]
    assert ingest_new(store, str(root)).total == 0
    prune(store, datetime(2030, 1, 1))
    assert names(store) == []


def test_repeated_batch_replaces_and_respects_prune(place, tmp_path):
    store, root = place
    append(root, "traces", span_line("a") + "\n" + span_line("b", service="svc-b") + "\n")
    ingest_new(store, str(root))
    prune(store, datetime(2030, 1, 1), service="svc-a")
    assert names(store) == ["b"]
    # Losing the commit record makes Spark run the last micro-batch again.
    (tmp_path / "store" / "_checkpoints" / "e0" / "traces" / "commits" / "0").unlink()
    hidden = tmp_path / "store" / "_checkpoints" / "e0" / "traces" / "commits" / ".0.crc"
    hidden.unlink(missing_ok=True)
    ingest_new(store, str(root))
    assert names(store) == ["b"]


def test_capped_batches_and_splits(place):
    store, root = place
    lines = [span_line(f"n{i:03d}") for i in range(60)]
    append(root, "traces", "\n".join(lines) + "\n")
    options = IngestOptions(max_bytes=3000, split_bytes=700)
    assert ingest_new(store, str(root), options).traces == 60
    assert names(store) == [f"n{i:03d}" for i in range(60)]
    assert len(store.batches("traces")) > 3
    store.compact("traces")
    assert len(store.batches("traces")) == 1 and len(names(store)) == 60
    store.vacuum()
    assert len(names(store)) == 60


def test_missing_time_fails_or_is_set_apart(place):
    store, root = place
    append(root, "traces", span_line("a", start=0) + "\n" + span_line("b") + "\n")
    with pytest.raises(Exception, match="no valid start_time"):
        ingest_new(store, str(root))
    assert names(store) == []
    ingest_new(store, str(root), IngestOptions(on_missing_time="quarantine"))
    assert names(store) == ["b"]


def test_periodic(place):
    import time

    store, root = place
    append(root, "traces", span_line("a") + "\n")
    job = PeriodicIngest(store, str(root), "500ms")
    try:
        for expected in (1, 2):
            end = time.time() + 60
            while job.report.traces < expected and time.time() < end:
                time.sleep(0.2)
            if expected == 1:
                append(root, "traces", span_line("b") + "\n")
    finally:
        job.stop()
    assert names(store) == ["a", "b"]


def test_periodic_survives_a_line_that_fails(place):
    """A span without a time fails its query; it is put aside and all others come in."""
    store, root = place
    append(root, "traces", "".join(span_line(f"n{k:03d}") + "\n" for k in range(40)) + span_line("bad", start=0) + "\n")
    append(root, "logs", log_line() + "\n")
    job = PeriodicIngest(store, str(root), "500ms")
    try:
        job.drain()
        assert job.restarts == 1 and job.report.traces == 40 and job.report.logs == 1
        append(root, "traces", span_line("worse", start=0) + "\n" + span_line("after") + "\n" + span_line("worse", start=0) + "\n")
        job.drain()
        assert job.restarts == 1 and set(job.failures.values()) == {0}
    finally:
        job.stop()
    assert names(store) == ["after", *(f"n{k:03d}" for k in range(40))]
    aside = store.spark.read.parquet(f"{store.root}/_poisoned/v0/traces")
    assert sorted(json.loads(r.value)["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["name"] for r in aside.collect()) == ["bad", "worse", "worse"]


def test_periodic_waits_longer_after_each_failure(place):
    """A file that cannot be followed is no line's fault: tried again ever more rarely."""
    import time

    store, root = place
    append(root, "logs", log_line() + "\n")
    (root / "logs" / "z.gz").write_bytes(b"z")
    job = PeriodicIngest(store, str(root), "100ms")
    try:
        end = time.time() + 90
        while job.failures["logs"] < 4 and time.time() < end:
            time.sleep(0.1)
        assert job.restarts >= 3 and job.report.logs == 0
        assert job._due["logs"] - time.monotonic() < 0.1 * job.MOST_WAIT
        (root / "logs" / "z.gz").unlink()
        job.drain()
        assert job.report.logs == 1 and job.failures["logs"] == 0
    finally:
        job.stop()


def test_search_for_failing_lines(spark):
    from teleskein.streaming.ingest import failing_hashes

    lines = spark.createDataFrame([(f"line {k}",) for k in range(200)] + [("line 7",)], "value string")

    def bad(*values):
        return lambda part: not part.filter(part.value.isin(*values)).isEmpty()

    found = failing_hashes(lines, bad("line 7", "line 90"))
    hit = [r.value for low, high in found for r in lines.filter(f"xxhash64(value) BETWEEN {low} AND {high}").collect()]
    assert sorted(hit) == ["line 7", "line 7", "line 90"]
    assert failing_hashes(lines, lambda part: False) is None
    assert failing_hashes(lines, lambda part: True, most=20) is None


def test_stretches_meet_on_line_borders(tmp_path):
    import random

    from teleskein.sources.tail import TailReader

    random.seed(5)
    lines = ["x" * random.choice([0, 1, 5, 40, 300]) for _ in range(400)]
    data = "".join(x + "\n" for x in lines)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(data + "open end")
    for split in (1, 7, 64, 1000, 10**6):
        reader = TailReader({"path": str(tmp_path / "in"), "positions": str(tmp_path / f"p{split}"), "split_bytes": str(split)})
        end = reader.latestOffset()
        assert end == {"version": 1} and reader.positions.offsets == {str(tmp_path / "in" / "a.jsonl"): len(data)}
        got = [v.decode() for p in reader.partitions({"version": 0}, end) for b in reader.read(p) for v in b.column(1).to_pylist()]
        assert got == lines
    # With a budget, offsets move on by whole lines until all is read.
    reader, start, got = TailReader({"path": str(tmp_path / "in"), "positions": str(tmp_path / "p"), "max_bytes": "500"}), {"version": 0}, []
    while (end := reader.latestOffset()) != start:
        got += [v.decode() for p in reader.partitions(start, end) for b in reader.read(p) for v in b.column(1).to_pylist()]
        reader.commit(end)
        start = end
    assert got == lines


def test_rotated_files_are_forgotten(spark, tmp_path):
    """10 000 files come and go: the offset stays a number, and snapshots hold what is there."""
    from teleskein.sources.tail import SNAPSHOT_EVERY, Positions, TailReader, position_files

    folder, kept = tmp_path / "in", tmp_path / "p"
    folder.mkdir()
    for k in range(10_000):
        (folder / f"f{k:05d}.jsonl").write_text("x" * (k % 7) + "\n")
    options = {"path": str(folder), "positions": str(kept)}
    reader = TailReader(options)
    end = reader.latestOffset()
    assert len(json.dumps(end)) < 30 and len(reader.positions.offsets) == 10_000
    assert sum(s.upto - s.start for s in reader.partitions(reader.initialOffset(), end)) == sum(k % 7 + 1 for k in range(10_000))
    for k in range(9_990):
        (folder / f"f{k:05d}.jsonl").unlink()
    for turn in range(2 * SNAPSHOT_EVERY):
        with open(folder / f"f{9_990 + turn % 10:05d}.jsonl", "a") as out:
            out.write(f"turn {turn}\n")
        before, end = end, reader.latestOffset()
        (read,) = reader.partitions(before, end)
        assert [v for b in reader.read(read) for v in b.column(1).to_pylist()] == [f"turn {turn}".encode()]
        reader.commit(end)
        assert reader.latestOffset() == end
    assert len(reader.positions.offsets) == 10 and len(list(kept.iterdir())) <= SNAPSHOT_EVERY + 3
    again = TailReader(options | {"version": str(end["version"])})
    assert again.positions.offsets == reader.positions.offsets and again.latestOffset() == end
    # A version handed out, but not logged, is made again.
    (folder / "new.jsonl").write_text("new\n")
    lost = again.latestOffset()
    (folder / "new.jsonl").write_text("new\nmore\n")
    anew = TailReader(options | {"version": str(end["version"])})
    assert anew.latestOffset() == lost
    assert [(s.start, s.upto) for s in anew.partitions(end, lost)] == [(0, 9)]
    assert Positions(str(kept), lost["version"]).offsets[str(folder / "new.jsonl")] == 9
    assert len(position_files(str(kept), lost["version"])) <= SNAPSHOT_EVERY + 1


def test_long_lines_over_read_blocks(tmp_path, monkeypatch):
    from teleskein.sources import tail

    monkeypatch.setattr(tail, "READ_BYTES", 16)
    lines = ["a" * 100, "", "b" * 15, "c" * 16, "d" * 17, "e"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(x + "\n" for x in lines) + "tail" * 20)
    for split in (1, 10, 33, 1000):
        reader = tail.TailReader({"path": str(tmp_path / "in"), "positions": str(tmp_path / f"p{split}"), "split_bytes": str(split)})
        end = reader.latestOffset()
        got = [v.decode() for p in reader.partitions({"version": 0}, end) for b in reader.read(p) for v in b.column(1).to_pylist()]
        assert got == lines


# --- manifest, prune and last lines ---


def test_prune_that_stops_before_its_record_changes_nothing(place, monkeypatch):
    store, root = place
    append(root, "traces", span_line("a") + "\n" + span_line("b", service="svc-b") + "\n")
    ingest_new(store, str(root))

    def stop(*args, **kwargs):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(SignalStore, "record", stop)
        with pytest.raises(RuntimeError):
            prune(store, datetime(2030, 1, 1), service="svc-b")
    assert names(store) == ["a", "b"]
    prune(store, datetime(2030, 1, 1), service="svc-b")
    assert names(store) == ["a"]
    store.vacuum()
    assert names(store) == ["a"] and ingest_new(store, str(root)).total == 0


def test_scan_lists_the_folders_of_its_dates_only(place):
    store, root = place
    day = 86_400_000_000_000
    for k in range(4):
        append(root, "traces", span_line(f"n{k}", start=START + k * day) + "\n" + span_line(f"m{k}", start=START) + "\n")
        ingest_new(store, str(root))
    rows = store.table("traces", since="2024-03-11", until="2024-03-11")
    assert [r["name"] for r in rows.collect()] == ["n2"]
    assert {f.rsplit("/", 2)[1] for f in rows.inputFiles()} == {"date=2024-03-11"}
    assert len(store.folders("traces")) == 7
    store.compact("traces")
    assert len(store.folders("traces")) == 4 and len(names(store)) == 8
    store.vacuum()
    assert len(names(store)) == 8


def test_rebuild_takes_a_whole_last_line_and_leaves_a_broken_one(place):
    store, root = place
    append(root, "traces", span_line("a") + "\n" + span_line("b"))
    append(root, "logs", log_line() + "\n" + log_line()[:20])
    assert ingest_new(store, str(root)).total == 2
    report = rebuild(store, str(root))
    assert (report.traces, report.logs) == (2, 1) and names(store) == ["a", "b"]
    append(root, "traces", "\n" + span_line("c") + "\n")
    assert ingest_new(store, str(root)).traces == 1


def test_compressed_file_is_an_error_and_other_names_are_followed(place):
    store, root = place
    append(root, "logs", log_line() + "\n")
    (root / "logs" / "other.log").write_text(log_line("x") + "\n")
    (root / "logs" / ".hidden").write_text(log_line("y") + "\n")
    assert ingest_new(store, str(root)).logs == 2
    (root / "logs" / "z.gz").write_bytes(b"z")
    with pytest.raises(Exception, match="compressed"):
        ingest_new(store, str(root))


def test_gzip_files_are_followed_by_members(place, monkeypatch):
    import gzip

    from teleskein.sources import tail

    store, root = place
    folder = root / "traces"
    folder.mkdir(parents=True)
    (folder / "a.gz").write_bytes(gzip.compress((span_line("a") + "\n" + span_line("b") + "\n").encode()))
    append(root, "traces", span_line("c") + "\n" + span_line("open")[:9])
    assert ingest_new(store, str(root)).traces == 3 and ingest_new(store, str(root)).total == 0
    with open(folder / "a.gz", "ab") as out:
        out.write(gzip.compress((span_line("d") + "\n").encode()) + gzip.compress(span_line("e").encode()))
    assert ingest_new(store, str(root), IngestOptions(max_bytes=10)).traces == 2
    assert names(store) == ["a", "b", "c", "d", "e"]
    # Pieces of any size give the lines; a member that is not whole is an error.
    lines = [b"x" * (k * 37 % 300) for k in range(100)] + [b"end"]
    whole = gzip.compress(b"\n".join(lines[:60]) + b"\n") + gzip.compress(b"\n".join(lines[60:]) + b"\n")
    for piece in (1, 16, 100, 4 << 20):
        monkeypatch.setattr(tail, "READ_BYTES", piece)
        for name, data in (("whole", whole), ("cut", whole[:-3])):
            (root / name).mkdir(exist_ok=True)
            (root / name / "a.gz").write_bytes(data)
            reader = tail.TailReader({"path": str(root / name), "positions": str(root / f"{name}-{piece}"), "split_bytes": "50"})
            (part,) = reader.partitions({"version": 0}, reader.latestOffset())
            if name == "whole":
                assert [v for b in reader.read(part) for v in b.column(1).to_pylist()] == lines
            else:
                with pytest.raises(ValueError, match="inside a gzip member"):
                    list(reader.read(part))


def test_micro_batches_keep_no_copy_of_their_lines(place, monkeypatch):
    from pyspark.sql import DataFrame

    store, root = place
    kept = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *level: kept.append(self) or self)
    append(root, "logs", log_line() + "\nnot json\n")
    report = ingest_new(store, str(root))
    assert report.logs == 1 and report.rejected["logs"] == 1 and not kept
    rejects = store.spark.read.parquet(f"{store.root}/_rejects/v0/logs").collect()
    assert [r.value for r in rejects] == ["not json"]


def test_drain_does_not_count_the_time_of_micro_batches(place):
    import time

    class Slow:
        isActive = True

        def processAllAvailable(self):
            self.calls = getattr(self, "calls", 0) + 1
            time.sleep(0.5)
            if self.calls == 1:
                raise RuntimeError("fails once, late")

    store, root = place
    job = PeriodicIngest(store, str(root), "100ms", enabled=False)
    job.queries["logs"] = slow = Slow()
    job.drain(timeout=0.4)
    assert slow.calls == 2
