"""Manifest, top-n by date, deletions and racing writers of a store."""

from __future__ import annotations

import random
import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from teleskein import manifest as manifests
from teleskein.manifest import Content, Deletion, Manifest, Stats, folder_stats
from teleskein.operators import scan as scans
from teleskein.operators.retention import prune
from teleskein.operators.scan import QueryOptions, count_store, scan_store
from teleskein.sources import paths
from teleskein.tables import SignalStore, SwitchedMeanwhile

START = datetime(2024, 1, 1)


def logs(spark, data):
    """data: (days since START, hour, service, body)."""
    rows = [(START + timedelta(days=d, hours=h), service, body) for d, h, service, body in data]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, service_name string, body string")
    nulls = {"severity": "string", "severity_number": "int", "trace_id": "string", "span_id": "string", "attributes": "map<string,string>"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in nulls.items()}).withColumn("date", F.to_date("timestamp"))


@pytest.fixture()
def store(spark, tmp_path):
    return SignalStore(spark, str(tmp_path / "store"))


def bodies(df):
    return [r["body"] for r in df.collect()]


def folders_read(df) -> set[str]:
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def test_statistics_come_from_footers(spark, store):
    store.append("logs", logs(spark, [(0, 1, "b", "x"), (0, 5, "a", "y"), (3, 2, "c", "z")]), "one")
    content = store.content("logs")
    assert content.folders == {
        ("one", "2024-01-01"): Stats(2, "2024-01-01T01:00:00", "2024-01-01T05:00:00", "a", "b"),
        ("one", "2024-01-04"): Stats(1, "2024-01-04T02:00:00", "2024-01-04T02:00:00", "c", "c"),
    }
    target = f"{store.table_path('logs')}/ingest_batch=one"
    files = manifests._dated(target)
    assert {d: s for d, s in manifests._many_stats(spark, files, "logs")} == folder_stats(spark, target, "logs")
    store.append("logs", logs(spark, []), "none")
    assert store.batch_count("logs", "none") == 0 and store.batch_count("logs", "one") == 3


def test_limit_opens_the_earliest_dates_only(spark, store):
    days = 2500
    rows = spark.range(days * 2).select(
        (F.lit(START.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % days, F.col("id") % 24)).alias("timestamp"),
        F.concat(F.lit("svc-"), F.col("id") % 2).alias("service_name"),
        F.col("id").cast("string").alias("body"),
        *[F.lit(None).cast(t).alias(c) for c, t in {"severity": "string", "severity_number": "int", "trace_id": "string", "span_id": "string"}.items()],
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    store.append("logs", rows.withColumn("date", F.to_date("timestamp")))
    assert len(store.folders("logs")) == days
    for options, most in (
        (QueryOptions(limit=100), 50),
        (QueryOptions(limit=100, service="svc-1"), 2 * 130),
        (QueryOptions(limit=100, since=START + timedelta(days=2000, hours=3)), 53),
        (QueryOptions(limit=100, until=START + timedelta(days=20)), 21),
        (QueryOptions(limit=10, since=START + timedelta(days=9000)), 0),
    ):
        found = scan_store(store, "logs", options)
        assert len(folders_read(found)) <= most
        assert bodies(found) == bodies(scans.scan(store.table("logs"), "logs", options))


def test_filters_and_counts_agree_with_plain_scans(spark, store):
    rng = random.Random(3)
    data = [(rng.randrange(40), rng.randrange(24), f"s{rng.randrange(4)}", str(k)) for k in range(600)]
    for k in range(0, 600, 100):
        store.append("logs", logs(spark, data[k : k + 100]), f"e0-{k // 100}")
    store.append("logs", logs(spark, [(50, 1, "alone", "first"), (51, 1, "zz", "last")]))
    prune(store, START + timedelta(days=5, hours=7), service="s1")
    assert bodies(scan_store(store, "logs", QueryOptions(service="alone"))) == ["first"]
    assert folders_read(scan_store(store, "logs", QueryOptions(service="alone"))) == {"date=2024-02-20"}
    for _ in range(12):
        low = START + timedelta(days=rng.randrange(-2, 45), hours=rng.randrange(24))
        options = QueryOptions(
            rng.choice([None, "s1", "s3", "nobody"]), rng.choice([None, low]), rng.choice([None, low + timedelta(days=rng.randrange(12))]), rng.choice([None, 1, 7, 80, 10_000])
        )
        assert bodies(scan_store(store, "logs", options)) == bodies(scans.scan(store.table("logs"), "logs", options)), options
    parsed = QueryOptions.parse(since="3d", until="2024-02-20T12:00:00Z", now=datetime(2024, 2, 20))
    assert bodies(scan_store(store, "logs", parsed)) == ["first"]
    counts = {r["signal"]: r["rows"] for r in count_store(store).collect()}
    assert counts == {"traces": 0, "metrics": 0, "logs": store.table("logs").count()}


def test_service_prune_opens_and_rewrites_nothing_else(spark, store, monkeypatch):
    store.append("logs", logs(spark, [(0, 1, "a", "a0"), (0, 2, "b", "b0"), (1, 1, "b", "b1"), (2, 1, "a", "a2"), (9, 1, "a", "a9")]), "one")
    before = paths.sizes(store.table_path("logs"))
    seen = []
    raw = SignalStore.raw

    def spied(self, *args, **more):
        found = raw(self, *args, **more)
        seen.append(folders_read(found))
        return found

    monkeypatch.setattr(SignalStore, "raw", spied)
    report = prune(store, START + timedelta(days=5), service="a").collect()
    assert [r["deleted"] for r in report] == [0, 0, 2]
    # the second day has no such service, the third nothing else, the tenth is too late
    assert seen == [{"date=2024-01-01"}] and paths.sizes(store.table_path("logs")) == before
    monkeypatch.undo()
    left = ["a9", "b0", "b1"]
    assert sorted(bodies(store.table("logs"))) == left
    assert [r["deleted"] for r in prune(store, START + timedelta(days=5), service="a").collect()] == [0, 0, 0]
    store.append("logs", logs(spark, [(0, 3, "a", "later")]), "two")
    assert sorted(bodies(store.table("logs"))) == [*left, "later"]
    store.compact("logs")
    assert sorted(bodies(store.table("logs"))) == [*left, "later"]
    store.vacuum()
    content = store.content("logs")
    assert sorted(bodies(store.table("logs"))) == [*left, "later"]
    on_disk = {tuple(p.split("/")[-3:-1]) for p in paths.sizes(store.table_path("logs"))}
    assert on_disk == {(f"ingest_batch={b}", f"date={d}") for b, d in content.folders}
    assert [r["deleted"] for r in prune(store, START + timedelta(days=20)).collect()] == [0, 0, 4]
    assert bodies(store.table("logs")) == []


def plain(records):
    """What the records say, one after the other."""
    live, hidden, deletions = {}, set(), []
    for batch, folders, hides, more in records:
        live = {k: s for k, s in live.items() if k[0] != batch} | {(batch, d): s for d, s in folders.items()}
        hidden |= set(hides)
        deletions += more
    return Content({k: s for k, s in live.items() if k not in hidden}, deletions)


def test_ten_thousand_batches_open_few_records(spark, tmp_path):
    batches, months = 10_000, 24
    own = Manifest(spark, str(tmp_path / "m"))
    records = []
    for k in range(batches):
        day = (date(2022, 1, 1) + timedelta(days=k * 30 * months // batches)).isoformat()
        entry = (f"e0-{k}", {day: Stats(k, f"{day}T00:00:00", f"{day}T01:00:00", "a", "b")}, [], [])
        if k % 97 == 96:
            entry = (f"merged-x{k}", {day: Stats(7)}, [(f"e0-{k - 1}", day), (f"e0-{k - 2}", day)], [])
        own.add(*entry)
        records.append(entry)
    reader = Manifest(spark, str(tmp_path / "m"))
    assert reader.content().folders == plain(records).folders
    assert reader.opened <= manifests.FOLD_AFTER + 1 + months
    narrow = Manifest(spark, str(tmp_path / "m"))
    found = narrow.content("2022-05-01", "2022-05-31").folders
    assert found == {k: s for k, s in plain(records).folders.items() if k[1][:7] == "2022-05"}
    assert narrow.opened <= manifests.FOLD_AFTER + 2
    last = max(int(b.split("-")[1]) for b, *_ in records if b.startswith("e0-"))
    assert narrow.last_number("e0-") == last and narrow.last_number("e1-") == -1
    assert len(paths.names(str(tmp_path / "m"))) <= manifests.FOLD_AFTER + 1


def test_repeated_last_batch_after_a_fold(spark, tmp_path, monkeypatch):
    """The last numbered batch may be written again: what was hidden of it stays so."""
    monkeypatch.setattr(manifests, "FOLD_AFTER", 3)
    own = Manifest(spark, str(tmp_path / "m"))
    day, other = "2024-01-01", "2024-02-01"
    own.add("e0-0", {day: Stats(1)})
    own.add("e0-1", {day: Stats(2), other: Stats(3)})
    own.add("pruned-x", {}, [("e0-0", day), ("e0-1", day)], [Deletion("2024-01-02 00:00:00", "s", ("e0-1", "gone"))])
    for _ in range(2):
        assert set(own.content().folders) == {("e0-1", other)}
        assert [d.service for d in own.content().deletions] == ["s"]
        own.add("e0-1", {day: Stats(2), other: Stats(3)})
        own.fold()
    own.add("load-x", {day: Stats(9)})
    own.fold()
    own.add("load-x", {other: Stats(8)})  # of a name that a fold covers
    assert set(own.content().folders) == {("e0-1", other), ("load-x", other)}


def test_of_two_writers_one_fails(spark, tmp_path):
    store = SignalStore(spark, str(tmp_path / "store"))
    for round_ in range(8):
        gate, outcome = threading.Barrier(4), []

        def switch(name):
            gate.wait()
            try:
                outcome.append(SignalStore(spark, store.root)._add_state(type(state)(state.sequence + 1, name, "e0")))
            except SwitchedMeanwhile:
                outcome.append("lost")

        state = store.state
        threads = [threading.Thread(target=switch, args=(f"v{round_}-{k}",)) for k in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert sorted(map(str, outcome)) == ["None", "lost", "lost", "lost"]
        assert store.state.sequence == state.sequence + 1
    # clearing does not depend on the state, so all of them get through
    threads = [threading.Thread(target=store.clear_cursors) for _ in range(4)]
    before = store.state.sequence
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.state.sequence == before + 4


def test_rename_without_overwrite_of_hadoop(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / name).write_text(name)
    assert paths._renamed(spark, f"file://{folder}", "a", "one.json")
    assert not paths._renamed(spark, f"file://{folder}", "b", "one.json")
    assert (folder / "one.json").read_text() == "a"


def test_two_writers_that_fold_lose_no_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifests, "FOLD_AFTER", 5)

    def write(name):
        own = Manifest(spark, str(tmp_path / "m"))
        for k in range(60):
            own.add(f"{name}-x{k}", {"2024-01-01": Stats(k)})

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = Manifest(spark, str(tmp_path / "m")).content().folders
    assert len(found) == 180
