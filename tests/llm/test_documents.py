"""Line dedup, mixing, Jaccard join, BPE and quality rules against plain versions."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from teleskein.llm import bpe, jaccard, line_dedup, mixing, quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(brute.odd_rows(), brute.ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.ODD_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def near_rows() -> list[tuple]:
    """Texts around the threshold, and a group of near copies larger than a block."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [f"b{k}w{rng.randrange(50)}" for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 20) + 1)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(copy)))
    base = [f"g{i}" for i in range(200)]
    for k in range(700):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(200)] = f"h{k % 40}"
        rows.append((len(rows), " ".join(copy)))
    return rows


def test_jaccard_equals_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.jaccard_classes(df).collect()), key=repr) == brute.jaccard_classes(rows)


def test_jaccard_odd_rows(spark, odd, empty):
    rows = [(r[0], r[1]) for r in brute.odd_rows()]
    assert sorted(map(tuple, jaccard.jaccard_classes(odd).collect()), key=repr) == brute.jaccard_classes(rows)
    assert jaccard.jaccard_classes(empty).collect() == []
    assert jaccard.one_of_each_class(empty).collect() == []


def test_one_of_each_class(odd):
    kept = jaccard.one_of_each_class(odd)
    assert kept.columns == odd.columns
    classes = {c for _, c, _, _ in brute.jaccard_classes([(r[0], r[1]) for r in brute.odd_rows()])}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_shingling_takes_bounded_memory(monkeypatch):
    """Also of one long text; and a hash does not depend on how words are cut into stretches."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))) for _ in range(500_000)).encode()
    tracemalloc.start()
    whole, counts = jaccard.shingles(*jaccard.flat(pa.array([text], pa.binary())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [499_996] and peak < 22 * len(text) + 20_000_000
    part = pa.array([text[:40_000], None, b" ", b"x" * 300 + b" y", text[40_000:60_000]], pa.binary())
    expected = jaccard.shingles(*jaccard.flat(part))
    for stretch in (1, 7, 100):
        monkeypatch.setattr(jaccard, "STRETCH", stretch)
        assert all((a == b).all() for a, b in zip(jaccard.shingles(*jaccard.flat(part)), expected, strict=True))
    assert (expected[0][:1000] == whole[:1000]).all()


def test_texts_are_shingled_in_small_pieces(spark):
    inner = spark.createDataFrame([(k, "a b c d e f " * 900) for k in range(600)], "doc long, text string")
    inner = inner.selectExpr("struct(doc as k1, doc as k2) as key", "doc", "text")
    held = []

    class Frame:  # keeps the function of a mapInArrow
        def select(self, *_):
            return self

        def mapInArrow(self, function, schema):
            held.append(function)
            return inner.selectExpr("key", "doc", "cast('' as binary) as sign")

    jaccard.texts_of(Frame())
    batch = inner.toArrow().combine_chunks().to_batches()[0]
    pieces = [b.num_rows for b in held[0]([batch])]
    assert sum(pieces) == 600 and max(pieces) * batch.nbytes / 600 <= 1_000_000


def test_least_matches_keep_true_pairs():
    for n, m in jaccard._LEAST.items():
        assert 0 < m < 0.8 * n


def test_bpe_equals_library(spark, odd, empty, docs):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "abc ABC  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000\u00e9\u00df\u6f22\u5b57\U0001d4b3\U0001f600'sll'llre0123\u00b2\u00bd\u0663!?.,-_\u0301\ud7ff\ufeff\u200b\u180e"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(600)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "aaaa" * 500, " " * 77, "it's we'll I'M", "\r\n\r\n x"]
    codec = bpe.Codec(bpe.Vocabulary(path))
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want, text
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False), ids
    for table in (odd, docs):
        want = []
        for r in table.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((r["doc_id"], len(ids), brute.sha256(",".join(map(str, ids)).encode()), brute.sha256(decoded.encode())))
        assert sorted(map(tuple, bpe.digests(table, path).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(empty, path).collect() == []


def test_line_dedup(odd, empty):
    done = line_dedup.dedup_lines(odd)
    assert done.columns == odd.columns
    texts = {}
    for r in done.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert texts[99] == ["shared line\nother"]
    assert all(texts[100 + i] == [f"own {i}"] for i in range(14))
    want = {}
    for r in brute.odd_rows():
        want.setdefault(r[0], []).append(r[1])
    for key in set(want) - set(range(99, 120)):
        assert sorted(map(repr, texts[key])) == sorted(map(repr, want[key]))
    assert line_dedup.dedup_lines(empty).collect() == []


def plain_removed(rows: list[tuple], min_sites: int) -> int:
    """Lines with at least ``min_sites`` sites, but for those at the first place of each; rows
    that repeat share their places."""
    sites, places = {}, {}
    for doc, text, _, site, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r")
            if key:
                sites.setdefault(key, set()).add(site)
                places.setdefault(key, []).append((doc is None, doc or 0, pos))
    return sum(p > min(found) for key, found in places.items() if len(sites[key]) >= min_sites for p in found)


def test_line_dedup_exact_and_sketched_agree(odd, monkeypatch):
    """A threshold far below the spread takes the sketch's word, one near it the exact count."""
    for sites in (3, 13, 14, 15):
        removed = [r["n_removed"] for r in line_dedup.cleaned(odd, min_sites=sites).collect()]
        assert sum(removed) == plain_removed(brute.odd_rows(), sites)


def test_line_dedup_trims_at_the_ends_only(spark):
    """A blank before a line separator at a line's end is inside the line, not white space after it."""
    rows = [(k, "shared \u2028\nown" if k % 2 else "shared\u2028\nown " + str(k), f"s{k}") for k in range(18)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sum(r["n_removed"] for r in line_dedup.cleaned(df).collect()) == plain_removed([(d, t, None, s) for d, t, s in rows], 10) == 0


def test_line_dedup_cuts_lines_twice_only(odd, monkeypatch):
    """Once for the sketches, once for the occurrences of the lines that they leave."""
    plans, plain = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, label))
    line_dedup.dedup_lines(odd).collect()
    assert sum(plan.count("posexplode(") for plan in plans) == 2


def test_line_dedup_of_a_long_document(spark):
    """200 000 lines of which two go; the work must not grow with the square of the lines."""
    lines = [f"l{i}" for i in range(200_000)]
    rows = [(k, f"shared\nown {k}\nalso", f"s{k}") for k in range(20)] + [(99, "\n".join(["shared", *lines, "also"]), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    begin = time.monotonic()
    (text,) = [r["text"] for r in line_dedup.dedup_lines(df).collect() if r["doc_id"] == 99]
    assert text == "\n".join(lines) and time.monotonic() - begin < 120


def test_join_beyond_the_broadcast_bound(odd, monkeypatch):
    from teleskein.llm import common

    want = sorted(map(repr, line_dedup.dedup_lines(odd).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, line_dedup.dedup_lines(odd).collect())) == want
    rows = [(r[0], r[1]) for r in brute.odd_rows()]
    assert sorted(map(tuple, jaccard.jaccard_classes(odd).collect()), key=repr) == brute.jaccard_classes(rows)


def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(brute.odd_rows())
    sizes = {}
    for r in brute.odd_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert 0 <= r["target"] <= 2 * r["source_size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    targets = {r["source"]: r["target"] for r in rows}
    assert all(taken[s] == round(targets[s]) for s in sizes)
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd.repartition(7)).collect()))
    assert mixing.mix(empty).collect() == []


def test_mixed_documents_hold_what_was_taken(odd, docs, empty):
    for table in (odd, docs):
        got = {}
        for r in mixing.mixed(table).collect():
            got[r["source"]] = got.get(r["source"], 0) + len(brute.words(r["text"]))
        want = {}
        for r in mixing.mix(table).collect():
            want[r["source"]] = want.get(r["source"], 0) + r["taken"]
        assert all(abs(got.get(s, 0) - n) <= 1 for s, n in want.items())
        assert mixing.mixed(table).columns == table.columns
    assert mixing.mixed(empty).collect() == []


def test_quality_stats_and_base_rules(odd, docs, empty, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for table in (odd, docs):
        want = sorted((brute.quality_stats(r["text"]) for r in table.collect()), key=repr)
        rows = quality.assess(table, labels).collect()
        got = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows]
        assert sorted(got, key=repr) == want
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.assess(empty, labels).collect() == []
    none = labels.limit(0)
    assert all(r["kept"] != r["base_failed"] for r in quality.assess(docs, none).collect())


def test_quality_held_out(spark):
    """Fitted on half of the labelled rows, judged on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.assess(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_forest_equals_plain_paths():
    """Scores against paths drawn one row at a time from another generator."""
    rng, plain = np.random.default_rng(1), random.Random(2)
    usual = rng.normal(0, 1, (400, 3))
    asked = np.vstack([usual[:4], [[6, 0, 0], [0, -5, 5], [8, 8, 8]]])
    low, high = np.full(3, -9.0), np.full(3, 9.0)
    got = quality.Forest(usual, low, high, trees=600, tree_rows=64).score(asked)
    for row, score in zip(asked.tolist(), got, strict=True):
        assert abs(score - brute.anomaly(row, usual.tolist(), low.tolist(), high.tolist(), 600, 64, plain)) < 0.02


def test_quality_fit_counts_every_labelled_row(spark):
    """Bad rows that come last by hash are learned from, and the forest is that of all good rows."""
    import pyspark.sql.functions as F

    ids = spark.range(30_000).withColumnRenamed("id", "doc_id")
    last = [r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(300).collect()]
    labels = ids.select("doc_id", (~F.col("doc_id").isin(last)).cast("int").alias("quality")).repartition(7)
    n = {c: F.lit(100) + F.pmod(F.xxhash64("doc_id", F.lit(c)), F.lit(20)) for c in quality.NAMES}
    n["n_symbols"] = F.when(F.col("doc_id").isin(last), F.lit(90)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    stats = ids.select("doc_id", *[n[c].cast("long").alias(c) for c in quality.NAMES], F.lit(False).alias("base_failed"))
    forest, limit = quality.fit(stats, labels)
    rows = stats.orderBy("doc_id").toPandas()
    values, bad = quality.features(rows[quality.NAMES].to_numpy()), rows["doc_id"].isin(last).to_numpy()
    plain = quality.Forest(values[~bad], values.min(0), values.max(0))
    assert all(np.array_equal(a, b) for x, y in zip(forest.trees, plain.trees, strict=True) for a, b in zip(x, y, strict=True))
    scores = plain.score(values)
    own = np.sort(scores[~bad])
    assert limit >= own[int(np.ceil(quality.KEEP_SHARE * (len(own) - 1)))]
    assert (scores[bad] > limit).all() and (scores[~bad] <= limit).mean() >= 0.999


def test_bare_words_are_counted():
    place = quality.NAMES.index("n_bare_words")
    for text, n in (("a | b -- c", 2), ("|", 1), ("a|b ?! _ 7 \u00e9\t***\n#", 3), ("", 0), (None, 0), ("!\u00a0!", 1)):
        assert quality.text_stats(text)[place] == n, text


def test_conflicting_labels_take_the_lowest(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    doubled = labels.union(labels.filter("quality = 0").selectExpr("doc_id", "1 AS quality"))
    want = sorted(map(repr, quality.assess(docs, labels).collect()))
    assert sorted(map(repr, quality.assess(docs, doubled.repartition(5)).collect())) == want


def test_filtered_equals_verdict(docs, spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.assess(docs, labels).collect() if r["kept"]}
    got = quality.filtered(docs, labels)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == kept
    assert quality.filtered(odd, labels).columns == odd.columns
