"""Spelling variant grouping: words one inserted, deleted or replaced code point apart.

The nodes of the trie of all words are numbered, and those of the trie of all reversed words.
A word is then, for each of its places, a pair of integers: the node of what stands before and
the node of what stands behind, with the place's letter skipped or with nothing skipped. Two
words differ by one replaced letter where a skipping pair of theirs is the same, and by one
inserted letter where a pair without skip of the shorter one is a skipping pair of the longer
one. Pairs compare exactly, so no candidate is checked again.

Tries are numbered without building them in one place: words are range-sorted, a task walks
its stretch in order and opens new nodes beyond what a word shares with the one before it, and
nodes that the first word of a stretch shares with earlier stretches are carried over from a
summary with one row for each stretch. Numbers of whole words keep the order of the words.

A pair of integers is shared by at most one word for each letter of the alphabet (90) and one
without skip, so its group is bounded by the alphabet; each member takes its number of near
words there and the best of them, one row a member, never all pairs. Where a letter stands
several times in a row, only the first of these places counts for insertions, so two words
meet once.

A word points at its form, of at least twice its count, so chains are at most log2 of the
largest count long; roots are found by doubling.

Defined cases: a null text has no words, a null doc_id counts as empty text in the hash;
repeated rows count each; words of any length are taken whole; an empty table gives an empty
result. Only the columns named are read.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleskein.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]+"
MISTYPED = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
# Words of one task when tries are numbered.
STRETCH = 250_000
NODE_BITS = 33


def mistyped(docs: DataFrame) -> DataFrame:
    """word: every run of letters, lower-cased in A-Z, without the letter that its hash names."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= MIN_LENGTH)
    lower = runs.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    hashed = lower.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % MISTYPED == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame) -> DataFrame:
    """Distinct words (word, n) that are long and frequent enough."""
    long = words.filter(F.length("word") >= MIN_LENGTH)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


# --- tries ---


def shared_length(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b))) if len(a) + len(b) < 200 else _halved(a, b)


def _halved(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b)) + 1
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def numbered(words: DataFrame, key: str, label: str) -> DataFrame:
    """``words`` with ``nodes``: for each non-empty prefix of ``key`` its trie node's number."""
    stretches = max(1, -(-words.count() // STRETCH), words.sparkSession.sparkContext.defaultParallelism)
    others = [c for c in words.columns if c != key]
    runs = words.repartitionByRange(stretches, key).sortWithinPartitions(key).select(key, *others, F.spark_partition_id().alias("part"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, path, free = "", [], 0
        for batch in batches:
            keys, part = batch.column(0).to_pylist(), batch.column(len(others) + 1)
            base = part[0].as_py() << NODE_BITS if len(keys) else 0
            rows, size, begin = [], 0, 0
            for row, word in enumerate(keys):
                keep = shared_length(before, word)
                new = len(word) - keep
                path = path[:keep] + list(range(base + free + 1, base + free + 1 + new))
                before, free = word, free + new
                rows.append(path)
                size += len(path)
                if size > 1_000_000:
                    yield _with_nodes(batch.slice(begin, row + 1 - begin), rows)
                    rows, size, begin = [], 0, row + 1
            yield _with_nodes(batch.slice(begin), rows)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    fresh = stored(runs.mapInArrow(walk, f"{kinds}, nodes array<bigint>"), label)
    return _carried(fresh, key).drop("part")


def _with_nodes(batch: pa.RecordBatch, rows: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], names=[*batch.schema.names, "nodes"])


def carried_nodes(stretches: list[tuple[int, str, str, list[int]]]) -> list[tuple[int, list[int]]]:
    """(part, first word, last word, nodes of the last word) of each stretch in order: which
    nodes of a stretch's first word exist already, under which numbers."""
    out, before, path = [], "", []
    for part, first, last, nodes in stretches:
        carry = path[: shared_length(before, first)]
        if carry:
            out.append((part, carry))
        keep = min(len(carry), shared_length(first, last))
        before, path = last, carry[:keep] + list(nodes[keep:])
    return out


def _carried(fresh: DataFrame, key: str) -> DataFrame:
    ends = fresh.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("nodes", key).alias("nodes"))
    found = carried_nodes([tuple(r) for r in ends.orderBy("part").collect()])
    if not found:
        return fresh
    # Spark broadcasts this if it is small enough by its own measure
    carry = fresh.sparkSession.createDataFrame(found, "part int, carry array<bigint>")
    both = fresh.join(carry, "part", "left")
    last_carried = F.shiftleft(F.col("part").cast("long"), NODE_BITS) + F.size("carry")
    keep = F.size(F.filter("nodes", lambda x: x <= last_carried))
    moved = F.concat(F.slice("carry", F.lit(1), keep), F.slice("nodes", keep + 1, F.size("nodes")))
    return both.withColumn("nodes", F.when(F.col("carry").isNull(), F.col("nodes")).otherwise(moved)).drop("carry")


# --- pairs ---


def first_of_its_run(word: str) -> list[bool]:
    return [not k or c != word[k - 1] for k, c in enumerate(word)]


def lexicon(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, word, n) and (id, n, left, right, first): nodes before and behind each place."""
    words = stored(words, "words")
    forward = numbered(words, "word", "trie").withColumnRenamed("nodes", "before")
    backward = numbered(words.select(F.reverse("word").alias("drow")), "drow", "eirt")
    both = forward.join(backward.select(F.reverse("drow").alias("word"), F.col("nodes").alias("behind")), "word")
    root = F.array(F.lit(0).cast("long"))
    placed = both.select(
        F.element_at("before", -1).alias("id"),
        "word",
        "n",
        F.concat(root, "before").alias("left"),
        F.reverse(F.concat(root, "behind")).alias("right"),
    )
    placed = stored(placed, "lexicon")
    return placed.select("id", "word", "n"), placed


# What a row of the pair dictionary is: a word without skip, with a letter skipped, with one
# skipped that is not the first of its run.
PLAIN, SKIP, REPEATED = 0, 1, 2


def dictionary(placed: DataFrame) -> DataFrame:
    """(left, right, kind, id, n): every word without skip and with each of its letters skipped."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["left", "right", "kind", "id", "n"]
        kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for key, word, n, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(word)
                out[0] += left + left[:size]
                out[1] += right + right[1:]
                out[2] += [PLAIN] * (size + 1) + [SKIP if f else REPEATED for f in first_of_its_run(word)]
                out[3] += [key] * (2 * size + 1)
                out[4] += [n] * (2 * size + 1)
                if len(out[0]) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return placed.select("id", "word", "n", "left", "right").mapInArrow(rows, "left long, right long, kind tinyint, id long, n long")


def near(placed: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id) of the words that have near words."""
    member = F.struct((-F.col("n")).alias("less"), "id", "kind")
    groups = dictionary(placed).groupBy("left", "right").agg(
        F.array_sort(F.collect_list(member)).alias("members"),
        F.count_if(F.col("kind") == PLAIN).alias("plain"),
        F.count_if(F.col("kind") == SKIP).alias("skip"),
        F.count_if(F.col("kind") == REPEATED).alias("repeated"),
    )

    def meets(x, y):
        skips = (x["kind"] != PLAIN) & (y["kind"] != PLAIN)
        return (x["id"] != y["id"]) & (skips | (x["kind"] + y["kind"] == SKIP))

    def met(x):
        """How many of the group a member meets, and the first of them in the order of choice."""
        others = F.col("skip") + F.col("repeated") - 1
        count = F.when(x["kind"] == PLAIN, F.col("skip")).when(x["kind"] == SKIP, others + F.col("plain")).otherwise(others)
        best = F.get(F.filter("members", lambda y: meets(x, y)), F.lit(0))
        return F.struct(x["id"].alias("id"), count.alias("count"), F.struct(best["less"].alias("less"), best["id"].alias("id")).alias("best"))

    each = groups.filter(F.size("members") > 1).select(F.explode(F.transform("members", met)).alias("m"))
    found = each.filter("m.count > 0").select("m.*")
    summed = found.groupBy("id").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))
    return summed.select("id", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.id").alias("best_id"))


def rooted(links: DataFrame) -> DataFrame:
    """``links`` (id, up) with up replaced by the end of its chain."""
    links = stored(links, "links")
    while True:
        here, there = links.alias("here"), links.alias("there")
        step = here.join(there, F.col("here.up") == F.col("there.id"), "left")
        links = stored(step.select("here.id", F.coalesce("there.up", "here.up").alias("up"), F.col("there.id").isNotNull().alias("moved")), "links")
        moved = not links.filter("moved").isEmpty()
        links = links.select("id", "up")
        if not moved:
            return links


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    return grouped(counted(mistyped(docs)))


def grouped(words: DataFrame) -> DataFrame:
    """The same for distinct words and their counts (word, n)."""
    known, placed = lexicon(words)
    seen = stored(near(placed), "near")
    formed = known.join(seen, "id", "left").withColumn("up", F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best_id")))
    formed = stored(formed.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "up"), "forms")
    ends = rooted(formed.filter("up is not null").select("id", "up")).withColumnRenamed("up", "end")
    names = known.select(F.col("id").alias("up"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    last = known.select(F.col("id").alias("end"), F.col("word").alias("last"))
    linked = formed.filter("up is not null").join(names, "up").join(ends, "id").join(last, "end")
    return formed.join(linked.select("id", "form", "form_n", "last"), "id", "left").select(
        "word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n"
    )
