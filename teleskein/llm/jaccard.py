"""N-gram Jaccard join: pairs of texts whose sets of five-word shingles are 0.8 alike or more.

1. Equal texts become one text with a number of copies (aggregation by a 128-bit key).
2. MinHash: 128 values of 16 bits a text. Texts that agree in one of 32 bands of four values
   share a bucket; a pair of similarity 0.8 shares none with probability 5e-8. Buckets with
   the same members are compared once.
3. Bayesian pruning: in a bucket, pairs are compared value by value in steps of 16; a pair is
   dropped as soon as the posterior probability of similarity >= 0.8, from a uniform prior and
   the matches so far, is under ``TOLERANCE``. What survives joins texts to candidate classes
   (only spanning edges leave a task, never all pairs).
4. Verification: the members of a candidate class meet with their whole shingle sets, pairs
   pass the same pruning and then an exact comparison. Links are counted where they are
   found; again only spanning edges and counts leave the task.

Buckets and classes of more than ``BLOCK`` members are cut into blocks and each pair of blocks
is a group of its own, so no task holds an unbounded group and none is capped. Classes are
connected components of verified links, found by repeated joins over written tables.

Defined cases: a text of one to four words has one shingle, all its words; texts without a word
(null, empty, blank) have the empty set and are copies of each other, linked to nothing else;
words are compared as they are; a null doc_id takes part and never names a class unless all
ids of the class are null; rows that repeat are copies; an empty table gives an empty result;
all columns of the caller are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleskein.llm.common import join_small, row_batches, row_key, stored, wrapped

WORDS = 5
THRESHOLD = 0.8
VALUES = 128
BAND = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
PIECE = 1_000_000  # bytes of rows that are shingled at once
STRETCH = 1 << 18  # bytes whose words are hashed at once, some 40 bytes of memory each

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C1B)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = _rng.integers(0, 2**64, VALUES, np.uint64) | np.uint64(1)
_TERMS = _rng.integers(0, 2**64, VALUES, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, null as empty, and the offsets of the texts."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; it does not depend on where the word lies."""
    power, back = (np.full(len(data) + 1, factor, np.uint64) for factor in (_BASE, _BASE_INVERSE))
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    power[1:] = np.add.accumulate(_LETTER[data] * power[:-1])
    power[0] = 0
    return mixed((power[ends] - power[begins]) * back[begins])


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in a row, and how many each text has."""
    texts = len(offsets) - 1
    letter = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends where its text ends
    before = np.concatenate([[False], letter[:-1]]) if len(data) else letter
    begins = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.concatenate([letter[1:], [False]]) if len(data) else letter
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    word = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):  # whole words of some STRETCH bytes, one word at least
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + STRETCH, "right")))
        word[at:to] = _word_hashes(data[begins[at] : ends[to - 1]], begins[at:to] - begins[at], ends[at:to] - begins[at])
        at = to
    first = np.searchsorted(begins, offsets)  # words of text k: first[k] to first[k + 1]
    n_words = np.diff(first)
    counts = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    starts = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    width = np.repeat(np.minimum(n_words, words), counts)
    value = np.zeros(len(starts), np.uint64)
    for k in range(words):
        inside = width > k
        value = np.where(inside, value * _NEXT + word[np.minimum(starts + k, max(len(word) - 1, 0))], value) if len(word) else value
    return mixed(value + width.astype(np.uint64)), counts


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits for each text; zeros where a text has no shingle."""
    out = np.zeros((len(counts), VALUES), np.uint16)
    some = counts > 0
    if not some.any():
        return out
    begins = (np.cumsum(counts) - counts)[some]
    rows = np.empty((int(some.sum()), VALUES), np.uint16)
    for k in range(VALUES):
        rows[:, k] = np.minimum.reduceat((hashes * _FACTORS[k] + _TERMS[k]) >> np.uint64(32), begins) & np.uint64(0xFFFF)
    out[some] = rows
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the fewest matches with P(similarity >= threshold) >= tolerance.

    From a uniform prior, m matches of n give Beta(m + 1, n - m + 1), whose upper tail at t is
    the chance of at most m successes in n + 1 draws of probability t.
    """
    least = {}
    for n in range(STEP, VALUES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                least[n] = m
                break
    return least


_LEAST = least_matches()


def likely_pairs(signs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that Bayesian pruning leaves."""
    matches = np.zeros(len(left), np.int32)
    for n in range(STEP, VALUES + 1, STEP):
        part = signs[:, n - STEP : n]
        matches = matches + (part[left] == part[right]).sum(1)
        stay = matches >= _LEAST[n]
        left, right, matches = left[stay], right[stay], matches[stay]
    return left, right


def alike_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets reach the threshold, by exact intersection sizes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    fits = np.minimum(sizes[left], sizes[right]) >= np.ceil(threshold * np.maximum(sizes[left], sizes[right]) - 1e-9)
    left, right = left[fits], right[fits]
    if len(left) <= 100:
        common = np.array([len(np.intersect1d(sets[a], sets[b], True)) for a, b in zip(left, right, strict=True)], np.int64)
    else:
        used = np.unique(np.concatenate([left, right]))
        _, column, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(used)), sizes[used])
        shared = times[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total, width = np.zeros((len(used), len(used)), np.float32), 4096
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [begin, begin + width])
            present = np.zeros((len(used), width), np.float32)
            present[row[a:b], column[a:b] - begin] = 1
            total += present @ present.T
        at = np.searchsorted(used, np.arange(len(sets)))
        common = total[at[left], at[right]].astype(np.int64)
    alike = common >= np.ceil(threshold * (sizes[left] + sizes[right] - common) - 1e-9)
    return left[alike], right[alike]


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' connected component."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def block_pairs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a group: all pairs of one block, or those across its two blocks."""
    kinds = np.unique(own)
    if len(kinds) == 1:
        return np.triu_indices(len(own), 1)
    a, b = np.flatnonzero(own == kinds[0]), np.flatnonzero(own == kinds[1])
    return np.repeat(a, len(b)), np.tile(b, len(a))


def in_blocks(df: DataFrame, group: str, size: str) -> DataFrame:
    """Rows of ``df`` (with a group key, its size and ``rep``) dealt so that each pair of a
    group's blocks meets in one run of equal (group, low, high); ``own`` is a row's block."""
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = df.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return dealt.drop("blocks", "other", size).repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], whole: bool = True) -> Iterator[pa.Table]:
    """The runs of rows with equal keys in a sorted stream, each as one table, or, if they need
    not come whole, as a table for each batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1
        begin = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            key = tuple(columns[begin])
            if held and (key != last or not whole):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last, begin = key, end
    if held:
        yield pa.Table.from_batches(held)


def distinct_reps(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row positions of the distinct texts, and their ids, in order of id."""
    reps, at = np.unique(table.column("rep").to_numpy(), return_index=True)
    return at, reps


def by_group(df: DataFrame, group: str, function: Callable[[pa.Table], list], schema: str) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        out: list[list[np.ndarray]] = []
        for table in runs(batches, [group, "low", "high"]):
            if got := function(table):
                out.append(got)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _sign_matrix(table: pa.Table, at: np.ndarray) -> np.ndarray:
    return np.array([np.frombuffer(s, np.uint16) for s in table.column("sign").take(pa.array(at)).to_pylist()]).reshape(-1, VALUES)


def likely_edges(table: pa.Table) -> list:
    at, reps = distinct_reps(table)
    if len(reps) < 2:
        return []
    pairs = block_pairs(table.column("own").to_numpy()[at])
    label = roots(len(reps), *likely_pairs(_sign_matrix(table, at), *pairs))
    moved = np.flatnonzero(label != np.arange(len(reps)))
    return [reps[moved], reps[label[moved]]] if len(moved) else []


def verified_links(table: pa.Table) -> list:
    at, reps = distinct_reps(table)
    if len(reps) < 2:
        return []
    pairs = likely_pairs(_sign_matrix(table, at), *block_pairs(table.column("own").to_numpy()[at]))
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").take(pa.array(at)).to_pylist()]
    left, right = alike_pairs(sets, *pairs)
    copies = table.column("copies").to_numpy()[at]
    texts = np.bincount(left, minlength=len(reps)) + np.bincount(right, minlength=len(reps))
    links = np.bincount(left, copies[right], len(reps)) + np.bincount(right, copies[left], len(reps))
    some = np.flatnonzero(texts)
    return [reps[some], reps[roots(len(reps), left, right)[some]], texts[some].astype(np.int64), links[some].astype(np.int64)]


def components(edges: DataFrame, label: str) -> DataFrame:
    """node and root (its component's smallest node) for all nodes of ``edges`` (a, b).

    Alternating large-star and small-star steps over written tables until nothing changes.
    """
    star = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    previous = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = join_small(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = stored(large, label)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = join_small(large, low, "a")
        small = small.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        star = stored(small.filter("a <> b").distinct(), label)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == previous:
            break
        previous = now
    nodes = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def texts_of(inner: DataFrame) -> DataFrame:
    """key, rep (an id), doc (smallest id), copies and sign of every different text."""

    def run(batches):
        for batch in row_batches(batches, PIECE):
            hashes, counts = shingles(*flat(batch.column("text")))
            signs = signatures(hashes, counts)
            rows = pa.array([s.tobytes() for s in signs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc"), rows], names=["key", "doc", "sign"])

    signed = inner.select("key", "doc", "text").mapInArrow(run, "key struct<k1:long,k2:long>, doc long, sign binary")
    found = signed.groupBy("key").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("sign").alias("sign"))
    return stored(found.withColumn("rep", F.monotonically_increasing_id()), "jaccard-texts")


def linked_texts(inner: DataFrame, texts: DataFrame) -> DataFrame:
    """rep, root, n_texts, n_links of the texts that have a link (several rows where a class
    fills several blocks)."""
    filled = texts.filter(F.col("sign") != F.lit(bytes(2 * VALUES)))
    bands = VALUES // BAND
    parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sign"), k * 2 * BAND + 1, F.lit(2 * BAND))))
    rows = filled.select("rep", F.explode(parts).alias("bucket"))
    shared = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"))
        .filter("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "n")
    )
    members = join_small(rows, stored(shared, "jaccard-buckets"), "bucket")
    signed = members.join(filled.select("rep", "sign"), "rep")
    edges = by_group(in_blocks(signed, "bucket", "n"), "bucket", likely_edges, "a long, b long")
    classes = stored(components(stored(edges, "jaccard-likely"), "jaccard-stars"), "jaccard-classes")
    sizes = classes.groupBy("root").agg(F.count("*").alias("n"))
    chosen = classes.join(sizes, "root").withColumnRenamed("node", "rep").join(texts, "rep")
    chosen = chosen.select(F.struct("key", "doc").alias("slot"), "rep", "root", "n", "copies", "sign")
    full = join_small(inner.select(F.struct("key", "doc").alias("slot"), "text"), stored(chosen, "jaccard-chosen"), "slot")

    def run(batches):
        for batch in row_batches(batches, PIECE):
            hashes, counts = shingles(*flat(batch.column("text")))
            ends = np.cumsum(counts)
            sets = [np.unique(hashes[e - c : e]).tobytes() for e, c in zip(ends, counts, strict=True)]
            others = [batch.column(c) for c in ("rep", "root", "n", "copies", "sign")]
            yield pa.RecordBatch.from_arrays([*others, pa.array(sets, pa.binary())], names=["rep", "root", "n", "copies", "sign", "shingles"])

    schema = "rep long, root long, n long, copies long, sign binary, shingles binary"
    with_sets = full.select("rep", "root", "n", "copies", "sign", "text").mapInArrow(run, schema)
    return stored(by_group(in_blocks(with_sets, "root", "n"), "root", verified_links, "rep long, root long, n_texts long, n_links long"), "jaccard-links")


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed documents (key, doc, text, row), and for each text key: class_id, keeper (doc
    and key of the one that stays), n_links, n_texts."""
    inner = wrapped(docs, doc="doc_id", text="text").withColumn("doc", F.col("doc").cast("long"))
    has_word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    plain = F.when(has_word, F.col("text")).otherwise(F.lit(""))
    key = F.struct(row_key(plain)["col1"].alias("k1"), row_key(plain)["col2"].alias("k2"))
    inner = inner.withColumn("key", key)
    texts = texts_of(inner.withColumn("text", plain))
    links = linked_texts(inner.withColumn("text", plain), texts)
    roots_ = stored(components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "jaccard-final"), "jaccard-roots")
    counts = links.groupBy("rep").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_links").alias("n_links"))
    every = (
        texts.select("rep", "key", "doc", "copies")
        .join(roots_.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counts, "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
    )
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "key")).alias("first")
    keepers = every.groupBy("root").agg(first)
    named = every.join(keepers, "root").select(
        "key",
        F.col("first")["doc"].alias("class_id"),
        F.struct(F.col("first")["doc"].alias("doc"), F.col("first")["key"].alias("key")).alias("keeper"),
        F.coalesce("n_texts", F.lit(0).cast("long")).alias("n_texts"),
        (F.coalesce("n_links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
    )
    return inner, stored(named, "jaccard-named")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id linked directly or through others), n_links (other
    documents that are alike, copies included) and n_texts (different texts that are alike)."""
    inner, named = text_classes(docs)
    return join_small(inner.select("key", F.col("doc").alias("doc_id")), named.drop("keeper"), "key").select("doc_id", "class_id", "n_links", "n_texts")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The documents without those that are like one with a smaller id, with all columns. Of
    rows equal in id and text one stays."""
    inner, named = text_classes(docs)
    keep = stored(named.select("keeper").distinct().withColumnRenamed("keeper", "slot"), "jaccard-keepers")
    rows = inner.select(F.struct("doc", "key").alias("slot"), "row")
    stay = join_small(rows, keep, "slot")
    twice = rows.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.take(1):
        return stay.select("row.*")
    return stay.groupBy("slot").agg(F.first("row").alias("row")).select("row.*")
