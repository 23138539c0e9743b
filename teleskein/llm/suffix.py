"""Exact substring dedup: removes bytes of strings that an earlier document holds too.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller
id. The order of suffixes matters to that depth only, so the difference-cover construction is
run to that depth, as Spark jobs over chunks of documents:

1. Sample: the positions of a document whose residue modulo 21 is in the difference cover
   {0, 1, 4, 14, 16}. Any two positions have a shift below 21 that makes both of them sampled.
2. Names: the sampled tuples, the 30 bytes from each sampled position, are sorted by
   fingerprint (dealt by its range of values, sorted in each). A tuple that stands alone is discarded:
   no suffix through it can agree with another for 50 bytes. Names that occur again survive.
3. Merge: a suffix is ranked with the names only if one of its five sampled positions within
   the shift has a surviving name. Neighbouring ones form segments, cut where the fingerprint
   of a suffix says so, so that equal passages are cut alike in all documents. Segments are
   sorted by the fingerprint of all their bytes; one that a smaller document holds goes whole.
4. The suffixes of the other segments, each passage once, are sorted by a fingerprint of their
   first 50 bytes, and adjacent equal ones compared for the smallest document.

A document whose whole text an earlier one has needs no suffixes: all its bytes go, and it
adds no string that the earlier one has not. Such copies are found by one aggregation first.
The same holds for a segment that a smaller document holds.

A further recursion would order suffixes beyond byte 50, which the result does not depend on.
Keys travel packed: a chunk sends each key once and only with its smallest document, and what
comes back is one bit a key. Chunks are written once; each later job recomputes their keys from
the written table. A chunk holds about ``CHUNK`` bytes, or one document if that is longer; keys
are dealt into parts of about ``PART_KEYS``, so both follow the data, not the session.

Fingerprints: a collision of two different tuples only adds a suffix to step 3. Segments and
strings are told apart by 96 bits of two independent fingerprints, not by their bytes; among n
different ones some n * n / 2^97 false matches are expected (2e-10 for 5e9).

Defined cases: null and empty texts have no bytes; texts under 50 bytes lose nothing; a null
doc_id is larger than all others; rows with the same id do not remove each other's bytes; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleskein.llm.common import join_small, row_batches, row_key, stored
from teleskein.llm.jaccard import mixed, runs

LENGTH = 50
# A perfect difference cover of the residues modulo 21.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
CHUNK = 4_000_000
PART_KEYS = 1 << 20
LEAST_PARTS = 256
CUT = np.uint64(15)  # a suffix in 16 begins a segment
BASE = 0x9E3779B97F4A7C1B
TEXT_LEVEL = 6  # of zstd, as chunks are shuffled three times
TASKS = 4  # for each shuffle partition of the session, as packed keys take more memory than rows
LAST = np.int64(2**63 - 1)

CHUNK_SCHEMA = "chunk long, ids array<long>, sizes array<long>, blob binary"
KEY_SCHEMA = "part int, chunk long, n int, keys binary, rest binary, extra binary, docs binary, base long"
REPLY_SCHEMA = "chunk long, part int, flags binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _sampled(n: int) -> np.ndarray:
    """The positions below ``n`` whose residue is in the cover."""
    whole = np.arange(0, n, PERIOD)[:, None] + np.array(COVER)
    return whole.ravel()[: np.searchsorted(whole.ravel(), n)]


def planes(values: np.ndarray) -> bytes:
    """The bytes of an array by significance, packed: high ones are mostly alike."""
    data = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return pa.compress(data, "zstd", asbytes=True)


def from_planes(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    data = pa.decompress(data, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class Prints:
    """Two independent fingerprints of strings, by prefix sums of a polynomial modulo 2^64; the
    values of the bytes are drawn for each, the powers shared."""

    def __init__(self) -> None:
        self.letters = np.random.default_rng(50).integers(0, 2**64, (2, 256), np.uint64)
        self.powers = {BASE: np.ones(1, np.uint64), pow(BASE, -1, 2**64): np.ones(1, np.uint64)}

    def _power(self, base: int, n: int) -> np.ndarray:
        if len(self.powers[base]) < n:
            values = np.full(n, base, np.uint64)
            values[0] = 1
            self.powers[base] = np.multiply.accumulate(values)
        return self.powers[base][:n]

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.multiply(self.letters[which][data], self._power(BASE, len(data)), out=out[1:])
        return np.add.accumulate(out, out=out)

    def at(self, sums: np.ndarray, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        out = sums[starts + width]
        out -= sums[starts]
        out *= self._power(pow(BASE, -1, 2**64), len(sums))[starts]
        return mixed(out)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a chunk, offsets of its documents, their ids (null as the largest)."""
    offsets = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))]).astype(np.int64)
    data = pa.decompress(row["blob"], int(offsets[-1]), "zstd") if offsets[-1] else b""
    return np.frombuffer(data, np.uint8), offsets, np.array([LAST if i is None else i for i in row["ids"]], np.int64)


def chunked(docs: DataFrame) -> DataFrame:
    """The documents packed into chunks, written."""

    def run(batches):
        task, made, total = TaskContext.get().partitionId(), 0, 0
        ids, sizes, parts = [], [], []
        codec = pa.Codec("zstd", compression_level=TEXT_LEVEL)

        def chunk():
            blob = codec.compress(b"".join(parts), asbytes=True)
            arrays = [pa.array([(task << 32) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([blob])]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "ids", "sizes", "blob"])

        for batch in row_batches(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if ids and total + len(text) > CHUNK:
                    yield chunk()
                    made, total, ids, sizes, parts = made + 1, 0, [], [], []
                ids.append(doc), sizes.append(len(text)), parts.append(text)
                total += len(text)
        if ids:
            yield chunk()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNK_SCHEMA), "suffix-chunks")


def same_as_before(value: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of fingerprints, and which of them in that order repeat the one before."""
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    if (same & (extra[order][1:] != extra[order][:-1])).any():
        order = np.lexsort((extra, value))
        same = (value[order][1:] == value[order][:-1]) & (extra[order][1:] == extra[order][:-1])
    return order, np.concatenate([[False], same])[: len(order)]


def bounds(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    part = (slots >> np.uint64(32)).astype(np.int64)
    kinds, begins = np.unique(part, return_index=True)
    return kinds, np.append(begins, len(part))


class Keys:
    """The distinct keys among the items of a chunk, sorted. ``slots``: of a fingerprint, so
    many upper ``bits`` name its part; the next 32 are the key that is sent, the others the
    rest. ``of``: the key of each item; ``least``: the smallest document of each key; ``later``:
    items whose key a smaller document of the chunk has."""

    def __init__(self, value: np.ndarray, extra: np.ndarray, ids: np.ndarray, bits: int) -> None:
        order, same = same_as_before(value, extra)
        first = np.flatnonzero(~same)
        self.of = np.empty(len(value), np.int32)
        self.of[order] = np.cumsum(~same, dtype=np.int32) - 1
        value = value[order[first]]
        self.slots, self.extra = value >> np.uint64(32 - bits), extra[order[first]]
        self.rest = (value & np.uint64((1 << (32 - bits)) - 1)).astype(np.uint32)
        self.least = np.minimum.reduceat(ids[order], first) if len(first) else ids
        self.later = ids > self.least[self.of]


class Chunk:
    """The keys of one chunk, recomputed alike in every job."""

    def __init__(self, row: dict, prints: Prints, bits: int) -> None:
        self.prints, self.bits, self.id = prints, bits, row["chunk"]
        self.data, self.offsets, self.ids = unpacked(row)
        self.null = [i is None for i in row["ids"]]
        self.sums = self.prints.sums(self.data, 0)
        n = np.diff(self.offsets)
        self.doc_of = np.repeat(np.arange(len(n), dtype=np.int32), n)

    def names(self) -> None:
        """sampled: the sampled positions; slots: part and key of the distinct tuples, sorted;
        name: the slot of each sampled position."""
        width = LENGTH - PERIOD + 1
        found = []
        for begin, end in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            if end - begin >= LENGTH:
                found.append(begin + _sampled(end - begin - width + 1))
        self.sampled = np.concatenate(found) if found else np.zeros(0, np.int64)
        slot = self.prints.at(self.sums, self.sampled, width) >> np.uint64(32 - self.bits)
        order = np.argsort(slot)
        slot, doc = slot[order], self.doc_of[self.sampled[order]]
        new = np.concatenate([[True], slot[1:] != slot[:-1]])[: len(slot)]
        first = np.flatnonzero(new)
        self.slots, self.name = slot[first], np.empty(len(slot), np.int64)
        self.name[order] = np.cumsum(new) - 1
        # Whether two documents of this chunk have the tuple.
        self.again = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first) if len(first) else first > 0

    def _fingerprints(self, starts: np.ndarray, width: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = self.prints.at(self.second_sums, starts, width) >> np.uint64(32)
        return self.prints.at(self.sums, starts, width), extra.astype(np.uint32)

    def suffixes(self, flags: np.ndarray) -> None:
        """starts: the suffixes that a surviving name admits; segment: the segment of each;
        segments: their keys."""
        admitted = self.sampled[(flags | self.again)[self.name]]
        del self.name, self.sampled, self.slots, self.again
        first_of = self.offsets[:-1][self.doc_of[admitted]]
        edge = np.bincount(np.maximum(admitted - (PERIOD - 1), first_of), minlength=len(self.data) + 1)
        edge[admitted + 1] -= 1
        starts = np.flatnonzero(np.add.accumulate(edge, out=edge)[:-1] > 0)
        self.starts = starts = starts[starts + LENGTH <= self.offsets[1:][self.doc_of[starts]]]
        self.second_sums = self.prints.sums(self.data, 1)
        # The last start of a document is LENGTH before its end, so neighbours are of one document.
        head = np.concatenate([[True], starts[1:] != starts[:-1] + 1])[: len(starts)]
        head |= self.prints.at(self.sums, starts, LENGTH) & CUT == 0
        self.segment = np.cumsum(head, dtype=np.int32) - 1
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(starts)))
        value, extra = self._fingerprints(starts[begin], size + (LENGTH - 1))
        self.segments = Keys(value, extra, self.ids[self.doc_of[starts[begin]]], self.bits)

    def strings_left(self, flags: np.ndarray) -> None:
        """gone: the suffixes in segments that a smaller document holds; strings: the keys of
        the others, ``left``."""
        self.gone = (flags[self.segments.of] | self.segments.later)[self.segment]
        self.left = self.starts[~self.gone]
        value, extra = self._fingerprints(self.left, LENGTH)
        del self.sums, self.second_sums  # memory, by far the most of it
        self.strings = Keys(value, extra, self.ids[self.doc_of[self.left]], self.bits)
        del self.doc_of

    def name_rows(self) -> pa.RecordBatch:
        return self._rows(self.slots, None)

    def key_rows(self, keys: Keys) -> pa.RecordBatch:
        return self._rows(keys.slots, keys)

    def _rows(self, slots: np.ndarray, full: Keys | None) -> pa.RecordBatch:
        kinds, cut = bounds(slots)
        low = (slots & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        keys, rest, extra, docs, base = [], [], [], [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            keys.append(planes(np.diff(low[a:b], prepend=np.uint32(0))))
            if full:
                base.append(int(full.least[a:b].min()))
                rest.append(planes(full.rest[a:b]))
                extra.append(full.extra[a:b].tobytes())
                docs.append(planes((full.least[a:b] - base[-1]).astype(np.uint64)))
        empty = [None] * len(kinds)
        packed = [pa.array(c if full else empty, pa.binary()) for c in (rest, extra, docs)]
        arrays = [
            pa.array(kinds.astype(np.int32)), pa.array(np.full(len(kinds), self.id, np.int64)), pa.array(np.diff(cut).astype(np.int32)), pa.array(keys, pa.binary()),
            *packed, pa.array(base if full else empty, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "chunk", "n", "keys", "rest", "extra", "docs", "base"])

    def flags(self, slots: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
        kinds, cut = bounds(slots)
        found = [np.unpackbits(np.frombuffer(replies[int(k)], np.uint8), count=b - a) for k, a, b in zip(kinds, cut[:-1], cut[1:], strict=True)]
        return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)

    def result(self, earlier: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([self.starts[self.gone], self.left[earlier[self.strings.of] | self.strings.later]])
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[starts] += 1
        edge[starts + LENGTH] -= 1
        gone = np.cumsum(edge, out=edge)[:-1] > 0
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        first_byte = np.zeros(len(gone), bool)
        first_byte[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        removed = np.concatenate([[0], np.cumsum(gone, dtype=np.int32)])
        spans = np.concatenate([[0], np.cumsum(gone & (~before | first_byte), dtype=np.int32)])
        rows = []
        for k, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
            n = int(removed[b] - removed[a])
            kept = self.data[a:b] if not n else self.data[a:b][~gone[a:b]]
            doc = None if self.null[k] else int(self.ids[k])
            rows.append((doc, b - a, n, int(spans[b] - spans[a]), hashlib.sha256(kept.tobytes()).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[p.split()[0] for p in RESULT_SCHEMA.split(", ")])


def shared_names(table: pa.Table) -> list[bytes]:
    """Of the keys of one part, which ones more than one chunk has sent."""
    columns = zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True)
    keys = [np.cumsum(from_planes(k, np.uint32, n), dtype=np.uint32) for k, n in columns]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for own in keys:
        at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
        out.append(np.packbits(twice[at] == own if len(twice) else np.zeros(len(own), bool)).tobytes())
    return out


def earlier_strings(table: pa.Table) -> list[bytes]:
    """Of the keys of one part, which ones another chunk has in a smaller document."""
    value, extra, docs, sizes = [], [], [], []
    columns = [table.column(c).to_pylist() for c in ("keys", "rest", "extra", "docs", "base", "n")]
    for k, r, e, d, base, n in zip(*columns, strict=True):
        key = np.cumsum(from_planes(k, np.uint32, n), dtype=np.uint32).astype(np.uint64)
        value.append((key << np.uint64(32)) | from_planes(r, np.uint32, n))
        extra.append(np.frombuffer(e, np.uint32))
        docs.append(from_planes(d, np.uint64, n).astype(np.int64) + base)
        sizes.append(n)
    doc = np.concatenate(docs)
    order, same = same_as_before(np.concatenate(value), np.concatenate(extra))
    least = np.minimum.reduceat(doc[order], np.flatnonzero(~same))
    flags = np.empty(len(doc), bool)
    flags[order] = least[np.cumsum(~same) - 1] < doc[order]
    return [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]


def replies(keys: DataFrame, judge, label: str) -> DataFrame:
    def run(batches):
        for table in runs(batches, ["part"]):
            yield pa.RecordBatch.from_arrays(
                [table.column("chunk").combine_chunks(), table.column("part").combine_chunks(), pa.array(judge(table), pa.binary())],
                names=["chunk", "part", "flags"],
            )

    tasks = TASKS * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(tasks, "part").sortWithinPartitions("part", "chunk")
    return stored(dealt.mapInArrow(run, REPLY_SCHEMA), label)


def with_replies(chunks: DataFrame, answers: list[DataFrame], function, schema: str) -> DataFrame:
    """``function(row of a chunk, its replies to each question)`` for every chunk."""
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("ids", "array<long>"), ("sizes", "array<long>"), ("blob", "binary"))]
    rows = chunks.select("chunk", F.lit(len(answers)).alias("kind"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("flags"), "ids", "sizes", "blob")
    for kind, answer in enumerate(answers):
        rows = rows.unionByName(answer.select("chunk", F.lit(kind).alias("kind"), "part", "flags", *nothing))
    tasks = TASKS * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "part")
    asked = len(answers)

    def run(batches):
        for table in runs(batches, ["chunk"]):
            kind, part, flags = (table.column(c).to_pylist() for c in ("kind", "part", "flags"))
            own: list[dict] = [{} for _ in range(asked)]
            for k, p, f in zip(kind, part, flags, strict=True):
                if k < asked:
                    own[k][p] = f
            yield function(table.slice(len(kind) - 1).to_pylist()[0], own)

    return dealt.mapInArrow(run, schema)


def whole_copies(inner: DataFrame) -> DataFrame:
    """key and least id of the texts that several documents have."""
    same = inner.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    return stored(same.filter("n > 1 and least is not null").select("key", "least"), "suffix-copies")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key(F.col("text")))
    marked = join_small(inner, whole_copies(inner.filter(F.octet_length("text") >= LENGTH)), "key", "left")
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    size = F.octet_length("text").cast("long")
    nothing_left = marked.filter(copy).select(
        "doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"),
    )
    n_bytes = inner.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return _without_repeats(marked.filter(~copy), n_bytes).unionByName(nothing_left)


def _without_repeats(docs: DataFrame, n_bytes: int) -> DataFrame:
    # Small partitions are read together, as each makes a chunk of its own.
    chunks = chunked(docs.coalesce(max(1, -(-n_bytes // CHUNK))))
    bits = min(24, (max(LEAST_PARTS, n_bytes * len(COVER) // PERIOD // PART_KEYS) - 1).bit_length())
    prints = Prints()

    def name_keys(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = Chunk(batch.slice(k, 1).to_pylist()[0], prints, bits)
                chunk.names()
                yield chunk.name_rows()

    def admitted(row, answers):
        chunk = Chunk(row, prints, bits)
        chunk.names()
        chunk.suffixes(chunk.flags(chunk.slots, answers[0]))
        return chunk

    def left(row, answers):
        chunk = admitted(row, answers)
        chunk.strings_left(chunk.flags(chunk.segments.slots, answers[1]))
        return chunk

    def segment_keys(row, answers):
        chunk = admitted(row, answers)
        return chunk.key_rows(chunk.segments)

    def string_keys(row, answers):
        chunk = left(row, answers)
        return chunk.key_rows(chunk.strings)

    def last(row, answers):
        chunk = left(row, answers)
        return chunk.result(chunk.flags(chunk.strings.slots, answers[2]))

    names = replies(chunks.mapInArrow(name_keys, KEY_SCHEMA), shared_names, "suffix-names")
    segments = replies(with_replies(chunks, [names], segment_keys, KEY_SCHEMA), earlier_strings, "suffix-segments")
    strings = replies(with_replies(chunks, [names, segments], string_keys, KEY_SCHEMA), earlier_strings, "suffix-strings")
    return with_replies(chunks, [names, segments, strings], last, RESULT_SCHEMA)
