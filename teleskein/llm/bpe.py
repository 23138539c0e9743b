"""Byte-level BPE: text to token ids and back, for a vocabulary file of a public tokenizer.

Encoding: the strings of added tokens are cut out first; the rest is split by the pre-token
pattern; each piece's bytes become a doubly linked list of symbols with a priority queue of
(merge rank, position). The lowest entry is merged; entries whose symbols have changed since
are stale and skipped; the two new neighbours enter the queue. O(n log n) for a piece of n
bytes, so a text of one huge word is no special case. Ids of frequent pieces are remembered per
worker in two tables of bounded size. Decoding joins the byte strings of the vocabulary and reads
the whole as UTF-8, with the replacement character where ids do not form any.

Each row is encoded where it lies; nothing is shuffled. The vocabulary, of fixed size, is read
once on the driver and broadcast.

Defined cases: null and empty texts give no ids, null ids give null text; repeated rows are
encoded each; further columns are kept by the pipeline and not read by the query.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleskein.llm.common import Shared, row_batches

# Fixed value: the pattern that splits a text into pieces before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 200_000
CACHE_LENGTH = 40
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where
    it is printable, else the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Vocabulary:
    """Merges and byte strings of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, letters = spec["model"]["vocab"], byte_letters()
        self.base = [ids[letters[b]] for b in range(256)]
        # By left symbol: the right symbol's merge rank, shifted to leave room for a place.
        self.merges: dict[int, dict[int, int]] = {}
        self.made = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[left], {})[ids[right]] = rank << PLACE_BITS
            self.made.append(ids[left + right])
        back = {letter: b for b, letter in letters.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max(*ids.values(), *self.added.values()))
        for token, i in ids.items():
            self.bytes[i] = bytes(back[x] for x in token)
        for content, i in self.added.items():
            self.bytes[i] = content.encode()


class _Pieces(dict):
    """Ids by piece; a missing one is merged and remembered. A full table becomes the older
    one, from which pieces that come again return, so frequent ones stay."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.codec.merge(piece.encode("utf-8"))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.pieces = vocabulary, _Pieces(self)
        self.ranks = [vocabulary.merges.get(i, {}).get for i in range(len(vocabulary.bytes))]
        self.find = regex.compile(PATTERN).findall
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.split = regex.compile(f"({'|'.join(map(regex.escape, added))})").split if added else lambda text: [text]

    def __reduce__(self):
        return Codec, (self.vocabulary,)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Queue entries are one integer each: the merge's rank above the place of its left symbol."""
        ranks, made = self.ranks, self.vocabulary.made
        symbols = [self.vocabulary.base[b] for b in piece]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [rank + i for i, (x, y) in enumerate(pairwise(symbols)) if (rank := ranks[x](y)) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & PLACE
            j = after[i]
            if symbols[i] < 0 or j >= n or ranks[symbols[i]](symbols[j]) != entry - i:
                continue
            symbols[i] = new = made[entry >> PLACE_BITS]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks[new](symbols[k])) is not None:
                    heappush(queue, rank + i)
            h = before[i]
            if h >= 0 and (rank := ranks[symbols[h]](new)) is not None:
                heappush(queue, rank + h)
        return tuple([s for s in symbols if s >= 0])

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                ids.append(self.vocabulary.added[part])
            elif part:
                ids.extend(chain.from_iterable(map(self.pieces.__getitem__, self.find(part))))
        return ids

    def decode(self, ids) -> str:
        strings = self.vocabulary.bytes
        return b"".join(map(strings.__getitem__, ids)).decode("utf-8", "replace")


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, offsets[-1])))


def encoded(df: DataFrame, vocabulary_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with its column ``text`` replaced by ``out``, the token ids (array<int>)."""
    shared = Shared(df.sparkSession, Codec(Vocabulary(vocabulary_path)))
    schema, at = df.select(*[F.col(c) if c != text else F.lit(None).cast("array<int>").alias(out) for c in df.columns]).schema, df.columns.index(text)

    def run(batches):
        codec = shared.value
        for batch in row_batches(batches):
            lists = _lists([codec.encode(t or "") for t in batch.column(at).to_pylist()])
            columns = [*batch.columns[:at], lists, *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a further column ``out``, the text of its token ids."""
    shared = Shared(df.sparkSession, Codec(Vocabulary(vocabulary_path)))
    schema, at = df.withColumn(out, F.lit(None).cast("string")).schema, df.columns.index(ids)

    def run(batches):
        codec = shared.value
        for batch in row_batches(batches):
            lists = batch.column(at)
            texts = [None if row is None else codec.decode(row) for row in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``text`` replaced by ``ids`` and a further column ``out``, the text that these
    ids decode to: ``encoded`` and ``decoded`` in one pass over the rows."""
    shared = Shared(df.sparkSession, Codec(Vocabulary(vocabulary_path)))
    at = df.columns.index(text)
    kept = [F.col(c) if c != text else F.lit(None).cast("array<int>").alias(ids) for c in df.columns]
    schema = df.select(*kept, F.lit(None).cast("string").alias(out)).schema

    def run(batches):
        codec = shared.value
        for batch in row_batches(batches):
            rows = [codec.encode(t or "") for t in batch.column(at).to_pylist()]
            texts = pa.array([codec.decode(row) for row in rows], pa.string())
            columns = [*batch.columns[:at], _lists(rows), *batch.columns[at + 1 :], texts]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text for every document."""
    coded = round_trip(docs.select("doc_id", "text"), vocabulary_path)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
