"""LM scoring by online logistic context mixing over binary decisions.

A text is its words, lower-cased A to Z, and an end mark. A word is a path of binary decisions
down a Huffman tree of the ``VOCABULARY`` most frequent training words (seen ``MIN_COUNT``
times or more, so that rare words teach the spelling), the end mark and an escape; an escaped
word is spelled in bytes, with a closing blank, by a Huffman tree of the bytes of those words. Three predictors see a
decision: its place in the tree alone, with the last one of the ``TELLING_WORDS`` most
frequent words that the text had, and with the last two words; in spelling, its place with the
last byte, three bytes and five bytes. The second and third use hashed slots of fixed tables. Each gives the
log odds of its counts. A mixer adds them by weights that a gate chooses by how much the two
contexts have been seen, and a map from mixed to observed probability refines the result. The
probabilities of a text's decisions multiply to the model's probability of the text.

Training, all as Spark jobs over all training documents: word counts by aggregation; texts written
as symbols once the vocabulary is known, for all jobs that follow; decision counts, a partial table
in each task, added up by blocks of slots in two rounds and turned into log odds there, so that the
driver holds three bytes a slot and no counts; mixer weights and refinement by Newton steps on a
tenth of the training documents whose counts are kept apart (remainder ``FIT`` of ten), so that
counts are never judged on their own documents.
Afterwards the tables of both parts are added. While a text is scored the mixer goes on
learning: after its tokens 4, 8, 16 and each further ``SEGMENT`` a text's own weights take the
sum of the gradients times ``RATE``, and its own shifts of the refined probability (by coarse
bucket) take the mean of what was missed, held back by ``HOLD`` decisions. A segment is always
scored before anything is learned from it. The predictors' counts stay as trained. A score
depends on its text and the model alone, not on the rows around it.

Counts of the frequent words and the tables have fixed sizes and are broadcast. Counts of all
other words stay distributed: their occurrences, of which no word has a large share, are
joined with the table of counts.

Defined cases: a null text is empty and has one token, its end; a null doc_id counts as an
empty text under the remainder rule (so it is held out); rows that repeat are scored each; without
training documents all counts are 0 and every decision has probability one half; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleskein.llm.common import Shared, row_batches, stored

HELD_OUT = 0
FIT = 9
VOCABULARY = 1 << 18
MIN_COUNT = 3
SLOTS = 1 << 21
SPELLING_SLOTS = 1 << 19
TELLING_WORDS = 64
BLOCK = 1 << 16
FLUSH_WORDS = 200_000
FLUSH_SHORT = 1_000_000
WORD_PIECE = 2_000_000
FLUSH_TOKENS = 500_000
SEGMENT = 32
RATE = 0.0005
HOLD = 100.0
COARSE = 7  # buckets of the map that a text's own shifts take together
ROUNDS = 3
BUCKETS = 161
REACH = 8.0
PRIOR = 0.4
SALTS = 16
INPUTS = 4
CONSTANT = np.float32(0.3)  # the last input
GATES = 32
PIECE = 400_000
SCORE_PIECE = 4_000_000
STRETCH = 4096  # tokens whose decisions are made at once outside the segments


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)).cast("int")


def tokens_of(text: bytes) -> list[bytes]:
    """Words by ASCII white space, A to Z lower-cased."""
    return text.lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary) and n over all training documents."""

    def run(batches):
        short, times, long = np.zeros(0, np.uint64), np.zeros(0, np.int64), Counter()
        for batch in row_batches(batches, WORD_PIECE):
            words, _ = words_of([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            keys, n = np.unique(words.eight(np.flatnonzero(words.size <= 8), 0), return_counts=True)
            short, times = added(np.concatenate([short, keys]), np.concatenate([times, n]))
            long.update(words.letters(np.flatnonzero(words.size > 8)).tobytes().split())
            if len(short) > FLUSH_SHORT:
                yield from rows_short(short, times)
                short, times = short[:0], times[:0]
            if len(long) > FLUSH_WORDS:
                yield rows(pa.array(list(long), pa.binary()), pa.array(list(long.values()), pa.int64()))
                long = Counter()
        yield from rows_short(short, times)
        yield rows(pa.array(list(long), pa.binary()), pa.array(list(long.values()), pa.int64()))

    def added(keys, times):
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.add.reduceat(times[order], first) if len(first) else times

    def rows_short(keys, times):
        for begin in range(0, len(keys), BLOCK):
            letters = keys[begin : begin + BLOCK].view(np.uint8).reshape(-1, 8)
            inside = letters != 32
            offsets = np.append(0, np.cumsum(inside.sum(1))).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(letters), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside])])
            yield rows(words, pa.array(times[begin : begin + BLOCK]))

    def rows(words, n):
        return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above the lowest count level at which at most ``most`` words remain."""
    level = F.floor(F.log(F.col("n").cast("double")) * 64).cast("int")
    total, cut = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["level"]):
        total += row["rows"]
        if total > most:
            break
        cut = row["level"]
    if cut is None:
        return []
    found = counts.filter((level >= cut) & (F.col("n") >= MIN_COUNT)).select("word", "n").toArrow()
    found = found.sort_by([("n", "descending"), ("word", "ascending")])
    return list(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k of eight bytes
_BLANKS = np.uint64(0x2020202020202020) & ~_FIRST
HASHED = 256  # bytes of a word that are hashed and compared eight at a time


@dataclass
class Words:
    """Words as arrays: their bytes one after the other, each with a closing blank, eight bytes more
    at the end; where each begins, and its size."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def eight(self, which: np.ndarray | slice, at: int) -> np.ndarray:
        """Bytes ``at`` to ``at`` + 8 of some words as numbers, blanks behind the end."""
        every = np.ndarray(len(self.data) - 7, np.uint64, self.data, strides=(1,))
        inside = np.clip(self.size[which] - at, 0, 8)
        return every[self.start[which] + at] & _FIRST[inside] | _BLANKS[inside]

    def keys(self) -> np.ndarray:
        """Words of up to eight bytes as numbers, as no word holds a blank; hashes of longer ones
        with a blank for the first byte, so that these never equal those."""
        keys, which = self.eight(slice(None), 0), np.flatnonzero(self.size > 8)
        value = keys[which]
        for at in range(8, HASHED, 8):
            more = np.flatnonzero(self.size[which] > at)
            if not len(more):
                break
            part = _mixed(value[more])
            part += self.eight(which[more], at)
            value[more] = part
        keys[which] = _mixed(value) & ~np.uint64(255) | np.uint64(32)
        return keys

    def same(self, which: np.ndarray, other: Words, others: np.ndarray) -> np.ndarray:
        """Whether some words equal those of ``other``, byte by byte."""
        equal = self.size[which] == other.size[others]
        left = np.flatnonzero(equal)
        for at in range(0, HASHED, 8):
            differ = self.eight(which[left], at) != other.eight(others[left], at)
            equal[left[differ]] = False
            left = left[~differ & (self.size[which[left]] > at + 8)]
            if not len(left):
                break
        for k in left.tolist():
            a, b, n = self.start[which[k]], other.start[others[k]], self.size[which[k]]
            equal[k] = bool((self.data[a : a + n] == other.data[b : b + n]).all())
        return equal

    def letters(self, which: np.ndarray) -> np.ndarray:
        """The bytes of some words, closing blanks included."""
        sizes = self.size[which] + 1
        return self.data[np.repeat(self.start[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value


def words_of(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of ``tokens_of`` of all texts, and how many each text has."""
    data = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER) + bytes(8), np.uint8) if texts else np.zeros(8, np.uint8)
    blanks = np.flatnonzero(data == 32)
    start = np.append(0, blanks + 1)[:-1]
    size = blanks - start
    real = size > 0
    ends = np.searchsorted(blanks, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1)
    return Words(data, start[real], size[real]), np.diff(np.cumsum(real)[ends], prepend=0)


@dataclass
class Lexicon:
    """Ids of words, looked up for many at once in an open hash table."""

    words: Words
    keys: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(words: list[bytes]) -> Lexicon:
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(w + b" " for w in words) + bytes(8), np.uint8)
        own = Words(data, np.cumsum(sizes + 1) - sizes - 1, sizes)
        out = Lexicon(own, own.keys(), np.full(1 << (4 * len(words) + 1).bit_length(), -1, np.int32))
        ids, slot = np.arange(len(words), dtype=np.int32), out.slots(out.keys)
        while len(ids):
            free = out.table[slot] < 0
            out.table[slot[free]] = ids[free]
            rest = out.table[slot] != ids
            ids, slot = ids[rest], (slot[rest] + 1) % len(out.table)
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys) >> np.uint64(65 - len(self.table).bit_length())).astype(np.intp)

    def find(self, words: Words) -> np.ndarray:
        """The id of each word, -1 for others."""
        found = np.full(len(words.size), -1, np.int32)
        if not len(self.keys):
            return found
        keys = words.keys()
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            ids = self.table[slot]
            same = (self.keys[ids] == keys) & (ids >= 0)
            long = np.flatnonzero(same & (words.size[left] > 8))
            same[long] = words.same(left[long], self.words, ids[long])
            found[left[same]] = ids[same]
            rest = np.flatnonzero(~same & (ids >= 0))
            left, keys, slot = left[rest], keys[rest], (slot[rest] + 1) % len(self.table)
        return found


@dataclass
class Codes:
    """words: ids of the words; counts by id; the decisions of symbol s (word ids, then end, then
    escape) are taken[start[s]:start[s + 1]], twice the node and the bit; letters: start and taken
    of the 256 bytes; homes: of the nodes of both trees (``homes_of``)."""

    words: Lexicon
    counts: np.ndarray
    start: np.ndarray
    taken: np.ndarray
    letters: tuple[np.ndarray, np.ndarray]
    homes: tuple[np.ndarray, np.ndarray]

    @property
    def node(self) -> np.ndarray:
        return self.taken >> 1

    @property
    def bit(self) -> np.ndarray:
        return (self.taken & 1).astype(np.uint8)

    @cached_property
    def routes(self) -> tuple[np.ndarray, np.ndarray]:
        """Twice the home, and the bit, of every decision in ``taken`` and in that of the letters."""
        return tuple(home[t >> 1] << np.uint32(1) | (t & 1).astype(np.uint32) for home, t in zip(self.homes, (self.taken, self.letters[1]), strict=True))

    @cached_property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Inner nodes below the root by depth, the deepest first, each with the decision that leads
        to it, as in ``taken``."""
        symbols, length, out = np.arange(len(self.start) - 1), np.diff(self.start), []
        for depth in range(1, int(length.max(initial=0))):
            symbols = symbols[length[symbols] > depth]
            at = self.start[symbols] + depth
            node, one = np.unique(self.taken[at] >> 1, return_index=True)
            out.append((node, self.taken[at[one] - 1]))
        return out[::-1]

    @property
    def end(self) -> int:
        return len(self.counts)

    @property
    def escape(self) -> int:
        return len(self.counts) + 1


def codes(words: list[tuple[bytes, int]], ends: int, rest: int) -> Codes:
    """Huffman paths; ``ends`` documents end, ``rest`` tokens are escaped. Bytes get theirs from the
    different words, with a floor that keeps the paths of rare ones short."""
    weights = np.array([n for _, n in words] + [max(1, ends), max(1, rest)], np.int64)
    spelled = np.bincount(np.frombuffer(b"".join(w + b" " for w, _ in words), np.uint8), minlength=256)
    known, letters = paths(weights), paths(spelled + spelled.sum() // 1024 + 1)
    return Codes(Lexicon.of([w for w, _ in words]), weights[: len(words)], *known, letters, (homes_of(*known), homes_of(*letters)))


def paths(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and taken of the Huffman tree of two leaves or more."""
    leaves = len(weights)
    order = np.argsort(weights, kind="stable")
    # Inner nodes are made in order of weight, so two queues take the place of a heap.
    parent, side, made = np.full(2 * leaves - 1, -1, np.int32), np.zeros(2 * leaves - 1, np.uint8), []
    queue, child_of, at, used = weights[order].tolist(), order.tolist(), 0, 0
    for new in range(leaves, 2 * leaves - 1):
        total = 0
        for turn in (0, 1):
            if used == len(made) or (at < leaves and queue[at] <= made[used]):
                weight, child, at = queue[at], child_of[at], at + 1
            else:
                weight, child, used = made[used], leaves + used, used + 1
            parent[child], side[child], total = new, turn, total + weight
        made.append(total)
    del queue, child_of, made
    length = np.zeros(2 * leaves - 1, np.int32)
    for child in range(2 * leaves - 3, -1, -1):
        length[child] = length[parent[child]] + 1
    start = np.concatenate([[0], np.cumsum(length[:leaves], dtype=np.int64)])
    taken = np.empty(start[-1], np.int32)
    now, place = np.arange(leaves), start[1:] - 1
    while len(now):  # one step up all paths
        taken[place] = 2 * (parent[now] - leaves) + side[now]
        now, place = parent[now], place - 1
        deeper = parent[now] >= 0
        now, place = now[deeper], place[deeper]
    return start, taken


def homes_of(start: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """16 times the node at which the four levels of each node begin, plus its place in them."""
    homes = np.zeros(len(start) - 2, np.uint32)
    symbols, length = np.arange(len(start) - 1), np.diff(start)
    for depth in range(int(length.max(initial=0))):
        symbols = symbols[length[symbols] > depth]
        now = taken[start[symbols] + depth] >> 1
        if depth % 4 == 0:
            homes[now] = 16 * now + 1
        else:
            before = taken[start[symbols] + depth - 1]
            above = homes[before >> 1]
            homes[now] = (above & ~np.uint32(15)) + 2 * (above & np.uint32(15)) + (before & 1).astype(np.uint32)
    return homes


def steps(start: np.ndarray, symbols: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many decisions each symbol takes, and where in ``taken`` they are, one by one."""
    if lengths is None:
        lengths = start[symbols + 1] - start[symbols]
    step = np.repeat(start[symbols] - (np.cumsum(lengths) - lengths), lengths)
    step += np.arange(len(step))
    return lengths, step


_ODD = np.uint32(0x9E3779B1)


def _context(*parts: np.ndarray) -> np.ndarray:
    """A hash of what is the same for all decisions of a token or letter."""
    value = np.full(len(parts[0]), 0x2545F491, np.uint32)
    for part in parts:
        value = (value ^ part.astype(np.uint32)) * _ODD
        value ^= value >> np.uint32(15)
    return value


def _slots(low: int, high: int, context: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Slots from ``low`` to ``high``, a multiple of 2^19 and at most 2^21 apart, for decisions with a
    context and a home (``homes_of``). In a context, nodes of the same four levels are 16 neighbours,
    a line of the processor's cache."""
    value = home >> np.uint32(4)
    value *= np.uint32(0x85EBCA77)
    value ^= context
    value *= _ODD
    value ^= value >> np.uint32(13)
    value *= np.uint32(0xC2B2AE3D)
    value >>= np.uint32(2)
    value *= np.uint32((high - low) >> 19)
    value >>= np.uint32(11)
    value ^= home & np.uint32(15)
    value += np.uint32(low)
    return value


@dataclass
class Stretch:
    """Decisions one by one, first ``words`` on words, then those of spelled words: where in ``taken``
    those on words are, the first predictor's slots of the others, the slots of the two other
    predictors, and the bit that was taken."""

    code: Codes
    words: int
    paths: np.ndarray
    spelt: np.ndarray
    hashed: list[np.ndarray]
    bit: np.ndarray


@dataclass
class Decisions:
    """Of a list of texts: first those on words, then those of spelled words.

    Tokens come by segment, then text, then place in it, and decisions in order of their tokens.
    They are made by stretches of tokens, whose arrays stay in the processor's cache.
    tokens: how many each text has; segment, owner, symbols: segment, text and symbol of each token;
    lengths: its decisions on its word; known: its contexts, the last telling symbol, the last symbol
    and the one before it. spelled: the tokens that are spelled, and how many decisions each takes
    (spelling); letter: the first letter of each, and the end; letters: their letters, closing
    blanks included, and the decisions of each (spans).
    """

    code: Codes
    tokens: np.ndarray
    segment: np.ndarray
    owner: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    known: list[np.ndarray]
    spelled: np.ndarray
    spelling: np.ndarray
    letter: np.ndarray
    letters: np.ndarray
    spans: np.ndarray

    def stretch(self, begin: int, end: int) -> Stretch:
        """The decisions of the tokens from ``begin`` up to ``end``."""
        code, lengths = self.code, self.lengths[begin:end]
        a, b = self.letter[np.searchsorted(self.spelled, (begin, end))]
        spans = self.spans[a:b]
        paths = steps(code.start, self.symbols[begin:end], lengths)[1]
        total = len(paths)
        every = total + int(spans.sum())
        bit, spelt = np.empty(every, np.uint8), np.empty(every - total, np.intp)
        hashed = [np.empty(every, np.intp) for _ in range(2)]
        home = code.routes[0].take(paths, mode="clip")  # clip checks no bounds first
        np.bitwise_and(home, 1, out=bit[:total], casting="unsafe")
        home >>= np.uint32(1)
        telling, last, last2 = (c[begin:end] for c in self.known)
        for k, context in enumerate((_context(telling), _context(last, last2))):
            hashed[k][:total] = _slots(SPELLING_SLOTS, SLOTS, np.repeat(context, lengths), home)
        if b > a:
            letters = self.letters[a:b]
            back, three, four = before(letters)
            step = steps(code.letters[0], letters, spans)[1]
            home = code.routes[1].take(step, mode="clip")
            np.bitwise_and(home, 1, out=bit[total:], casting="unsafe")
            home >>= np.uint32(1)
            np.right_shift(code.letters[1].take(step, mode="clip"), 1, out=spelt)
            spelt += np.repeat(back * np.uint32(256) + np.uint32(len(code.start)), spans)
            for k, context in enumerate((_context(three), _context(back, four))):
                hashed[k][total:] = _slots(0, SPELLING_SLOTS, np.repeat(context, spans), home)
        return Stretch(code, total, paths, spelt, hashed, bit)

    def stretches(self) -> Iterator[Stretch]:
        for begin in range(0, len(self.symbols), STRETCH):
            yield self.stretch(begin, min(begin + STRETCH, len(self.symbols)))

    @cached_property
    def _whole(self) -> Stretch:
        return self.stretch(0, len(self.symbols))

    @property
    def words(self) -> int:
        return self._whole.words

    @property
    def bit(self) -> np.ndarray:
        return self._whole.bit

    @property
    def slots(self) -> list[np.ndarray]:
        """Of each predictor."""
        return [np.concatenate([self.code.node[self._whole.paths], self._whole.spelt]), *self._whole.hashed]


@dataclass
class Encoded:
    """Texts as symbols: how many tokens each has, the symbols of all, and the letters of all spelled
    words, each with a closing blank."""

    tokens: np.ndarray
    symbols: np.ndarray
    letters: np.ndarray


def encoded(texts: list[bytes], code: Codes) -> Encoded:
    words, tokens = words_of(texts)
    found = code.words.find(words)
    unknown = np.flatnonzero(found < 0)
    found[unknown] = code.escape
    symbols, inside = np.full(len(found) + len(texts), code.end, np.int32), np.ones(len(found) + len(texts), bool)
    inside[np.cumsum(tokens + 1) - 1] = False
    symbols[inside] = found
    return Encoded(tokens + 1, symbols, words.letters(unknown))


def encoded_rows(docs: DataFrame, code: Shared) -> DataFrame:
    """``docs`` with symbols and letters of each text (``Encoded``) and its bytes in its place, so that
    a text is cut into words and looked up once for all jobs that follow."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in row_batches(batches, PIECE):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            e = encoded(texts, code.value)
            ends = np.cumsum(e.tokens)
            blanks = np.append(0, np.flatnonzero(e.letters == 32) + 1)  # the end of each word
            spelled = np.append(0, np.cumsum(e.symbols == code.value.escape))[np.append(0, ends)]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array([len(t) for t in texts], pa.int64()), binary(4 * np.append(0, ends), e.symbols), binary(blanks[spelled], e.letters)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_bytes", "symbols", "letters"])

    def binary(offsets, values):
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])

    schema = docs.select(*kept).schema.add("n_bytes", "long").add("symbols", "binary").add("letters", "binary")
    return docs.mapInArrow(run, schema)


def encoded_of(batch: pa.RecordBatch) -> Encoded:
    """The texts of some rows of ``encoded_rows``."""

    def values(name, kind):
        column = batch.column(name).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        inside = (data or b"")[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
        return np.diff(offsets), np.frombuffer(inside, kind)

    sizes, symbols = values("symbols", np.int32)
    return Encoded(sizes // 4, symbols, values("letters", np.uint8)[1])


def contexts(texts: Encoded, code: Codes) -> tuple:
    """Of each token in order: text, place in it, the last telling symbol, the last symbol and the
    one before it."""
    symbols, tokens, end = texts.symbols, texts.tokens, code.end
    first = (np.cumsum(tokens) - tokens).astype(np.int32)
    owner = np.repeat(np.arange(len(tokens), dtype=np.int32), tokens)
    begin = np.repeat(first, tokens)
    count = np.arange(len(symbols), dtype=np.int32)
    last, last2 = np.full(len(symbols), end, np.int32), np.full(len(symbols), end, np.int32)
    last[1:], last2[2:] = symbols[:-1], symbols[:-2]
    last[first], last2[first], last2[(first + 1)[tokens > 1]] = end, end, end
    telling = np.full(len(symbols), -1, np.int32)
    np.maximum.accumulate(np.where(symbols < TELLING_WORDS, count, np.int32(-1))[:-1], out=telling[1:])
    telling = np.where(telling >= begin, symbols[np.maximum(telling, 0)], np.int32(end))
    return owner, count - begin, telling, last, last2


def before(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each letter of words with closing blanks: the letter before it, the last three in one
    number and the four before the last in another; blanks before a word."""
    padded = np.full(len(letters) + 5, 32, np.uint32)
    padded[5:] = letters
    back, inside = [padded[4:-1]], padded[4:-1] != 32
    for k in (2, 3, 4, 5):  # no letter of a word lies behind a blank
        back.append(np.where(inside, padded[5 - k : -k], np.uint32(32)))
        inside = back[-1] != 32
    three = back[0] << np.uint32(8) | back[1]
    four = (back[1] << np.uint32(8) | back[2]) << np.uint32(16) | back[3] << np.uint32(8) | back[4]
    return back[0], three << np.uint32(8) | back[2], four


def decisions(texts: list[bytes] | Encoded, code: Codes) -> Decisions:
    texts = texts if isinstance(texts, Encoded) else encoded(texts, code)
    owner, place, *known = contexts(texts, code)
    segment = np.searchsorted([4, 8, 16], np.minimum(place, 16), "right").astype(np.int32) + place // SEGMENT
    # Numpy sorts 16 bits by radix, wider numbers by comparison.
    order = np.argsort(segment.astype(np.uint16) if segment.max(initial=0) < 2**16 else segment, kind="stable")
    symbols, owner, segment, *known = (c.take(order) for c in (texts.symbols, owner, segment, *known))
    spelled = np.flatnonzero(symbols == code.escape)
    # The letters of spelled words in this order
    begins = np.append(0, np.flatnonzero(texts.letters == 32) + 1)
    word = np.cumsum(texts.symbols == code.escape)[order[spelled]] - 1
    sizes = np.diff(begins)[word]
    letter = np.append(0, np.cumsum(sizes))
    letters = texts.letters[np.repeat(begins[word] - letter[:-1], sizes) + np.arange(letter[-1])]
    lengths, spans = np.diff(code.start)[symbols], np.diff(code.letters[0])[letters]
    spelling = np.add.reduceat(spans, letter[:-1]) if len(spelled) else spans
    return Decisions(code, texts.tokens, segment, owner, symbols, lengths, known, spelled, spelling, letter, letters, spans)


class Tally:
    """Counts of the decisions of a task. Equal tokens in equal contexts are counted together and
    followed through the tree once: of ``FLUSH_TOKENS`` tokens, or letters, at a time."""

    def __init__(self, code: Codes, sizes: list[int]) -> None:
        self.code, self.sizes, self.any = code, sizes, False
        self.symbols, self.pairs = np.zeros(len(code.start) - 1, np.int64), np.zeros(1 << 16, np.int64)
        self.hashed = np.zeros((2, 2 * SLOTS), np.int32)
        self.held: list[list[np.ndarray]] = [[], [], [], []]

    def add(self, texts: list[bytes] | Encoded) -> None:
        texts = texts if isinstance(texts, Encoded) else encoded(texts, self.code)
        self.any = True
        _, _, telling, last, last2 = contexts(texts, self.code)
        symbols, letters, many = texts.symbols, texts.letters, len(self.symbols)
        back, three, four = before(letters)
        self.symbols += np.bincount(symbols, minlength=many)
        self.pairs += np.bincount(back * np.uint32(256) + letters, minlength=1 << 16)
        # The symbol leads, so that equal paths are followed one after the other.
        bases = [(many, (symbols, telling)), (many, (symbols, last, last2)), (1 << 24, (letters, three)), (1 << 32, (letters.astype(np.int64) << 8 | back, four))]
        for k, (base, parts) in enumerate(bases):
            key = parts[0].astype(np.int64)
            for part in parts[1:]:
                key *= base
                key += part
            self.held[k].append(key)
            if sum(map(len, self.held[k])) > FLUSH_TOKENS:
                self.flush(k)

    def flush(self, k: int) -> None:
        """Kinds 0 and 1 are words in their two contexts, 2 and 3 letters in theirs."""
        keys, times = np.unique(np.concatenate(self.held[k]), return_counts=True) if self.held[k] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.held[k], times, many = [], times.astype(np.int32), len(self.symbols)
        start, routes = (self.code.start, self.code.letters[0])[k // 2], self.code.routes[k // 2]
        low, high = (SPELLING_SLOTS, SLOTS) if k < 2 else (0, SPELLING_SLOTS)
        for begin in range(0, len(keys), STRETCH):
            own = keys[begin : begin + STRETCH]
            base = (many, many * many, 1 << 24, 1 << 40)[k]
            symbols = own // base
            own = own - symbols * base
            parts = {0: [own], 1: [own // many, own % many], 2: [own], 3: [own >> 32, own & 0xFFFFFFFF]}[k]
            lengths, step = steps(start, symbols)
            route = routes.take(step, mode="clip")
            slots = _slots(low, high, np.repeat(_context(*parts), lengths), route >> np.uint32(1)) << np.uint32(1)
            slots |= route & np.uint32(1)
            np.add.at(self.hashed[k & 1], slots.astype(np.intp), np.repeat(times[begin : begin + STRETCH], lengths))

    def tables(self) -> list[np.ndarray]:
        """Counts of both bits of every slot of each predictor."""
        for k in range(4):
            self.flush(k)
        return [place_counts(self.code, self.symbols, self.pairs, self.sizes[0]), *(own.reshape(-1, 2) for own in self.hashed)]


def table_sizes(code: Codes) -> list[int]:
    return [-(-(len(code.start) + 65536) // BLOCK) * BLOCK, SLOTS, SLOTS]


def count_tables(rows: DataFrame, code: Shared, sizes: list[int]) -> DataFrame:
    """Of encoded rows: block, and what the model holds of its slots (``packed_odds``): from the counts without the
    documents kept for the fit (fit), and from all (whole)."""

    def partial(batches):
        c, begins = code.value, np.cumsum([0, *sizes])
        tallies = [Tally(c, sizes), Tally(c, sizes)]
        for batch in row_batches(batches, PIECE):
            apart = pc.equal(batch.column("remainder"), FIT)
            for part, own in ((0, batch.filter(pc.invert(apart))), (1, batch.filter(apart))):
                if own.num_rows:
                    tallies[part].add(encoded_of(own))
        task = TaskContext.get().partitionId()
        for part in (0, 1):
            if tallies[part].any:
                for table, begin in zip(tallies[part].tables(), begins, strict=False):
                    for at in range(0, len(table), BLOCK):
                        yield packed(part, (begin + at) // BLOCK, task % SALTS, table[at : at + BLOCK].T)

    def packed(part, block, salt, values):
        wide = 2 if values.max() < 1 << 16 else 4 if values.max() < 1 << 32 else 8  # bytes a count
        data = np.ascontiguousarray(values.astype(f"u{wide}")).view(np.uint8).reshape(-1, wide).T.tobytes()
        data = bytes([wide]) + pa.compress(data, "zstd", asbytes=True)
        arrays = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([data])]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "salt", "counts"])

    def unpacked(data):
        wide = data[0]
        planes = np.frombuffer(pa.decompress(memoryview(data)[1:], 2 * wide * BLOCK, "zstd"), np.uint8).reshape(wide, -1)
        return np.ascontiguousarray(planes.T).view(f"u{wide}").astype(np.int64).reshape(2, BLOCK)

    def sums(batches):
        held, total = None, None
        for batch in batches:
            for part, block, salt, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "salt", "counts")), strict=True):
                if held != (part, block, salt):
                    if held:
                        yield held, total
                    held, total = (part, block, salt), np.zeros((2, BLOCK), np.int64)
                total = total + unpacked(data)
        if held:
            yield held, total

    def added(batches):
        for held, total in sums(batches):
            yield packed(*held, total)

    def finished(batches):
        held, fit, whole = None, None, None
        for (part, block, _), total in sums(batches):
            if held != block:
                if held is not None:
                    yield row(held, fit, whole)
                held, fit, whole = block, np.zeros((2, BLOCK), np.int64), np.zeros((2, BLOCK), np.int64)
            whole += total
            if part == 0:
                fit += total
        if held is not None:
            yield row(held, fit, whole)

    def row(block, fit, whole):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed_odds(fit)]), pa.array([packed_odds(whole)])], names=["block", "fit", "whole"])

    schema = "part int, block int, salt int, counts binary"
    rows = rows.mapInArrow(partial, schema)
    keys = ["part", "block", "salt"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added, schema)
    rows = rows.withColumn("salt", F.lit(0)).repartition("block").sortWithinPartitions("block", "part").mapInArrow(finished, "block int, fit binary, whole binary")
    return stored(rows, "lm-counts")


def place_counts(code: Codes, symbols: np.ndarray, pairs: np.ndarray, size: int) -> np.ndarray:
    """Counts of both bits of the first predictor's slots, from those of symbols and of letters
    behind each letter: its slots are the places themselves."""
    seen = np.flatnonzero(pairs)
    lengths, step = steps(code.letters[0], seen & 255)
    place = len(code.start) + np.repeat(seen >> 8 << 8, lengths)
    out = np.bincount(2 * place + code.letters[1][step], np.repeat(pairs[seen], lengths), 2 * size).astype(np.int64)
    out[code.taken[code.start[1:] - 1]] = symbols
    for node, decision in code.levels:  # as often as one of both was taken below
        out[decision] = out[2 * node] + out[2 * node + 1]
    return out.reshape(-1, 2)


@dataclass
class Model:
    """Log odds and confidence of every slot, mixer weights by gate, the refining map."""

    odds: list[np.ndarray]
    seen: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    @cached_property
    def places(self) -> np.ndarray:
        """Log odds of the first predictor in 32 bits."""
        return self.odds[0].astype(np.float32)

    def along(self, code: Codes) -> np.ndarray:
        """The same in the order of the decisions in ``taken``, kept for one code."""
        kept = self.__dict__.get("_along")
        if kept is None or kept[0] is not code:
            kept = self._along = code, self.places[code.node]
        return kept[1]

    @cached_property
    def packed(self) -> list[np.ndarray]:
        """Log odds of the others in 32 bits, with their parts of the gate in the lowest four, which
        they leave empty."""
        return [o.astype(np.float32).view(np.uint32) | s << k for o, s, k in zip(self.odds[1:], self.seen[1:], (2, 0), strict=True)]


def odds_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds, and how much was seen, of slots from their counts of both bits."""
    zero, one = counts
    return np.log((one + PRIOR) / (zero + PRIOR)).astype(np.float16), np.searchsorted([0.5, 2.5, 12.5], zero + one).astype(np.uint8)


def packed_odds(counts: np.ndarray) -> bytes:
    odds, seen = odds_of(counts)
    return odds.tobytes() + seen.tobytes()


def new_model(odds: np.ndarray, seen: np.ndarray, sizes: list[int]) -> Model:
    cut = np.cumsum(sizes)[:-1]
    identity = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, BUCKETS)))
    return Model(np.split(odds, cut), np.split(seen, cut), np.tile([0.3, 0.4, 0.3, 0.0], (GATES, 1)), np.tile(identity, (2, 1)))


def model_of(tables: np.ndarray, sizes: list[int]) -> Model:
    return new_model(*odds_of(tables), sizes)


def models_of(blocks: DataFrame, sizes: list[int]) -> list[Model]:
    """The models of both columns of ``count_tables``; the driver holds no counts."""
    odds, seen = np.zeros((2, sum(sizes)), np.float16), np.zeros((2, sum(sizes)), np.uint8)
    for row in blocks.toLocalIterator():
        at = row["block"] * BLOCK
        for k, data in enumerate((row["fit"], row["whole"])):
            odds[k, at : at + BLOCK] = np.frombuffer(data, np.float16, BLOCK)
            seen[k, at : at + BLOCK] = np.frombuffer(data, np.uint8, BLOCK, 2 * BLOCK)
    return [new_model(odds[k], seen[k], sizes) for k in (0, 1)]


def inputs(model: Model, d: Stretch | Decisions) -> tuple[np.ndarray, np.ndarray]:
    """The predictors' log odds with a constant, and the gate, of every decision."""
    d = d._whole if isinstance(d, Decisions) else d
    x = np.empty((INPUTS, len(d.bit)), np.float32)
    model.along(d.code).take(d.paths, out=x[0, : d.words], mode="clip")
    model.places.take(d.spelt, out=x[0, d.words :], mode="clip")
    x[3] = CONSTANT
    one, two = (model.packed[k].take(d.hashed[k], mode="clip") for k in (0, 1))
    gate = (one | two).astype(np.uint8) & np.uint8(15)
    for k, own in ((1, one), (2, two)):
        np.bitwise_and(own, ~np.uint32(15), out=x[k].view(np.uint32))
    gate[d.words :] += np.uint8(16)
    return x, gate


def squash(t: np.ndarray) -> np.ndarray:
    p = np.clip(t, -REACH, REACH)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


def bucket(t: np.ndarray, words: int) -> np.ndarray:
    """The nearest bucket of each mixed log odds; those of spelling come behind those of words."""
    near = np.clip(t, -REACH, REACH)
    near *= np.float32((BUCKETS - 1) / (2 * REACH))
    near += np.float32(BUCKETS / 2)
    at = near.astype(np.intp)
    at[words:] += BUCKETS
    return at


def _per_task_sums(rows: DataFrame, code: Shared, model: Shared, weights: np.ndarray, function, size: int) -> np.ndarray:
    """``size`` sums of ``function`` over the decisions of all texts, added up by Spark. The model
    has these ``weights`` now; its tables are sent once."""

    def run(batches):
        total, now = np.zeros(size), replace(model.value, weights=weights)
        for batch in row_batches(batches, PIECE):
            total += function(now, decisions(encoded_of(batch), code.value))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["k", "v"])

    out = np.zeros(size)
    for row in rows.select("symbols", "letters").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[row["k"]] = row["v"]
    return out


def mixed_odds(model: Model, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    w, at = np.ascontiguousarray(model.weights.T, np.float32), gate.astype(np.intp)
    total = (w[3] * CONSTANT).take(at, mode="clip")
    for k in range(INPUTS - 1):
        own = w[k].take(at, mode="clip")
        own *= x[k]
        total += own
    return total


def newton_sums(model: Model, d: Decisions) -> np.ndarray:
    """Gradient and curvature of the log loss by gate."""
    slopes, bends = np.zeros((INPUTS, GATES)), np.zeros((INPUTS, INPUTS, GATES))
    for stretch in d.stretches():
        x, gate = inputs(model, stretch)
        order = np.argsort(gate, kind="stable")
        cut = np.cumsum(np.bincount(gate, minlength=GATES)).tolist()
        p = squash(mixed_odds(model, x, gate))
        for k in range(INPUTS - 1):
            x[k] = x[k].take(order)
        wrong, bend = (stretch.bit - p).take(order), (p * (1 - p)).take(order)
        bent = x * bend
        for g, (begin, end) in enumerate(zip([0, *cut], cut, strict=False)):
            if end > begin:
                own = x[:, begin:end]
                slopes[:, g] += own @ wrong[begin:end]
                bends[:, :, g] += bent[:, begin:end] @ own.T
    return np.concatenate([slopes.ravel(), bends.ravel()])


def refine_sums(model: Model, d: Decisions) -> np.ndarray:
    out = np.zeros((2, 2 * BUCKETS))
    for stretch in d.stretches():
        at = bucket(mixed_odds(model, *inputs(model, stretch)), stretch.words)
        out += np.bincount(at, minlength=2 * BUCKETS), np.bincount(at, stretch.bit, 2 * BUCKETS)
    return out.ravel()


def fitted(model: Model, rows: DataFrame, code: Shared) -> Model:
    shared = Shared(rows.sparkSession, model)
    for _ in range(ROUNDS):
        sums = _per_task_sums(rows, code, shared, model.weights, newton_sums, GATES * (INPUTS + INPUTS**2))
        slope = sums[: INPUTS * GATES].reshape(INPUTS, GATES).T
        bend = sums[INPUTS * GATES :].reshape(INPUTS, INPUTS, GATES).transpose(2, 0, 1)
        # A pull to the start where a gate has seen little; rounded, as sums come in any order.
        step = np.linalg.solve(bend + 5 * np.eye(INPUTS), slope[:, :, None])[:, :, 0]
        model.weights = np.round(model.weights + np.clip(step, -1, 1), 7)
    sums = _per_task_sums(rows, code, shared, model.weights, refine_sums, 4 * BUCKETS)
    shared.drop()
    n, ones = sums[: 2 * BUCKETS].reshape(2, -1), sums[2 * BUCKETS :].reshape(2, -1)
    model.refined = (ones + 20 * model.refined) / (n + 20)
    return model


def runs(segment: np.ndarray, owner: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's tokens in a segment begin, its text and its number of decisions."""
    first = np.flatnonzero((np.diff(segment, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    return first, owner[first], np.add.reduceat(lengths, first) if len(first) else lengths


def by_segment(model: Model, d: Decisions, made: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The probability of a 1 in every decision, a text's weights and map learning from segment
    to segment of the text: for some texts of a segment at a time, texts, how many decisions each has
    on end, their probabilities and their bits. ``made`` gives how many decisions are on words, the
    inputs, mixed log odds and bits of tokens from one up to another."""
    half = BUCKETS // COARSE
    n, wide = len(d.tokens), 2 * half
    own = np.zeros((n, INPUTS), np.float32)
    missed, seen = np.zeros((n, wide), np.float32), np.zeros((n, wide), np.float32)
    flat = model.refined.astype(np.float32).ravel()
    coarse = np.arange(2 * BUCKETS) // COARSE
    words = runs(d.segment, d.owner, d.lengths)
    spelled = runs(d.segment[d.spelled], d.owner[d.spelled], d.spelling)
    # Groups of texts, so that the arrays of a step stay in the processor's cache.
    of = d.segment[words[0]]
    inside = words[0] - words[0][np.searchsorted(of, of)]
    cut = np.append(np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(inside // STRETCH, prepend=0) != 0)), len(of))
    tokens = np.append(words[0], len(d.symbols))[cut].tolist()
    spelled_cut = np.searchsorted(d.spelled[spelled[0]], tokens).tolist()
    of, final = of[cut[:-1]].tolist(), int(d.segment.max(initial=-1))
    for k, segment in enumerate(of):
        # A text's decisions on words lie together, and so do those in its spelled words.
        here = slice(cut[k], cut[k + 1])
        names, sizes = words[1][here], words[2][here]
        text = np.arange(len(names))
        more = np.zeros(0, np.intp)
        if spelled_cut[k + 1] > spelled_cut[k]:
            here = slice(spelled_cut[k], spelled_cut[k + 1])
            more = np.searchsorted(names, spelled[1][here])
            text, sizes = np.concatenate([text, more]), np.concatenate([sizes, spelled[2][here]])
        known, x, t, bit = made(tokens[k], tokens[k + 1])
        if segment:
            weights = own[names[text]].T
            t += np.repeat(weights[3] * CONSTANT, sizes)
            for i in range(INPUTS - 1):
                change = np.repeat(weights[i], sizes)
                change *= x[i]
                t += change
        mixed = squash(t)
        at = bucket(t, known)
        refined = flat.take(at, mode="clip")
        refined += mixed
        refined *= np.float32(0.5)
        # Places of these texts alone, so that a step costs what it holds.
        at = coarse.take(at, mode="clip")
        at += np.repeat(text * wide, sizes)
        value = refined
        if segment:
            value = (missed[names] / (seen[names] + np.float32(HOLD))).ravel().take(at, mode="clip")
            value += refined
        yield names[text], sizes, np.clip(value, 1e-4, 1 - 1e-4), bit
        if segment < final:
            wrong, first = bit - mixed, np.cumsum(sizes) - sizes
            slopes = [np.add.reduceat(wrong * x[i], first) for i in range(INPUTS - 1)]
            slopes = np.stack([*slopes, CONSTANT * np.add.reduceat(wrong, first)], axis=1) * np.float32(RATE)
            own[names] += slopes[: len(names)]
            own[names[more]] += slopes[len(names) :]
            if len(at) < 1 << 19:  # then both sums come out of one, with room between them
                both = np.subtract(bit, refined, dtype=np.float64)
                both += 1 << 20
                both = np.bincount(at, both, len(names) * wide).reshape(-1, wide)
                times = np.rint(both / (1 << 20))
                both -= times * (1 << 20)
            else:
                both, times = (np.bincount(at, w, len(names) * wide).reshape(-1, wide) for w in (bit - refined, None))
            missed[names] += both
            seen[names] += times


def learned(model: Model, d: Decisions, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The probability of a 1 in every decision, from inputs and mixed log odds of all of them."""
    ends, letter_ends = np.append(0, np.cumsum(d.lengths)), d.words + np.append(0, np.cumsum(d.spelling))
    places = []

    def made(begin, end):
        a, b = letter_ends[np.searchsorted(d.spelled, (begin, end))]
        places.append(np.concatenate([np.arange(ends[begin], ends[end]), np.arange(a, b)]))
        return ends[end] - ends[begin], x[:, places[-1]], t[places[-1]], d.bit[places[-1]].astype(np.float32)

    p = np.empty(len(t), np.float32)
    for k, (_, _, value, _) in enumerate(by_segment(model, d, made)):
        p[places[k]] = value
    return p


def log_scores(model: Model, d: Decisions) -> np.ndarray:
    """log10 of each text's probability."""

    def made(begin, end):
        stretch = d.stretch(begin, end)
        x, gate = inputs(model, stretch)
        return stretch.words, x, mixed_odds(model, x, gate), stretch.bit.astype(np.float32)

    scores = np.zeros(len(d.tokens))
    for text, sizes, p, bit in by_segment(model, d, made):
        p += bit
        p -= 1
        log = np.log(np.abs(p, out=p), out=p)
        scores += np.bincount(text, np.add.reduceat(log, np.cumsum(sizes) - sizes, dtype=np.float64), len(scores))
    return scores / np.log(10)


@dataclass
class Trained:
    code: Codes
    shared: Shared
    model: Model
    counts: DataFrame
    rows: DataFrame
    n_tokens: int
    n_distinct: int
    n_ends: int


def train(docs: DataFrame) -> Trained:
    """The model of the documents (remainder, text) that are not held out; and all of them encoded."""
    own = docs.filter(F.col("remainder") != HELD_OUT)
    counts = stored(word_counts(own), "lm-words")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    ends = own.count()
    words = frequent(counts, VOCABULARY)
    code = codes(words, ends, (total or 0) - sum(n for _, n in words))
    del words
    shared, sizes = Shared(docs.sparkSession, code), table_sizes(code)
    rows = stored(encoded_rows(docs, shared), "lm-encoded")
    fit, whole = models_of(count_tables(rows.filter(F.col("remainder") != HELD_OUT), shared, sizes), sizes)
    fit = fitted(fit, stored(rows.filter(F.col("remainder") == FIT), "lm-fit"), shared)
    whole.weights, whole.refined = fit.weights, fit.refined
    return Trained(code, shared, whole, counts, rows, (total or 0) + ends, distinct + (ends > 0), ends)


SCORE_SCHEMA = (
    "row long, doc_id long, remainder int, n_tokens long, n_known long, base double, score double, n_bytes long, word binary, times long"
)


def scored(trained: Trained) -> DataFrame:
    """A row for each document, and one for each of its different words outside the vocabulary."""
    code, model = trained.shared, Shared(trained.rows.sparkSession, trained.model)
    total = trained.n_tokens + 0.1 * (trained.n_distinct + 1)
    ends = trained.n_ends

    def run(batches):
        task, row = TaskContext.get().partitionId() << 40, 0
        c = code.value
        known = np.concatenate([c.counts, [ends, 0]])
        base = np.log10((known + 0.1) / total)
        base[c.escape] = 0
        for batch in row_batches(batches, SCORE_PIECE):
            n = batch.num_rows
            d = decisions(encoded_of(batch), c)
            owner = d.owner
            rows = np.arange(task + row, task + row + n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows), batch.column("doc_id"), batch.column("remainder"), pa.array(d.tokens),
                    pa.array(np.bincount(owner, known[d.symbols] > 0, n).astype(np.int64)), pa.array(np.bincount(owner, base[d.symbols], n)),
                    pa.array(log_scores(model.value, d)), batch.column("n_bytes"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                ],
                names=names,
            )
            rest = [Counter(letters.split()) for letters in batch.column("letters").to_pylist()]
            k = sum(map(len, rest))
            if k:
                empty = [pa.nulls(k, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rows, list(map(len, rest)))), *empty, pa.array(list(chain.from_iterable(rest)), pa.binary()), pa.array([t for own in rest for t in own.values()], pa.int64())],
                    names=names,
                )
            row += n

    names = [part.split()[0] for part in SCORE_SCHEMA.split(", ")]
    return stored(trained.rows.mapInArrow(run, SCORE_SCHEMA), "lm-scored")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), remainder(F.col("doc_id")).alias("remainder"), "text")
    trained = train(inner)
    rows = scored(trained)
    total = F.lit(float(trained.n_tokens + 0.1 * (trained.n_distinct + 1)))
    rest = rows.filter("word is not null").select("row", "word", "times").join(trained.counts, "word", "left")
    count = F.coalesce("n", F.lit(0).cast("long"))
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((count + 0.1) / total)).alias("rest"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rest_known")
    )
    return (
        rows.filter("word is null")
        .join(rest, "row", "left")
        .select(
            "doc_id",
            (F.col("remainder") == HELD_OUT).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("rest_known", F.lit(0).cast("long"))).alias("n_known"),
            F.lit(trained.n_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
            "score",
            F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )
