"""Conversation structure repair: the cheapest edits that give role initials ``(s?(ua)+)?``.

A row becomes a letter for its role initial and its fault. Letters have a min-plus transfer
matrix: entry (i, j) is the least (cost, audit) of all edits of that row, inserted rows before
it included, which lead the grammar's automaton from state i to state j. Matrices multiply, so
Re-Pair rules get a matrix each, once, from those of their two symbols, and a conversation is
the product over the few symbols that its letters compress to. Rules are counted over the
distinct letter sequences of all conversations by Spark jobs, broadcast (at most ``ROUNDS`` x
``PER_ROUND`` of them; which rules there are never changes a result), and shared.

Audits are ropes: parts of rules are referred to, not copied. Two audits of one stretch that
cost the same never continue one another (the longer one would hold further paid inserts), so
taking the least audit of each part gives the least of the whole.

Scale: equal rows of a conversation are counted before any shuffle of single rows, and a
conversation's letters are cut into segments by a range sort, so a long conversation is spread
over tasks for all but two things that its result forces into one row and one pass: its audit,
and the digest of its repaired text, both streamed.

Defined cases: a null role, text, id or turn counts as one space in damage and digests; rows
of a null conv_id are one conversation; rows of one turn are ordered by role, then by the
SHA-256 of the text. Initials other than s, u and a (an empty role too) cannot be kept.
Repeated rows are rows of one turn. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleskein.llm.common import Shared, stored

SEGMENT = 1024
ROUNDS = 8
PER_ROUND = 24
LEAF = 64
MEMO = 50_000

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
# States of the automaton: nothing yet, after s, after u, after a. The first and last accept.
STATES, ACCEPTING = 4, (0, 3)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# Letters: initial (s, u, a, other) times fault (none, truncated, blank, duplicate).
INITIALS = "sua"
WHOLE, CUT, BLANK, DUPLICATE = range(4)
# For the repair all blank and duplicate rows are one symbol, D; others are a to h.
_TO_SYMBOL = str.maketrans({chr(65 + 4 * i + f): "D" if f >= BLANK else chr(97 + 2 * i + f) for i in range(4) for f in range(4)})
FIRST_RULE = 0x100


def letter(initial: str, fault: int) -> str:
    return chr(65 + 4 * (INITIALS.find(initial) % 4 if initial else 3) + fault)


# --- ropes and matrices ---


class Rope:
    __slots__ = ("left", "right", "size")

    def __init__(self, left: Rope | str, right: Rope | str) -> None:
        self.left, self.right, self.size = left, right, length(left) + length(right)


def length(rope: Rope | str) -> int:
    return len(rope) if isinstance(rope, str) else rope.size


def joined(a: Rope | str, b: Rope | str) -> Rope | str:
    if not length(a):
        return b
    if not length(b):
        return a
    if length(a) + length(b) <= LEAF and isinstance(a, str) and isinstance(b, str):
        return a + b
    return Rope(a, b)


def flat(rope: Rope | str) -> str:
    out, todo = [], [rope]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        else:
            todo += (node.right, node.left)
    return "".join(out)


def less(a: Rope | str, b: Rope | str) -> bool:
    """a < b in code-point order; shared parts are passed over as wholes."""
    one, two = [a], [b]
    while one and two:
        x, y = one.pop(), two.pop()
        if x is y:
            continue
        if isinstance(x, Rope) and (isinstance(y, str) or x.size >= y.size):
            one += (x.right, x.left)
            two.append(y)
        elif isinstance(y, Rope):
            two += (y.right, y.left)
            one.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x < y
            if len(x) > n:
                one.append(x[n:])
            if len(y) > n:
                two.append(y[n:])
    return bool(two) and not one


Entry = tuple[int, Rope | str] | None
Matrix = list[list[Entry]]


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = []
    for row in x:
        line: list[Entry] = [None] * STATES
        for k, left in enumerate(row):
            if left is None:
                continue
            for j, right in enumerate(y[k]):
                if right is None or (line[j] is not None and line[j][0] < left[0] + right[0]):
                    continue
                line[j] = better(line[j], (left[0] + right[0], joined(left[1], right[1])))
        out.append(line)
    return out


def _none() -> Matrix:
    return [[None] * STATES for _ in range(STATES)]


def identity() -> Matrix:
    return [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]


def inserts() -> Matrix:
    """The fewest inserted rows from state to state."""
    one = _none()
    for role in "ua":
        for i, j in STEPS[role].items():
            one[i][j] = (INSERT, "I")
    out = identity()
    for _ in range(STATES):
        longer = product(out, one)
        out = [[better(out[i][j], longer[i][j]) for j in range(STATES)] for i in range(STATES)]
    return out


CLOSURE = inserts()


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts before a row, then the row kept, given another role or deleted."""
    edits = _none()
    for i in range(STATES):
        edits[i][i] = (DELETE, "D")
    if symbol != "D":
        initial, cut = divmod(ord(symbol) - 97, 2)
        extra = TRUNCATED if cut else 0
        for role in "ua":
            for i, j in STEPS[role].items():
                edits[i][j] = better(edits[i][j], (REROLE + extra, "R"))
        if initial < len(INITIALS):
            for i, j in STEPS[INITIALS[initial]].items():
                edits[i][j] = better(edits[i][j], (KEEP + extra, "K"))
    return product(CLOSURE, edits)


def ended(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation with this product of its rows."""
    last = product(matrix, CLOSURE)[0]
    cost, audit = better(last[ACCEPTING[0]], last[ACCEPTING[1]])
    return cost, flat(audit)


# --- grammar ---


def compressed(symbols: str, rules: list[tuple[str, str]]) -> str:
    for pair, name in rules:
        if len(symbols) < 2:
            break
        symbols = symbols.replace(pair, name)
    return symbols


class Grammar:
    """Rules in the order in which they are applied, and a matrix for each symbol."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str]] = []
        self.matrices = {c: symbol_matrix(c) for c in "abcdefghD"}
        self.memo: dict[str, Matrix] = {}

    def add(self, pair: str) -> None:
        name = chr(FIRST_RULE + len(self.rules))
        self.rules.append((pair, name))
        self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def matrix(self, symbols: str) -> Matrix:
        """Of a segment; equal segments of all conversations of a task share it."""
        found = self.memo.get(symbols)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[symbols] = self._product(compressed(symbols, self.rules))
        return found

    def _product(self, names: str) -> Matrix:
        parts = [self.matrices[c] for c in names] or [identity()]
        while len(parts) > 1:
            parts = [product(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]


class Chain:
    """Product of a sequence of matrices as they come, in pairs of like length."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Matrix]] = []

    def add(self, matrix: Matrix) -> None:
        size = 1
        while self.parts and self.parts[-1][0] == size:
            matrix, size = product(self.parts.pop()[1], matrix), 2 * size
        self.parts.append((size, matrix))

    def total(self) -> Matrix:
        if not self.parts:
            return identity()
        out = self.parts[-1][1]
        for _, matrix in reversed(self.parts[:-1]):
            out = product(matrix, out)
        return out


def pair_counts(symbols: str, weight: int, into: Counter) -> None:
    """Occurrences that do not overlap, of every adjacent pair."""
    for pair, n in Counter(map("".join, zip(symbols, symbols[1:]))).items():
        into[pair] += weight * (symbols.count(pair) if pair[0] == pair[1] else n)


def disjoint(pairs: Iterable[str]) -> list[str]:
    """The first pairs of which none begins with what another one ends with: they cannot
    overlap, so that they may be replaced in one round."""
    heads, tails, out = set(), set(), []
    for a, b in pairs:
        if a not in tails and b not in heads:
            heads.add(a)
            tails.add(b)
            out.append(a + b)
    return out


def learned(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Grammar:
    """Re-Pair over ``sequences`` (symbols, weight): every round counts the pairs of all
    sequences as they are compressed so far, and makes rules of the most frequent ones."""
    grammar = Grammar()
    for _ in range(rounds):
        shared = Shared(sequences.sparkSession, grammar.rules)

        def run(batches: Iterator[pa.RecordBatch], shared: Shared = shared) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for symbols, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    pair_counts(compressed(symbols, shared.value), weight, found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        counts = sequences.select("symbols", "weight").mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        frequent = counts.filter("n > 1").orderBy(F.desc("n"), "pair").limit(per_round).collect()
        if not frequent:
            break
        for pair in disjoint(r["pair"] for r in frequent):
            grammar.add(pair)
    return grammar


# --- rows ---


def talk_key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(talks: DataFrame) -> DataFrame:
    """conv (the id as text), turn, role and text after the damage that a row's crc32 names."""
    rows = talks.select(
        talk_key(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    place = F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = rows.withColumn("hit", F.crc32(place.cast("binary")) % 20).filter("hit <> 0")
    return hit.select(
        "conv",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered_key(rows: DataFrame) -> DataFrame:
    """``at`` orders turns with null first, ``mark`` stands for role and text together."""
    mark = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumn("at", F.coalesce("turn", F.lit(-(2**63)))).withColumn("mark", mark)


ORDER = ["conv", "at", "role", "mark"]


def row_groups(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn counted, with initial, blank and truncated."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    judged = ordered_key(rows).select(
        *ORDER,
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), WHOLE).otherwise(CUT).alias("fault"),
    )
    return judged.groupBy(*ORDER, "turn", "initial", "fault").agg(F.count("*").alias("copies"))


def segments(groups: DataFrame) -> DataFrame:
    """(conv, part, piece, letters): each conversation's rows in order, cut at ``SEGMENT``."""
    firsts = groups.groupBy("conv", "mark").agg(F.min("at").alias("first_at"))
    flagged = groups.join(firsts, ["conv", "mark"]).select(*ORDER, "initial", "fault", "copies", (F.col("at") == F.col("first_at")).alias("first"))
    runs = flagged.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv", "initial", "fault", "copies", "first", F.spark_partition_id().alias("part"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str]] = []
        now, part, piece, size, letters = None, 0, 0, 0, []

        def close() -> None:
            nonlocal piece, size, letters
            if letters:
                out.append((now, part, piece, "".join(letters)))
                piece, size, letters = piece + 1, 0, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "part", "piece", "letters"])

        for batch in batches:
            for conv, initial, fault, copies, first, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    close()
                    now = conv
                own = letter(initial, fault if fault == BLANK or first else DUPLICATE)
                again = letter(initial, BLANK if fault == BLANK else DUPLICATE)
                at = 0
                while at < copies:
                    take = min(copies - at, SEGMENT - size)
                    letters.append(own + again * (take - 1) if at == 0 else again * take)
                    at, size = at + take, size + take
                    if size >= SEGMENT:
                        close()
                if len(out) >= 4096:
                    yield flush()
        close()
        yield flush()

    return runs.mapInArrow(cut, "conv string, part int, piece long, letters string")


def _is_legal(pair: str) -> bool:
    roles = [(ord(c) - 65) // 4 for c in pair]
    return all(r < len(INITIALS) for r in roles) and "".join(INITIALS[r] for r in roles) in ("su", "ua", "au")


ILLEGAL = frozenset(a + b for a in map(chr, range(65, 81)) for b in map(chr, range(65, 81)) if not _is_legal(a + b))


class Tally:
    """What a conversation's segments give, in order."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar, self.chain = grammar, Chain()
        self.faults, self.illegal, self.last = [0] * 4, 0, ""

    def add(self, letters: str) -> None:
        for c, n in Counter(letters).items():
            self.faults[(ord(c) - 65) % 4] += n
        pairs = Counter(zip(self.last + letters, (self.last + letters)[1:]))
        self.illegal += sum(n for (a, b), n in pairs.items() if a + b in ILLEGAL)
        self.last = letters[-1]
        self.chain.add(self.grammar.matrix(letters.translate(_TO_SYMBOL)))

    def result(self) -> tuple[int, int, int, int, int, str]:
        return (self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, *ended(self.chain.total()))


def audits(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """Fault counts, cost and audit of each conversation."""
    shared = Shared(pieces.sparkSession, grammar)
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, tally = None, None
            for batch in batches:
                for conv, letters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if conv != now:
                        if tally:
                            yield (now, *tally.result())
                        now, tally = conv, Tally(shared.value)
                    tally.add(letters)
            if tally:
                yield (now, *tally.result())

        yield from _batches(rows(), names, [pa.string(), *[pa.int64()] * 5, pa.string()])

    sorted_pieces = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece").select("conv", "letters")
    return sorted_pieces.mapInArrow(fold, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], bound: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes of text."""
    held, size = [], 0
    make: Callable[[], pa.RecordBatch] = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*held, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str))
        if size > bound:
            yield make()
            held, size = [], 0
    yield make()


class Repair:
    """Applies an audit to the rows of a conversation as they come, and keeps the digest."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.digest, self.any = audit, 0, 0, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.digest.update((b"\n" if self.any else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True
        self.state = STEPS[role[0]][self.state]

    def _due(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(self._due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text)
        elif edit == "R":
            self._put(self._due(), text)

    def result(self) -> str:
        self._insert()
        return self.digest.hexdigest()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = f"conv string, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"


def digested(scripts: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each script: the script goes first in its conversation's stream of rows."""
    empty = {"turn": "long", "at": "long", "role": "string", "text": "string", "mark": "binary"}
    heads = scripts.select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], *_COUNTS, "audit")
    tails = ordered_key(rows).select("conv", F.lit(1).alias("kind"), *empty, *[F.lit(None).cast("long").alias(c) for c in _COUNTS], F.lit(None).cast("string").alias("audit"))
    stream = heads.unionByName(tails).repartition("conv").sortWithinPartitions("conv", "kind", "at", "role", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[tuple]:
            head, repair = None, None
            for batch in batches:
                for conv, kind, role, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == 0:
                        if repair:
                            yield (*head, repair.result())
                        head, repair = (conv, *rest), Repair(rest[-1])
                    else:
                        repair.row(role, text)
            if repair:
                yield (*head, repair.result())

        yield from _batches(done(), ["conv", *_COUNTS, "audit", "repaired_sha256"], [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()])

    return stream.select("conv", "kind", "role", "text", *_COUNTS, "audit").mapInArrow(run, _RESULT)


def repaired(talks: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of
    every conversation; ``damage`` turns the given rows into (conv, turn, role, text)."""
    rows = damage(talks)
    groups = stored(row_groups(rows), "talk-rows")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = groups.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    pieces = stored(segments(groups), "talk-pieces")
    table = str.maketrans(_TO_SYMBOL)
    symbols = F.translate("letters", "".join(map(chr, table)), "".join(table.values()))
    sequences = stored(pieces.groupBy(symbols.alias("symbols")).agg(F.count("*").alias("weight")), "talk-sequences")
    scripts = audits(pieces, learned(sequences)).join(gaps, "conv")
    known = talks.select(talk_key(F.col("conv_id")).alias("conv"), F.col("conv_id").cast("long").alias("conv_id")).distinct()
    blank = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS]
    every = known.join(scripts, "conv", "left").select("conv", *blank, F.coalesce("audit", F.lit("")).alias("audit"))
    done = digested(every, rows)
    return known.join(done, "conv").drop("conv")
