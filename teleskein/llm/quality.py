"""Quality rules: rule statistics of a text, an isolation forest over them, thresholds from labels.

Statistics are counted exactly over the whole text of every document. The forest comes from all
labelled rows that pass the base rules: random splits over the range of all of them, drawn some
levels at a time; Spark counts all good rows through the trees, and a tree goes on where a node
holds more than one row in proportion to ``TREE_ROWS`` at the root. That share of rows takes the
place of a sample for each tree. The anomaly score of a row is
2^(-mean path length / expected length). The threshold is the score that parts labelled good
from labelled bad rows with the fewest errors weighted by class, never below the ``KEEP_SHARE``
quantile of the good ones; all labelled rows are counted by score in steps of 1 / ``BINS``.

Defined cases: a null text has no words and fails the base rules like every text under 50
words; rows that repeat are scored each; without usable labels the forest judges nothing and
the base rules alone decide; of several labels of one document the lowest counts; an empty table gives an empty result. Only the columns named are
read, so further columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleskein.llm.common import Shared, map_arrow, row_batches, stored, wrapped

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
TREES = 150
TREE_ROWS = 256
KEEP_SHARE = 0.999
LEVELS = 4
BINS = 1 << 16
SEED = 7

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_marks long, n_distinct long, n_bare_words long"
)
FEATURES = 8
NAMES = [part.split()[0] for part in STATS.split(", ")]
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_BARE_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\w\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")
_NOT_UPPER = re.compile(r"[^A-ZÀ-ÖØ-Þ]+")
_NOT_MARK = re.compile(r"[^.,;:!?]+")
_NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")


def repeated_words(words: list[str]) -> int:
    """How many words lie in a window of three words that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
    windows, counts = np.unique(pairs[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)[1:]
    again = counts[windows] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``STATS``."""
    text = text or ""
    words = _WORDS.findall(text)
    lines = [line for line in text.split("\n") if _WORDS.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(_NOT_SYMBOL.sub("", text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(_NOT_UPPER.sub("", text)),
        len(_NOT_MARK.sub("", text)),
        len(set(words)),
        len(_BARE_WORD.findall(text)),
    )


def with_stats(docs: DataFrame, columns: str, schema: str, text: str = "text") -> DataFrame:
    """``columns`` (a prefix of ``schema``) of every row with the statistics of its text."""

    def run(batch: pa.RecordBatch):
        stats = np.array([text_stats(t) for t in batch.column(text).to_pylist()], np.int64).reshape(-1, len(NAMES))
        return [batch.column(c) for c in columns.split()] + [pa.array(stats[:, k]) for k in range(len(NAMES))]

    return map_arrow(docs, run, f"{schema}, {STATS}")


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios that do not depend on length, one row each."""
    n, chars, symbols, dup, repeat, lines, upper, marks, distinct, bare = stats.T.astype(float)
    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    return np.column_stack(
        [
            chars / words,
            symbols / words,
            dup / np.maximum(lines, 1),
            repeat / words,
            upper / letters,
            marks / words,
            distinct / words**0.9,
            bare / words,
        ]
    )


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search in a random tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


class Forest:
    """Random trees as flat arrays: feature (-1 at a leaf), split, left child, path length.

    Splits are drawn over the box that ``low`` and ``high`` span, without a look at the rows, so
    a region where no usual row lies is cut off after few of them. All usual rows are counted: a
    node is split while it holds more than one row in proportion to ``tree_rows`` at the root.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> None:
        self._grow(lambda grown: ends(grown, rows), len(rows), low, high, trees, tree_rows, seed)

    @classmethod
    def over(cls, counted: Callable, n: int, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
        """The forest of ``n`` usual rows of which ``counted`` tells, for a list of trees, how
        many end in each node."""
        self = cls.__new__(cls)
        self._grow(counted, n, low, high, trees, tree_rows, seed)
        return self

    def _grow(self, counted: Callable, n: int, low: np.ndarray, high: np.ndarray, trees: int, tree_rows: int, seed: int) -> None:
        self.size = min(tree_rows, n)
        depth = 2 * int(np.ceil(np.log2(max(self.size, 2))))
        growing = [_Growing(np.random.default_rng([seed, k]), low, high, depth) for k in range(trees)]
        while any([tree.drawn() for tree in growing]):
            for tree, ended in zip(growing, counted([tree.arrays()[:3] for tree in growing]), strict=True):
                tree.settle(ended * (self.size / n))
        self.trees = [tree.arrays() for tree in growing]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; short paths, the anomalous rows, score high."""
        total = np.zeros(len(rows))
        for *tree, length in self.trees:
            total += length[leaves(tree, rows)]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(float(_expected(self.size)), 1e-9))


def leaves(tree: tuple[np.ndarray, ...], rows: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    feature, split, left = tree
    node, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        right = rows[every, np.maximum(f, 0)] > split[node]
        node = np.where(inner, left[node] + right, node)


def ends(trees: list[tuple[np.ndarray, ...]], rows: np.ndarray) -> list[np.ndarray]:
    """How many rows end in each node of each tree."""
    return [np.bincount(leaves(tree, rows), minlength=len(tree[0])) for tree in trees]


class _Growing:
    """A tree that draws ``LEVELS`` levels at a time and keeps what rows reach. A node is a list
    of feature, split, left child, path length, level and box."""

    def __init__(self, rng: np.random.Generator, low: np.ndarray, high: np.ndarray, depth: int) -> None:
        self.rng, self.depth = rng, depth
        self.nodes = [[-1, 0.0, 0, 0.0, 0, (low, high)]]
        self.open = [0]

    def arrays(self) -> tuple[np.ndarray, ...]:
        feature, split, left, length, _, _ = zip(*self.nodes, strict=True)
        return np.array(feature), np.array(split), np.array(left), np.array(length)

    def drawn(self) -> bool:
        """Whether there are open nodes; splits are drawn below them."""
        tops = self.open
        for _ in range(LEVELS):
            below = []
            for top in tops:
                level, (low, high) = self.nodes[top][4:]
                wide = np.flatnonzero(high > low)
                if level == self.depth or not len(wide):
                    continue
                f = int(self.rng.choice(wide))
                at = self.rng.uniform(low[f], high[f])
                under, over = high.copy(), low.copy()
                under[f] = over[f] = at
                self.nodes[top][:3] = f, at, len(self.nodes)
                for box in ((low, under), (over, high)):
                    below.append(len(self.nodes))
                    self.nodes.append([-1, 0.0, 0, 0.0, level + 1, box])
            tops = below
        return bool(self.open)

    def settle(self, held: np.ndarray) -> None:
        """Cuts the tree at nodes that hold one row or less, given what ends in each node, and
        opens those of the last level that hold more. Nodes that are cut off go."""
        for k in range(len(held) - 1, 0, -1):
            node = self.nodes[k]
            if node[0] >= 0:
                held[k] += held[node[2]] + held[node[2] + 1]
        before, kept, self.nodes, self.open = self.nodes, [0], [], []
        for k in kept:
            feature, split, left, _, level, box = before[k]
            if feature >= 0 and (held[k] > 1 or k == 0):
                self.nodes.append([feature, split, len(kept), 0.0, level, box])
                kept += [left, left + 1]
                continue
            if feature < 0 and held[k] > 1 and level < self.depth and (box[1] > box[0]).any():
                self.open.append(len(self.nodes))
            self.nodes.append([-1, 0.0, 0, level + float(_expected(held[k])), level, box])


def threshold(good: np.ndarray, bad: np.ndarray, keep_share: float = KEEP_SHARE) -> float:
    """The score above which a row is rejected, from how many rows have each of ``BINS`` + 1
    scores, rounded up."""
    own, other = np.cumsum(good), np.cumsum(bad)
    wrong = 1 - own / own[-1] + other / other[-1]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    least = np.searchsorted(own, np.ceil(keep_share * (own[-1] - 1)) + 1)
    return float(max(best[len(best) // 2], least) / BINS)


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """Forest and threshold from all labelled rows that pass the base rules; None where there
    are no good or no bad ones."""
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))

    def valued(batch: pa.RecordBatch):
        values = features(np.column_stack([batch.column(c).to_numpy() for c in NAMES]))
        return [batch.column("good"), *(pa.array(v) for v in values.T)]

    names = [f"f{k}" for k in range(FEATURES)]
    joined = stats.filter("not base_failed").join(known, "doc_id").select("good", *NAMES)
    rows = stored(map_arrow(joined, valued, "good boolean, " + ", ".join(f"{c} double" for c in names)), "quality-labelled")
    box = rows.agg(F.count_if("good"), F.count_if(~F.col("good")), *(F.min(c) for c in names), *(F.max(c) for c in names)).first()
    if not box[0] or not box[1]:
        return None
    low, high = np.array(box[2:]).reshape(2, -1)
    usual = rows.filter("good").drop("good")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(c).to_numpy() for c in names])

    def counted(trees: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        shared = Shared(rows.sparkSession, trees)
        cut = np.cumsum([0, *(len(tree[0]) for tree in trees)])
        sums = _sums(usual, lambda batch: np.concatenate(ends(shared.value, matrix(batch))), cut[-1])
        return np.split(sums, cut[1:-1])

    forest = Forest.over(counted, box[0], low, high)
    shared = Shared(rows.sparkSession, forest)

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        bins = np.ceil(shared.value.score(matrix(batch)) * BINS).astype(np.int64)
        return np.bincount(bins + (BINS + 1) * ~batch.column("good").to_numpy(zero_copy_only=False), minlength=2 * (BINS + 1))

    return forest, threshold(*_sums(rows, scores, 2 * (BINS + 1)).reshape(2, -1))


def _sums(rows: DataFrame, function: Callable, size: int) -> np.ndarray:
    """``size`` sums of ``function`` over all batches, added up by Spark."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in row_batches(batches):
            total += function(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    found = rows.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly
    (the forest's score, null where it judges nothing) and kept, a row for each document."""
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = stored(with_stats(inner, "doc_id", "doc_id long").withColumn("base_failed", base_failed()), "quality")
    return judged(stats, fit(stats, labels))


def judged(stats: DataFrame, model: tuple[Forest, float] | None) -> DataFrame:
    columns = [c for c in stats.columns if c not in ("n_lines", "n_upper", "n_marks", "n_distinct", "n_bare_words")]
    if model is None:
        return stats.select(*columns, F.lit(None).cast("double").alias("anomaly"), (~F.col("base_failed")).alias("kept"))
    forest, limit = model
    shared = Shared(stats.sparkSession, forest)

    @F.pandas_udf("double")
    def anomaly(frame):
        return pd.Series(shared.value.score(features(frame[NAMES].to_numpy())))

    scored = stats.withColumn("anomaly", anomaly(F.struct(*NAMES)))
    return scored.select(*columns, "anomaly", (~F.col("base_failed") & (F.col("anomaly") <= limit)).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Two passes over the text: one for the
    fit, one that judges each row where it lies, so no text moves."""
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = with_stats(inner, "doc_id", "doc_id long").withColumn("base_failed", base_failed())
    return _kept_rows(docs, fit(stats, labels))


def _kept_rows(docs: DataFrame, model: tuple[Forest, float] | None) -> DataFrame:
    shared = Shared(docs.sparkSession, model)

    @F.pandas_udf("boolean")
    def keep(texts):
        stats = np.array([text_stats(t) for t in texts], np.int64).reshape(-1, len(NAMES))
        passed = (stats[:, 0] >= MIN_WORDS) & (100 * stats[:, 4] <= MAX_REPEAT_PERCENT * stats[:, 0])
        if shared.value is not None and len(stats):
            forest, limit = shared.value
            passed &= forest.score(features(stats)) <= limit
        return pd.Series(passed)

    inner = wrapped(docs, text="text")
    return inner.filter(keep("text")).select("row.*")
