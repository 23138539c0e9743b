"""Language ID: a convolutional network over bytes, trained in numpy on labelled texts.

The network sees a fixed window of ``WINDOW`` bytes (shorter texts are padded with zero
bytes). Filters of several widths slide over the one-hot bytes, so a filter is a table of 256
weights for each of its places; the maximum of each filter over the window goes through a
rectifier into one softmax layer. A text is cut into windows, the last one moved back to end
with the text, and its probabilities are the mean over all of them: every byte counts.

The fit takes a bounded sample (``SAMPLE_ROWS`` documents of a language, a row's place in it
depends on a hash alone, and one stretch of ``STRETCH`` code points of each) of the
``LANGUAGES`` most frequent labels, from documents whose crc32(doc_id as text) mod 5 is not 0.
Prediction is one pass without a shuffle, a model of fixed size beside each task.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every
text where nothing can be learned; one learned language takes all other texts with score 1. A
null doc_id counts as empty text (its crc32 is 0, held out). Rows that repeat are judged each;
an empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleskein.llm.common import Shared, map_arrow

WINDOW = 256
STRETCH = 512
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_ROWS = 2_000
LANGUAGES = 256
EPOCHS = 6
BATCH = 64
RATE = 0.01
SEED = 11
FOLDS = 5
UNKNOWN = "und"


@dataclass
class Network:
    """``tables[w][k]``: 256 x filters, what byte b at place k of a filter of width w adds."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Network:
        pooled = len(WIDTHS) * FILTERS
        tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        out = rng.normal(0, pooled**-0.5, (pooled, len(languages))).astype(np.float32)
        return cls(languages, tables, np.zeros(pooled, np.float32), out, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.out, self.out_bias]

    def responses(self, places: np.ndarray, width: int) -> np.ndarray:
        """places x windows x filters for the filters of one width; ``places`` are the bytes,
        places x windows, so that sums and maxima run over whole rows of memory."""
        table = self.tables[width]
        count = len(places) - len(table) + 1
        total = np.take(table[0], places[:count], axis=0, mode="clip")
        part = np.empty_like(total)
        for k in range(1, len(table)):
            total += np.take(table[k], places[k : k + count], axis=0, mode="clip", out=part)
        return total

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        places = np.ascontiguousarray(windows.T, np.intp)
        pooled = np.concatenate([self.responses(places, w).max(0) for w in range(len(self.tables))], 1)
        return softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of ``parameters``."""
        rows, pooled, tops = np.arange(len(windows))[:, None], [], []
        places = np.ascontiguousarray(windows.T, np.intp)
        for w in range(len(self.tables)):
            found = self.responses(places, w)
            best = found.max(0)
            tops.append((found == best).argmax(0))
            pooled.append(best)
        active = np.concatenate(pooled, 1) + self.bias
        hidden = np.maximum(active, 0)
        error = softmax(hidden @ self.out + self.out_bias)
        error[rows[:, 0], wanted] -= 1
        error /= len(windows)
        back = (error @ self.out.T) * (active > 0)
        steps = []
        for w, table in enumerate(self.tables):
            part = back[:, w * FILTERS : (w + 1) * FILTERS]
            step = np.empty_like(table)
            for k in range(len(table)):
                at = windows[rows, tops[w] + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
                step[k] = np.bincount(at.ravel(), part.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            steps.append(step)
        return [*steps, back.sum(0), hidden.T @ error, error.sum(0)]


def softmax(values: np.ndarray) -> np.ndarray:
    powers = np.exp(values - values.max(1, keepdims=True))
    return powers / powers.sum(1, keepdims=True)


def window_starts(lengths: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in its text) of every window; a text of no bytes has one, too."""
    count = np.maximum(1, -(-lengths // width))
    rows = np.repeat(np.arange(len(lengths)), count)
    place = (np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)) * width
    return rows, np.maximum(0, np.minimum(place, lengths[rows] - width))


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """``data[begin : begin + width]`` of each window, zero from ``end`` on."""
    at = begin[:, None] + np.arange(width)
    inside = at < end[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8) if len(data) else np.zeros(at.shape, np.uint8)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over shuffled windows; half of the windows are cut short, so that texts of a few
    words are learned as well."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = Network.fresh(languages, rng)
    raw = [t.encode() for t in texts]
    lengths = np.array([len(b) for b in raw], np.int64)
    rows, place = window_starts(lengths)
    data = np.frombuffer(b"".join(raw), np.uint8)
    first = np.cumsum(lengths) - lengths
    begin, end = first[rows] + place, first[rows] + lengths[rows]
    wanted = np.array([languages.index(x) for x in labels], np.int64)[rows]
    weight = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        short = np.where(rng.random(len(rows)) < 0.5, rng.integers(8, WINDOW + 1, len(rows)), WINDOW)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            windows = cut(data, begin[pick], np.minimum(end[pick], begin[pick] + short[pick]))
            step += 1
            pace = RATE * 0.5**epoch * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for p, g, m, v in zip(net.parameters(), net.gradients(windows, wanted[pick]), weight, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, stretch) of at most ``rows`` documents of each learned language.

    Languages are counted first, so that a row of a frequent one is dropped by its hash where
    it is read; what reaches the shuffle is about twice the sample, whatever the corpus.
    """
    usable = docs.select(
        F.col("doc_id").cast("string").alias("doc"), "text", F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out")
    ).filter("not held_out and lang is not null and text is not null")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return usable.select("lang", F.col("text").alias("stretch")).limit(0)
    grain = 1 << 30
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(grain, 1 + 2 * rows * grain // r["count"]))])
    near = usable.withColumn("place", F.xxhash64(F.lit(SEED), "doc")).filter(F.pmod("place", F.lit(grain)) < share[F.col("lang")])
    # where the stretch begins depends on another part of the hash
    begin = F.pmod(F.shiftright("place", 30), F.greatest(F.length("text") - STRETCH, F.lit(0)).cast("long") + 1).cast("int") + 1
    pieces = near.filter(F.col("text").rlike(r"\p{L}")).select("lang", "place", F.col("text").substr(begin, F.lit(STRETCH)).alias("stretch"))
    order = Window.partitionBy("lang").orderBy("place", "stretch")
    return pieces.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows).select("lang", "stretch")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """The network, or None where there is nothing to learn from."""
    table = sample(docs, rows).orderBy("lang", "stretch").toArrow()
    if not table.num_rows:
        return None
    return train(table.column("stretch").to_pylist(), table.column("lang").to_pylist())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: none) and the offsets of its rows, not copied."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), offsets.astype(np.int64)


def judged(net: Network, column: pa.Array, block: int = 32) -> np.ndarray:
    """Mean probabilities of each row, summed up over blocks of windows."""
    data, offsets = text_bytes(column)
    lengths = np.diff(offsets)
    rows, place = window_starts(lengths)
    total = np.zeros((len(column), len(net.languages)))
    for at in range(0, len(rows), block):
        row = rows[at : at + block]
        windows = cut(data, offsets[row] + place[at : at + block], offsets[row + 1])
        np.add.at(total, row, net.probabilities(windows))
    return total / np.bincount(rows, minlength=len(column))[:, None]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    inner = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        F.col("text"),
    )
    if net is None:
        return inner.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = Shared(docs.sparkSession, net)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
        means = judged(model, batch.column("text"))
        best = means.argmax(1) if len(means) else np.zeros(0, np.int64)
        names = np.array([*model.languages, UNKNOWN], object)[np.where(known, best, len(model.languages))]
        score = np.where(known, np.clip(means[np.arange(len(best)), best], 0.0, 1.0), 0.0)
        return [batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64())]

    return map_arrow(inner, run, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fits on the documents that are not held out and predicts all of them."""
    return predict(docs, fit(docs, rows))
