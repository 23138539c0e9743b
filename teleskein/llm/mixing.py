"""Mixing sources to target weights: exact budgets of words per source.

Weights go to the sources in code-point order (null last), repeating. The budget is shared by
weight; a source takes at most ``MAX_EPOCHS`` times its size and what it cannot take is
reshared. Within a source the documents stand in the order of a hash of their id. Full epochs
take every document; the last, partial epoch takes documents in that order up to the exact
budget, which needs prefix sums of sizes: rows are range-partitioned by (source, hash) and
sorted, written, summed per partition, and only the partition totals (one row per partition
and source) are prefix-summed again in the same way.

A hot source spreads over many range partitions. Ties of hash, id and text are copies of one
row; each is taken in its place. Sizes are counted over whole texts.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source; a
null doc_id has a hash like any other; sources of size 0 have target 0; an empty table gives
an empty result; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleskein.llm.common import SPACE, WORD, join_small, row_key, stored, wrapped

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17


def word_count(text: Column) -> Column:
    """Words of a text: every word with its white space shrinks to one mark."""
    marks = F.length(F.regexp_replace(text, f"{SPACE}*{WORD}{SPACE}*", "x"))
    return F.when(text.rlike(WORD), marks).otherwise(0).cast("long")


def _prefix(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``size`` over the rows of the same source that stand
    ahead in ``order`` (which begins with source). No task holds a source that is large."""
    dealt = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), label
    )
    here = Window.partitionBy("part", "source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part", "source").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("total").over(ahead), F.lit(0))).withColumn(
        "slot", F.struct("part", "source")
    ).select("slot", "offset")
    local = dealt.withColumn("inside", F.coalesce(F.sum("size").over(here), F.lit(0))).withColumn("slot", F.struct("part", "source"))
    return local.join(offsets, local["slot"].eqNullSafe(offsets["slot"])).select(
        *[local[c] for c in df.columns], (F.col("inside") + F.col("offset")).alias("before")
    )


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """source, source_size, target from (source, source_size), one row for each source.

    The target is min(max_epochs * size, level * weight), the level where the targets add up
    to the budget; it is found by repeated aggregates over the table of sources, each of which
    fixes the sources that have reached their bound.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stored(
        sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sources"
    )
    counts = dealt.groupBy("part").agg(F.count("*").alias("rows"))
    ahead = counts.withColumn("first", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("first")
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = stored(
        dealt.join(ahead, "part").select("source", "source_size", chosen.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("bound")),
        "weights",
    )
    budget = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, fixed = 0.0, -1
    while True:
        full = F.col("bound") <= F.lit(level) * F.col("weight")
        n, taken, free = table.agg(
            F.count_if(full), F.sum(F.when(full, F.col("bound")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == fixed or not free:
            break
        fixed, level = n, max(level, (budget - taken) / free)
    target = F.least(F.col("bound"), F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def taken_words(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """The columns of ``sized`` (source, size, doc_id and others) with source_size, target and
    taken: the words the mix takes of each row."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    spread = stored(sized.withColumn("draw", draw), "mix-sized")
    sizes = spread.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    order = ["source", "draw", "doc_id", *[c for c in sized.columns if c not in ("source", "doc_id")]]
    placed = _prefix(spread, order, "mix-order").drop("draw").withColumn("slot", F.struct("source"))
    joined = join_small(placed, targets.select(F.struct("source").alias("slot"), "source_size", "target"), "slot").drop("slot")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return joined.withColumn("taken", epochs * F.col("size") + part).drop("before")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    sized = docs.select("doc_id", "source", F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")).alias("size"))
    return taken_words(sized, **settings)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, f"(?<={WORD[:-1]})(?={SPACE})", -1)
    return F.array_join(F.slice(pieces, 1, n), "")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them, with all their columns: a row for each full epoch,
    and where an epoch ends inside a document, a row with its text up to the cut. Documents
    that the mix does not reach are left out; those without words stay as they are."""
    inner = wrapped(docs, doc_id="doc_id", source="source", text="text")
    inner = inner.withColumn("at", row_key(F.col("doc_id"), F.col("source"), F.col("text")))
    sized = inner.select("doc_id", "source", F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")).alias("size"), "at")
    once = taken_words(sized, **settings).groupBy("at").agg(F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    met = inner.join(once, "at")
    # Equal rows share what they take together; each holds an equal part of it, the rest falls to no one.
    own = F.floor(F.col("taken") / F.col("rows")).cast("long")
    full = F.when(F.col("size") > 0, F.floor(own / F.col("size"))).otherwise(1).cast("int")
    cut = F.when(F.col("size") > 0, own - full * F.col("size")).otherwise(0).cast("int")
    words = F.concat(F.array_repeat(F.lit(-1), full), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")))
    rows = met.select("row", "text", F.explode(words).alias("words"))
    text = F.when(F.col("words") < 0, F.col("text")).otherwise(first_words(F.col("text"), F.col("words")))
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")
