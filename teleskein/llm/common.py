"""What the operators of this package share: tables between jobs, row wrapping, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleskein.session import scratch_dir

# Rows that a broadcast side may have after its count was taken; a row here is under 64 bytes.
BROADCAST_ROWS = 100_000
SALTS = 16
# White space of the word pattern [^\x20\x09-\x0D]+, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: its lineage ends here, so a
    lost executor costs at most the tasks of the job that reads it."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wrapped(df: DataFrame, **needed: str) -> DataFrame:
    """``needed`` columns under the operator's own names beside the whole row as one struct,
    so that no column of the caller can clash with the operator's."""
    return df.select(
        *[df[column].alias(own) for own, column in needed.items()],
        F.struct(*[df[c] for c in df.columns]).alias("row"),
    )


def replaced(df: DataFrame, columns: list[str], **new: Column) -> list[Column]:
    """The fields of ``row`` in their order, those in ``new`` replaced."""
    return [(new[c] if c in new else df["row"][c]).alias(c) for c in columns]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def row_key(*columns: Column) -> Column:
    """Identity of a row for joins of a table with itself: equal rows share it."""
    return F.struct(F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns))


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join with a written table that is often, but not surely, small.

    Its rows are counted: up to BROADCAST_ROWS it is broadcast. Beyond, both sides are
    shuffled by key and salt, so that a key with a large share of ``big`` is spread.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salted = big.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "salt"], how).drop("salt")


class Shared:
    """An object of bounded size for all tasks; a worker process unpacks it once and keeps it
    beside the broadcast it came from."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        if not hasattr(self.packed, "unpacked"):
            self.packed.unpacked = cloudpickle.loads(self.packed.value)
        return self.packed.unpacked

    def drop(self) -> None:
        """Frees it everywhere, once all jobs that read it are done."""
        self.packed.destroy()


def row_batches(batches: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``size`` bytes, one row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow where ``function`` takes one bounded piece and returns a column list."""

    def run(batches):
        names = None
        for batch in row_batches(batches):
            out = function(batch)
            names = names or fields
            yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [part.strip().split(" ")[0] for part in schema.split(",")]
    return df.mapInArrow(run, schema)
