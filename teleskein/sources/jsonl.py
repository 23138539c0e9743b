"""Batch reading and writing of line files: ``<dir>/<signal>/*``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from teleskein.operators.decode import Decoded, decode
from teleskein.operators.encode import encode
from teleskein.schemas import SIGNALS, check_signal
from teleskein.session import shuffles_dropped
from teleskein.sources import paths


def signal_dir(root: str, signal: str) -> str:
    """``<root>/<signal>``, or ``<root>/signal=<signal>`` where mixed lines were routed to."""
    plain = f"{root.rstrip('/')}/{check_signal(signal)}"
    routed = f"{root.rstrip('/')}/signal={signal}"
    return routed if not paths.exists(plain) and paths.exists(routed) else plain


def read_lines(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """All lines of a signal in a column ``value``; no rows where the folder is missing."""
    folder = signal_dir(paths.checked(spark, root), signal)
    if not paths.exists(folder):
        return spark.createDataFrame([], "value string")
    return spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder)


def scan_all(
    spark: SparkSession, root: str, now: Column | None = None, **options
) -> dict[str, Decoded]:
    """Decode every signal from its first byte. Keeps no cursor: twice gives rows twice."""
    return {s: decode(read_lines(spark, root, s), s, now=now, **options) for s in SIGNALS}


def write_lines(lines: DataFrame, root: str, signal: str, compression: str | None = None) -> None:
    """Append lines to a signal's folder; parent folders are made. With ``compression="gzip"``
    they take some tenth of the disk, and can still be read as a batch and followed."""
    options = {"compression": compression} if compression else {}
    with shuffles_dropped(lines.sparkSession):
        lines.select("value").write.mode("append").options(**options).text(signal_dir(root, signal))


def write_rows(rows: DataFrame, root: str, signal: str, records_per_line: int = 1024, compression: str | None = None) -> None:
    """Encode rows as export batches and append them."""
    write_lines(encode(rows, signal, records_per_line), root, signal, compression)
