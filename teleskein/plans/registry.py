"""All registered queries by name, each with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from teleskein.operators.decode import decode
from teleskein.operators.encode import encode
from teleskein.operators.scan import aggregate_metric
from teleskein.plans import decode_queries, mapping, table_queries

_ALL = {**decode_queries.QUERIES, **table_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = encode(mapping.metrics(spark, sf_dir), "metrics")
    return aggregate_metric(decode(lines, "metrics").rows, "purchase")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
