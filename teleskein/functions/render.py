"""Result rows as JSON text: which NULLs are printed and how times look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns printed as null; all other NULL columns are left out.
PRINTED_NULLS = frozenset({"end_time", "body"})


def time_text(time: Column) -> Column:
    """ISO text without a zone; the fraction has 0, 3 or 6 digits, as few as are exact."""
    micros = F.date_format(time, "SSSSSS")
    fraction = (
        F.when(micros == "000000", "")
        .when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3)))
        .otherwise(F.concat(F.lit("."), micros))
    )
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def sorted_attributes(attributes: Column) -> Column:
    """The map with its keys in order, so that equal maps give equal text."""
    return F.map_from_entries(F.sort_array(F.map_entries(attributes)))


def attributes_text(attributes: Column) -> Column:
    """Attribute map as JSON text, keys in order."""
    return F.to_json(sorted_attributes(attributes))


def parse_attributes(text: Column) -> Column:
    """Stored JSON text read back; NULL where it is no JSON object."""
    return F.when(
        F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"),
        F.from_json(text, "map<string,string>"),
    )


def json_lines(rows: DataFrame) -> DataFrame:
    """One column ``value`` with each row as a JSON object."""

    def shown(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            column = time_text(column)
        elif isinstance(field.dataType, T.MapType):
            column = sorted_attributes(column)
        if field.name in PRINTED_NULLS:
            column = F.coalesce(column.cast("variant"), F.parse_json(F.lit("null")))
        return column.alias(field.name)

    return rows.select(F.to_json(F.struct(*[shown(f) for f in rows.schema.fields])).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    """Write rows as JSON lines, one file per task."""
    json_lines(rows).write.mode("overwrite").text(path)
