"""The nested OTLP/JSON shape each signal accepts, written once as data.

From this one description come
  * the typed schema used to parse ordinary lines,
  * the VARIANT-leaf schema used to parse doubtful lines, where the JSON type of a value
    has to be seen,
  * the regular expressions that tell the two kinds of line apart, and
  * the Column predicates that decide whether a whole line is accepted.

Multi-word keys may be written in camelCase or snake_case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleskein.functions.values import json_number_text, let

# Leaf kinds: what JSON a field admits.
TEXT = "text"  # a JSON string
NANO = "nano"  # an integer, or text holding one
ANY = "any"  # any JSON; only strings and numbers carry a value
INT = "int"  # a 32-bit integer
BOOL = "bool"
NUMBER = "number"  # any finite JSON number

_TYPED_LEAF = {
    TEXT: T.StringType(),
    NANO: T.StringType(),
    ANY: T.StringType(),
    INT: T.IntegerType(),
    BOOL: T.BooleanType(),
    NUMBER: T.DoubleType(),
}


@dataclass(frozen=True)
class Leaf:
    kind: str
    required: bool = False


@dataclass(frozen=True)
class Record:
    fields: dict[str, "Node"]
    required: bool = False


@dataclass(frozen=True)
class Items:
    item: "Node"
    required: bool = False


Node = Leaf | Record | Items

# --- Fixed values: the OTLP/JSON field names and types each signal reads. ---

_VALUE = Record(
    {
        "stringValue": Leaf(TEXT),
        "intValue": Leaf(ANY),
        "boolValue": Leaf(BOOL),
        "doubleValue": Leaf(NUMBER),
    }
)
_ATTRIBUTES = Items(Record({"key": Leaf(TEXT, required=True), "value": _VALUE}))
_RESOURCE = Record({"attributes": _ATTRIBUTES})

_SPAN = Record(
    {
        "traceId": Leaf(TEXT),
        "spanId": Leaf(TEXT),
        "parentSpanId": Leaf(TEXT),
        "name": Leaf(TEXT),
        "kind": Leaf(INT),
        "startTimeUnixNano": Leaf(NANO),
        "endTimeUnixNano": Leaf(NANO),
        "status": Record({"code": Leaf(INT)}),
        "attributes": _ATTRIBUTES,
    }
)

_NUMBER_POINT = Record(
    {
        "attributes": _ATTRIBUTES,
        "timeUnixNano": Leaf(NANO),
        "asInt": Leaf(ANY),
        "asDouble": Leaf(NUMBER),
    }
)
_HISTOGRAM_POINT = Record(
    {"attributes": _ATTRIBUTES, "timeUnixNano": Leaf(NANO), "sum": Leaf(NUMBER)}
)
_METRIC = Record(
    {
        "name": Leaf(TEXT, required=True),
        "unit": Leaf(TEXT),
        "sum": Record(
            {
                "dataPoints": Items(_NUMBER_POINT, required=True),
                "aggregationTemporality": Leaf(INT),
                "isMonotonic": Leaf(BOOL),
            }
        ),
        "gauge": Record({"dataPoints": Items(_NUMBER_POINT, required=True)}),
        "histogram": Record(
            {
                "dataPoints": Items(_HISTOGRAM_POINT, required=True),
                "aggregationTemporality": Leaf(INT),
            }
        ),
    }
)

_LOG = Record(
    {
        "timeUnixNano": Leaf(NANO),
        "observedTimeUnixNano": Leaf(NANO),
        "severityText": Leaf(TEXT),
        "severityNumber": Leaf(INT),
        "body": _VALUE,
        "traceId": Leaf(TEXT),
        "spanId": Leaf(TEXT),
        "attributes": _ATTRIBUTES,
    }
)


def _envelope(resources: str, scopes: str, records: str, record: Record) -> Record:
    scope = Record({records: Items(record, required=True)})
    resource = Record({"resource": _RESOURCE, scopes: Items(scope, required=True)})
    return Record({resources: Items(resource, required=True)})


# signal -> (root key, scope key, record key)
KEYS = {
    "traces": ("resourceSpans", "scopeSpans", "spans"),
    "metrics": ("resourceMetrics", "scopeMetrics", "metrics"),
    "logs": ("resourceLogs", "scopeLogs", "logRecords"),
}
ENVELOPES = {
    signal: _envelope(*KEYS[signal], record)
    for signal, record in (("traces", _SPAN), ("metrics", _METRIC), ("logs", _LOG))
}

CORRUPT = "_corrupt_record"

# Plain JSON only: no single quotes, no NaN or Infinity words.
JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": CORRUPT,
}


def snake(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "_" + m.group().lower(), name)


def spellings(name: str) -> tuple[str, ...]:
    other = snake(name)
    return (name,) if other == name else (name, other)


def pick(parent: Column, name: str) -> Column:
    """The field under either spelling."""
    return F.coalesce(*[parent[s] for s in spellings(name)])


# --- schemas ---


def _spark_type(node: Node, variant_leaves: bool) -> T.DataType:
    if isinstance(node, Leaf):
        return T.VariantType() if variant_leaves else _TYPED_LEAF[node.kind]
    if isinstance(node, Items):
        return T.ArrayType(_spark_type(node.item, variant_leaves))
    return T.StructType(
        [
            T.StructField(spelling, _spark_type(child, variant_leaves))
            for name, child in node.fields.items()
            for spelling in spellings(name)
        ]
    )


def line_schema(signal: str, variant_leaves: bool = False) -> T.StructType:
    body = _spark_type(ENVELOPES[signal], variant_leaves)
    return T.StructType([*body.fields, T.StructField(CORRUPT, T.StringType())])


def resources_type(signal: str) -> T.DataType:
    return _spark_type(ENVELOPES[signal].fields[KEYS[signal][0]], False)


# --- telling ordinary lines from doubtful ones ---


def _walk(node: Node) -> Iterator[tuple[str, Node]]:
    if isinstance(node, Items):
        yield from _walk(node.item)
    elif isinstance(node, Record):
        for name, child in node.fields.items():
            yield name, child
            yield from _walk(child)


def _one_of(names: set[str]) -> str:
    return "(?:" + "|".join(sorted(names)) + ")"


def _keys_of_kind(signal: str, *kinds: str) -> str:
    return _one_of(
        {
            spelling
            for name, node in _walk(ENVELOPES[signal])
            if isinstance(node, Leaf) and node.kind in kinds
            for spelling in spellings(name)
        }
    )


def doubtful(shape: Column, signal: str) -> Column:
    """True where the plain typed parse could not be trusted to see a wrong JSON type.

    ``shape`` is the line's ``schema_of_variant`` text: short, whatever the line's length. The
    typed parse reads any JSON as text where a text field is due, so a text field with another
    type (or with several, shown as VARIANT) makes the line doubtful, and so do numbers in
    exponent form, which may overflow, and both spellings of one key. A doubtful line is not
    rejected: it is parsed with VARIANT leaves and judged exactly.
    """
    odd = "|".join(
        [
            _keys_of_kind(signal, TEXT) + ": (?!STRING|VOID)",
            _keys_of_kind(signal, NANO, ANY) + ": (?!STRING|BIGINT|VOID)",
            # Other wrong types in number fields are seen by the typed parse.
            _keys_of_kind(signal, NUMBER) + ": DOUBLE",
        ]
    )
    both = {n for n, _ in _walk(ENVELOPES[signal]) if len(spellings(n)) > 1}
    mixed = shape.rlike(f"[<` ]{_one_of({snake(n) for n in both})}`?: ") & shape.rlike(
        f"[<` ]{_one_of(both)}`?: "
    )
    return shape.rlike(f"[<` ](?:{odd})") | mixed


# --- accepting a line ---


def typed_ok(node: Node, value: Column) -> Column | None:
    """Required parts are there; types were checked by the parse. None = nothing to check."""
    if isinstance(node, Leaf):
        return value.isNotNull() if node.required else None
    if isinstance(node, Items):
        ok = F.forall(value, lambda x: _all([x.isNotNull(), typed_ok(node.item, x)]))
    else:
        ok = _all([typed_ok(child, pick(value, name)) for name, child in node.fields.items()])
        if ok is None:
            return value.isNotNull() if node.required else None
    return (value.isNotNull() & ok) if node.required else (value.isNull() | ok)


def variant_ok(node: Node, value: Column) -> Column:
    """The exact rules, on a parse whose leaves are VARIANT."""
    if isinstance(node, Leaf):
        if node.kind == ANY:
            return F.lit(True)
        ok = let(F.schema_of_variant(value), lambda kind: _leaf_ok(node, value, kind))
        return (value.isNotNull() & ok) if node.required else (value.isNull() | ok)
    if isinstance(node, Items):
        ok = F.forall(value, lambda x: x.isNotNull() & variant_ok(node.item, x))
    else:
        checks = []
        for name, child in node.fields.items():
            names = spellings(name)
            if len(names) > 1:
                checks.append(~(value[names[0]].isNotNull() & value[names[1]].isNotNull()))
            checks.append(variant_ok(child, pick(value, name)))
        ok = _all(checks)
    return F.coalesce((value.isNotNull() & ok) if node.required else (value.isNull() | ok), F.lit(False))


def _leaf_ok(node: Leaf, value: Column, kind: Column) -> Column:
    """Whether a present leaf of this ``schema_of_variant`` kind is admissible."""
    if node.kind == TEXT:
        ok = kind == "STRING"
    elif node.kind == NANO:
        ok = kind.isin("BIGINT", "STRING")
    elif node.kind == BOOL:
        ok = kind == "BOOLEAN"
    elif node.kind == INT:
        ok = (kind == "BIGINT") & F.try_variant_get(value, "$", "int").isNotNull()
    else:
        number = F.try_variant_get(value, "$", "double")
        ok = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (
            F.abs(number) < float("inf")
        )
    return ok if node.required else ((kind == "VOID") | ok)


def _any_text(value: Column, kind: Column) -> Column:
    return (
        F.when(kind.isin("STRING", "BIGINT"), F.try_variant_get(value, "$", "string"))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), json_number_text(value))
        .when(kind != "VOID", F.lit(""))
    )


def variant_to_typed(node: Node, value: Column) -> Column:
    """A VARIANT-leaf parse brought to the type of the plain parse."""
    if isinstance(node, Leaf):
        if node.kind in (INT, BOOL, NUMBER):
            return F.try_variant_get(value, "$", _TYPED_LEAF[node.kind].simpleString())
        text = F.try_variant_get(value, "$", "string")
        if node.kind != ANY:
            return text
        return F.when(
            value.isNotNull(), let(F.schema_of_variant(value), lambda kind: _any_text(value, kind))
        )
    if isinstance(node, Items):
        return F.transform(value, lambda x: variant_to_typed(node.item, x))
    parts = []
    for name, child in node.fields.items():
        parts.append(variant_to_typed(child, pick(value, name)).alias(name))
        for other in spellings(name)[1:]:
            parts.append(F.lit(None).cast(_spark_type(child, False)).alias(other))
    return F.when(value.isNotNull(), F.struct(*parts))


def _all(checks: list[Column | None]) -> Column | None:
    kept = [c for c in checks if c is not None]
    if not kept:
        return None
    out = kept[0]
    for c in kept[1:]:
        out = out & c
    return out
