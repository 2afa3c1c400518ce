"""Property values as canonical JSON text, in Python and as column expressions.

Compact JSON, object keys sorted, integers without and floats with a decimal point; so integer and
float, number and string, stay apart under plain text equality.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def plain(value: Any) -> Any:
    """A value as JSON has it: non-finite numbers become null, integers beyond 64 bits floats, and
    what JSON does not know (tuples too) its text."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return value if -(2**63) <= value < 2**63 else float(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return str(value)


def encode(value: Any) -> str:
    return json.dumps(plain(value), separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def encode_map(properties: dict[str, Any] | None) -> dict[str, str]:
    return {k: encode(v) for k, v in (properties or {}).items()}


def decode(text: str | None) -> Any:
    return None if text is None else json.loads(text)


def decode_map(properties: dict[str, str] | None) -> dict[str, Any]:
    return {k: decode(v) for k, v in (properties or {}).items()}


def literal_map(properties: dict[str, Any] | None) -> Column:
    pairs = [F.lit(x) for kv in encode_map(properties).items() for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast(MAP)


def no_props() -> Column:
    return F.create_map().cast(MAP)


def quote(col: Column) -> Column:
    """A string column as JSON text."""
    body = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
    return F.when(col.isNull(), F.lit("null")).otherwise(F.substring(body, F.lit(6), F.length(body) - 6))


def is_string(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit('"')), F.lit(False))


def string(text: Column) -> Column:
    """The string that JSON text holds; null where it holds none."""
    return F.when(is_string(text), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0])


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike("^-?[0-9]"), F.lit(False))


def number(text: Column) -> Column:
    """The number that JSON text holds as a double; null where it holds none."""
    return F.when(is_number(text), text.try_cast("double"))


def edge_weight(props: Column, key: str | None) -> Column:
    """A numeric edge property; one where it is missing or no number."""
    return F.lit(1.0) if key is None else F.coalesce(number(props[key]), F.lit(1.0))


def node_weight(props: Column, key: str) -> Column:
    """A node's weight: numbers and numeric strings count, missing is zero, anything else an error."""
    text = props[key]
    value = F.coalesce(number(text), string(text).try_cast("double"))
    wrong = F.raise_error(F.concat(F.lit(f"node weight {key!r} is no number: "), text)).cast("double")
    return F.when(text.isNull(), F.lit(0.0)).when(value.isNotNull(), value).otherwise(wrong)


def predicate(props: Column, mode: str, default: str = "") -> Column:
    """The predicate of an edge.

    ``triples``, ``rdf`` and ``infer`` take ``predicate``, else ``type``, else the default;
    ``sparql`` takes ``predicate`` alone, else the default.
    """
    first = string(props["predicate"])
    if mode == "sparql":
        return F.coalesce(first, F.lit(default))
    fallback = {"triples": "relatedTo", "infer": ""}.get(mode, default)
    return F.coalesce(first, string(props["type"]), F.lit(fallback))


def strictly_equals(props: Column, key: str, value: Any) -> Column:
    """JSON equality: 1 and 1.0 differ; a missing key equals nothing."""
    return F.coalesce(props[key] == F.lit(encode(value)), F.lit(False))


def loosely_equals(props: Column, key: str, value: Any) -> Column:
    """Equality by value: 1, 1.0 and true are equal; None also equals a missing key."""
    text = props[key]
    if value is None:
        return text.isNull() | (text == "null")
    if isinstance(value, (bool, int, float)):
        own = F.coalesce(number(text), F.when(text == "true", 1.0).when(text == "false", 0.0))
        return F.coalesce(own == F.lit(float(value)), F.lit(False))
    return F.coalesce(text == F.lit(encode(value)), F.lit(False))


def truthy_string(text: Column) -> Column:
    """The string where it is not empty."""
    value = string(text)
    return F.when(value != "", value)
