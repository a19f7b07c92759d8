"""Column functions over documents held as VARIANT values."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(value: Any) -> str:
    """JSON text whose floats are tagged as doubles when parsed into a VARIANT: a number
    with an exponent is a double, one with a point alone would be a decimal."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return json.dumps(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("JSON has no such number")
        text = repr(value)
        return text if "e" in text else text + "e0"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k))}:{encode(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(encode, value)) + "]"
    raise TypeError(f"no JSON value: {type(value).__name__}")


def to_python(value: Any) -> Any:
    """A collected VARIANT as plain Python values."""
    if hasattr(value, "toPython"):
        value = value.toPython()
    if isinstance(value, dict):
        return {k: to_python(v) for k, v in value.items()}
    if isinstance(value, list):
        return [to_python(v) for v in value]
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def let(value: Column, body) -> Column:
    """Binds a value once for a larger expression, so that it isn't computed again at every
    place that refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(value: Any) -> Column:
    """A constant VARIANT."""
    return F.parse_json(F.lit(encode(value)))


def path_of(field: str) -> str:
    """The path of a literal top-level name, dots included."""
    return '$["' + field.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def get(data: Column, field: str) -> Column:
    """The field's VARIANT; NULL where the field is missing, a null VARIANT where it is null."""
    return F.try_variant_get(data, path_of(field), "variant")


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("ARRAY"), F.lit(False))


def is_number(value: Column) -> Column:
    kind = kind_of(value)
    return F.coalesce((kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def pack(value: Column) -> Column:
    """A map or array of VARIANTs as one VARIANT."""
    return F.to_variant_object(value)


def with_member(value: Column, name: str, member: Column) -> Column:
    """The object with one member set."""
    others = F.map_filter(as_map(value), lambda k, _: k != name)
    return pack(F.map_concat(others, F.create_map(F.lit(name), member)))


def without_member(value: Column, name: str) -> Column:
    return pack(F.map_filter(as_map(value), lambda k, _: k != name))


def equals(value: Column, constant: Any) -> Column:
    """Deep JSON equality with a constant; 1 equals 1.0, nothing equals another family."""
    if isinstance(constant, (int, float)) and not isinstance(constant, bool):
        exact = (kind_of(value) == "BIGINT") & (F.try_variant_get(value, "$", "bigint") == F.lit(constant)) if isinstance(constant, int) and abs(constant) < 1 << 63 else F.lit(False)
        return F.coalesce(exact | (is_number(value) & (kind_of(value) != "BIGINT" if isinstance(constant, int) else F.lit(True)) & (F.try_variant_get(value, "$", "double") == float(constant))), F.lit(False))
    return F.coalesce(F.to_json(value) == F.to_json(literal(constant)), F.lit(False)) & ~is_number(value)


def documents_from(rows: DataFrame, id_col: str) -> DataFrame:
    """(_id, data): every row as a document with its columns as fields; NULL columns are
    missing fields.  The id is the key column as a string and also a field."""
    fields = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in rows.columns)), F.array(*(_variant(rows, c) for c in rows.columns))), lambda _, v: v.isNotNull())
    key = F.col(id_col).cast("string")
    return rows.select(key.alias("_id"), pack(F.map_concat(fields, F.create_map(F.lit("_id"), key.cast("variant")))).alias("data"))


def _variant(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType.simpleString()
    column = F.col(f"`{name}`")
    if kind.startswith(("struct", "map", "array")):
        return F.when(column.isNotNull(), F.to_variant_object(column))
    if kind in ("date",) or kind.startswith("timestamp"):
        column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind != "date" else column.cast("string")
    return column.cast("variant") if kind != "variant" else column
