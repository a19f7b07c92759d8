"""How a field of a document is read: from a typed column, or out of a VARIANT.

Values compare within their family only: numbers with numbers (integers exactly, otherwise
as doubles), strings by code point, booleans with false before true.
"""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions import variants


class Fields(Protocol):
    def compare(self, op: str, field: str, value: Any) -> Column: ...

    def present(self, field: str) -> Column: ...

    def order(self, field: str, ascending: bool) -> list[Column]: ...


def _apply(op: str, left: Column, right: Column) -> Column:
    return left == right if op == "eq" else left > right if op == "gt" else left < right


class TypedFields:
    """Fields are columns; a NULL is a missing field."""

    def __init__(self, schema: T.StructType):
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def compare(self, op: str, field: str, value: Any) -> Column:
        kind = self.kinds.get(field)
        if kind is None:
            return F.lit(False)
        column = F.col(f"`{field}`")
        if value is None:
            return F.lit(False)
        if isinstance(value, bool):
            return _apply(op, column, F.lit(value)) if isinstance(kind, T.BooleanType) else F.lit(False)
        if isinstance(value, (int, float)):
            if not isinstance(kind, T.NumericType):
                return F.lit(False)
            return _apply(op, column, F.lit(value))
        if isinstance(kind, T.StringType):
            return _apply(op, column, F.lit(value))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return _apply(op, column, F.lit(value).cast(kind))
        return F.lit(False)

    def present(self, field: str) -> Column:
        return F.col(f"`{field}`").isNotNull() if field in self.kinds else F.lit(False)

    def order(self, field: str, ascending: bool) -> list[Column]:
        column = F.col(f"`{field}`")
        return [column.asc() if ascending else column.desc()]


class VariantFields:
    """Fields are members of one VARIANT column; null and missing differ."""

    def __init__(self, column: str = "data"):
        self.data = F.col(column)

    def _as(self, field: str, kind: str) -> Column:
        return F.try_variant_get(self.data, variants.path_of(field), kind)

    def compare(self, op: str, field: str, value: Any) -> Column:
        own = variants.get(self.data, field)
        kind = variants.kind_of(own)
        if value is None:
            return F.coalesce(F.is_variant_null(own), F.lit(False))
        # the value is compared first: naming a value's type is dearer, and few values get so far
        if isinstance(value, bool):
            return _apply(op, self._as(field, "boolean"), F.lit(value)) & (kind == "BOOLEAN")
        if isinstance(value, str):
            return _apply(op, self._as(field, "string"), F.lit(value)) & (kind == "STRING")
        if isinstance(value, float) or abs(value) < 1 << 53:  # a double tells all integers from such a literal
            return _apply(op, self._as(field, "double"), F.lit(float(value))) & variants.is_number(own)
        integers = (kind == "BIGINT") & _apply(op, self._as(field, "bigint"), F.lit(value).cast("bigint")) if abs(value) < 1 << 63 else F.lit(False)
        others = (kind != "BIGINT") if abs(value) < 1 << 63 else F.lit(True)
        return integers | (others & variants.is_number(own) & _apply(op, self._as(field, "double"), F.lit(float(value))))

    def present(self, field: str) -> Column:
        return variants.get(self.data, field).isNotNull()

    def order(self, field: str, ascending: bool) -> list[Column]:
        """Nulls, booleans, numbers, strings, in this order; objects and arrays by their text, last."""
        own = variants.get(self.data, field)
        kind = variants.kind_of(own)
        family = F.when(F.is_variant_null(own), 0).when(kind == "BOOLEAN", 1).when(variants.is_number(own), 2).when(kind == "STRING", 3).otherwise(4)
        keys = [
            family,
            F.when(kind == "BOOLEAN", self._as(field, "boolean")),
            F.when(variants.is_number(own), self._as(field, "double")),
            F.when(kind == "BIGINT", self._as(field, "bigint")),
            F.when(kind == "STRING", self._as(field, "string")).otherwise(F.when(family == 4, F.to_json(own))),
        ]
        return [k.asc() if ascending else k.desc() for k in keys]
