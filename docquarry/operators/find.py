"""Running queries over a DataFrame of documents.

A whole query is one plan: comparisons become one filter each, ``$and`` and ``$or`` one
filter altogether, operators on one level a union.  Ids and documents come from
the same scan; order is made only where it is asked for.
"""

from __future__ import annotations

from collections.abc import Set
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.ordering import numbered
from docquarry.plans.fields import Fields, TypedFields, VariantFields
from docquarry.plans.query import All, Any_, Cmp, Node, OrderBy, Query, parse
from docquarry.status import Status


class DocumentView:
    """Documents of a DataFrame: typed columns, or one VARIANT column ``data``."""

    def __init__(self, rows: DataFrame, id_col: str = "_id", indexed: Set[str] = frozenset(), fields: Fields | None = None):
        self.rows, self.id_col, self.indexed = rows, id_col, set(indexed)
        variant = dict(rows.dtypes).get("data") == "variant"
        self.fields: Fields = fields or (VariantFields("data") if variant else TypedFields(rows.schema))
        self.last_status = Status()

    @property
    def key(self) -> Column:
        """The id as documents are ordered by it."""
        return F.col(f"`{self.id_col}`").cast("string")

    def parse(self, query: Any, strict: bool = False) -> Query:
        tree = parse(query, self.indexed, strict)
        self.last_status = tree.status
        return tree

    def predicate(self, node: Node) -> Column:
        if isinstance(node, Cmp):
            return self.fields.compare(node.op, node.field, node.value)
        if isinstance(node, OrderBy):
            return self.fields.present(node.field)
        parts = [self.fields.compare(c.op, c.field, c.value) for c in node.parts]
        return reduce(Column.__and__ if isinstance(node, All) else Column.__or__, parts)

    def order(self, node: Node) -> list[Column]:
        """The sequence of one operator's results: by value for comparisons of order, by id
        otherwise; ties by id in the same direction."""
        if isinstance(node, OrderBy):
            return [*self.fields.order(node.field, node.ascending), self.key.asc() if node.ascending else self.key.desc()]
        if isinstance(node, Cmp) and node.op in ("gt", "lt"):
            up = node.op == "gt"
            return [*self.fields.order(node.field, up), self.key.asc() if up else self.key.desc()]
        return [self.key.asc()]

    def _empty(self) -> DataFrame:
        return self.rows.where(F.lit(False)).withColumn("op_seq", F.lit(0))

    def find(self, query: Any, strict: bool = False) -> DataFrame:
        """Matching documents and ``op_seq``, the place of the operator that found them.
        Unordered; documents found by several operators come several times."""
        found = [self.rows.where(self.predicate(node)).withColumn("op_seq", F.lit(place)) for place, node in self.parse(query, strict).nodes]
        return reduce(DataFrame.unionAll, found) if found else self._empty()

    def find_sorted(self, query: Any, strict: bool = False, limit: int | None = None) -> DataFrame:
        """Like find, but every operator's results in their sequence; with ``limit`` the first
        of each operator, by a top-k that no full sort precedes."""
        parts = []
        for place, node in self.parse(query, strict).nodes:
            rows = self.rows.where(self.predicate(node)).orderBy(*self.order(node))
            parts.append((rows if limit is None else rows.limit(limit)).withColumn("op_seq", F.lit(place)))
        return reduce(DataFrame.unionAll, parts) if parts else self._empty()

    def find_numbered(self, query: Any, strict: bool = False) -> DataFrame:
        """Like find, with ``ord``, the place of a result among its operator's, from 1."""
        parts = []
        for place, node in self.parse(query, strict).nodes:
            rows = numbered(self.rows.where(self.predicate(node)), self.order(node), "ord")
            parts.append(rows.withColumn("ord", F.col("ord") + 1).withColumn("op_seq", F.lit(place)))
        return reduce(DataFrame.unionAll, parts) if parts else self._empty().withColumn("ord", F.lit(0).cast("long"))

    def find_ids(self, query: Any, strict: bool = False) -> list[str]:
        """Ids in the sequence of the results, operator by operator."""
        ids: list[str] = []
        for _, node in self.parse(query, strict).nodes:
            ids += [r[0] for r in self.rows.where(self.predicate(node)).orderBy(*self.order(node)).select(self.key).collect()]
        return ids

    def read(self, doc_id: str) -> DataFrame:
        """The document with an id, or no row.  A typed key is compared in its own type, so
        that the comparison reaches the scan; an id that isn't its text form matches nothing."""
        kind = self.rows.schema[self.id_col].dataType
        column = F.col(f"`{self.id_col}`")
        return self.rows.where((column == F.lit(doc_id).try_cast(kind)) & (self.key == doc_id)).limit(1)

    def scan(self, limit: int | None = 10, start: str | None = None) -> DataFrame:
        """Documents by id, from ``start`` on; ten unless told otherwise, all with None."""
        rows = self.rows if start is None else self.rows.where(self.key >= start)
        ordered = rows.orderBy(self.key.asc())
        return ordered if limit is None else ordered.limit(limit)
