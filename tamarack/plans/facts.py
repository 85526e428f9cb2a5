"""Measured facts about tables, with as few jobs as the checks need.

A check's plan first states what it needs to know. Per table that is one aggregation for the row
count and the presence of all undefined fields, whatever their number, and one pass for the ordered
samples of all text fields with a vocabulary; the ends of edges are aggregated over all rows. Tables are
measured side by side. If a fused measurement fails, its error is kept and its facts are measured one by
one when they are asked for, so that one broken field spoils nothing else.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.sources.catalog import Catalog, Table

#: Rows of a sample: of values, of embeddings.
VALUES, EMBEDDINGS = 200, 500
#: Tables measured at the same time.
AT_ONCE = 4
ENDS = (("in", "out"), ("in_id", "out_id"))


@dataclass
class Need:
    """What is to be measured of a table besides its row count."""

    present: set[str] = field(default_factory=set)
    #: Fields to be sampled, by the key that orders their rows.
    sampled: dict[tuple[str, ...], set[str]] = field(default_factory=dict)


def _sortable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _sortable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_sortable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def counts(table: Table, fields: list[str]) -> DataFrame:
    """One row: ``total`` and, in order, how many rows have each field (``present_0``, ...)."""
    values = [table.value(f) for f in fields]
    return table.rows.agg(F.count("*").alias("total"), *[(F.lit(0) if v is None else F.count(v)).alias(f"present_{i}") for i, v in enumerate(values)])


def sample(table: Table, name: str, limit: int, order: list[str]) -> DataFrame:
    """The field's first values that are there, by ``order`` or else the first column, then by value: ``(value)``.

    The first rows are taken before anything is made distinct. A sample of tied rows is the same
    however often it is drawn.
    """
    value = table.value(name)
    known = [k for k in order if k in table.rows.columns] or table.rows.columns[:1]
    rows = table.rows.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(known)], value.alias("value")).where("value is not null")
    return rows.orderBy(*[c for c in rows.columns if _sortable(rows.schema[c].dataType)]).limit(limit).select("value")


def samples(table: Table, names: list[str], limit: int, order: list[str]) -> DataFrame:
    """``sample`` for several text fields in one pass: ``(field, value)``.

    Each task keeps the first rows of each field before any are exchanged.
    """
    known = [k for k in order if k in table.rows.columns] or table.rows.columns[:1]
    keys = [k for k in known if _sortable(table.rows.schema[k].dataType)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), table.value(n).alias("value")) for n in names]))
    rows = table.rows.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], each.alias("_s")).select("*", "_s.*").where("value is not null")
    first = Window.partitionBy("field").orderBy(*[f"k{i}" for i in range(len(keys))], "value")
    return rows.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= limit).select("field", "value")


def edge_ends(table: Table) -> DataFrame:
    """Distinct ``(source, target)`` tables of all edges; a missing pointer reads ``None``.

    Edges are made distinct where they are read, so that what is exchanged are tables, not edges.
    """
    a, b = next((p for p in ENDS if set(p) <= set(table.rows.columns)), ENDS[0])
    of = lambda c: F.coalesce(F.split_part(F.col(f"`{c}`"), F.lit(":"), F.lit(1)), F.lit("None"))
    return table.rows.select(of(a).alias("source"), of(b).alias("target")).distinct()


def _length(table: Table, name: str) -> Column | None:
    value = F.col("value")
    if name in table.rows.columns:
        return F.size(value) if isinstance(table.rows.schema[name].dataType, T.ArrayType) else None
    return F.size(F.from_json(value, "array<double>"))


class Facts:
    """Facts of a catalog's tables; measured once, when first needed."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self._totals: dict[str, int] = {}
        self._present: dict[tuple[str, str], int] = {}
        self._sampled: dict[tuple[str, str, tuple[str, ...]], list[object]] = {}
        #: What went wrong in a fused measurement, by table.
        self.failed: dict[str, Exception] = {}

    def _measure(self, name: str, fields: list[str]) -> None:
        table = self.catalog.tables[name]
        row = counts(table, fields).first() if table.rows is not None else None
        self._totals[name] = row["total"] if row else 0
        for i, f in enumerate(fields):
            self._present[name, f] = row[f"present_{i}"] if row else 0

    def prefetch(self, needs: dict[str, Need]) -> None:
        def fused(item: tuple[str, Need]) -> None:
            try:
                self._measure(item[0], sorted(item[1].present))
                for order, names in item[1].sampled.items():
                    self._sample(item[0], names, order)
            except Exception as e:  # noqa: BLE001 - the fact that fails does so again, alone, where it is asked for
                self.failed[item[0]] = e

        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(fused, needs.items()))

    def total(self, name: str) -> int:
        if name not in self._totals:
            self._measure(name, [])
        return self._totals[name]

    def present(self, name: str, field_name: str) -> int:
        if (name, field_name) not in self._present:
            self._measure(name, [field_name])
        return self._present[name, field_name]

    def _sample(self, name: str, names: set[str], order: tuple[str, ...]) -> None:
        table = self.catalog.tables[name]
        there = {n: v for n in names if table.rows is not None and (v := table.value(n)) is not None}
        types = dict(table.rows.select(*[v.alias(n) for n, v in there.items()]).dtypes) if there else {}
        if texts := sorted(n for n, t in types.items() if t == "string"):
            out: dict[str, list[object]] = {n: [] for n in texts}
            for r in samples(table, texts, VALUES, list(order)).collect():
                out[r["field"]].append(r["value"])
            self._sampled |= {(name, n, order): v for n, v in out.items()}

    def values(self, name: str, field_name: str, order: list[str]) -> list[object]:
        if (name, field_name, tuple(order)) in self._sampled:
            return self._sampled[name, field_name, tuple(order)]
        table = self.catalog.tables[name]
        return [] if table.value(field_name) is None else [r[0] for r in sample(table, field_name, VALUES, order).collect()]

    def lengths(self, name: str, field_name: str, order: list[str]) -> set[int]:
        """Lengths of the sampled lists; what is no list has none."""
        table = self.catalog.tables[name]
        if table.value(field_name) is None or (length := _length(table, field_name)) is None:
            return set()
        return {r[0] for r in sample(table, field_name, EMBEDDINGS, order).select(length).distinct().collect()} - {None}

    def ends(self, name: str) -> set[tuple[str, str]]:
        table = self.catalog.tables[name]
        return set() if table.rows is None else {(r[0], r[1]) for r in edge_ends(table).collect()}
