"""What tables there are, what is defined about them, and their rows.

Spark knows columns and types, but no indexes, analyzers, relations or schemaless tables. Those
come from a script of definition statements beside the data. A table that the script defines has
the fields that it defines and no others; any other table has its Spark columns as defined fields.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.sources.ddl import Definitions, FieldDef, IndexDef, TableDef, read_definitions

#: A definition script in a data directory has this name.
SCRIPT = "definitions.ddl"


def type_name(t: T.DataType, link: str | None = None) -> str:
    """The normalized name of a Spark type; ``link`` is the table that a record field points to."""
    if link:
        return f"record<{link.lower()}>"
    if isinstance(t, T.ArrayType):
        return f"array<{type_name(t.elementType)}>"
    names = (
        ((T.StringType, T.CharType, T.VarcharType), "string"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType), "float"), ((T.DecimalType,), "decimal"), ((T.BooleanType,), "bool"),
        ((T.TimestampType, T.TimestampNTZType), "datetime"), ((T.DateType,), "date"), ((T.DayTimeIntervalType,), "duration"), ((T.StructType, T.MapType, T.VariantType), "object"),
    )
    return next((name for kinds, name in names if isinstance(t, kinds)), t.simpleString())


@dataclass
class Table:
    """A table: definition, defined fields, indexes in order, and rows (none if it has never been written).

    ``payload`` is a column of JSON or variant objects in which undefined fields are looked up.
    """

    definition: TableDef
    fields: dict[str, FieldDef]
    indexes: dict[str, IndexDef] = field(default_factory=dict)
    rows: DataFrame | None = None
    payload: str | None = None

    def value(self, name: str) -> Column | None:
        """The values of a field, null where it is absent; None if the rows can't have it. Names match exactly."""
        if self.rows is None:
            return None
        if name in self.rows.columns:
            return F.col(f"`{name}`")
        if self.payload:
            c = F.col(f"`{self.payload}`")
            if isinstance(self.rows.schema[self.payload].dataType, T.VariantType):
                return F.try_variant_get(c, f"$.{name}", "string")
            return F.get_json_object(c, f"$.{name}")
        return None


@dataclass
class Catalog:
    """A snapshot of all tables and analyzers, and where it was taken."""

    source: str
    tables: dict[str, Table]
    analyzers: dict[str, str] = field(default_factory=dict)


def from_frames(frames: Mapping[str, DataFrame], script: str = "", source: str = "frames", payloads: Mapping[str, str] | None = None) -> Catalog:
    """A catalog of DataFrames by name and of the tables that the script defines."""
    return _build(source, frames, read_definitions(script), payloads or {})


def from_directory(spark: SparkSession, directory: str, script: str | None = None, payloads: Mapping[str, str] | None = None) -> Catalog:
    """A catalog of the ``*.parquet`` files or folders of a directory on any file system that Spark reads.

    ``script`` is the text of definition statements; by default it is the directory's ``definitions.ddl``.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(directory)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    frames = {Path(n).stem: spark.read.parquet(f"{directory}/{n}") for n in names if n.endswith(".parquet")}
    if script is None and SCRIPT in names:
        script = spark.read.text(f"{directory}/{SCRIPT}", wholetext=True).first()[0]
    return _build(directory, frames, read_definitions(script or ""), payloads or {})


def from_session(spark: SparkSession, database: str | None = None, script: str = "", payloads: Mapping[str, str] | None = None) -> Catalog:
    """A catalog of the tables and views of a database of the session."""
    database = database or spark.catalog.currentDatabase()
    frames = {t.name: spark.table(f"`{t.name}`" if t.isTemporary else f"`{database}`.`{t.name}`") for t in spark.catalog.listTables(database)}
    return _build(database, frames, read_definitions(script), payloads or {})


def _build(source: str, frames: Mapping[str, DataFrame], defined: Definitions, payloads: Mapping[str, str]) -> Catalog:
    tables = {}
    for name in [*frames, *(n for n in defined.tables if n not in frames)]:
        rows = frames.get(name)
        if name in defined.tables:
            definition, fields_ = defined.tables[name], dict(defined.fields.get(name, {}))
        else:
            definition = TableDef(name, schemafull=True)
            fields_ = {f.name: FieldDef(f.name, type=type_name(f.dataType, f.metadata.get("link"))) for f in rows.schema.fields} | defined.fields.get(name, {})
        tables[name] = Table(definition, fields_, defined.indexes.get(name, {}), rows, payloads.get(name))
    return Catalog(source, tables, dict(defined.analyzers))
