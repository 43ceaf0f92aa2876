"""Table definitions: types, keys, nullability, defaults, indexes, statistics; and the checks on written rows.

Parquet tables accept no primary key and take nulls into NOT NULL columns, so the
checks are expressions over the rows to be written, raised by the executors.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.fs import Files

# The type names of the data model.
TYPES = {"int": T.LongType(), "integer": T.LongType(), "str": T.StringType(), "string": T.StringType(), "float": T.DoubleType(), "double": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType()}


class CatalogError(ValueError):
    pass


class ValidationError(ValueError):
    pass


def data_type(name: str) -> T.DataType:
    """The Spark type of a type name: one of the data model or one that Spark itself knows."""
    known = TYPES.get(name.strip().lower())
    if known is not None:
        return known
    try:
        return T.StructType.fromDDL(f"c {name}")["c"].dataType
    except Exception as e:
        raise CatalogError(f"unknown type {name!r}") from e


@dataclass
class ColumnDef:
    name: str
    type: str
    primary_key: bool = False
    nullable: bool = True
    default: str | None = None  # an SQL expression

    @property
    def required(self) -> bool:
        return self.primary_key or (not self.nullable and self.default is None)


@dataclass
class IndexDef:
    name: str
    columns: list[str]
    unique: bool = False


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef]
    indexes: list[IndexDef] = field(default_factory=list)

    def __post_init__(self) -> None:
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) != len(names):
            raise CatalogError(f"table {self.name} has a column twice")
        for c in self.columns:
            data_type(c.type)

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, data_type(c.type), not c.required, {"pk": c.primary_key}) for c in self.columns])

    @property
    def row_type(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, data_type(c.type), True) for c in self.columns])

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise CatalogError(f"table {self.name} has no column {name}")

    def aligned(self, rows: DataFrame) -> DataFrame:
        """rows with the table's columns in order: defaults filled in, required values checked as they are computed."""
        given = {c.lower(): c for c in rows.columns}
        unknown = set(given) - {c.name.lower() for c in self.columns}
        if unknown:
            raise ValidationError(f"unknown columns {sorted(unknown)}")
        out = []
        for c in self.columns:
            kind = data_type(c.type)
            if c.name.lower() in given:
                value = F.col(f"`{given[c.name.lower()]}`")
                self._check_type(c, rows.schema[given[c.name.lower()]].dataType, kind)
                value = value.cast(kind)
                if c.default is not None and not c.primary_key:
                    value = F.coalesce(value, F.expr(c.default).cast(kind))
            elif c.required:
                raise ValidationError(f"column {c.name} is required")
            else:
                value = (F.expr(c.default) if c.default is not None else F.lit(None)).cast(kind)
            if c.required:
                value = F.coalesce(value, F.raise_error(F.lit(f"column {c.name} must not be null")).cast(kind))
            out.append(value.alias(c.name))
        return rows.select(*out)

    @staticmethod
    def _check_type(c: ColumnDef, given: T.DataType, kind: T.DataType) -> None:
        """Integers widen to floats; otherwise kinds must agree."""
        number = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        real = (*number, T.FloatType, T.DoubleType, T.DecimalType)
        ok = (
            isinstance(given, T.NullType)
            or type(given) is type(kind)
            or (isinstance(kind, T.LongType) and isinstance(given, (*number, T.BooleanType)))
            or (isinstance(kind, T.DoubleType) and isinstance(given, real))
            or not isinstance(kind, tuple(type(t) for t in TYPES.values()))
        )
        if not ok:
            raise ValidationError(f"column {c.name} is {c.type}, not {given.simpleString()}")

    def key_column(self) -> Column:
        """table||pk or table||pk|ck; bars and backslashes of the values are escaped."""
        escaped = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.concat(F.lit(f"{self.name}||"), F.concat_ws("|", *(escaped(F.col(k).cast("string")) for k in self.keys)))

    def key_of(self, *values) -> str:
        """The same of plain values."""
        return f"{self.name}||" + "|".join(str(v).replace("\\", "\\\\").replace("|", "\\|") for v in values)


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def split_top(text: str, sep: str = ",") -> list[str]:
    """Pieces between separators that lie outside brackets and quotes."""
    out, depth, quote, last = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([{<":
            depth += 1
        elif ch in ")]}>":
            depth -= 1
        elif ch == sep and depth == 0:
            out.append(text[last:i])
            last = i + 1
    out.append(text[last:])
    return [p.strip() for p in out if p.strip()]


def parse_column(text: str) -> ColumnDef:
    m = re.match(rf"({_NAME})\s+(.+)$", text, re.S)
    if not m:
        raise CatalogError(f"not a column: {text!r}")
    name, rest = m[1], m[2]
    found = re.search(r"\b(PRIMARY\s+KEY|NOT\s+NULL|NULL|DEFAULT|UNIQUE)\b", rest, re.I)
    kind = (rest[: found.start()] if found else rest).strip()
    extra = rest[found.start() :] if found else ""
    default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\S+)", extra, re.I)
    out = ColumnDef(name, kind, bool(re.search(r"PRIMARY\s+KEY", extra, re.I)), not re.search(r"NOT\s+NULL", extra, re.I), default[1] if default else None)
    data_type(kind)
    return out


def parse_create(sql: str) -> TableDef:
    m = re.match(rf"\s*CREATE\s+TABLE\s+({_NAME})\s*\((.*)\)\s*;?\s*$", sql, re.I | re.S)
    if not m:
        raise CatalogError(f"not a CREATE TABLE statement: {sql!r}")
    columns, keys = [], []
    for part in split_top(m[2]):
        k = re.match(r"PRIMARY\s+KEY\s*\((.*)\)$", part, re.I)
        if k:
            keys += split_top(k[1])
        else:
            columns.append(parse_column(part))
    table = TableDef(m[1], columns)
    for k in keys:
        table.column(k).primary_key = True
    return table


class Catalog:
    """Definitions and statistics as JSON files below root, each a folder of its versions."""

    def __init__(self, files: Files):
        self.files = files

    def _file(self, name: str) -> str:
        return f"_catalog/{name.lower()}.json"

    def names(self) -> list[str]:
        return [n[:-5] for n in self.files.names("_catalog") if n.endswith(".json") and not n.endswith(".stats.json")]

    def has(self, name: str) -> bool:
        return bool(self.files.names(self._file(name)))

    def get(self, name: str) -> TableDef:
        if not self.has(name):
            raise CatalogError(f"no table {name}")
        d = json.loads(self.files.latest(self._file(name))[1])
        return TableDef(d["name"], [ColumnDef(**c) for c in d["columns"]], [IndexDef(**i) for i in d["indexes"]])

    def save(self, table: TableDef) -> None:
        self.files.write(self._file(table.name), json.dumps(asdict(table)))

    def create(self, table: TableDef) -> None:
        if self.has(table.name):
            raise CatalogError(f"table {table.name} exists")
        if not table.keys:
            raise CatalogError(f"table {table.name} has no primary key")
        self.save(table)

    def add_column(self, name: str, column: ColumnDef) -> TableDef:
        """Rows written before read the new column as null."""
        table = self.get(name)
        if any(c.name.lower() == column.name.lower() for c in table.columns):
            raise CatalogError(f"table {name} has a column {column.name}")
        if column.required:
            raise CatalogError("an added column must be nullable or have a default")
        table = TableDef(table.name, [*table.columns, column], table.indexes)
        self.save(table)
        return table

    def add_index(self, name: str, index: IndexDef) -> None:
        table = self.get(name)
        for c in index.columns:
            table.column(c)
        table.indexes = [i for i in table.indexes if i.name != index.name] + [index]
        self.save(table)

    def save_stats(self, name: str, stats: dict) -> None:
        self.files.write(f"_catalog/{name.lower()}.stats.json", json.dumps(stats))

    def stats(self, name: str) -> dict | None:
        text = self.files.latest(f"_catalog/{name.lower()}.stats.json")[1]
        return json.loads(text) if text else None
