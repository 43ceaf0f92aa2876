"""SQL over the tables of a store.

SELECT goes to Spark SQL over views of the current rows, so the whole of it is
available. Statements that change tables become operations in the log.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.catalog import CatalogError, IndexDef, TableDef, parse_column, parse_create, split_top
from quarry.operators.index import Indexes
from quarry.plans.explain import plan_tree
from quarry.plans.stats import Path, access_path, analyze
from quarry.sources.store import Store

_N = r"([A-Za-z_][A-Za-z0-9_]*)"


class SqlError(ValueError):
    pass


def _cut(sql: str, word: str) -> tuple[str, str | None]:
    """The text before and after a keyword that stands outside brackets and quotes."""
    depth, quote = 0, ""
    for m in re.finditer(rf"['\"`()]|\b{word}\b", sql, re.I):
        s = m[0]
        if quote:
            quote = "" if s == quote else quote
        elif s in "'\"`":
            quote = s
        elif s in "()":
            depth += 1 if s == "(" else -1
        elif depth == 0:
            return sql[: m.start()], sql[m.end() :].strip()
    return sql, None


class Sql:
    def __init__(self, store: Store):
        self.store, self.spark, self.indexes = store, store.spark, Indexes(store)

    def execute(self, sql: str) -> DataFrame:
        """The result of a statement; of those that change something, one row with the rows affected."""
        text = sql.strip().rstrip(";").strip()
        for pattern, run in (
            (r"CREATE\s+TABLE\b", self._create),
            (r"CREATE\s+(?:UNIQUE\s+)?INDEX\b", self._create_index),
            (r"ALTER\s+TABLE\b", self._alter),
            (r"INSERT\s+INTO\b", self._insert),
            (r"UPDATE\b", self._update),
            (r"DELETE\s+FROM\b", self._delete),
            (r"ANALYZE\b", self._analyze),
            (r"EXPLAIN\b", self._explain),
            (r"(?:SELECT|WITH|VALUES)\b|\(", self._select),
        ):
            if re.match(pattern, text, re.I):
                return run(text)
        raise SqlError(f"unsupported statement: {text[:60]!r}")

    def _done(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected long")

    def _register(self, sql: str) -> None:
        names = self.store.catalog.names()
        for name in names:
            if re.search(rf"\b{re.escape(name)}\b", sql, re.I):
                self.store.view(name).createOrReplaceTempView(name)

    # DDL

    def _create(self, sql: str) -> DataFrame:
        self.store.catalog.create(parse_create(sql))
        return self._done(0)

    def _create_index(self, sql: str) -> DataFrame:
        m = re.match(rf"CREATE\s+(UNIQUE\s+)?INDEX\s+{_N}\s+ON\s+{_N}\s*\((.*)\)$", sql, re.I | re.S)
        if not m:
            raise SqlError("CREATE INDEX name ON table (column)")
        columns = split_top(m[4])
        table, index = self.store.catalog.get(m[3]), IndexDef(m[2], columns, bool(m[1]))
        with self.store.lock:
            self.store.check_unique(TableDef(table.name, table.columns, [index]), self.store.view(table.name))
            self.store.catalog.add_index(m[3], index)
            self.indexes.build(m[3], *columns)
        return self._done(0)

    def _alter(self, sql: str) -> DataFrame:
        m = re.match(rf"ALTER\s+TABLE\s+{_N}\s+ADD\s+(?:COLUMN\s+)?(.+)$", sql, re.I | re.S)
        if not m:
            raise SqlError("ALTER TABLE name ADD COLUMN column type")
        self.store.catalog.add_column(m[1], parse_column(m[2].strip()))
        return self._done(0)

    # DML

    def _insert(self, sql: str) -> DataFrame:
        m = re.match(rf"INSERT\s+INTO\s+{_N}\s*(\([^()]*\))?\s*((?:VALUES|SELECT|WITH)\b.*)$", sql, re.I | re.S)
        if not m:
            raise SqlError("INSERT INTO name [(columns)] VALUES … or SELECT …")
        table = self.store.catalog.get(m[1])
        names = split_top(m[2][1:-1]) if m[2] else [c.name for c in table.columns]
        self._register(m[3])
        rows = self.spark.sql(f"SELECT * FROM {m[3]}" if m[3][:6].upper() == "VALUES" else m[3])
        if len(rows.columns) != len(names):
            raise SqlError(f"{len(names)} columns are named and {len(rows.columns)} given")
        n = self._write(table.name, rows.toDF(*names))
        return self._done(n)

    def _write(self, name: str, rows: DataFrame, delete: bool = False) -> int:
        """Append and count from what was written, so that rows are computed once."""
        counted = Observation()
        (self.store.delete if delete else self.store.put)(name, rows.observe(counted, F.count(F.lit(1)).alias("n")))
        return counted.get["n"]

    def _update(self, sql: str) -> DataFrame:
        m = re.match(rf"UPDATE\s+{_N}\s+SET\s+(.+)$", sql, re.I | re.S)
        if not m:
            raise SqlError("UPDATE name SET column = expression [WHERE condition]")
        table = self.store.catalog.get(m[1])
        sets, where = _cut(m[2], "WHERE")
        new = {}
        for part in split_top(sets):
            a = re.match(rf"{_N}\s*=\s*(.+)$", part, re.S)
            if not a:
                raise SqlError(f"not an assignment: {part!r}")
            new[table.column(a[1]).name] = a[2]
        rows = self.store.view(table.name)
        rows = rows.where(where) if where else rows
        changed = rows.select(*((F.expr(new[c.name]) if c.name in new else F.col(c.name)).alias(c.name) for c in table.columns))
        if any(k in new for k in table.keys):  # rows move to other keys
            with self.store.lock:
                both = rows.select(F.struct(*(F.col(c.name) for c in table.columns)).alias("_old"), *((F.expr(new[c.name]) if c.name in new else F.col(c.name)).alias(c.name) for c in table.columns))
                ts = self.store.tick()
                gone = self.store.operations(table, both.select("_old.*"), delete=True, ts=ts)
                come = self.store.operations(table, table.aligned(both.drop("_old")), ts=self.store.tick())
                n = rows.count()
                self.store.append(table.name, gone.unionByName(come))
                return self._done(n)
        return self._done(self._write(table.name, changed))

    def _delete(self, sql: str) -> DataFrame:
        m = re.match(rf"DELETE\s+FROM\s+{_N}\s*(.*)$", sql, re.I | re.S)
        _, where = _cut(m[2], "WHERE")
        rows = self.store.view(m[1])
        return self._done(self._write(m[1], rows.where(where) if where else rows, delete=True))

    def _analyze(self, sql: str) -> DataFrame:
        m = re.match(rf"ANALYZE\s+(?:TABLE\s+)?{_N}", sql, re.I)
        return self.analyze(m[1])

    def analyze(self, name: str) -> DataFrame:
        got = analyze(self.store.view(name)).collect()  # one row a column
        self.store.catalog.save_stats(name, {"num_rows": got[0]["num_rows"], "num_distinct": {r["column"]: r["num_distinct"] for r in got}})
        return self.spark.createDataFrame(got, "column string, num_rows long, num_distinct long")

    # queries

    def _simple(self, sql: str) -> tuple[str, str, object, str] | None:
        """(table, column, value, select list) of a query on one table with an indexed equality among its AND-ed conditions."""
        m = re.match(rf"SELECT\s+(.+?)\s+FROM\s+{_N}\s+WHERE\s+(.+)$", sql, re.I | re.S)
        if not m or re.search(r"\b(JOIN|GROUP|ORDER|LIMIT|HAVING|UNION|SELECT|DISTINCT|WINDOW|OR)\b", f"{m[1]} {m[3]}", re.I) or not self.store.catalog.has(m[2]):
            return None
        table = self.store.catalog.get(m[2])
        indexed = {c.lower() for i in table.indexes for c in i.columns[:1]}
        rest, found = m[3], None
        while rest:
            part, rest = _cut(rest, "AND")
            e = re.match(rf"\s*(?:{_N}\.)?{_N}\s*=\s*('(?:[^']|'')*'|[+-]?\d+(?:\.\d+)?)\s*$", part)
            if e and e[2].lower() in indexed and not found:
                value = e[3][1:-1].replace("''", "'") if e[3][0] == "'" else float(e[3]) if "." in e[3] else int(e[3])
                found = (m[2], table.column(e[2]).name, value, m[1])
        return found

    def path(self, sql: str) -> Path:
        """The access path that a query would take."""
        text = sql.strip().rstrip(";").strip()
        s = self._simple(text)
        return access_path(self.store.catalog.stats(s[0]), s[1], True) if s else access_path({"num_rows": 0, "num_distinct": {}}, None, False)

    def _select(self, sql: str) -> DataFrame:
        s = self._simple(sql)
        if s and access_path(self.store.catalog.stats(s[0]), s[1], True).kind == "IndexScan":
            rows = self.indexes.rows(s[0], s[1], s[2])
            if rows is not None:
                rows.createOrReplaceTempView(s[0])
                return self.spark.sql(sql)  # all conditions are applied again
        self._register(sql)
        return self.spark.sql(sql)

    def _explain(self, sql: str) -> DataFrame:
        text = re.sub(r"^EXPLAIN\s+", "", sql, flags=re.I)
        tree = {"path": self.path(text).kind, "plan": plan_tree(self._select(text))}
        return self.spark.createDataFrame([(json.dumps(tree),)], "plan string")


def connect(spark: SparkSession, root: str) -> Sql:
    return Sql(Store(spark, root))


__all__ = ["CatalogError", "Sql", "SqlError", "connect"]
