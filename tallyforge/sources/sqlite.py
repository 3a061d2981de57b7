"""SQLite databases as a data source: filters are answered by the database, ranges of a key are read in tasks of their own.

    spark.read.format("tallyforge_sqlite").option("path", ..).option("table", ..)

INTEGER is long, REAL is double, the rest is string. Options: columns (names with commas; all else), partitions.
Filters reach the source where spark.sql.python.filterPushdown.enabled is set, which read_sqlite does. The file must lie
where all executors read it.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COMPARED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(_local(path))}?mode=ro", uri=True)


def _kind(declared: str) -> T.DataType:
    up = declared.upper()
    return T.LongType() if "INT" in up else T.DoubleType() if any(x in up for x in ("REAL", "FLOA", "DOUB")) else T.StringType()


class Range(D.InputPartition):
    """Rows whose key is at least low and below high; null is no bound."""

    def __init__(self, low, high):
        self.low, self.high = low, high


class SqliteReader(D.DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: T.StructType):
        self.path, self.table, self.parts, self.schema = path, table, max(1, parts), schema
        self.where: list[str] = []
        self.values: list = []

    def _condition(self, f: D.Filter) -> tuple[str, list] | None:
        """SQL and values of a filter that the database answers as Spark would; None for others."""
        if isinstance(f, D.Not):
            inner = self._condition(f.child)
            return (f"NOT ({inner[0]})", inner[1]) if inner else None
        if len(f.attribute) != 1 or f.attribute[0] not in self.schema.names:
            return None
        column, kind = _quoted(f.attribute[0]), self.schema[f.attribute[0]].dataType
        fits = {T.LongType(): int, T.DoubleType(): (int, float), T.StringType(): str}[kind]
        alike = lambda x: isinstance(x, fits) and not isinstance(x, bool) and x == x  # noqa: E731 - NaN has an order of its own in Spark
        if isinstance(f, D.IsNull):
            return f"{column} IS NULL", []
        if isinstance(f, D.IsNotNull):
            return f"{column} IS NOT NULL", []
        if isinstance(f, D.In):
            values = list(f.value)
            return (f"{column} IN ({', '.join('?' * len(values))})", values) if values and all(map(alike, values)) else None
        if type(f) in COMPARED and alike(f.value):
            return f"{column} {COMPARED[type(f)]} ?", [f.value]
        if isinstance(f, D.StringStartsWith) and kind == T.StringType():
            return f"substr({column}, 1, ?) = ?", [len(f.value), f.value]
        return None

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Keeps what the database can answer; the rest is Spark's."""
        for f in filters:
            known = self._condition(f)
            if known:
                self.where.append(known[0])
                self.values += known[1]
            else:
                yield f

    def _key(self, con: sqlite3.Connection) -> str:
        """The row id, or the first column of the primary key where a table has none."""
        try:
            con.execute(f"SELECT rowid FROM {_quoted(self.table)} LIMIT 0")
            return "rowid"
        except sqlite3.OperationalError:
            info = con.execute(f"PRAGMA table_info({_quoted(self.table)})").fetchall()
            return _quoted(next(c[1] for c in sorted(info, key=lambda c: c[5]) if c[5]))

    def partitions(self) -> list[Range]:
        with _connect(self.path) as con:
            key, table = self._key(con), _quoted(self.table)
            if key == "rowid":
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
                step = 0 if low is None else -(-(high - low + 1) // self.parts)
                cuts = [] if low is None else list(range(low + step, high + 1, step))
            else:  # keys of any kind: every so many rows, by the key's own index
                rows = con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
                cuts = [con.execute(f"SELECT {key} FROM {table} ORDER BY {key} LIMIT 1 OFFSET ?", (rows * i // self.parts,)).fetchone()[0] for i in range(1, self.parts)] if rows >= self.parts else []
                cuts = sorted(set(cuts))
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def sql(self, key: str, partition: Range) -> tuple[str, list]:
        """What a task asks the database."""
        where, values = list(self.where), list(self.values)
        for bound, sign in ((partition.low, ">="), (partition.high, "<")):
            if bound is not None:
                where.append(f"{key} {sign} ?")
                values.append(bound)
        columns = ", ".join(map(_quoted, self.schema.names))
        return f"SELECT {columns} FROM {_quoted(self.table)}" + (" WHERE " + " AND ".join(f"({w})" for w in where) if where else "") + f" ORDER BY {key}", values

    def read(self, partition: Range) -> Iterator[tuple]:
        with _connect(self.path) as con:
            yield from con.execute(*self.sql(self._key(con), partition))


class SqliteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallyforge_sqlite"

    def schema(self) -> T.StructType:
        with _connect(self.options["path"]) as con:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        every = {c[1]: T.StructField(c[1], _kind(c[2] or "")) for c in found}
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or list(every)
        return T.StructType([every[c] for c in wanted])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("partitions", 4)), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, parts: int = 4) -> DataFrame:
    """A table, or some of its columns. Filters are pushed into the database from now on in this session."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SqliteSource)
    found = spark.read.format(SqliteSource.name()).option("path", path).option("table", table).option("partitions", parts)
    return (found.option("columns", ",".join(columns)) if columns else found).load()


def write_sqlite(rows: DataFrame, path: str, table: str, key: list[str], rowid: bool = True) -> None:
    """A small table as a database file, a batch of rows at a time; for what leaves the cluster anyway, such as a report."""
    with sqlite3.connect(_local(path)) as con:
        kinds = {T.LongType(): "INTEGER", T.IntegerType(): "INTEGER", T.DoubleType(): "REAL"}
        columns = ", ".join(f"{_quoted(f.name)} {kinds.get(f.dataType, 'TEXT')}" for f in rows.schema)
        con.execute(f"CREATE TABLE {_quoted(table)} ({columns}, PRIMARY KEY ({', '.join(map(_quoted, key))}))" + ("" if rowid else " WITHOUT ROWID"))
        con.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(rows.columns))})", (tuple(r) for r in rows.toLocalIterator()))
