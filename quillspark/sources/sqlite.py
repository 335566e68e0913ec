"""A Spark data source over SQLite tables: read only, Arrow batches, chosen columns and rows, partitions of equally many rows."""

from __future__ import annotations

import json
import math
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_KINDS = {"INT": "long", "CHAR": "string", "TEXT": "string", "CLOB": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
#: Rows of a batch.
BATCH = 1000
_COMPARISONS = {ds.EqualTo: "=", ds.EqualNullSafe: "IS", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
_PARTS = {ds.StringStartsWith: "substr({c}, 1, length(?)) = ?", ds.StringEndsWith: "length({c}) >= length(?) AND substr({c}, length({c}) - length(?) + 1) = ?", ds.StringContains: "instr({c}, ?) > 0"}


def connect(path: str) -> sqlite3.Connection:
    """An immutable, query-only connection; a missing file is an error."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no such corpus: {path}")
    con = sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro&immutable=1", uri=True)
    con.execute("PRAGMA query_only = ON")
    return con


def table_names(path: str) -> list[str]:
    with connect(path) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def condition(f: ds.Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
    """A filter as SQL with its values, or None if SQLite could judge it otherwise than Spark. kinds: of the columns whose values have the declared type."""
    if isinstance(f, ds.Not):
        inner = condition(f.child, kinds)
        return inner and (f"NOT ({inner[0]})", inner[1])
    name = f.attribute[0] if len(f.attribute) == 1 else None
    kind = kinds.get(name)
    if kind is None:
        return None
    # Texts compare by their bytes, whatever collation the column has.
    column = _quoted(name) + (" COLLATE BINARY" if kind == "string" else "")
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return f"{_quoted(name)} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL", []

    def fits(value) -> bool:
        if kind == "string":
            return isinstance(value, str) and "\0" not in value
        return not isinstance(value, bool) and isinstance(value, int) or kind == "double" and isinstance(value, float) and not math.isnan(value)

    if isinstance(f, ds.In):
        return (f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)) if f.value and len(f.value) <= 500 and all(map(fits, f.value)) else None
    if type(f) in _COMPARISONS:
        return (f"{column} {_COMPARISONS[type(f)]} ?", [f.value]) if fits(f.value) else None
    if type(f) in _PARTS and kind == "string" and fits(f.value):
        text = _PARTS[type(f)].format(c=_quoted(name))
        return text, [f.value] * text.count("?")
    return None


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, exact: dict[str, str], partitions: int):
        self.path, self.table, self.n, self.exact = path, table, partitions, exact
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.where, self.values = "1", []

    def require(self, f: ds.Filter) -> None:
        if not (sql := condition(f, self.exact)):
            raise ValueError(f"SQLite can't judge {f} as Spark does")
        self.where += f" AND ({sql[0]})"
        self.values += sql[1]

    def partitions(self) -> list[RowRange]:
        """Ranges of row ids with equally many of the rows that are wanted, however sparse the ids are."""
        with connect(self.path) as con:
            cut = f"SELECT rowid AS r, ntile({self.n}) OVER (ORDER BY rowid) AS part FROM {_quoted(self.table)} WHERE {self.where}"
            return [RowRange(a, b) for a, b in con.execute(f"SELECT min(r), max(r) FROM ({cut}) GROUP BY part ORDER BY 1", self.values)] or [RowRange(0, -1)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        chosen = ", ".join(f"CAST({_quoted(c)} AS TEXT)" if kind == "string" else _quoted(c) for c, kind in self.columns) or "1"
        schema = pa.schema([(c, _ARROW[kind]) for c, kind in self.columns])
        with connect(self.path) as con:
            rows = con.execute(f"SELECT {chosen} FROM {_quoted(self.table)} WHERE {self.where} AND rowid BETWEEN ? AND ?", [*self.values, partition.low, partition.high])
            while part := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def told(f: ds.Filter) -> list:
    """A filter as plain lists."""
    return ["Not", told(f.child)] if isinstance(f, ds.Not) else [type(f).__name__, list(f.attribute), *([list(f.value) if isinstance(f, ds.In) else f.value] if hasattr(f, "value") else [])]


def meant(x: list) -> ds.Filter:
    """The filter of told()."""
    if x[0] == "Not":
        return ds.Not(meant(x[1]))
    return getattr(ds, x[0])(tuple(x[1]), *(tuple(v) if isinstance(v, list) else v for v in x[2:]))


class SqliteSource(DataSource):
    """Options: path, table, partitions (8), where (see read_table). Every executor must see the path. Columns are those of the schema that is asked for."""

    @classmethod
    def name(cls) -> str:
        return "corpusdb"

    def _declared(self) -> list[tuple[str, str]]:
        with connect(self.options["path"]) as con:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no such table: {self.options['table']}")
        return [(name, next((v for k, v in _KINDS.items() if k in (declared or "TEXT").upper()), "")) for _, name, declared, *_ in found]

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind or 'string'}" for name, kind in self._declared())

    def reader(self, schema: StructType) -> SqliteReader:
        exact = {name: kind for name, kind in self._declared() if kind and kind != "binary"}
        reader = SqliteReader(self.options["path"], self.options["table"], schema, exact, int(self.options.get("partitions", 8)))
        for f in map(meant, json.loads(self.options.get("where", "[]"))):
            reader.require(f)
        return reader


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8, columns: list[str] | None = None, where: tuple[ds.Filter, ...] = ()) -> DataFrame:
    """A table, or only some of its columns and of its rows: those for which all filters hold (pyspark.sql.datasource), which SQLite judges.

    A filter that SQLite could judge otherwise than Spark is an error. Filters are given here and not left to Spark, which (in 4.1) keeps those of one
    query for others over the same DataFrame.
    """
    spark.dataSource.register(SqliteSource)
    source = spark.read.format("corpusdb").option("path", path).option("table", table).option("partitions", partitions).option("where", json.dumps([told(f) for f in where]))
    if columns is None:
        return source.load()
    kinds = dict(SqliteSource({"path": path, "table": table})._declared())
    if missing := [c for c in columns if c not in kinds]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return source.schema(", ".join(f"`{c}` {kinds[c] or 'string'}" for c in columns)).load()


def read_corpus(spark: SparkSession, path: str, partitions: int = 8):
    """The corpus of a SQLite file with the tables repos, files and analysis; a missing one is an error. Only columns of the corpus are read."""
    from pyspark.sql import types as T

    from ..plans.corpus import SCHEMAS, Corpus, fitted

    if missing := sorted(set(SCHEMAS) - set(table_names(path))):
        raise ValueError(f"tables are missing: {', '.join(missing)}")
    tables = []
    for name, ddl in SCHEMAS.items():
        want = {f.name for f in T._parse_datatype_string(ddl).fields}
        have = [c for c, _ in SqliteSource({"path": path, "table": name})._declared() if c.lower() in want]
        tables.append(fitted(read_table(spark, path, name, partitions, have), name))
    return Corpus(*tables)
