"""Tables of a database by any DB-API driver: scans with filters pushed down, and writes that take effect in one transaction."""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date, datetime
from decimal import Decimal
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from ..operators.writes import latest_rows

STRATEGIES = ("append", "truncate_insert", "merge", "delete_insert")
#: Column types by the names that databases use (fixed values); a type that isn't here is read as text.
READ_TYPES = {
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "smallint": T.ShortType(), "int2": T.ShortType(), "integer": T.IntegerType(), "int": T.IntegerType(), "int4": T.IntegerType(),
    "bigint": T.LongType(), "int8": T.LongType(), "real": T.FloatType(), "float4": T.FloatType(), "double precision": T.DoubleType(), "double": T.DoubleType(), "float8": T.DoubleType(),
    "numeric": T.DoubleType(), "decimal": T.DoubleType(), "text": T.StringType(), "character varying": T.StringType(), "varchar": T.StringType(), "character": T.StringType(),
    "bytea": T.BinaryType(), "blob": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamp without time zone": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(),
}
#: Types that the database casts before it sends them: numbers of any precision to doubles. All unknown types are cast to text.
CASTS = {"numeric": "double precision", "decimal": "double precision"}
#: Column types that a new table gets.
WRITE_TYPES = {
    T.BooleanType: "BOOLEAN", T.ByteType: "SMALLINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "REAL",
    T.DoubleType: "DOUBLE PRECISION", T.StringType: "TEXT", T.BinaryType: "BYTEA", T.DateType: "DATE", T.TimestampType: "TIMESTAMPTZ",
    T.TimestampNTZType: "TIMESTAMP", T.DecimalType: "NUMERIC",
}
RECEIPTS = "write_receipts"
ROWS = 10_000
#: Rows that a task stages in one transaction: long enough that tasks seldom wait for a lock or a disk, short enough for memory.
STAGED_ROWS = 50_000


def quoted(name: str) -> str:
    """An identifier; a dot parts schema and table."""
    return ".".join('"' + p.replace('"', '""') + '"' for p in name.split("."))


class Database:
    """Connections to one database: a DB-API module and the address that its connect() takes."""

    def __init__(self, driver: str, address: str) -> None:
        self.driver, self.address = driver, address
        self.local = driver == "sqlite3"
        self.mark = "?" if importlib.import_module(driver).paramstyle == "qmark" else "%s"

    @contextmanager
    def cursor(self) -> Iterator:
        """A cursor on a connection of its own. What it does is one transaction if it begins one."""
        more = {"timeout": 300, "isolation_level": None} if self.local else {}
        connection = importlib.import_module(self.driver).connect(self.address, **more)
        try:
            yield connection.cursor()
        finally:
            connection.close()

    @contextmanager
    def transaction(self) -> Iterator:
        with self.cursor() as c:
            c.execute("BEGIN IMMEDIATE" if self.local else "BEGIN")
            try:
                yield c
            except BaseException:
                c.execute("ROLLBACK")
                raise
            c.execute("COMMIT")

    def columns(self, c, table: str) -> dict[str, str]:
        """The columns of a table or view with their types in lower case, without lengths; empty if there is no such table."""
        if self.local:
            c.execute(f"PRAGMA table_info({quoted(table)})")
            found = [(r[1], r[2]) for r in c.fetchall()]
        else:
            c.execute(f"SELECT column_name, data_type FROM information_schema.columns WHERE table_name = {self.mark} ORDER BY ordinal_position", (table.split(".")[-1],))
            found = c.fetchall()
        return {n: (t or "").lower().split("(")[0].strip() for n, t in found}

    def columns_of_query(self, c, query: str) -> dict[str, str]:
        """Those of a query, told by a temporary view; the database types no expression that it can't."""
        probe = f"probe_{uuid.uuid4().hex}"
        c.execute(f"CREATE TEMPORARY VIEW {probe} AS {query}")
        try:
            return self.columns(c, probe)
        finally:
            c.execute(f"DROP VIEW {probe}")

    def taken(self, kind: T.DataType) -> bool:
        """Whether the driver takes all values of a type as they are."""
        return not self.local or not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType))

    def value(self, v):
        """A value as the driver takes it."""
        if self.local and isinstance(v, (date, datetime, Decimal)):
            return v.isoformat() if isinstance(v, date) else str(v)
        return v


def _read_value(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.BooleanType):
        return bool(v)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(v[:10]) if isinstance(v, str) else v
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.fromisoformat(v) if isinstance(v, str) else v
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(v))
    return v if not isinstance(kind, T.StringType) or isinstance(v, str) else str(v)


def _read_column(found: Sequence, kind: T.DataType, t: pa.DataType) -> pa.Array:
    """The values of a column; numbers at once, unless the database holds something else among them."""
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType, T.DoubleType)):
        try:
            return pa.array(found, t)
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
            pass
    return pa.array([_read_value(v, kind) for v in found], t)


class Range(InputPartition):
    """low <= column < high; an open end takes all that is left, nulls go with the first range."""

    def __init__(self, low, high) -> None:
        self.low, self.high = low, high


Test = tuple[str, str, object]
COMPARED = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
PATTERNS = {"starts": ("", "%"), "ends": ("%", ""), "contains": ("%", "%")}


def passes(test: Test) -> Column:
    """A test as Spark takes it. Null passes `is null` alone."""
    name, op, value = test
    column = F.col(f"`{name}`")
    if op in COMPARED:
        return COMPARED[op](column, F.lit(value))
    if op in ("in", "not in"):
        return column.isin(list(value)) if op == "in" else ~column.isin(list(value))
    if op in ("is null", "is not null"):
        return column.isNull() if op == "is null" else column.isNotNull()
    if op in PATTERNS:
        return {"starts": column.startswith, "ends": column.endswith, "contains": column.contains}[op](value)
    raise ValueError(f"no such test: {op}")


class DatabaseSource(DataSource):
    """A table or query. Options: driver, address, table or query, columns (names, one a line: only these are read), where (tests
    as JSON), limit, partition_column and partitions (ranges of equal width, read in parallel); for writes strategy, keys,
    add_columns, job, batch."""

    @classmethod
    def name(cls) -> str:
        return "database"

    def _database(self) -> Database:
        return Database(self.options.get("driver", "sqlite3"), self.options["address"])

    def schema(self) -> T.StructType:
        database = self._database()
        with database.cursor() as c:
            types = database.columns(c, self.options["table"]) if self.options.get("table") else database.columns_of_query(c, self.options["query"])
        if not types:
            raise ValueError(f"no such table: {self.options.get('table')}")
        wanted = self.options["columns"].split("\n") if self.options.get("columns") else list(types)
        return T.StructType([T.StructField(n, READ_TYPES.get(types[n], T.StringType())) for n in wanted])

    def reader(self, schema: T.StructType) -> DatabaseReader:
        return DatabaseReader(self._database(), dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DatabaseWriter:
        return DatabaseWriter(self._database(), dict(self.options), schema, overwrite)


class DatabaseReader(DataSourceReader):
    """Reads with the tests of the option `where` in the database, which returns only rows that pass.

    Order of text is left to Spark, as a database may define it in another way; so is all that can't be said for sure.
    """

    def __init__(self, database: Database, options: dict, schema: T.StructType) -> None:
        self.database, self.options, self.schema = database, options, schema
        with database.cursor() as c:
            types = database.columns(c, options["table"]) if options.get("table") else database.columns_of_query(c, options["query"])
        self.types = {n: READ_TYPES.get(t, T.StringType()) for n, t in types.items()}
        cast = lambda t: CASTS.get(t, None if t in READ_TYPES else "text")
        self.as_sent = {n: f"CAST({quoted(n)} AS {cast(t)})" if cast(t) else quoted(n) for n, t in types.items()}
        made = [self._sql(*test) for test in json.loads(options.get("where", "[]"))]
        self.tests, self.values = [m[0] for m in made if m], [v for m in made if m for v in m[1]]

    def _sql(self, name: str, op: str, value) -> tuple[str, list] | None:
        """A test as SQL with its values; None if the database might take it otherwise than Spark."""
        column, mark, text = self.as_sent[name], self.database.mark, isinstance(self.types[name], T.StringType)
        known = lambda v: self.database.value(_read_value(v, self.types[name]))
        if op in ("is null", "is not null"):
            return f"{column} {op.upper()}", []
        if op in ("in", "not in"):
            return (f"{column} {op.upper()} ({', '.join([mark] * len(value))})", [known(v) for v in value]) if value and None not in value else None
        if op in PATTERNS and text:
            before, after = PATTERNS[op]
            literal = value.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
            return f"{column} LIKE {mark} ESCAPE '\\'", [before + literal + after]
        if op in COMPARED and value is not None and (not text or op in ("=", "<>")):
            return f"{column} {op} {mark}", [known(value)]
        return None

    def _statement(self, what: str, tests: Sequence[str] = ()) -> str:
        source = quoted(self.options["table"]) if self.options.get("table") else f"({self.options['query']}) AS source"
        every = [*self.tests, *tests]
        return f"SELECT {what} FROM {source}" + (f" WHERE {' AND '.join(every)}" if every else "")

    def partitions(self) -> list[InputPartition]:
        column, n = self.options.get("partition_column"), int(self.options.get("partitions", 8))
        if not column or self.options.get("limit"):
            return [Range(None, None)]
        with self.database.cursor() as c:
            c.execute(self._statement(f"min({quoted(column)}), max({quoted(column)})"), self.values)
            low, high = c.fetchone()
        if low is None:
            return [Range(None, None)]
        edges = sorted({low + (high - low) * k // n if isinstance(low, int) else low + (high - low) * k / n for k in range(1, n)} - {low})
        return [Range(a, b) for a, b in zip([None, *edges], [*edges, None])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        column, tests, values = quoted(self.options.get("partition_column", "")), [], []
        if partition.low is not None:
            tests, values = [f"{column} >= {self.database.mark}"], [partition.low]
        if partition.high is not None:
            below = f"{column} < {self.database.mark}"
            tests, values = [*tests, below if partition.low is not None else f"({below} OR {column} IS NULL)"], [*values, partition.high]
        target = to_arrow_schema(self.schema)
        limit = f" LIMIT {int(self.options['limit'])}" if self.options.get("limit") else ""
        with self.database.cursor() as c:
            c.execute(self._statement(", ".join(self.as_sent[n] for n in self.schema.names), tests) + limit, [*self.values, *values])
            while rows := c.fetchmany(ROWS):
                columns = [_read_column(found, f.dataType, t.type) for found, f, t in zip(zip(*rows), self.schema, target)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


class Staged(WriterCommitMessage):
    def __init__(self, task: str, rows: int) -> None:
        self.task, self.rows = task, rows


class DatabaseWriter(DataSourceArrowWriter):
    """Tasks put their rows, marked by an id of the attempt, into a staging table of the job. When all are done, one
    transaction brings the rows of the attempts that counted into the table and notes a receipt; a job that fails only drops its
    staging table. A job that commits again finds its receipt and changes nothing."""

    def __init__(self, database: Database, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.database, self.schema, self.table = database, schema, options["table"]
        self.strategy, self.keys = options.get("strategy", "truncate_insert" if overwrite else "append"), [k for k in options.get("keys", "").split("\n") if k]
        self.add_columns, self.batch, self.job = options.get("add_columns") == "true", int(options.get("batch", 1000)), options.get("job") or uuid.uuid4().hex
        self.stage = f"stage_{self.job}"
        if bad := [f.name for f in schema if type(f.dataType) not in WRITE_TYPES]:
            raise ValueError(f"a database table can't hold {bad}")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"no such strategy: {self.strategy}")
        if self.strategy in ("merge", "delete_insert") and not self.keys:
            raise ValueError(f"{self.strategy} needs keys")
        if missing := [k for k in self.keys if k not in schema.names]:
            raise ValueError(f"no such columns: {missing}")

    def _definition(self, f: T.StructField) -> str:
        kind = f.dataType
        return f"{quoted(f.name)} {WRITE_TYPES[type(kind)]}" + (f"({kind.precision}, {kind.scale})" if isinstance(kind, T.DecimalType) else "")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        task, n, marks = uuid.uuid4().hex, 0, ", ".join([self.database.mark] * (len(self.schema) + 1))
        with self.database.cursor() as c:
            c.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.stage)} ({', '.join(map(self._definition, self.schema))}, task_ TEXT)")
        ready, plain = [], [self.database.taken(f.dataType) for f in self.schema]

        def put() -> int:
            rows = sum(map(len, ready))
            if rows:
                with self.database.transaction() as c:  # what it writes is at hand, so tasks don't wait for each other's input
                    for some in ready:
                        c.executemany(f"INSERT INTO {quoted(self.stage)} VALUES ({marks})", some)
            ready.clear()
            return rows

        for batch in iterator:
            for start in range(0, len(batch), self.batch):
                columns = [c.to_pylist() for c in batch.slice(start, self.batch).columns]
                columns = [c if fine else [*map(self.database.value, c)] for c, fine in zip(columns, plain)]
                ready.append([*zip(*columns, repeat(task))])
                if sum(map(len, ready)) >= STAGED_ROWS:
                    n += put()
        n += put()
        return Staged(task, n)

    def commit(self, messages: list[Staged]) -> None:
        table, stage, done = quoted(self.table), quoted(self.stage), quoted(f"{self.stage}_done")
        names = [quoted(n) for n in self.schema.names]
        same = " AND ".join(f"t.{quoted(k)} = s.{quoted(k)}" for k in self.keys)
        rows = f"(SELECT {', '.join(names)} FROM {stage} WHERE task_ IN (SELECT task FROM {done}))"
        with self.database.transaction() as c:
            receipts = quoted(RECEIPTS)
            c.execute(f"CREATE TABLE IF NOT EXISTS {receipts} (job TEXT PRIMARY KEY, strategy TEXT, rows_inserted BIGINT, rows_updated BIGINT, rows_deleted BIGINT)")
            c.execute(f"SELECT count(*) FROM {receipts} WHERE job = {self.database.mark}", (self.job,))
            if c.fetchone()[0]:
                return
            if not messages:  # a plan without partitions has staged nothing
                c.execute(f"CREATE TABLE IF NOT EXISTS {stage} ({', '.join(map(self._definition, self.schema))}, task_ TEXT)")
            c.execute(f"CREATE TABLE {done} (task TEXT)")
            c.executemany(f"INSERT INTO {done} VALUES ({self.database.mark})", [(m.task,) for m in messages if m])
            count = lambda sql: (c.execute(f"SELECT count(*) FROM {sql}"), c.fetchone()[0])[1]
            self._prepare(c, table)
            total, updated, deleted = sum(m.rows for m in messages if m), 0, 0
            if self.strategy == "truncate_insert":
                deleted = count(table)
                c.execute(f"DELETE FROM {table}")
            elif self.strategy in ("merge", "delete_insert"):
                rows = self._keyed(c, "_rows", f"SELECT * FROM {rows} s")
            if self.strategy == "delete_insert":
                gone = f"{table} AS t WHERE EXISTS (SELECT 1 FROM {rows} s WHERE {same})"
                deleted = count(gone)
                c.execute(f"DELETE FROM {gone}")
            elif self.strategy == "merge":
                keys = ", ".join(f"s.{quoted(k)}" for k in self.keys)
                hits = self._keyed(c, "_hits", f"SELECT DISTINCT {keys} FROM {table} t JOIN {rows} s ON {same}")
                there = f"EXISTS (SELECT 1 FROM {hits} t WHERE {same})"
                matched, rest = count(f"{rows} s WHERE {there}"), [n for n in self.schema.names if n not in self.keys]
                c.execute(f"CREATE TABLE {quoted(self.stage + '_new')} AS SELECT * FROM {rows} s WHERE NOT {there}")
                if rest:
                    updated = matched
                    c.execute(f"UPDATE {table} AS t SET {', '.join(f'{quoted(n)} = s.{quoted(n)}' for n in rest)} FROM {rows} s WHERE {same}")
                rows, total = quoted(self.stage + "_new"), total - matched
            c.execute(f"INSERT INTO {table} ({', '.join(names)}) SELECT {', '.join(names)} FROM {rows} s")
            c.execute(f"INSERT INTO {receipts} VALUES ({', '.join([self.database.mark] * 5)})", (self.job, self.strategy, total, updated, deleted))
            for extra in ("", "_done", "_rows", "_hits", "_new"):
                c.execute(f"DROP TABLE IF EXISTS {quoted(self.stage + extra)}")

    def _keyed(self, c, extra: str, sql: str) -> str:
        """A table of the job, found by key: with an index where the database joins by nothing else. Without one it reads the whole table for each row."""
        name = quoted(self.stage + extra)
        c.execute(f"CREATE TABLE {name} AS {sql}")
        if self.database.local:
            c.execute(f"CREATE INDEX {quoted(self.stage + extra + '_index')} ON {name} ({', '.join(map(quoted, self.keys))})")
        return name

    def _prepare(self, c, table: str) -> None:
        """Makes the table if it isn't there; adds columns if that is allowed."""
        known = self.database.columns(c, self.table)
        if not known:
            c.execute(f"CREATE TABLE {table} ({', '.join(map(self._definition, self.schema))})")
        elif new := [f for f in self.schema if f.name not in known]:
            if not self.add_columns:
                raise ValueError(f"the table has no columns {[f.name for f in new]}")
            for f in new:
                c.execute(f"ALTER TABLE {table} ADD COLUMN {self._definition(f)}")

    def abort(self, messages: list[Staged | None]) -> None:
        with self.database.cursor() as c:
            c.execute(f"DROP TABLE IF EXISTS {quoted(self.stage)}")


def read_database(spark: SparkSession, address: str, table: str | None = None, query: str | None = None, columns: list[str] | None = None, where: list[Test] | None = None, split: tuple[str, int] | None = None, limit: int | None = None, driver: str = "sqlite3") -> DataFrame:
    """A table or a query (just one of them). `columns` are all that is read; split: (column, number of ranges) reads in parallel.

    where: tests (column, operator, value) that all must pass; operators are = <> < <= > >=, in, not in, is null, is not null, starts,
    ends, contains. Of a table the database returns only rows that pass, as far as it takes a test as Spark does, and Spark
    checks all tests once more. `limit` rows at most are asked for, after the tests, which must then be of kinds that the
    database decides alone. Each call is a scan of its own: filters put on the result later are Spark's.
    """
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    tests = where or []
    spark.dataSource.register(DatabaseSource)
    pushed = json.dumps(tests, default=lambda v: v.isoformat() if isinstance(v, date) else str(v)) if table else "[]"
    reading = list(dict.fromkeys([*columns, *(t[0] for t in tests)])) if columns else []
    options = {"driver": driver, "address": address, "table": table, "query": query, "columns": "\n".join(reading), "where": pushed}
    if split:
        options |= {"partition_column": split[0], "partitions": split[1]}
    if limit is not None:
        reader = DatabaseReader(Database(driver, address), options, T.StructType())
        if len(reader.tests) < len(tests):
            raise ValueError("the database can't decide all tests, so it can't limit the rows that pass")
        options["limit"] = limit
    df = spark.read.format("database").options(**{k: v for k, v in options.items() if v}).load()
    for t in tests:
        df = df.filter(passes(t))
    return df.select(*(f"`{c}`" for c in columns)) if columns else df


def write_database(df: DataFrame, address: str, table: str, strategy: str = "append", keys: list[str] | None = None, order: str | None = None, add_columns: bool = False, indexes: list[list[str]] | None = None, batch: int = 1000, driver: str = "sqlite3") -> dict:
    """Writes all of `df` in one transaction and gives its receipt: strategy, rows_inserted, rows_updated, rows_deleted.

    append adds; truncate_insert empties the table first; merge replaces all other columns of rows whose keys match, and adds
    the rest (if every column is a key, matched rows stay); delete_insert deletes matches first, then adds every row. Null keys
    match nothing. Repeated keys of a merge are an error unless `order` says which row is the last. Nested columns are
    refused. Columns that the table lacks are an error unless add_columns. `indexes` (lists of columns) are made afterwards.
    """
    if strategy == "merge" and keys:
        df = latest_rows(df, keys, order)
    df.sparkSession.dataSource.register(DatabaseSource)
    job = uuid.uuid4().hex
    options = {"driver": driver, "address": address, "table": table, "strategy": strategy, "keys": "\n".join(keys or []), "add_columns": str(add_columns).lower(), "job": job, "batch": batch}
    DatabaseWriter(Database(driver, address), options, df.schema, False)  # refuses here what it can't write
    df.write.format("database").mode("append").options(**options).save()
    database = Database(driver, address)
    with database.transaction() as c:
        for names in indexes or []:
            c.execute(f"CREATE INDEX IF NOT EXISTS {quoted('_'.join([table, *names, 'index']))} ON {quoted(table)} ({', '.join(map(quoted, names))})")
        c.execute(f"SELECT strategy, rows_inserted, rows_updated, rows_deleted FROM {quoted(RECEIPTS)} WHERE job = {database.mark}", (job,))
        return dict(zip(("strategy", "rows_inserted", "rows_updated", "rows_deleted"), c.fetchone()))
