"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import file_parts


#: Names of storage options and the settings of Hadoop's file systems that they stand for; {account} is the Azure account (fixed values).
STORAGE = {
    "aws_access_key_id": "fs.s3a.access.key", "aws_secret_access_key": "fs.s3a.secret.key", "aws_session_token": "fs.s3a.session.token",
    "aws_region": "fs.s3a.endpoint.region", "aws_endpoint": "fs.s3a.endpoint", "google_service_account": "fs.gs.auth.service.account.json.keyfile",
    "azure_storage_account_key": "fs.azure.account.key.{account}.dfs.core.windows.net", "azure_storage_sas_token": "fs.azure.sas.fixed.token.{account}.dfs.core.windows.net",
}
_PROVIDER = "fs.s3a.aws.credentials.provider"


def located(path: str, storage: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """A path as Hadoop names it, and the options of one read or write that give it its credentials.

    s3:// becomes s3a://, az://container/... becomes abfss:// in the account of azure_storage_account_name; other paths stay.
    Options may be those of STORAGE, aws_allow_http, aws_skip_signature (read without credentials) or any fs.* setting; others
    are an error. They hold for this read alone, not for the session. Without options the cluster's own settings serve.
    """
    given = dict(storage or {})
    account = given.pop("azure_storage_account_name", "")
    if path.startswith("s3://"):
        path = "s3a" + path[2:]
    elif path.startswith("az://"):
        if not account:
            raise ValueError("az:// paths need azure_storage_account_name")
        container, _, rest = path[5:].partition("/")
        path = f"abfss://{container}@{account}.dfs.core.windows.net/{rest}"
    options = {}
    if given.pop("aws_allow_http", "false").lower() in ("1", "true"):
        options["fs.s3a.connection.ssl.enabled"] = "false"
    if given.pop("aws_skip_signature", "false").lower() in ("1", "true"):
        options[_PROVIDER] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    elif "aws_session_token" in given:
        options[_PROVIDER] = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
    for name, value in given.items():
        if name not in STORAGE and not name.startswith("fs."):
            raise ValueError(f"no such storage option: {name}")
        options[STORAGE.get(name, name).format(account=account)] = value
    if "aws_endpoint" in given:
        options["fs.s3a.path.style.access"] = "true"
    return path, options


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, quote: str = '"', null_values: tuple[str, ...] = (), schema: T.StructType | None = None, storage: dict[str, str] | None = None) -> DataFrame:
    """CSV files or a glob, of any store (`located`). Each of `null_values` becomes null before the columns are cast to the schema (inferred if absent)."""
    path, access = located(path, storage)
    options, reader = {"sep": delimiter, "header": header, "quote": quote}, spark.read.options(**access)
    if not null_values:
        return reader.csv(path, schema=schema, inferSchema=schema is None, **options)
    text = reader.csv(path, **options)
    clean = text.select(*(F.when(F.col(f"`{c}`").isin(list(null_values)), None).otherwise(F.col(f"`{c}`")).alias(c) for c in text.columns))
    if schema is None:
        return clean
    return clean.select(*(F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(clean.columns, schema)))


def read_parquet(spark: SparkSession, path: str, partition_columns: bool = False, storage: dict[str, str] | None = None) -> DataFrame:
    """Parquet files or a glob (none matching is Spark's error), of any store (`located`). Partition values stay strings."""
    path, access = located(path, storage)
    reader = spark.read.options(**access)
    if not partition_columns:
        return reader.parquet(path)
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return reader.parquet(path)
    finally:
        spark.conf.set(key, before)


def read_json(spark: SparkSession, path: str, data_path: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """JSON bodies, one a file: rows at a dotted path; a single object is one row."""
    body = spark.read.json(path, multiLine=True, schema=schema)
    if not data_path:
        return body
    kind = body.select(data_path).schema[0].dataType
    at = F.explode(data_path) if isinstance(kind, T.ArrayType) else F.col(data_path)
    return body.select(at.alias("row")).select("row.*")


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    if mode not in ("overwrite", "append"):
        raise ValueError(mode)
    df.write.mode(mode).csv(path, sep=delimiter, header=header)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", block_bytes: int | None = None, sort_by: tuple[str, ...] = ()) -> None:
    """Parquet, snappy by default; rows may be sorted within files, which serves as an index."""
    if compression not in ("snappy", "gzip", "zstd", "none"):
        raise ValueError(compression)
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite").option("compression", compression)
    (writer.option("parquet.block.size", block_bytes) if block_bytes else writer).parquet(path)


def arrivals(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """Files at a path or glob that aren't in `seen` (file_path): file_path, file_name, file_dir, file_ext, length, modified."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified"))
    if seen is not None:
        found = found.join(seen, "file_path", "left_anti")
    return found.select("file_path", *(c.alias(n) for n, c in file_parts(F.col("file_path")).items()), "length", "modified")


def arrival_summary(files: DataFrame) -> DataFrame:
    """One row: file_count, and the sorted file_paths."""
    return files.agg(F.count("*").alias("file_count"), F.array_sort(F.collect_list("file_path")).alias("file_paths"))


def inferred_rows(rows: DataFrame, column: str, types: dict[str, str] | None = None) -> DataFrame:
    """The objects in a column of JSON text as columns. Types are found over all rows; `types` (column to type) goes before.

    A column that is null everywhere is text; nested objects and arrays stay JSON text; a value that doesn't fit its type is null.
    """
    found = rows.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]
    fields = T.StructType.fromDDL(f"r {found.replace('OBJECT<', 'STRUCT<')}")["r"].dataType if found and found.startswith("OBJECT<") else T.StructType()
    text = (T.StructType, T.ArrayType, T.NullType, T.VariantType)
    kinds = {f.name: "string" if isinstance(f.dataType, text) else f.dataType.simpleString() for f in fields} | (types or {})
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return rows.select(F.from_json(column, schema).alias("r")).select("r.*") if kinds else rows.select()


#: Rows in one bucket, and least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 8


def buckets_for(*tables: DataFrame) -> int:
    """A number of buckets that grows with the largest of some tables, so that a bucket, which one task sorts and joins, doesn't."""
    return max(LEAST_BUCKETS, *(-(-t.count() // BUCKET_ROWS) for t in tables))


def write_buckets(df: DataFrame, table: str, columns: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """A table of the catalog (its files at `path`, or in the warehouse), its rows dealt into buckets by a hash of the columns and sorted by them in each file; gives the table.

    Two tables with the same number of buckets join on these columns, and group by them, without an exchange. Rows are
    dealt before they are written, so a bucket is one file.
    """
    writer = df.repartition(buckets, *columns).write.mode("overwrite").bucketBy(buckets, *columns).sortBy(*columns).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def _at_most(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))


def interleaved(df: DataFrame, columns: list[str], bits: int = 8) -> Column:
    """A place on a curve on which rows that are near in all the columns are near: the bits of each column's rank class, in turn.

    Classes have equally many rows, by approximate percentiles (one pass); nulls are in the first.
    """
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 1 << (bits + 5)).alias(c) for c in columns)).first()  # numbers only: 2 ** bits for each column
    place = F.lit(0).cast("long")
    for n, c in enumerate(columns):
        edges = F.array(*(F.lit(float(x)) for x in sorted(set(cuts[c] or []))))
        value = F.col(c).cast("double")
        rank = F.when(value.isNull(), 0).otherwise(_at_most(edges, value))
        for b in range(bits):
            place = place + F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)).cast("long"), b * len(columns) + n)
    return place


def write_interleaved(df: DataFrame, path: str, columns: list[str], files: int) -> None:
    """Parquet whose files each cover a small range of all the columns (numbers, dates or times), so that a filter on any of them rules files and row groups out by their statistics."""
    placed = df.withColumn("place_", interleaved(df, columns))
    placed.repartitionByRange(files, "place_").sortWithinPartitions("place_").drop("place_").write.mode("overwrite").parquet(path)
