"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch. Texts can be long, so a batch of Spark's default 10,000 rows may not fit in a worker.
BATCH_ROWS = 1000
#: Characters that a Python task handles together.
GROUP_CHARS = 500_000
#: Rows that a task takes of a table that is dealt by its size (fitted); of a table without texts or sets.
TASK_ROWS, NARROW_ROWS = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Texts can be long, so Arrow batches of the session hold BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the checkpoint folder that all executors share (spark.checkpoint.dir), and cuts its lineage. Only one machine may do without a folder: there a temporary one serves."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def fitted(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """A cut of a table that is read again by no more tasks than its rows need: a task that shuffles writes a file for each partition, however few rows it has."""
    rows = Observation()
    out = cut(df.observe(rows, F.count(F.lit(1)).alias("n")))
    return out.coalesce(1 + rows.get["n"] // task_rows)


def groups(texts: list[str], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs (start, end) of at most `most` characters, or one text."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if texts:
        yield start, len(texts)


@lru_cache(maxsize=1)
def kept(owner: str) -> dict:
    """What a worker keeps of its words from batch to batch; that of the owner before goes, since workers outlive the stages of a job."""
    return {}


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_texts(df: DataFrame, id_col: str, text_col: str, columns: str, fn: Callable[[list[str]], list[list]]) -> DataFrame:
    """Runs `fn(texts) -> columns` over Arrow batches; gives the id and `columns` (a DDL string). A null text counts as empty.

    Only the two named columns are read, so other columns of `df` may have any name.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL(columns).fields])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                made = fn(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(out[0].type), *(pa.array(c, f.type) for c, f in zip(made, list(out)[1:]))], schema=out)

    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).mapInArrow(run, schema)
