"""Corpus preparation in stages; each stage takes what the one before has kept."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, langid, lines, mixing, nearjoin
from tidewright.llm.common import cut, table

#: Least mean of the words' largest marginals. It asks whether each word has a sure language, not whether all have the same, so code-switched documents stay.
CERTAIN = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose words have a sure language; those without letters, null and empty texts included, go.

    Repeated rows have one fate; without a document to learn from none is kept.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    found = rows.withColumn("found", langid.language(rows, langid.train(docs)))
    return found.filter((F.col("found.lang_pred") != langid.UNKNOWN) & (F.col("found.sure") >= CERTAIN)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each group of lines; documents of which nothing is left go.

    Null and empty texts have no lines and stay. Rows that share an id are one document. An empty table gives no rows.
    """
    out = lines.dedup_lines(docs.withColumn("own_", F.struct(*docs.columns)))
    out = out.filter((F.col("removed_") == 0) | (F.trim("text") != ""))
    own = lambda c: F.col("text") if c == "text" else F.length("text").cast("long") if c == "n_chars" else F.col(f"own_.`{c}`")
    return out.select(*(own(c).alias(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of the least id, and of its texts the one of the least hash.

    Repeated rows of one id and text are copies, so one of them stays. Null and empty texts are in no group: one row for
    each id stays. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("doc_id", F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), F.col("text").isNull().alias("none")).alias("key_"), F.struct(*docs.columns).alias("own_"))
    kept = nearjoin.near_groups(rows.select("key_", F.col("own_.text").alias("text")), "key_").filter("kept").select(F.col("key_").alias("kept_"))
    return rows.join(kept, rows["key_"].eqNullSafe(F.col("kept_")), "left_semi").dropDuplicates(["key_"]).select("own_.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources come near their weights. Null and empty texts have size 0 and are taken like others; rows that share an id share the number of copies."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to, as digests; a null text counts as empty."""
    return bpe.digests(bpe.encode_decode(docs, path("byte_bpe_50k.json")))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mix", mix_sources), ("bpe", encode)]
#: The stages hold a trained model and a random join, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each cut from the one before at the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if k else docs, sf_dir)
    return docs
