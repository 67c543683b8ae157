"""Resource catalog: discovery, annotations, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tokens


def discover(bindings: DataFrame) -> DataFrame:
    """Producers and consumers of each resource."""
    who = lambda d: F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("pipeline_id"))))
    return bindings.groupBy("resource_fingerprint").agg(who("sink").alias("producers"), who("source").alias("consumers"))


def merge_annotations(found: DataFrame, notes: DataFrame) -> DataFrame:
    """Discovered resources with their annotations; a name by default is the last part of the path."""
    last = F.regexp_extract("resource_fingerprint", "([^/]*)$", 1)
    return found.join(notes, "resource_fingerprint", "left").withColumn("name", F.coalesce("name", last))


def merge_columns(schema: DataFrame, notes: DataFrame) -> DataFrame:
    """Columns of the schema, then those that are only annotated: name, type, description, annotated_only."""
    return schema.join(notes, "name", "full").select("name", "type", "description", F.col("type").isNull().alias("annotated_only"))


def dangling_annotations(notes: DataFrame, found: DataFrame) -> DataFrame:
    return notes.join(found.select("resource_fingerprint"), "resource_fingerprint", "left_anti")


def duplicate_annotations(files: DataFrame) -> DataFrame:
    return files.groupBy("resource_fingerprint").agg(F.count("*").alias("n")).filter("n > 1")


def token_index(rows: DataFrame, key: str, texts: list[str], whole: tuple[str, ...] = ()) -> DataFrame:
    """key, token: tokens of the texts, and whole values (arrays or strings) in lower case."""
    out = rows.select(key, F.explode(F.concat(*(F.coalesce(tokens(F.col(t)), F.array().cast("array<string>")) for t in texts))).alias("token"))
    for w in whole:
        one = F.explode(w) if rows.schema[w].dataType.typeName() == "array" else F.col(w)
        out = out.unionByName(rows.select(key, one.alias("token")).select(key, F.lower("token").alias("token")))
    return out.distinct()


def search(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Keys for which every word is part of some token."""
    hits = F.array(*(F.when(F.col("token").contains(w.lower()), F.lit(k)) for k, w in enumerate(words)))
    hit = index.select(key, F.explode(hits).alias("word")).filter("word is not null")
    return hit.groupBy(key).agg(F.count_distinct("word").alias("n")).filter(F.col("n") == len(words)).select(key)


def with_tag(rows: DataFrame, tag: str) -> DataFrame:
    return rows.filter(F.array_contains("tags", tag))


def all_tags(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag")).distinct()


def with_owner(rows: DataFrame, owner: str) -> DataFrame:
    return rows.filter(F.col("owner") == owner)


def all_owners(rows: DataFrame) -> DataFrame:
    """Owners with the number of resources they have; none for resources without one."""
    return rows.filter(F.col("owner").isNotNull()).groupBy("owner").agg(F.count("*").alias("resources"))


def resolve_environment(tables: DataFrame, chain: list[str]) -> DataFrame:
    """The location of each table in the first environment of the chain that has it: tables (table, environment, location)."""
    place = F.array_position(F.array(*map(F.lit, chain)), F.col("environment"))
    return tables.withColumn("place", place).filter("place > 0").groupBy("table").agg(F.min_by("location", "place").alias("location"), F.min_by("environment", "place").alias("environment"))
