"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Rows that share a cell on average if all fell into one band of sizes.
CELL_ROWS = 2000
#: Offsets from which a source takes the best.
OFFSETS = 64
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Id, source and number of words; a null text has none."""
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def running(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Adds <column>_before, the sum over all rows before in an order without ties, and <column>_all, the sum over all rows.

    Rows are range-partitioned; each partition sums its own, and the sums of those before are added. The only window over
    all rows has a row for each partition.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    sums = parts.groupBy("part_").agg(*(F.sum(c).alias(c) for c in columns))
    ahead = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part_", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_base") for c in columns), *(F.sum(c).over(W.partitionBy()).alias(f"{c}_all") for c in columns))
    own = W.partitionBy("part_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = parts.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{c}_before") for c in columns))
    out = local.join(F.broadcast(sums), "part_").withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_base") for c in columns})
    return out.drop("part_", *(f"{c}_base" for c in columns))


def targets(cells: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """The target of each source, whatever their number.

    A source is capped if, with all sources of a lower cap per weight capped, the level of the others would pass its cap.
    """
    s = cells.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    s = running(s, [F.col("source").asc_nulls_last()], ["one"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("one_before") % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", weight.cast("long").alias("weight"))
    s = running(s, [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()], ["source_size", "weight"])
    s = s.withColumn("left", F.col("source_size_all") - cap * F.col("source_size_before")).withColumn("share", F.col("weight_all") - F.col("weight_before"))
    s = cut(s.withColumn("capped", F.col("left") * F.col("weight") >= cap * F.col("source_size") * F.col("share")))
    level = s.filter("not capped").agg((F.max("left") / F.max("share")).alias("level")).first()["level"]  # one number
    return s.select("source", "source_size", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level).cast("double")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """How many copies of each document a mix takes, one row per row of `df`: the id, source, size (words), source_size, target, copies, taken.

    Sources in code-point order (null last, a source of its own) weigh `weights` in turn and share all words; no target
    passes `cap` times its source, and the excess goes to the others by weight. Every document of a source has the same
    expected number of copies, target / source_size. Documents stand in a fixed order (size band, hash, size, id); a
    document's copies are the integers that the running sum of expectations, plus one offset for the source, passes
    while it grows by this document. The offset is the one of OFFSETS, evenly spaced from a random start, with which the
    words taken come nearest the target (the first of equals). So no document has more than `cap` copies, and reruns agree.
    Null or empty texts have size 0 and add nothing to the words taken; repeated rows count each on its own; an empty table
    gives no rows.

    The running sum has three levels: totals of ranges of small cells (source, size band, hash of the id), cells within a
    range, rows within a cell. So no task holds a source.
    """
    d = cut(sizes(df, id_col, text_col, source_col))
    buckets = max(1, -(-d.count() // CELL_ROWS))
    hashed = lambda c, digits: F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("long")
    d = d.withColumns({"bits": F.length(F.bin("size"))}).withColumns(
        {"band": F.col("bits") * 8 + F.expr("shiftright(size, greatest(bits - 3, 0))"), "bucket": hashed(F.coalesce(F.col("id").cast("string"), F.lit("")), 8) % buckets, "absent": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}
    )
    keys, one = ["name", "absent", "band", "bucket"], ["name", "absent"]
    cells = cut(d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source")))
    goal = targets(cells, weights, cap).select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("absent"), "source_size", "target")
    placed = cut(running(cells.select(*keys, "n"), [F.col(k) for k in keys], ["n"]))
    first = placed.groupBy(*one).agg(F.min("n_before").alias("first")).join(goal, one)
    cells = placed.join(first, one).select(*keys, (F.col("n_before") - F.col("first")).alias("ahead"), "source_size", "target")
    rank = F.col("ahead") + F.row_number().over(W.partitionBy(*keys).orderBy("size", "id"))
    start = hashed(F.concat_ws("/", F.lit(seed), F.col("name"), F.col("absent").cast("string")), 5) / F.lit(float(1 << 20))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = cut(d.join(cells, keys).select("id", "source", *one, "size", "source_size", "target", rank.alias("rank"), start.alias("start"), rate.alias("rate")))
    offset = (F.col("start") + F.col("choice") / F.lit(float(OFFSETS))) % 1
    copies = F.floor(F.col("offset") + F.col("rate") * F.col("rank")) - F.floor(F.col("offset") + F.col("rate") * (F.col("rank") - 1))
    tried = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))).alias("choice")).withColumn("offset", offset)
    tried = tried.groupBy(*one, "choice").agg(F.sum(copies * F.col("size")).alias("words"), F.max("target").alias("goal"))
    best = tried.groupBy(*one).agg(F.min_by("choice", F.struct(F.abs(F.col("words") - F.col("goal")), "choice")).alias("choice"))
    out = out.join(best, one).withColumn("offset", offset).withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
n AS (SELECT greatest(1, (count(*) + 1999) // 2000) AS buckets FROM d),
e AS (SELECT d.*, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS band,
             ('0x' || substr(md5(coalesce(id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT buckets FROM n) AS bucket FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM s),
v AS (SELECT *, sum(source_size) OVER ()::BIGINT - 3 * coalesce(sum(source_size) OVER b, 0)::BIGINT AS rest,
             sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS share
      FROM w WINDOW b AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, rest * weight >= 3 * source_size * share AS capped FROM v),
g AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
             ELSE weight * (max(rest) FILTER (NOT capped) OVER () / max(share) FILTER (NOT capped) OVER ()) END AS target FROM c),
r AS (SELECT e.id, e.source, e.size, g.source_size, g.target, row_number() OVER (PARTITION BY e.source ORDER BY band, bucket, size, e.id) AS rank,
             CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('mix/' || coalesce(e.source, '') || '/' || (e.source IS NULL)::VARCHAR), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start
      FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source),
o AS (SELECT r.*, choice, (start + choice / 64.0::DOUBLE) % 1 AS offs FROM r, range(64) t(choice)),
b AS (SELECT source, choice FROM (SELECT source, choice, abs(sum(size * (floor(offs + rate * rank) - floor(offs + rate * (rank - 1)))::BIGINT)::DOUBLE - max(target)) AS off FROM o GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, choice) = 1),
k AS (SELECT o.*, (floor(offs + rate * rank) - floor(offs + rate * (rank - 1)))::BIGINT AS copies FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source AND o.choice = b.choice)
"""


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The rows of `df`, each as often as the mix takes its document. Rows that share an id share the copies of one of them."""
    taken, key = mix(df, **options), options.get("id_col", "doc_id")
    taken = taken.groupBy(F.col(key).alias("id")).agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("key")).join(taken, F.col("key").eqNullSafe(F.col("id")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def queries() -> dict:
    return {"op3_mix_sources": lambda spark, sf_dir: mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": MIX_SQL.replace("{docs}", "documents") + "SELECT id AS doc_id, size, source_size, target, copies * size AS taken FROM k"}
