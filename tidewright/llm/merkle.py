"""Merkle manifest of a dataset: every few levels are stored, the levels between are made again for proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .order import placed

#: Levels from one stored level to the next; a stored node stands for up to 2 ** STEP nodes of the stored level below.
STEP = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(encoded, values)))


def _interior(nodes: DataFrame, *carried: str) -> DataFrame:
    """A row for each aligned subtree: tree, up (its place among the subtrees), size (nodes of the tree at this level),
    below (the stored nodes in order) and level_0 to level_STEP, the digests of each level of the subtree. At most 2 ** STEP nodes are in a group."""
    struct = F.struct("place", "digest", *carried)
    df = nodes.groupBy("tree", F.shiftright("place", STEP).alias("up")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(struct)).alias("below"))
    df = df.withColumn("level_0", F.col("below.digest"))
    for k in range(STEP):
        df = df.withColumn(f"level_{k + 1}", F.when(_nodes(k) > 1, _hashed_runs(f"level_{k}")).otherwise(F.col(f"level_{k}")))
    return df


def _hashed_runs(level: str) -> Column:
    """The level above: every two digests in a row become one; the last alone, if their number is odd."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(runs, lambda i: digest(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))))


def _nodes(k: int) -> Column:
    """Nodes of the whole tree k levels above a stored one."""
    return F.shiftright(F.col("size") + (1 << k) - 1, k)


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels of all trees from the leaves up, each cut; the last has one node a tree, its root.

    leaves: tree (no nulls), place (from 0), size (leaves of the tree), digest, and columns of the leaves alone. While a tree
    has more than one node, every two in a row (the last alone, if their number is odd) become the hash of their hex texts.
    A tree that has come to one node stays as it is.
    """
    levels = [cut(leaves)]
    most = levels[0].agg(F.max("size")).first()[0] or 0  # one number
    while most > 1:
        up = _interior(levels[-1].select("tree", "place", "size", "digest"))
        levels.append(cut(up.select("tree", F.col("up").alias("place"), _nodes(STEP).alias("size"), F.get(f"level_{STEP}", F.lit(0)).alias("digest"))))
        most = (most + (1 << STEP) - 1) >> STEP
    return levels


def proofs(levels: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Each leaf with its path: a list of (sibling, left) from the leaf up, sibling being null where the run has one node.

    above: tree, path (that of the tree's root in what lies above, may be empty) and columns to keep. From the top stored level
    down, each aligned subtree's interior is made again from its stored nodes, its siblings are put before the path of its
    root, and it is dropped. Gives tree, digest, path, the columns of `above` and those of `carried`.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    paths = levels[-1].join(above, "tree").select("tree", "place", "path", *extra, "digest", *(carried if len(levels) == 1 else []))
    for n in range(len(levels) - 2, -1, -1):
        kept = carried if n == 0 else []
        blocks = _interior(levels[n], *kept).join(paths.select("tree", F.col("place").alias("up"), "path", *extra), ["tree", "up"])

        def own(p: Column) -> Column:
            at = lambda k: F.shiftright(p, k)
            found = [F.when(_nodes(k) > 1, F.struct(F.get(f"level_{k}", at(k).bitwiseXOR(F.lit(1))).alias("sibling"), (at(k).bitwiseAND(F.lit(1)) == 1).alias("left"))) for k in range(STEP)]
            return F.array_compact(F.array(*found))

        with_path = F.transform("below", lambda x, p: F.struct(x["place"].alias("place"), x["digest"].alias("digest"), *(x[c].alias(c) for c in kept), F.concat(own(p), F.col("path")).alias("path")))
        paths = blocks.select("tree", *extra, F.explode(with_path).alias("row")).select("tree", *extra, "row.*")
    return paths.drop("place")


def folded(digest_: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    joined = lambda x, acc: F.when(x["left"], F.concat(x["sibling"], acc)).otherwise(F.concat(acc, F.coalesce(x["sibling"], F.lit(""))))
    return F.aggregate(path, digest_, lambda acc, x: digest(joined(x, acc)))


def manifest(df: DataFrame, group: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, count: str = "n_chars") -> tuple[list[DataFrame], list[DataFrame]]:
    """The stored levels of the trees of all groups, and those of the tree over their roots, from the leaves up; the last table of the second list holds the root.

    Each row is a leaf: the hash of its encoded fields. Leaves ascend by id (null first; rows that share an id by their
    digests, so equal rows stand together), groups by the bytes of their name (null first). A leaf also carries its id and
    `tampered`, the digest with 1 added to `count`, where the id's crc32 is divisible by 7 and the count isn't null. An empty
    table has no root. Only ids, groups and digests are shuffled, not the texts; of any length, they are hashed whole.
    """
    value = lambda c: F.col(f"`{c}`")
    tree = F.when(value(group).isNull(), "").otherwise(F.concat(F.lit("="), value(group).cast("string")))
    more = [value(c).cast("decimal(38,0)") + 1 if c == count else value(c) for c in fields]
    chosen = (F.crc32(value(id_col).cast("string").cast("binary")) % 7 == 0) & value(count).isNotNull()
    rows = df.select(tree.alias("tree"), value(id_col).alias("key"), leaf([value(c) for c in fields]).alias("digest"), F.when(chosen, leaf(more)).alias("tampered"))
    rows = placed(rows, "tree", F.col("key").asc_nulls_first(), F.col("digest").asc())
    trees = stored_levels(rows.select("tree", F.col("place_").alias("place"), F.col("count_").alias("size"), "digest", "key", "tampered"))
    roots = placed(trees[-1].select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), "all", F.col("name").asc())
    return trees, stored_levels(roots.select(F.col("all").alias("tree"), F.col("place_").alias("place"), F.col("count_").alias("size"), "digest", "name"))


def verified(trees: list[DataFrame], top: list[DataFrame], id_col: str = "doc_id") -> DataFrame:
    """One row for each leaf of a manifest: its id, leaf, subroot, root, proof_sha256 (hash of its siblings' hex texts), path, folded_root (of the tampered leaf where there is one) and verified (folded_root is the root)."""
    root = top[-1].select("digest").first()  # one digest; None for an empty table
    whole = top[-1].select("tree", F.array().cast("array<struct<sibling:string,left:boolean>>").alias("path"))
    above = proofs(top, whole, ["name"]).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    rows = proofs(trees, above, ["key", "tampered"]).withColumn("root", F.lit(root[0] if root else None).cast("string"))
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    siblings = digest(F.concat_ws("", F.transform("path", lambda x: x["sibling"])))
    return rows.select(F.col("key").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", siblings.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path")


def _op12(spark, sf_dir):
    return verified(*manifest(table(spark, sf_dir, "documents"))).drop("path")


def queries() -> dict:
    return {"op12_merkle_manifest": _op12}


def _part(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def oracle_sql() -> dict[str, str]:
    parts = lambda n: " || ".join(_part(n if c == "n_chars" else c) for c in FIELDS)
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda a, b: {})) % 7 = 0"
    step = "xor(a, b)"
    for _ in range(8):
        step = f"[xor(t >> 1, 3988292384 * (t & 1)) for t in [{step}]][1]"
    sql = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({parts('n_chars')}) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {crc.format(step)} THEN sha256({parts('(n_chars + 1)')}) END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (SELECT tree, 0 AS lvl, place, n, leaf AS digest FROM p
  UNION ALL SELECT tree, lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY tree, lvl, place // 2, n),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, place, n, subroot AS digest FROM s
  UNION ALL SELECT lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY lvl, place // 2, n),
i AS (SELECT p.tree, p.place, w.lvl, o.digest, o.place < (p.place >> w.lvl) AS before
  FROM p JOIN (SELECT DISTINCT tree, lvl, n FROM t WHERE n > 1) w ON p.tree = w.tree LEFT JOIN t o ON o.tree = p.tree AND o.lvl = w.lvl AND o.place = xor(p.place >> w.lvl, 1)),
j AS (SELECT s.tree, w.lvl, o.digest, o.place < (s.place >> w.lvl) AS before
  FROM s CROSS JOIN (SELECT DISTINCT lvl, n FROM u WHERE n > 1) w LEFT JOIN u o ON o.lvl = w.lvl AND o.place = xor(s.place >> w.lvl, 1)),
m AS (SELECT tree, place, lvl, digest, before FROM i UNION ALL SELECT p.tree, p.place, 1000 + j.lvl, j.digest, j.before FROM p JOIN j ON p.tree = j.tree),
h AS (SELECT tree, place, list(CASE WHEN before THEN 'L' ELSE 'R' END || coalesce(digest, '') ORDER BY lvl) AS path, string_agg(digest, '' ORDER BY lvl) AS siblings FROM m GROUP BY 1, 2),
f AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(coalesce(h.siblings, '')) AS proof_sha256,
       list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(h.path, [])), lambda v, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || v ELSE v || x[2:] END)) AS folded_root
  FROM p JOIN s ON p.tree = s.tree LEFT JOIN h ON h.tree = p.tree AND h.place = p.place)
SELECT *, folded_root = root AS verified FROM f"""
    return {"op12_merkle_manifest": sql}
