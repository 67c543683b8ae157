"""I-Match fingerprints: terms of a band of inverse document frequency, hashed in randomised subsets of the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .order import placed

#: The band: terms that stand in at least one of RARE and at most one of COMMON documents.
RARE, COMMON = 2000, 10
#: The random subsets of the lexicon by depth. A term's random path has DEPTHS - 1 base-4 digits; a subset is given by a prefix of
#: the path. Subsets of depth k hold 4 ** -k of the terms: one at depth 0, all 4 at depth 1, all 16 at depth 2, then 16 again.
DEPTHS = 7
PREFIXES = [[""], [str(a) for a in range(4)], *([f"{a}{b}{'0' * k}" for a in range(4) for b in range(4)] for k in range(DEPTHS - 2))]
SUBSETS = sum(map(len, PREFIXES))
#: Bytes of one subset's hash; zeros stand for a subset without a term of the text.
BYTES = 2
#: Terms up to which a list of them is broadcast (about 100 bytes each); beyond, that join is shuffled.
BROADCAST = 300_000
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["absent_", "id_", "mark_"]


def terms(text: Column) -> Column:
    """Distinct terms: what stands between ASCII characters that are neither letters nor digits, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), APART)), "")


def path(term: Column) -> Column:
    """A term's random path: the first hex digits of its SHA-256, each divided by four."""
    return F.translate(F.substring(F.sha2(term.cast("binary"), 256), 1, DEPTHS - 1), "0123456789abcdef", "0000111122223333")


def lexicon(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The terms of the band, and those too common for it. Document frequencies count all rows.

    A term of the first list stands in one of RARE documents at least, one of the second in more than one of COMMON. So the
    lists have at most RARE and COMMON times the mean number of distinct terms of a document, however many documents there are.
    """
    n = df.count()
    found = df.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    found = cut(found.filter(F.col("n") >= -(-n // RARE)))
    return found.filter(F.col("n") <= n // COMMON).select("term", path(F.col("term")).alias("path")), found.filter(F.col("n") > n // COMMON).select("term")


def signature(df: DataFrame, entries: str, out: str) -> DataFrame:
    """Adds `out`, the fingerprint of an array of (term, path) sorted by term: the hashes of the terms of each subset, depth by depth."""
    hashed = lambda a: F.when(F.size(a) > 0, F.substring(F.unhex(F.md5(F.array_join(F.col(a)["term"], " ").cast("binary"))), 1, BYTES)).otherwise(F.lit(bytes(BYTES)))
    names = [entries]
    for depth in range(1, DEPTHS):

        def inside(prefix: str) -> Column:
            above = entries if depth == 1 else f"in_{prefix[:-1]}_"
            return F.filter(above, lambda x: F.substring(x["path"], depth, 1) == prefix[-1])

        made = {f"in_{prefix}_": inside(prefix) for prefix in PREFIXES[depth]}
        df, names = df.withColumns(made), names + list(made)
    return df.withColumn(out, F.concat(*map(hashed, names))).drop(*names[1:])


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds `out`, how like two fingerprints are, from 0 to 1: of the subsets that hold a term of either text, the share with equal hashes.

    Only depths at which some subset is empty for both count: where all hold terms, one edit changes nearly every hash. If
    that leaves nothing, all depths count. Equal fingerprints give 1.
    """
    part = lambda c, k: F.substring(F.col(c), k * BYTES + 1, F.lit(BYTES))
    none = F.lit(bytes(BYTES))
    state = lambda k: F.when(part(a, k) != part(b, k), 1).when(part(a, k) == none, 0).otherwise(2)
    df = df.withColumn("states_", F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), state))
    starts = [1 + sum(map(len, PREFIXES[:k])) for k in range(DEPTHS)]
    depths = F.array(*(F.slice("states_", start, len(some)) for start, some in zip(starts[1:], PREFIXES[1:])))
    df = df.withColumn("sparse_", F.flatten(F.filter(depths, lambda s: F.array_contains(s, 0))))
    held = lambda s: F.size(F.filter(s, lambda x: x > 0))
    share = lambda s: F.size(F.filter(s, lambda x: x == 2)) / F.nullif(held(s), F.lit(0))
    return df.withColumn(out, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.coalesce(share("sparse_"), share("states_")))).drop("states_", "sparse_")


def _with_words(rows: DataFrame, inside: DataFrame, common: DataFrame) -> DataFrame:
    """The columns text_ and edited_ replaced by own_ and new_, their terms of the lexicon (or all, of a text that has none of it) with their paths, sorted by term.

    Terms of both texts are looked up once. Rows of a key stay where they are if the lexicon is broadcast. Else terms meet
    it by shuffle; common terms, if they may be broadcast, are told before, so that no term has most of the rows.
    """
    rest = [c for c in rows.columns if c not in (*KEY, "text_", "edited_")]
    rows = rows.select(*KEY, F.struct(*rest).alias("rest_"), terms(F.col("text_")).alias("a_"), terms(F.col("edited_")).alias("b_"))
    nothing = F.lit(None).cast(rows.schema["rest_"].dataType)
    marked = lambda array, which: F.transform(array, lambda t: F.struct(t.alias("term"), F.lit(which).alias("which"), nothing.alias("rest")))
    head = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("which"), F.col("rest_").alias("rest")))
    every = F.concat(head, marked(F.array_intersect("a_", "b_"), 3), marked(F.array_except("a_", "b_"), 1), marked(F.array_except("b_", "a_"), 2))
    pairs = rows.select(*KEY, F.explode(every).alias("x_")).select(*KEY, "x_.*")
    if inside.count() <= BROADCAST:
        pairs = pairs.join(F.broadcast(inside), "term", "left")
    else:
        if common.count() <= BROADCAST:
            pairs = pairs.join(F.broadcast(common.withColumn("common_", F.lit(True))), "term", "left")
        else:
            pairs = pairs.withColumn("common_", F.lit(None).cast("boolean"))
        apart = F.col("common_") | F.col("term").isNull()
        there = pairs.filter(apart).withColumn("path", F.lit(None).cast("string"))
        pairs = pairs.filter(~F.coalesce(apart, F.lit(False))).join(inside, "term", "left").unionByName(there).drop("common_")
    found = pairs.groupBy(*KEY).agg(F.first("rest", ignorenulls=True).alias("rest_"), F.collect_list(F.when(F.col("which") > 0, F.struct("term", "path", "which"))).alias("pairs_"))

    def entries(which: int) -> Column:
        own = F.filter("pairs_", lambda x: x["which"].bitwiseAND(F.lit(which)) > 0)
        inside_ = F.filter("pairs_", lambda x: (x["which"].bitwiseAND(F.lit(which)) > 0) & x["path"].isNotNull())
        every = F.transform(own, lambda x: F.struct(x["term"].alias("term"), path(x["term"]).alias("path"), x["which"].alias("which")))
        return F.sort_array(F.when(F.size(inside_) > 0, inside_).otherwise(every))

    return found.select(*KEY, "rest_.*", entries(1).alias("own_"), entries(2).alias("new_"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per row of `df`.

    The edited text has, in place of its last quarter (of code points, rounded down), the first as many of the next
    document's; that is the next by id (null first; rows of one id by a hash of their texts), and after the last the first.
    Gives the id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited and near_next, the likeness of
    the text's fingerprint to the edited text's and to the next document's. A fingerprint depends on nothing but the text's
    terms and the lexicon, so equal texts have equal ones. A text without a term of the lexicon is told by all its terms;
    texts without any term are alike. Null counts as empty. Rows equal in id and text are one document here, and each has
    its row in the result. A document alone is its own next one. Whole texts of any length count; an empty table gives no rows.

    Texts are shuffled once, and up to a quarter of each once more, to where the document before it is.
    """
    value = lambda c: F.col(f"`{c}`")
    text = F.coalesce(value(text_col).cast("string"), F.lit(""))
    kind = df.schema[id_col].dataType
    keyed = df.select(value(id_col).isNull().alias("absent_"), F.coalesce(value(id_col), F.lit(0).cast(kind)).alias("id_"), F.xxhash64(text).alias("mark_"), text.alias("text_"))
    inside, common = lexicon(keyed, "text_")
    ids = keyed.select(F.lit(0).alias("all_"), *KEY, F.char_length("text_").alias("chars_")).distinct()
    ids = placed(ids, "all_", F.col("absent_").desc(), F.col("id_").asc(), F.col("mark_").asc()).select(*KEY, "chars_", "place_", "count_")
    quarter = F.floor(F.col("chars_") / 4).cast("int")
    before = ids.select(((F.col("place_") + 1) % F.col("count_")).alias("place_"), *(F.col(k).alias(f"to_{k}") for k in KEY), quarter.alias("take_"))
    rows = keyed.groupBy(*KEY).agg(F.first("text_").alias("text_"), F.count("*").alias("copies_")).join(ids.join(before, "place_"), KEY)
    # asks for all columns of the texts' shuffle, so that it is one for both sides of the join below
    take = F.when(F.col("copies_") > 0, F.col("take_"))
    heads = rows.select(*(F.col(f"to_{k}").alias(k) for k in KEY), F.substring("text_", F.lit(1), take).alias("head_"))
    rows = rows.drop("take_", *(f"to_{k}" for k in KEY)).join(heads, KEY)
    rows = rows.withColumn("edited_", F.concat(F.substring("text_", F.lit(1), F.col("chars_") - quarter), "head_"))
    rows = _with_words(rows.drop("head_").withColumn("sha_", F.unhex(F.sha2(F.col("edited_").cast("binary"), 256))), inside, common)
    rows = signature(signature(rows, "own_", "own_print_"), "new_", "new_print_").drop("own_", "new_")
    rows = with_likeness(rows, "own_print_", "new_print_", "near_edited")
    # a row goes to its own place, its fingerprint also to the one before; so nothing is made twice or stored for it
    own = F.struct("absent_", "id_", "copies_", "chars_", "sha_", "own_print_", "new_print_", "near_edited")
    before = (F.col("place_") + F.col("count_") - 1) % F.col("count_")
    sent = F.array(F.struct(F.col("place_").alias("place"), own.alias("own"), F.lit(None).cast("binary").alias("next")), F.struct(before.alias("place"), F.lit(None).cast(rows.select(own).schema[0].dataType).alias("own"), F.col("own_print_").alias("next")))
    met = rows.select(F.explode(sent).alias("x_")).select("x_.*").groupBy("place").agg(F.first("own", ignorenulls=True).alias("own"), F.first("next", ignorenulls=True).alias("next_print_"))
    out = with_likeness(met.select("own.*", "next_print_"), "own_print_", "next_print_", "near_next")
    out = out.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies_"))))
    shown = lambda c: F.lower(F.hex(c))
    return out.select(F.when(~F.col("absent_"), F.col("id_")).alias(id_col), F.col("chars_").cast("long").alias("n_chars"), shown("sha_").alias("edited_sha256"), shown("own_print_").alias("fingerprint"), shown("new_print_").alias("edited_fingerprint"), "near_edited", "near_next")


def queries() -> dict:
    return {"op11_imatch_fingerprints": lambda spark, sf_dir: fingerprints(table(spark, sf_dir, "documents"))}


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS docs FROM d),
e AS (SELECT a.doc_id, a.place, a.n, a.docs, a.text, substr(a.text, 1, (a.n - a.n // 4)::BIGINT) || substr(b.text, 1, (a.n // 4)::BIGINT) AS edited
      FROM o a JOIN o b ON b.place = (a.place + 1) % a.docs),
w AS (SELECT place, 1 AS side, unnest(list_filter(list_distinct(regexp_split_to_array(lower(text), '{apart}')), lambda x: x <> '')) AS term FROM e
      UNION ALL SELECT place, 2, unnest(list_filter(list_distinct(regexp_split_to_array(lower(edited), '{apart}')), lambda x: x <> '')) FROM e),
x AS (SELECT term, true AS known FROM w WHERE side = 1 GROUP BY term
      HAVING count(*) BETWEEN (SELECT ceil(count(*) / {rare})::BIGINT FROM d) AND (SELECT count(*) // {common} FROM d)),
k AS (SELECT w.*, coalesce(known, false) AS known, max(coalesce(known, false)) OVER (PARTITION BY place, side) AS has_known FROM w LEFT JOIN x USING (term)),
t AS (SELECT place, side, term, translate(left(sha256(term), {depths} - 1), '0123456789abcdef', '0000111122223333') AS path FROM k WHERE known OR NOT has_known),
l(subset, depth, prefix) AS (VALUES {prefixes}),
s AS (SELECT place, side, subset, left(md5(string_agg(term, ' ' ORDER BY term)), {digits}) AS hash FROM t JOIN l ON starts_with(path, prefix) GROUP BY 1, 2, 3),
z AS (SELECT e.place, q.side, l.subset, l.depth, coalesce(s.hash, repeat('0', {digits})) AS hash
      FROM e CROSS JOIN (VALUES (1), (2)) q(side) CROSS JOIN l LEFT JOIN s ON s.place = e.place AND s.side = q.side AND s.subset = l.subset),
f AS (SELECT place, side, string_agg(hash, '' ORDER BY subset) AS print FROM z GROUP BY 1, 2),
c AS (SELECT a.place, j.kind, a.depth, CASE WHEN a.hash <> b.hash THEN 1 WHEN a.hash = repeat('0', {digits}) THEN 0 ELSE 2 END AS state
      FROM z a CROSS JOIN (VALUES (1), (2)) j(kind) JOIN e ON e.place = a.place
      JOIN z b ON b.subset = a.subset AND b.place = CASE WHEN kind = 1 THEN a.place ELSE (a.place + 1) % e.docs END AND b.side = CASE WHEN kind = 1 THEN 2 ELSE 1 END
      WHERE a.side = 1),
g AS (SELECT place, kind, depth, count(*) FILTER (state = 2) AS same, count(*) FILTER (state > 0) AS held, depth > 0 AND bool_or(state = 0) AS sparse FROM c GROUP BY 1, 2, 3),
h AS (SELECT place, kind, coalesce(sum(same) FILTER (sparse) / nullif(sum(held) FILTER (sparse), 0), sum(same) / nullif(sum(held), 0))::DOUBLE AS near FROM g GROUP BY 1, 2)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, f1.print AS fingerprint, f2.print AS edited_fingerprint,
       CASE WHEN f1.print = f2.print THEN 1.0 ELSE h1.near END::DOUBLE AS near_edited, CASE WHEN f1.print = f3.print THEN 1.0 ELSE h2.near END::DOUBLE AS near_next
FROM e JOIN f f1 ON f1.place = e.place AND f1.side = 1 JOIN f f2 ON f2.place = e.place AND f2.side = 2 JOIN f f3 ON f3.place = (e.place + 1) % e.docs AND f3.side = 1
JOIN h h1 ON h1.place = e.place AND h1.kind = 1 JOIN h h2 ON h2.place = e.place AND h2.kind = 2
"""


def oracle_sql() -> dict[str, str]:
    flat = [(depth, prefix) for depth, some in enumerate(PREFIXES) for prefix in some]
    prefixes = ", ".join(f"({k}, {depth}, '{prefix}')" for k, (depth, prefix) in enumerate(flat))
    return {"op11_imatch_fingerprints": SQL.format(apart=APART, rare=RARE, common=COMMON, depths=DEPTHS, prefixes=prefixes, digits=2 * BYTES)}
