"""Data-quality assertions. A suite counts violations; all row-level rules share one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named rule. bad marks violating rows (unknown passes); keys are to be unique; rows bounds the row count; query counts failing."""

    name: str
    bad: Column | None = None
    keys: tuple[str, ...] = ()
    rows: tuple[int | None, int | None] | None = None
    query: str | None = None
    severity: str = "error"


def not_null(*columns: str) -> Rule:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return Rule(f"not_null({', '.join(columns)})", bad)


def unique(*columns: str) -> Rule:
    return Rule(f"unique({', '.join(columns)})", keys=columns)


def no_duplicates() -> Rule:
    return Rule("no_duplicates", keys=("*",))


def accepted_values(column: str, values: list) -> Rule:
    return Rule(f"accepted_values({column})", ~F.col(column).isin(values))


def row_count_between(least: int | None, most: int | None) -> Rule:
    return Rule("row_count_between", rows=(least, most))


def row_count_equal_to(n: int) -> Rule:
    return Rule("row_count_equal_to", rows=(n, n))


def matches_regex(column: str, pattern: str) -> Rule:
    return Rule(f"matches_regex({column})", ~F.col(column).rlike(pattern))


def expression_true(expression: str) -> Rule:
    return Rule(f"expression_true({expression})", ~F.expr(expression))


def sql_rule(name: str, query: str) -> Rule:
    """A query over {input} with a column failing; rows where it is above 0 violate."""
    return Rule(name, query=query)


def violations(df: DataFrame, rule: Rule) -> DataFrame:
    """The violating rows, or groups with dup_count."""
    if rule.bad is not None:
        return df.filter(F.coalesce(rule.bad, F.lit(False)))
    if rule.keys:
        keys = df.columns if rule.keys == ("*",) else rule.keys
        return df.groupBy(*keys).agg(F.count("*").alias("dup_count")).filter("dup_count > 1")
    if rule.query:
        return df.sparkSession.sql(rule.query, input=df).filter("failing > 0")
    least, most = rule.rows
    n = df.agg(F.count("*").alias("row_count"))
    return n.filter((F.col("row_count") < least if least is not None else F.lit(False)) | (F.col("row_count") > most if most is not None else F.lit(False)))


def failing_sample(df: DataFrame, rule: Rule, n: int = 25, key: str | None = None) -> DataFrame:
    """At most n violating rows or groups, the first by the key if there is one."""
    bad = violations(df, rule)
    return (bad.orderBy(key) if key else bad).limit(n)


def _compiles(df: DataFrame, rule: Rule) -> str | None:
    """What keeps a rule from being planned, or None."""
    try:
        violations(df, rule).schema  # noqa: B018 (plans the rule, runs nothing)
    except AnalysisException as e:
        return e.getMessage() or str(e)
    return None


def run_suite(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """name, severity, passed, violation_count, message for each rule. A rule that can't be planned has failed with one violation.

    Rules on rows and on their number share one pass; rules on groups and queries have one each.
    """
    broken = {k: e for k, r in enumerate(rules) if (e := _compiles(df, r)) is not None}
    row = lambda r, n, note: F.struct(F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), n.cast("long").alias("violation_count"), F.lit(note).cast("string").alias("note"))
    n, counts = F.count(F.lit(1)), []
    shared = []
    for k, r in enumerate(rules):
        if k in broken:
            shared.append(row(r, F.coalesce(F.max(F.lit(1)), F.lit(1)), broken[k].splitlines()[0]))
        elif r.bad is not None:
            shared.append(row(r, F.count_if(r.bad), None))
        elif not r.keys and not r.query:
            least, most = r.rows
            out = (n < least if least is not None else F.lit(False)) | (n > most if most is not None else F.lit(False))
            shared.append(row(r, out.cast("int"), None))
        else:
            counts.append(violations(df, r).agg(row(r, n, None).alias("r")).select("r.*"))
    if shared:
        counts.insert(0, df.agg(F.array(*shared).alias("all_")).select(F.explode("all_").alias("r")).select("r.*"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    count = F.coalesce("violation_count", F.lit(1))
    passed = count == 0
    message = F.when(F.col("note").isNotNull(), F.concat(F.lit("can't be planned: "), F.col("note"))).when(passed, "ok").otherwise(F.concat(count.cast("string"), F.lit(" violations")))
    return out.select("name", "severity", passed.alias("passed"), count.alias("violation_count"), message.alias("message"))
