"""Column functions: names, tokens, fingerprints and JSON paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_name(c: Column) -> Column:
    """Trimmed; a quoted name loses its quotes and keeps its case, another is lowered."""
    t = F.trim(c)
    return F.when(t.rlike('^".*"$') & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.lower(t))


def tokens(c: Column) -> Column:
    """Lower-case tokens between white space and / : @ . _ -"""
    return F.filter(F.split(F.lower(c), r"[\s/:@._-]+"), lambda x: x != "")


def fingerprint(kind: Column, host: Column, port: Column, database: Column, schema: Column, name: Column) -> Column:
    """scheme://host:port/database/schema.table, lower-case but for the path; files are file:// and the path."""
    return F.when(kind == "file", F.concat(F.lit("file://"), name)).otherwise(F.concat(F.lower(kind), F.lit("://"), F.lower(host), F.lit(":"), port.cast("string"), F.lit("/"), F.lower(database), F.lit("/"), F.lower(schema), F.lit("."), F.lower(name)))


def fingerprint_parts(c: Column) -> tuple[Column, Column]:
    """Namespace (scheme and authority) and name (the rest) of a fingerprint."""
    return F.regexp_extract(c, "^([a-z]+://[^/]*)", 1), F.regexp_extract(c, "^[a-z]+://[^/]*/?(.*)$", 1)


def json_number(c: Column, path: str, default: float | None = None) -> Column:
    """A number at a JSON path; what isn't one counts as absent."""
    n = F.get_json_object(c, path).try_cast("double")
    return n if default is None else F.coalesce(n, F.lit(default))


def row_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def file_parts(c: Column) -> dict[str, Column]:
    """Name, folder and extension of a path."""
    return {"file_name": F.regexp_extract(c, "([^/]*)$", 1), "file_dir": F.regexp_extract(c, "^(.*)/[^/]*$", 1), "file_ext": F.regexp_extract(c, r"\.([^./]*)$", 1)}
