"""SQL functions and variables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BUILT_IN = ("run_date", "run_id", "pipeline_name", "environment")


def sql_function(spark: SparkSession, name: str, parameters: dict[str, str], returns: str, body: str) -> None:
    """Makes a scalar SQL function of named, typed parameters; Catalyst inlines it."""
    words = [name, *parameters]
    if bad := [w for w in words if not re.fullmatch(r"[A-Za-z_]\w*", w)]:
        raise ValueError(f"not a name: {bad}")
    typed = ", ".join(f"{p} {t}" for p, t in parameters.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({typed}) RETURNS {returns} RETURN {body}")


def resolve(defaults: dict, overrides: dict, built_in: dict) -> dict:
    """Overrides before defaults before built-in values."""
    return {**{k: v for k, v in built_in.items() if k in BUILT_IN}, **defaults, **overrides}


def run_sql(spark: SparkSession, text: str, variables: dict, **tables: DataFrame) -> DataFrame:
    """SQL with :name parameters over tables given as {name}; an undefined variable is an error of Spark."""
    return spark.sql(text, args=variables, **tables)


def transform(inputs: dict[str, DataFrame], step, **parameters) -> DataFrame:
    """A Python step on whole tables: step(inputs, parameters) -> DataFrame."""
    out = step(inputs, parameters)
    if not isinstance(out, DataFrame):
        raise TypeError("a step returns a DataFrame")
    return out
