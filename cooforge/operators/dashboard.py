"""Tables of builds and runs: newest distinct rows, counts, generic selection, upsert, log metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, columns: list[str], date: str, n: int, project: str | None = None, name: str = "project") -> DataFrame:
    """The n newest distinct rows of some columns, of projects like a pattern."""
    rows = df.where(F.col(name).like(project)) if project is not None else df
    return rows.select(*dict.fromkeys([*columns, date])).distinct().orderBy(F.desc(date), *columns).limit(n)


def totals(df: DataFrame, keys: list[str], warnings: str = "warnings", errors: str = "errors") -> DataFrame:
    """Rows, warnings and errors of each key: one aggregate for all keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(warnings).alias("warnings"), F.sum(errors).alias("errors"))


def select_like(df: DataFrame, columns: list[str], patterns: dict[str, str], positive: tuple[str, ...] = (), order: str | None = None, n: int = 10_000) -> DataFrame:
    """Some columns of rows that match every pattern and have every ``positive`` column over 0, the first n in order."""
    tests: list[Column] = [F.col(c).cast("string").like(p) for c, p in patterns.items()] + [F.col(c) > 0 for c in positive]
    rows = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return rows.select(*columns).orderBy(F.desc(order) if order else F.lit(1), *columns).limit(n)


def lookup(df: DataFrame, keys: dict) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def most_recent(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.max(date).alias(date))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of both, the last by ``seq`` for each key; columns that one side lacks are null."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(seq))
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_new")


def with_columns(df: DataFrame, more: dict[str, str]) -> DataFrame:
    """Columns added where absent, as nulls of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in more.items() if c not in df.columns})


def log_metrics(logs: DataFrame, patterns: dict[str, str], text: str = "line", keys: tuple[str, ...] = ()) -> DataFrame:
    """The first group of each named pattern over the lines of each key, as numbers where they are numbers."""
    found = {n: F.max(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for n, p in patterns.items()}
    return logs.groupBy(*keys).agg(*[c.alias(n) for n, c in found.items()])
