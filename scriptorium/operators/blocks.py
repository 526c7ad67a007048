"""Relational rows to Markdown blocks: a parent with its children's lines, lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import safe
from scriptorium.session import join_small


def lookup(rows: DataFrame, dimension: DataFrame, key: str, dimension_key: str, name: str, order: str, out: str) -> DataFrame:
    """``out``: the dimension's name for the key, by the first of several rows in ``order``; the key itself where there is none."""
    first = dimension.groupBy(F.col(dimension_key).alias("__k")).agg(F.min_by(name, order).alias("__v"))
    joined = join_small(rows.withColumn("__k", F.col(key)), first, ["__k"], "left")
    fallback = F.col(key).cast("string")
    return joined.withColumn(out, F.when(safe(F.col("__v")) == "—", fallback).otherwise(F.coalesce(safe(F.col("__v")), fallback))).drop("__k", "__v")


def child_lines(children: DataFrame, key: str, order: list[Column], line: Column, out: str) -> DataFrame:
    """One row per key: the rendered lines in order, joined by line ends. Children are rolled up before any join, so that several
    kinds of them do not multiply."""
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))
    return children.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias(out))


def markdown(title: Column, facts: list[tuple[str, Column]], sections: list[tuple[str, Column]]) -> Column:
    """A heading, a line of facts, and every section that is not null or empty."""
    line = F.concat_ws("  |  ", *[F.concat(F.lit(f"**{k}:** "), v) for k, v in facts])
    parts = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"\n\n## {k}\n"), v)).otherwise("") for k, v in sections]
    return F.concat(F.lit("# "), title, F.lit("\n"), line, *parts)


def distinct_in_order(names: DataFrame, key: str, name: str, order: str, out: str) -> DataFrame:
    """The distinct names of each key by first appearance, joined by commas."""
    first = names.groupBy(key, name).agg(F.min(order).alias("__o"))
    item = F.struct("__o", F.col(name).alias("n"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["n"]), ", ").alias(out))


def missing_columns(df: DataFrame, required: set[str]) -> set[str]:
    """The schema contract: further columns are allowed."""
    return required - set(df.columns)
