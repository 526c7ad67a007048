"""Completeness, fidelity and retrieval audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.matching import substring_pairs


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def present(wanted: DataFrame, key: str, name: str, corpus: DataFrame, text: str, width: int = 55) -> DataFrame:
    """``key, present``: whether the first ``width`` characters of the normal form occur in some corpus text."""
    prints = wanted.select(F.col(key), F.substring(normal(F.col(name)), 1, width).alias("needle"))
    hits = substring_pairs(prints, corpus.select(normal(F.col(text)).alias("text"))).select(key).distinct()
    return prints.select(key).join(hits.withColumn("hit", F.lit(True)), key, "left").select(key, F.coalesce("hit", F.lit(False)).alias("present"))


def fidelity(lines: DataFrame, source: DataFrame, least: int = 15) -> DataFrame:
    """``id, line, kind`` of each corpus line (id, line): verbatim if its normal form occurs in a source text, reworded if any run of
    five words does, missing otherwise; short lines are left out."""
    rows = lines.withColumn("needle", normal(F.col("line"))).filter(F.length("needle") >= least)
    texts = source.select(normal(F.col("text")).alias("text"))
    verbatim = substring_pairs(rows.select("needle").distinct(), texts).select("needle").distinct().withColumn("v", F.lit(True))
    words = F.split("needle", " ")
    five = lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(5)), " "))).otherwise(F.array().cast("array<string>"))
    mine = rows.select("needle", F.explode(F.array_distinct(five(words))).alias("run")).distinct()
    theirs = texts.select(F.explode(F.array_distinct(five(F.split("text", " ")))).alias("run")).distinct()
    reworded = mine.join(theirs, "run", "left_semi").select("needle").distinct().withColumn("r", F.lit(True))
    kind = F.when(F.col("v"), "verbatim").when(F.col("r"), "reworded").otherwise("missing")
    return rows.join(verbatim, "needle", "left").join(reworded, "needle", "left").select("id", "line", kind.alias("kind"))


def retrieval_scores(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``qid, precision, recall`` of found (qid, id) against wanted (qid, id); 1.0 where nothing could be wrong or missed."""
    both = found.select("qid", "id", F.lit(1).alias("f")).join(wanted.select("qid", "id", F.lit(1).alias("w")), ["qid", "id"], "full_outer")
    n = both.groupBy("qid").agg(F.count("f").alias("f"), F.count("w").alias("w"), F.count(F.when(F.col("f") == F.col("w"), 1)).alias("hit"))
    ratio = lambda d: F.when(F.col(d) == 0, 1.0).otherwise(F.try_divide("hit", d))
    return n.select("qid", ratio("f").alias("precision"), ratio("w").alias("recall"))
