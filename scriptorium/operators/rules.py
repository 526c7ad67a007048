"""The slice of rules that every question gets: the rules nearest to it, and those of armies and detachments that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.functions import text as T
from scriptorium.operators.dense import dense_topk
from scriptorium.operators.matching import substring_pairs
from scriptorium.operators.scorers import Embedder

# How a rule's block opens, and where it names its detachment.
RULE_TITLE = r"^#\s*(?:Army|Detachment)\s+Rule:\s*(.+?)\s*$"
RULE_DETACHMENT = r"\*\*Detachment:\*\*\s*([^|]+)"


def rule_categories(pack_on: bool, s: Settings = SETTINGS) -> tuple[str, ...]:
    """The categories of the rules slice, which may also source and receive dependencies: the pack's only with the pack on."""
    return (s.core_category, s.pack_category) if pack_on else (s.core_category,)


def is_rule(category: Column, pack_on: bool, s: Settings = SETTINGS) -> Column:
    return F.coalesce(category.isin(*rule_categories(pack_on, s)), F.lit(False))


def title_and_detachment(text: Column, title: str = RULE_TITLE) -> tuple[Column, Column]:
    """The rule's name by its first line (group 1 of the pattern) and the detachment by its first three, lower-cased, empty where there is none."""
    lines = F.split(F.coalesce(text, F.lit("")), T.LINE_END)
    name = F.regexp_extract(F.get(lines, F.lit(0)), title, 1)
    found = F.filter(F.transform(F.slice(lines, 1, 3), lambda x: F.regexp_extract(x, RULE_DETACHMENT, 1)), lambda x: x != "")
    return F.trim(F.lower(name)), F.trim(F.lower(F.coalesce(F.get(found, F.lit(0)), F.lit(""))))


def named_rules(questions: DataFrame, chunks: DataFrame, s: Settings = SETTINGS, pattern: str = RULE_TITLE) -> DataFrame:
    """``qid, id`` of the army and detachment rules whose name (of four characters at least) or detachment (of five) the question holds.
    ``chunks``: id, category, text; ``pattern``: of the first line, its group 1 being the name."""
    title, detachment = title_and_detachment(F.col("text"), pattern)
    index = chunks.filter(F.col("category").isin(*s.rule_categories)).select("id", F.explode(F.array(F.struct(title.alias("needle"), F.lit(4).alias("least")), F.struct(detachment.alias("needle"), F.lit(5).alias("least")))).alias("n"))
    needles = index.select("id", "n.needle", "n.least").filter(F.length("needle") >= F.col("least")).select("id", "needle")
    return substring_pairs(needles, questions.select("qid", F.lower("text").alias("text"))).select("qid", "id").distinct()


def rules_slice(questions: DataFrame, chunks: DataFrame, embedder: Embedder, n: int = 8, pack_on: bool = True, s: Settings = SETTINGS) -> DataFrame:
    """``qid, id, cosine, provenance``: the ``n`` nearest rules over the similarity threshold, and the named rules with cosine 0. The filter
    comes before the cut to ``n``. ``chunks``: id BIGINT, category, text; ``questions``: qid BIGINT, text."""
    own = chunks.filter(is_rule(F.col("category"), pack_on, s)).select("id", embedder.embed(F.coalesce("text", F.lit(""))).alias("vector"))
    asked = questions.filter("text is not null").select("qid", embedder.embed(F.col("text")).alias("vector"))
    near = dense_topk(own, asked, n, s.similarity_threshold, same=False).select("qid", "id", "cosine", F.lit("dense").alias("provenance"))
    named = named_rules(questions, chunks, s).select("qid", "id", F.lit(0.0).alias("cosine"), F.lit("named_rule").alias("provenance"))
    return near.unionByName(named)
