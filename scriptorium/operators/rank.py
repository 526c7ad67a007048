"""Scores, reservations and the assembly of a question's context, as windows over candidate rows.

Candidates have ``qid``, ``id``, a content ``key``, ``pos`` (their place in the pool) and scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.functions import text as T


def blended_score(rerank: Column, cosine: Column, category: Column, override: Column | None = None, pack_on: bool = True, s: Settings = SETTINGS) -> Column:
    """The override if set; else the better of the rerank score and a part of the cosine, or the cosine where nothing was
    reranked; plus a small bonus for authoritative categories."""
    near = F.coalesce(cosine, F.lit(0.0))
    base = F.when(rerank.isNull(), near).otherwise(F.greatest(rerank, s.rerank_cosine_floor * near))
    bonus = F.when((category == s.pack_category) & F.lit(pack_on), 2 * s.authority_tiebreak).when(category == s.core_category, s.authority_tiebreak).otherwise(0.0)
    scored = base + bonus
    return scored if override is None else F.coalesce(override, scored)


def segment_maxpool(scores: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``qid, id, rerank`` from raw scores per segment (qid, id, segment, whole, x): the best segment's sigmoid plus a small
    part of the whole question's; just the sigmoid if there is one segment."""
    value = T.sigmoid(F.col("x"))
    out = scores.groupBy("qid", "id").agg(F.max(value).alias("best"), F.max(F.when(F.col("whole"), value)).alias("of_whole"), F.count("*").alias("n"))
    return out.select("qid", "id", F.when(F.col("n") > 1, F.col("best") + s.segment_tiebreak * F.coalesce("of_whole", F.lit(0.0))).otherwise(F.col("best")).alias("rerank"))


def first_per_key(rows: DataFrame) -> DataFrame:
    """The first row of each content in pool order, whatever its score."""
    by = Window.partitionBy("qid", "key").orderBy("pos")
    return rows.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def cap_below_parents(seeds: DataFrame, pool: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``seeds`` (qid, key, bridge, parent_keys) with ``override``: a margin below the weakest parent in ``pool`` (qid, key, pos,
    score), less a step for each better seed; null without a parent. Of several rows of a parent the last counts."""
    order = Window.partitionBy("qid").orderBy(F.desc("bridge"), F.asc("key"))
    ranked = seeds.withColumn("__i", F.row_number().over(order) - 1)
    parents = pool.groupBy("qid", F.col("key").alias("parent")).agg(F.max_by("score", "pos").alias("of_parent"))
    floor = ranked.select("qid", "key", F.explode("parent_keys").alias("parent")).join(parents, ["qid", "parent"]).groupBy("qid", "key").agg(F.min("of_parent").alias("floor"))
    return ranked.join(floor, ["qid", "key"], "left").withColumn("override", F.round(F.col("floor") - s.dependency_margin - F.col("__i") * s.dependency_step, 4)).drop("__i", "floor")


def reserve_units(rows: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """At most two rows of each ``unit`` with ``place`` 1 or 2: scores within the saturation bucket of the best tie and are
    ordered by cosine; the second stays if the first is weak or it comes near the first."""
    unit = Window.partitionBy("qid", "unit")
    bucketed = rows.withColumn("__top", F.max("score").over(unit)).withColumn("__bucket", F.when(F.col("score") >= F.col("__top") - s.unit_saturation, F.col("__top")).otherwise(F.col("score")))
    order = unit.orderBy(F.desc("__bucket"), F.desc("cosine"), F.asc("pos"))
    placed = bucketed.withColumn("place", F.row_number().over(order).cast("bigint")).withColumn("__first", F.first("score").over(order))
    second = (F.col("place") <= s.unit_chunks_per_unit) & ((F.col("__first") < s.unit_second_floor) | (F.col("score") >= s.unit_second_ratio * F.col("__first")))
    return placed.filter((F.col("place") == 1) | second).drop("__top", "__bucket", "__first")


def assemble(units: DataFrame, rules: DataFrame, main: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The context rows of each question, ``qid, id, tier, score, place``: the best row of every reserved unit, the best rules,
    the units' other reserved rows, and main rows of further units until ``top_k`` is reached. Inputs: qid, id, key, unit, pos,
    score, and cosine of the units; each deduplicated by content in pool order first. Units' rows that are among the best rules leave
    their place to the unit's next ones. A null unit is capped by none."""
    columns = ["qid", "id", "key", "unit", "pos", "score"]
    rule_order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("pos"))
    top_rules = first_per_key(rules.select(columns)).withColumn("__r", F.row_number().over(rule_order)).filter(F.col("__r") <= s.top_k_rules).drop("__r")
    free = first_per_key(units.select(*columns, "cosine")).join(top_rules.select("qid", "key"), ["qid", "key"], "left_anti")
    own = reserve_units(free, s).select(columns)
    best = Window.partitionBy("qid", "unit").orderBy(F.desc("score"), F.asc("pos"))
    own = own.withColumn("tier", F.when(F.row_number().over(best) == 1, 1).otherwise(3))
    reserved = own.select(*columns, "tier").unionByName(top_rules.select(*columns, F.lit(2).alias("tier")))
    taken = reserved.groupBy("qid").agg(F.count("*").alias("taken"))
    rest = first_per_key(main.select(columns)).join(reserved.select("qid", "key").distinct(), ["qid", "key"], "left_anti")
    rest = rest.filter(F.col("score") >= s.rest_gate).join(own.select("qid", "unit").distinct(), ["qid", "unit"], "left_anti")
    filled = rest.join(taken, "qid", "left").withColumn("__r", F.row_number().over(rule_order)).filter(F.col("__r") <= F.greatest(F.lit(0), s.top_k - F.coalesce("taken", F.lit(0))))
    every = reserved.unionByName(filled.select(*columns, F.lit(4).alias("tier")))
    order = Window.partitionBy("qid").orderBy("tier", F.desc("score"), F.asc("pos"))
    return every.withColumn("place", F.row_number().over(order).cast("bigint")).select("qid", "id", "tier", "score", "place")


def sequence_neighbours(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The siblings right before and after each row in its sequence, once each, behind their first parent. ``rows``: qid, group,
    seq, place; ``members``: group, seq, id. Result: qid, id, group, seq, place (the parent's). Not transitive."""
    wanted = rows.select("qid", "group", "place", F.explode(F.array(F.col("seq") - 1, F.col("seq") + 1)).alias("seq"))
    fresh = wanted.join(rows.select("qid", "group", "seq"), ["qid", "group", "seq"], "left_anti")
    first = fresh.groupBy("qid", "group", "seq").agg(F.min("place").alias("place"))
    return first.join(members, ["group", "seq"]).select("qid", "id", "group", "seq", "place")


def soft_budget(rows: DataFrame, label: Column, text: Column, budget: int, ratio: int = 4, by: str = "qid", pos: str = "pos") -> DataFrame:
    """Whole rows in order until the budget is met; the row that crosses it stays. Adds ``tokens`` and ``before``."""
    order = Window.partitionBy(by).orderBy(pos)
    nth = F.row_number().over(order)
    head = F.concat(F.lit("["), nth.cast("string"), F.lit("] "), label, F.lit("\n"), F.coalesce(text, F.lit("")))
    sized = rows.withColumn("tokens", T.token_estimate(head, ratio) + F.when(nth > 1, 2).otherwise(0))
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("before", before.cast("bigint")).filter(F.col("before") < budget)


def last_rows(rows: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(pos))
    return rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def ranking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``qid, id, change`` (added, dropped, moved) between two rankings (qid, id, place)."""
    both = old.select("qid", "id", F.col("place").alias("a")).join(new.select("qid", "id", F.col("place").alias("b")), ["qid", "id"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "dropped").when(F.col("a") != F.col("b"), "moved")
    return both.withColumn("change", change).filter("change is not null").select("qid", "id", "change")
