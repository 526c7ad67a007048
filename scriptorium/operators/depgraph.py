"""The graph of rules that name other rules, and the seeding of definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.functions import text as T
from scriptorium.operators.matching import substring_pairs


def name_edges(rules: DataFrame) -> DataFrame:
    """``src, dep``: rule ``src`` names rule ``dep`` as whole words. ``rules``: stem, name, text."""
    names = rules.select(F.col("stem").alias("dep"), T.phrase_form(F.col("name")).alias("needle")).filter(F.length("needle") > 2)
    texts = rules.select(F.col("stem").alias("src"), T.phrase_form(F.col("text")).alias("text"))
    return substring_pairs(names, texts).filter("src <> dep").select("src", "dep").distinct()


def with_one_hop(edges: DataFrame) -> DataFrame:
    """The edges and those two steps away."""
    hop = edges.alias("a").join(edges.alias("b"), F.col("a.dep") == F.col("b.src")).select("a.src", "b.dep").filter("src <> dep")
    return edges.unionByName(hop).distinct()


def parse_graph(json_text: str, spark) -> DataFrame:
    """``src, dep, ord`` from a JSON object of arrays; keys that begin with an underscore are notes. Unreadable text is an empty
    graph."""
    df = spark.createDataFrame([(json_text,)], "j string").select(F.from_json("j", "map<string,array<string>>").alias("g"))
    rows = df.filter("g is not null").select(F.explode("g").alias("src", "deps")).filter(~F.col("src").startswith("_"))
    return rows.select("src", F.posexplode("deps").alias("ord", "dep")).select("src", "dep", "ord")


def edge_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 of edges; 1.0 where nothing could be wrong or missed."""
    both = found.select("src", "dep", F.lit(1).alias("f")).join(truth.select("src", "dep", F.lit(1).alias("t")), ["src", "dep"], "full_outer")
    return scores(both.agg(F.count("f").alias("found"), F.count("t").alias("true"), F.count(F.when(F.col("f") == F.col("t"), 1)).alias("hit")))


def scores(n: DataFrame) -> DataFrame:
    """The same from the counts found, true and hit."""
    precision = F.when(F.col("found") == 0, 1.0).otherwise(F.try_divide("hit", "found"))
    recall = F.when(F.col("true") == 0, 1.0).otherwise(F.try_divide("hit", "true"))
    out = n.select("found", "true", "hit", precision.alias("precision"), recall.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total == 0, 0.0).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), total)))


def dangling(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges with an end that is no rule."""
    stems = rules.select("stem").distinct()
    bad_src = edges.join(stems.withColumnRenamed("stem", "src"), "src", "left_anti").select("src", "dep")
    return bad_src.unionByName(edges.join(stems.withColumnRenamed("stem", "dep"), "dep", "left_anti").select("src", "dep")).distinct()


def seed_definitions(parents: DataFrame, edges: DataFrame, payloads: DataFrame, bridges: DataFrame, present: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``qid, stem, id, key, bridge, parent_keys`` of the definitions to add. ``parents``: qid, key, stem, score (already gated);
    ``bridges``: qid, key, dep, bridge (best similarity of a parent's sentence that names the dep to the question); ``payloads``:
    stem, id, key; ``present``: qid, key. At most ``dependency_max`` per question, the best bridges first; all parents of a
    dep are its parent_keys, with or without a naming sentence."""
    wanted = parents.join(edges.select(F.col("src").alias("stem"), "dep"), "stem").select("qid", "key", "dep")
    scored = wanted.join(bridges, ["qid", "key", "dep"], "left")
    deps = scored.groupBy("qid", "dep").agg(F.max(F.coalesce("bridge", F.lit(-1.0))).alias("bridge"), F.array_sort(F.collect_set("key")).alias("parent_keys"))
    fit = deps.filter(F.col("bridge") >= s.span_gate_min).withColumnRenamed("dep", "stem").join(payloads, "stem").join(present.select("qid", "key").distinct(), ["qid", "key"], "left_anti")
    best = Window.partitionBy("qid", "key").orderBy(F.desc("bridge"), "stem")
    once = fit.withColumn("n", F.row_number().over(best)).filter("n = 1")
    order = Window.partitionBy("qid").orderBy(F.desc("bridge"), "stem")
    return once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= s.dependency_max).select("qid", "stem", "id", "key", "bridge", "parent_keys")
