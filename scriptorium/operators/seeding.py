"""Definitions and rules that the chunks found refer to but do not contain.

A definition is added if the question is about the sentence of its parent that names it: question and sentence are compared, not question
and definition. A rule that a unit's chunk names is added if the chunk is an ability and relevant, else by the same test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.functions import text as T
from scriptorium.operators.depgraph import seed_definitions
from scriptorium.operators.rules import is_rule
from scriptorium.operators.scorers import Embedder
from scriptorium.session import join_small

# How definitions are named in running text, where their own words do not tell.
SURFACES = {
    "normal_moves": r"normal move",
    "advance_moves": r"\badvanc",
    "fall_back_moves": r"f(?:all|ell) back",
    "remain_stationary": r"remain(?:s|ed|ing)? stationary",
    "engagement_range": r"engagement range",
    "unit_coherency": r"coherency",
    "charging_with_a_unit": r"charge move|charging",
}

# Rules that abilities name, by the pattern of the text and a part of the rule's own name.
REFERENCED = {
    r"\bfall(?:s|ing)? back\b|\bfell back\b": "fall back",
    r"\bdeep strike\b": "deep strike",
    r"\bfeel no pain\b": "feel no pain",
    r"\blone operative\b": "lone operative",
    r"\bengagement range\b": "engagement range",
    r"\bbattle.?shock(?:ed)?\b": "battle shock",
    r"\bdeadly demise\b": "deadly demise",
    r"\bfights? first\b": "fights first",
    r"\bstealth\b": "stealth",
    r"\bprecision\b": "precision",
    r"\bscouts?\b": "scouts",
    r"\binfiltrators?\b": "infiltrators",
    r"\bbig guns never tire\b": "big guns never tire",
    r"\bdevastating wounds\b": "devastating wounds",
    r"\bsustained hits\b": "sustained hits",
    r"\blethal hits\b": "lethal hits",
}


def stem_of(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, "^core_rules_", "")


def surface(stem: Column, surfaces: dict[str, str] = SURFACES) -> Column:
    """The pattern by which a text names a definition: the listed one, else the words of its stem without a number before and plural
    letters behind."""
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "_", " "), r"^\d+\s+", ""), "s+$", "")
    own = F.regexp_replace(words, r"([^A-Za-z0-9 ])", r"\\$1")
    listed = F.when(F.lit(False), own)
    for name, pattern in surfaces.items():
        listed = listed.when(stem == name, F.lit(pattern))
    return F.concat(F.lit("(?i)"), listed.otherwise(own))


def is_phase_pointer(stem: Column) -> Column:
    """Blocks that only point to a phase, or begin with a number."""
    return stem.rlike(r"_phase$|^\d+_")


def rule_index(chunks: DataFrame, pack_on: bool = True, s: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """``breadcrumb, stem`` (the first chunk of a breadcrumb counts), and ``stem, id, key, name`` (the last chunk of a stem counts) of
    the rules. ``chunks``: id, chunk_id, category, breadcrumb, text."""
    rules = chunks.filter(is_rule(F.col("category"), pack_on, s)).select("id", stem_of(F.col("chunk_id")).alias("stem"), "breadcrumb", T.content_key(F.col("text")).alias("key"))
    crumbs = rules.filter("breadcrumb <> ''").groupBy("breadcrumb").agg(F.min_by("stem", "id").alias("stem"))
    last = rules.groupBy("stem").agg(F.max_by(F.struct("id", "key", "breadcrumb"), "id").alias("p"))
    return crumbs, last.select("stem", "p.id", "p.key", T.display_name(F.lit(None).cast("string"), F.col("p.breadcrumb")).alias("name"))


def name_index(payloads: DataFrame, referenced: dict[str, str] = REFERENCED) -> DataFrame:
    """``pattern, stem``: for each listed rule the first stem whose name holds it; one pass, no join."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("name"), F.lit(part)), F.lit(pattern)) for pattern, part in referenced.items()]))
    return payloads.select("id", "stem", F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.min_by("stem", F.struct("id", "stem")).alias("stem"))


def _cosine(a: Column, b: Column) -> Column:
    size = T.norm(a) * T.norm(b)
    return F.when(size > 0, T.dot(a, b) / size).otherwise(0.0)


def _bridges(named: DataFrame, questions: DataFrame, texts: DataFrame, embedder: Embedder) -> DataFrame:
    """``qid, key, dep, bridge``: how near the question is to the nearest sentence of the parent that names the dep. ``named``: qid, key,
    dep, pattern; ``texts``: key, text. A sentence is embedded once for all questions."""
    wanted = named.select("key", "dep", "pattern").distinct()
    sentences = texts.select("key", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    naming = sentences.join(wanted, "key").filter(F.rlike("sentence", F.col("pattern"))).select("key", "dep", embedder.embed(F.col("sentence")).alias("v"))
    asked = questions.select("qid", embedder.embed(F.coalesce("text", F.lit(""))).alias("q"))
    pairs = named.select("qid", "key", "dep").join(naming, ["key", "dep"]).join(asked, "qid")
    return pairs.groupBy("qid", "key", "dep").agg(F.max(_cosine(F.col("q"), F.col("v"))).alias("bridge"))


def definitions(questions: DataFrame, pool: DataFrame, chunks: DataFrame, edges: DataFrame, embedder: Embedder, pack_on: bool = True, s: Settings = SETTINGS) -> DataFrame:
    """``qid, stem, id, key, bridge, parent_keys`` of the definitions that the pool's rules refer to. ``pool``: qid, id, key, category,
    breadcrumb, score; ``chunks``: id, chunk_id, category, breadcrumb, text; ``edges``: src, dep, and where stems are no names
    ``pattern``, by which a text names the dep."""
    crumbs, payloads = rule_index(chunks, pack_on, s)
    active = pool.filter(is_rule(F.col("category"), pack_on, s) & (F.col("score") >= s.similarity_threshold))
    parents = join_small(active, crumbs, ["breadcrumb"]).select("qid", "id", "key", "stem", "score")
    pattern = F.col("pattern") if "pattern" in edges.columns else surface(F.col("dep"))
    named = join_small(parents, edges.select(F.col("src").alias("stem"), "dep", pattern.alias("pattern")).distinct(), ["stem"]).select("qid", "id", "key", "dep", "pattern")
    texts = chunks.select("id", "text").join(parents.select("id", "key").distinct(), "id").groupBy("key").agg(F.min("text").alias("text"))
    bridges = _bridges(named, questions, texts, embedder)
    return seed_definitions(parents, edges, payloads.select("stem", "id", "key"), bridges, pool, s)


def referenced_rules(questions: DataFrame, pool: DataFrame, chunks: DataFrame, embedder: Embedder, pack_on: bool = True, s: Settings = SETTINGS) -> DataFrame:
    """The same for rules that relevant chunks of units name: an ability's own score is the bridge, any other chunk needs a naming sentence
    near the question."""
    _, payloads = rule_index(chunks, pack_on, s)
    names = name_index(payloads)
    strong = pool.filter(~F.coalesce(F.col("category").isin(s.core_category, s.pack_category), F.lit(False)) & (F.col("score") >= s.referenced_parent_min))
    texts = chunks.select("id", "text").join(strong.select("id", "key").distinct(), "id")
    flags = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?i)" + p), F.lit(p)) for p in REFERENCED]))
    found = texts.select("id", "key", F.explode(flags).alias("pattern"))
    hits = join_small(strong.select("qid", "id", "key", "category", "score").join(found.select("id", "pattern"), "id"), names, ["pattern"])
    hits = hits.select("qid", "key", "category", "score", F.col("stem").alias("dep"), F.concat(F.lit("(?i)"), F.col("pattern")).alias("pattern"))
    ability = hits.filter("category = 'Ability'").groupBy("qid", "key", "dep").agg(F.max("score").alias("bridge"))
    other = _bridges(hits.filter("category is null or category <> 'Ability'"), questions, texts.groupBy("key").agg(F.min("text").alias("text")), embedder)
    bridges = ability.unionByName(other).groupBy("qid", "key", "dep").agg(F.max("bridge").alias("bridge"))
    # Each parent is its own source of the deps that its text names.
    sources = hits.select("qid", "key", F.concat("key", F.lit("\n"), "dep").alias("stem"), "dep", "score").distinct()
    edges = sources.select(F.col("stem").alias("src"), "dep").distinct()
    return seed_definitions(sources.select("qid", "key", "stem", "score"), edges, payloads.select("stem", "id", "key"), bridges, pool, s)
