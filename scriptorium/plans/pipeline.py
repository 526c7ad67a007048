"""Question to context: the ordered stages over a batch of questions. Candidates are written once between stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.functions import text as T
from scriptorium.operators import dense, lexical, rank, resolve, rules, seeding
from scriptorium.operators.matching import substring_pairs
from scriptorium.operators.scorers import CoverageReranker, Embedder, HashedTerms, Reranker
from scriptorium.session import join_small, settle


@dataclass(frozen=True)
class Corpus:
    """``chunks``: chunk_id, text, category, army, unit_name, breadcrumb, section_group, seq of one edition; of an id given several times
    the least text counts. ``factions``: names of armies (name). ``edges``: src, dep of the graph of rules, by stems."""

    chunks: DataFrame
    factions: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass(frozen=True)
class Models:
    """What embeds and reranks; without a reranker the retrieval score decides."""

    embedder: Embedder = field(default_factory=HashedTerms)
    reranker: Reranker | None = field(default_factory=CoverageReranker)


def _tag(*parts: str | Column) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def chunk_tags(category: Column, army: Column, s: Settings = SETTINGS) -> Column:
    """What a route can ask for: everything, all but the pack, the core rules, the pack, an army with or without its pack rows."""
    pack, core = category.eqNullSafe(F.lit(s.pack_category)), category.eqNullSafe(F.lit(s.core_category))
    own = F.lower(army)
    return F.array_compact(F.array(_tag("all"), F.when(~pack, _tag("all-pack")), F.when(core, _tag("core")), F.when(pack, _tag("pack")), F.when(own != "", _tag("army", own)), F.when((own != "") & ~pack, _tag("army-pack", own))))


def route_tags(route: Column, faction: Column) -> Column:
    own = F.lower(faction)
    return (
        F.when(route == "faction+core+pack", F.array(_tag("army", own), _tag("core"), _tag("pack")))
        .when(route == "faction+pack", F.array(_tag("army", own), _tag("pack")))
        .when(route == "core+pack", F.array(_tag("core"), _tag("pack")))
        .when(route == "all", F.array(_tag("all")))
        .when(route == "faction", F.array(_tag("army-pack", own)))
        .when(route == "all-pack", F.array(_tag("all-pack")))
        .otherwise(F.array(_tag("core")))
    )


def numbered(chunks: DataFrame) -> DataFrame:
    """One row per chunk with ``id`` BIGINT, a hash of its chunk_id, the content ``key`` and the ``tags`` of its routes."""
    names = ("category", "army", "unit_name", "breadcrumb", "section_group", "seq")
    first = chunks.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min(F.struct("text", *names)).alias("c"))
    rows = first.select(F.xxhash64("chunk_id").alias("id"), "chunk_id", "c.*")
    return rows.withColumn("key", T.content_key(F.col("text"))).withColumn("tags", chunk_tags(F.col("category"), F.col("army")))


def routed(questions: DataFrame, corpus: Corpus, chunks: DataFrame, pack_on: bool, s: Settings = SETTINGS) -> DataFrame:
    """``qid, text, faction, route, tags, armies``: each question's faction (the longest that it names, of several the first by name), its
    route, and all armies that it names. ``chunks``: as ``numbered``."""
    asked = questions.select("qid", "text")
    lower = asked.select("qid", F.lower("text").alias("text"))
    if corpus.factions is None:
        found = asked.select("qid", F.lit(None).cast("string").alias("faction"), F.array().cast("array<string>").alias("armies")).limit(0)
    else:
        names = corpus.factions.filter(F.length("name") > 0).select("name", F.lower("name").alias("needle")).distinct()
        hits = substring_pairs(names, lower).select("qid", "name").distinct()
        found = hits.groupBy("qid").agg(F.min(F.struct(-F.length("name"), F.col("name").alias("name"))).alias("best"), F.array_sort(F.collect_set("name")).alias("armies")).select("qid", F.col("best.name").alias("faction"), "armies")
    units = chunks.filter("unit_name <> ''").filter(F.col("category").isin(*s.unit_categories)).select(F.col("unit_name").alias("name")).distinct()
    core = chunks.filter(F.col("category") == s.core_category).select("id", "text")
    tokens = resolve.distinctive_tokens(units, core, list(T.STOPWORDS))
    named = resolve.names_a_unit(asked, units, tokens).withColumn("unit", F.lit(True))
    rows = asked.join(found, "qid", "left").join(named, "qid", "left")
    route = resolve.route(F.col("text"), F.col("faction"), F.coalesce("unit", F.lit(False)), pack_on, list(s.core_phrases), list(s.core_words), s.pack_name)
    rows = rows.select("qid", "text", "faction", F.coalesce("armies", F.array().cast("array<string>")).alias("armies"), route.alias("route"))
    return rows.withColumn("tags", route_tags(F.col("route"), F.col("faction")))


def build_context(questions: DataFrame, corpus: Corpus, pack_on: bool = True, models: Models = Models(), s: Settings = SETTINGS) -> DataFrame:
    """The context rows of ``questions`` (qid BIGINT, text): ``qid, chunk_id, tier, score, place, tokens, text``.

    Route each question to a filter; search it, synonyms expanded, by vectors and words under that filter, and fuse by content; add the named
    units' own chunks and the rules slice; keep to the armies named; seed definitions and rules that the candidates refer to;
    rerank by clauses; cap seeds below their parents; reserve rules and units; fill; add neighbours in sequences; cut to the token
    budget. With the pack off, its category is in no stage. Null questions get nothing but what every question gets."""
    chunks = corpus.chunks if pack_on else corpus.chunks.filter(~F.col("category").eqNullSafe(F.lit(s.pack_category)))
    chunks = settle(numbered(chunks), "numbered")
    plan = settle(routed(questions, corpus, chunks, pack_on, s), "routed")
    asked = plan.select("qid", "text")
    # The chain of replacements would otherwise be copied into every filter that the optimiser infers.
    expanded = settle(plan.filter("text is not null").select("qid", T.expand(F.col("text")).alias("text"), "tags"), "expanded")

    # Search under the route's filter.
    vectors = chunks.select("id", "tags", models.embedder.embed(F.coalesce("text", F.lit(""))).alias("vector"))
    queries = expanded.select("qid", "tags", models.embedder.embed(F.col("text")).alias("vector"))
    near = dense.dense_topk(vectors, queries, s.rerank_candidates, s.similarity_threshold, same=False)
    keys, tags = chunks.select("id", "key"), chunks.select("id", F.col("tags").alias("held"))
    admitted = lambda found: found.join(tags, "id").join(plan.select("qid", "tags"), "qid").filter(F.arrays_overlap("held", "tags")).drop("held", "tags")
    named = chunks.select("id", T.display_name(F.lit(None).cast("string"), F.col("breadcrumb")).alias("name"))
    words = lexical.lexical_search(chunks.select("id", "text"), expanded.select("qid", "text"), lexical.exact_names(named, expanded), s, admitted)
    near = settle(near.join(keys, "id").select("qid", "id", "key", F.round("cosine", 3).alias("score")), "near")
    main = dense.fuse(near, words.join(keys, "id").select("qid", "id", "key", F.col("sim").alias("score")))
    main = settle(main.select("qid", "id", F.col("score").alias("cosine"), F.lit("main").alias("pool")), "main")

    # The named units' chunks take over the cosine of the search where it found them too. Rules of the slice come beside them.
    units = resolve.named_units(asked, chunks.filter("unit_name <> ''").select(F.col("unit_name").alias("name")).distinct())
    of_unit = chunks.filter(F.col("category").isin(*s.unit_categories)).select("id", F.lower("unit_name").alias("name"))
    slices = units.join(of_unit, "name").select("qid", "id").distinct().join(main.select("qid", "id", "cosine"), ["qid", "id"], "left")
    slices = slices.select("qid", "id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.lit("unit").alias("pool"))
    sliced = rules.rules_slice(expanded.select("qid", "text"), chunks.select("id", "category", "text"), models.embedder, s.top_k, pack_on, s)
    sliced = sliced.groupBy("qid", "id").agg(F.max("cosine").alias("cosine")).withColumn("pool", F.lit("rule"))
    rows = main.unionByName(slices).unionByName(sliced).join(chunks.drop("tags"), "id")
    rows = rows.join(plan.select("qid", "armies"), "qid").filter(resolve.in_scope(F.col("category"), F.col("army"), F.col("armies"), s)).drop("armies")
    rows = settle(rows, "candidates")

    # Seeds come from the retrieval scores, before anything is reranked.
    before = rows.withColumn("score", rank.blended_score(F.lit(None).cast("double"), F.col("cosine"), F.col("category"), pack_on=pack_on, s=s)).select("qid", "id", "key", "category", "breadcrumb", "score").distinct()
    parts = [seeding.referenced_rules(asked, before, chunks, models.embedder, pack_on, s)]
    if corpus.edges is not None:
        parts.append(seeding.definitions(asked, before, chunks, corpus.edges, models.embedder, pack_on, s))
    seeds = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    seeds = settle(seeds.groupBy("qid", "id", "key").agg(F.max("bridge").alias("bridge"), F.array_distinct(F.flatten(F.collect_list("parent_keys"))).alias("parent_keys")), "seeds")
    seeded = seeds.select("qid", "id", F.lit(0.0).alias("cosine"), F.lit("main").alias("pool"), F.lit(True).alias("seed")).join(chunks.drop("tags"), "id")
    rows = rows.withColumn("seed", F.lit(False)).unionByName(seeded)

    if models.reranker is None:
        scored = rows.withColumn("rerank", F.lit(None).cast("double"))
    else:
        segments = asked.select("qid", F.col("text").alias("question"), F.explode(T.clauses(F.col("text"), s.segment_max)).alias("segment"))
        segments = segments.select("qid", "segment", (F.col("segment") == F.trim("question")).alias("whole"))
        unique = rows.select("qid", "id", "text").distinct().join(segments, "qid").withColumn("x", models.reranker.score(F.col("segment"), F.col("text")))
        scored = rows.join(rank.segment_maxpool(unique, s), ["qid", "id"], "left")
    score = rank.blended_score(F.col("rerank"), F.col("cosine"), F.col("category"), pack_on=pack_on, s=s)
    order = Window.partitionBy("qid").orderBy("seed", F.desc("cosine"), "pool", "id")
    scored = settle(scored.withColumn("score", F.round(score, 6)).withColumn("pos", F.row_number().over(order)).withColumn("unit", F.nullif("unit_name", F.lit(""))), "scored")
    capped = rank.cap_below_parents(seeds, scored.filter("not seed"), s).select("qid", "id", F.lit(True).alias("seed"), "override")
    scored = scored.join(capped, ["qid", "id", "seed"], "left").withColumn("score", F.coalesce("override", "score")).drop("override")
    scored = settle(scored, "capped")
    ruled = scored.filter(rules.is_rule(F.col("category"), pack_on, s) | (F.col("pool") == "rule"))
    result = settle(rank.assemble(scored.filter("pool = 'unit'"), ruled, scored.filter("pool = 'main'"), s), "assembled")
    return _budgeted(result, chunks, s)


def _budgeted(result: DataFrame, chunks: DataFrame, s: Settings) -> DataFrame:
    """The assembled rows with their neighbours in sequences right behind them, cut to the token budget."""
    detail = chunks.select("id", "chunk_id", "text", "section_group", F.try_to_number("seq", F.lit("999999999")).cast("int").alias("seq"), F.coalesce(F.nullif("unit_name", F.lit("")), "category", F.lit("Rule")).alias("name"), F.coalesce("army", F.lit("")).alias("army"))
    placed = result.join(detail, "id")
    sequenced = placed.filter("section_group is not null and seq is not null").select("qid", F.col("section_group").alias("group"), "seq", "place")
    members = detail.filter("section_group is not null and seq is not null").select(F.col("section_group").alias("group"), "seq", "id")
    extra = rank.sequence_neighbours(sequenced, members).select("qid", "id", F.col("place"), F.col("seq").alias("after")).join(result.select("qid", "id"), ["qid", "id"], "left_anti")
    added = extra.join(result.select("qid", "place", "tier", "score"), ["qid", "place"]).join(detail, "id")
    every = placed.withColumn("after", F.lit(-1)).unionByName(added.select(*placed.columns, "after"))
    final = every.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("place", "after", "id")))
    label = F.concat(F.col("name"), F.lit(" ("), F.col("army"), F.lit(")"))
    kept = rank.soft_budget(final, label, F.col("text"), s.context_token_budget, s.token_char_ratio, pos="nth")
    return kept.select("qid", "chunk_id", "tier", "score", F.col("nth").cast("bigint").alias("place"), "tokens", "text")
