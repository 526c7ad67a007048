"""The question pipeline and its stages over the whole tables of chunks and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS as S
from scriptorium.functions import text as T
from scriptorium.operators import audit, depgraph, matching, rank, rules, seeding
from scriptorium.operators.scorers import CoverageReranker, HashedTerms
from scriptorium.plans import pipeline
from scriptorium.plans.corpus_queries import SQL_CHUNKS, _chunks
from scriptorium.plans.registry import query
from scriptorium.plans.text_queries import SQL_TERMS, SQL_TOKENS, SQL_TURNS, sql, turns
from scriptorium.session import settle
from scriptorium.sources.tables import table


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """The users' questions, each text once, with ``qid`` a hash of it."""
    asked = turns(spark, folder).filter("role = 'user' and content is not null").select(F.col("content").alias("text")).distinct()
    return settle(asked.select(F.xxhash64("text").alias("qid"), "text"), "questions")


def _graph(chunks: DataFrame) -> DataFrame:
    """``src, dep, pattern``: core rules that name other core rules, by stems, and how they name them."""
    rules_of = chunks.filter((F.col("category") == S.core_category) & F.col("text").startswith("# "))
    head = F.get(F.split("text", "\n"), F.lit(0))
    named = rules_of.select(seeding.stem_of(F.col("chunk_id")).alias("stem"), F.substring(head, F.lit(3), F.length(head)).alias("name"), F.substring("text", 1 + F.length(head), F.length("text")).alias("text"))
    words = F.trim(T.phrase_form(F.col("name")))
    patterns = named.select(F.col("stem").alias("dep"), F.concat(F.lit("(?i)\\b"), F.regexp_replace(words, " ", r"[^a-z0-9]+"), F.lit("\\b")).alias("pattern"))
    return settle(depgraph.name_edges(named).join(patterns, "dep"), "graph")


def _corpus(spark: SparkSession, folder: str) -> tuple[pipeline.Corpus, DataFrame]:
    """The chunks of the default edition, with the factions and the graph of core rules; and the chunks numbered."""
    edition = F.coalesce(F.lower(F.trim("edition")), F.lit(S.default_edition))
    chunks = _chunks(spark, folder).filter(edition == S.default_edition)
    numbered = settle(pipeline.numbered(chunks), "numbered")
    return pipeline.Corpus(chunks, table(spark, folder, "factions"), _graph(numbered)), numbered


@query()
def question_context(spark: SparkSession, folder: str) -> DataFrame:
    """The context of every question that users asked, by all stages of the pipeline."""
    corpus, _ = _corpus(spark, folder)
    return pipeline.build_context(_questions(spark, folder), corpus).select("qid", "chunk_id", "tier", "score", "place", "tokens")


@query()
def rules_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The rules that every question gets: the nearest and those it names."""
    _, chunks = _corpus(spark, folder)
    return rules.rules_slice(_questions(spark, folder), chunks.select("id", "category", "text"), HashedTerms())


@query(
    f"""WITH one AS (SELECT chunk_id, arg_min(category, coalesce(text, '')) AS category, min(text) AS text FROM {SQL_CHUNKS} GROUP BY chunk_id),
r AS (SELECT chunk_id, text, string_split(text, chr(10)) AS l FROM one WHERE category IN ('Army_Rule', 'Detachment_Rule') AND text IS NOT NULL),
n AS (SELECT chunk_id, lower(trim(regexp_extract(l[1], '^#\\s*(?:(?:Army|Detachment)\\s+Rule:\\s*)?(.+?)\\s*$', 1))) AS needle, 4 AS least FROM r
  UNION ALL SELECT chunk_id, lower(trim(coalesce([x for x in [regexp_extract(y, '\\*\\*Detachment:\\*\\*\\s*([^|]+)', 1) for y in l[:3]] if x <> ''][1], ''))), 5 FROM r),
q AS (SELECT DISTINCT content FROM ({SQL_TURNS}) WHERE role = 'user' AND content IS NOT NULL)
SELECT DISTINCT content AS text, chunk_id FROM q JOIN n ON len(needle) >= least AND contains(lower(content), needle)"""
)
def named_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Army and detachment rules that users' questions name."""
    asked, chunks = _questions(spark, folder), settle(pipeline.numbered(_chunks(spark, folder)), "numbered")
    # The titles of this corpus have no prefix.
    found = rules.named_rules(asked, chunks.select("id", "category", "text"), pattern=r"^#\s*(?:(?:Army|Detachment)\s+Rule:\s*)?(.+?)\s*$")
    return found.join(asked, "qid").join(chunks.select("id", "chunk_id"), "id").select("text", "chunk_id")


def _lexical_pool(spark: SparkSession, folder: str, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """The eight best chunks of every question by words, with a score from 0 to 1."""
    from scriptorium.operators.lexical import bm25_topk

    found = bm25_topk(chunks.select("id", "text"), asked, S.top_k)
    scored = found.withColumn("score", T.sigmoid(F.col("score") / 4 - 1))
    return settle(scored.select("qid", "id", "score").join(chunks.select("id", "key", "category", "breadcrumb"), "id"), "lexical_pool")


@query()
def seed_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """The definitions and rules to which each question's eight best chunks refer."""
    corpus, chunks = _corpus(spark, folder)
    asked = _questions(spark, folder)
    pool = _lexical_pool(spark, folder, chunks, asked)
    parts = [seeding.definitions(asked, pool, chunks, corpus.edges, HashedTerms()), seeding.referenced_rules(asked, pool, chunks, HashedTerms())]
    return parts[0].unionByName(parts[1]).select("qid", "stem", "id", F.round("bridge", 6).alias("bridge"), F.size("parent_keys").alias("parents"))


_SQL_PARTS = rf"[trim(x) for x in string_split_regex(regexp_replace(q, '\b({T.CLAUSE_MARKERS})\b|[.;,]', chr(1), 'gi'), chr(1)) if len(trim(x)) > 3]"
_SQL_OPERATIVE = rf"[x for x in parts if regexp_matches(x, '^({'|'.join(T.INTERROGATIVES)})\b', 'i')][:2]"


@query(
    f"""WITH q AS (SELECT id AS conv, pos, trim(content) AS q FROM ({SQL_TURNS}) WHERE role = 'user' AND content IS NOT NULL),
c AS (SELECT *, {_SQL_OPERATIVE} AS ops FROM (SELECT *, {_SQL_PARTS} AS parts FROM q)),
s AS (SELECT conv, pos, q, unnest(CASE WHEN len(parts) <= 1 OR len(ops) = 0 THEN [q] WHEN list_contains(ops, q) THEN ops ELSE list_append(ops, q) END) AS segment FROM c),
a AS (SELECT id AS conv, pos - 1 AS pos, content FROM ({SQL_TURNS}) WHERE role = 'assistant' AND content IS NOT NULL),
x AS (SELECT s.conv, s.pos, segment = q AS whole, {sql(SQL_TERMS, "segment")} AS asked, {sql(SQL_TOKENS, "content")} AS held FROM s JOIN a ON a.conv = s.conv AND a.pos = s.pos),
v AS (SELECT conv, pos, whole, 1 / (1 + exp(-(8 * len(list_distinct(list_intersect(asked, held))) / greatest(len(asked), 1) - 4))) AS v FROM x)
SELECT conv AS id, pos, round(CASE WHEN count(*) > 1 THEN max(v) + 0.05 * coalesce(max(CASE WHEN whole THEN v END), 0) ELSE max(v) END, 6) AS rerank FROM v GROUP BY conv, pos"""
)
def segment_maxpool(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every reply for its own question, by clauses."""
    said = turns(spark, folder).filter("content is not null")
    asked = said.filter("role = 'user'").select("id", "pos", F.col("content").alias("question"), F.explode(T.clauses(F.col("content"), S.segment_max)).alias("segment"))
    replies = said.filter("role = 'assistant'").select("id", (F.col("pos") - 1).alias("pos"), F.col("content").alias("text"))
    scored = asked.join(replies, ["id", "pos"]).withColumn("x", CoverageReranker().score(F.col("segment"), F.col("text")))
    scored = scored.select(F.col("id").alias("qid"), F.col("pos").alias("id"), (F.col("segment") == F.trim("question")).alias("whole"), "x")
    return rank.segment_maxpool(scored).select(F.col("qid").alias("id"), F.col("id").alias("pos"), F.round("rerank", 6).alias("rerank"))


_SQL_NORMAL = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH i AS (SELECT item_id AS id, text AS line, {sql(_SQL_NORMAL, "text")} AS needle FROM eval_items), k AS (SELECT * FROM i WHERE len(needle) >= 15),
d AS (SELECT {sql(_SQL_NORMAL, "text")} AS t FROM documents WHERE text IS NOT NULL),
runs AS (SELECT DISTINCT unnest([array_to_string(w[j:j + 4], ' ') for j in range(1, len(w) - 3)]) AS run FROM (SELECT string_split(t, ' ') AS w FROM d) WHERE len(w) >= 5),
mine AS (SELECT id, unnest([array_to_string(w[j:j + 4], ' ') for j in range(1, len(w) - 3)]) AS run FROM (SELECT id, string_split(needle, ' ') AS w FROM k) WHERE len(w) >= 5)
SELECT id, md5(line) AS line, CASE WHEN EXISTS (SELECT 1 FROM d WHERE contains(t, needle)) THEN 'verbatim' WHEN id IN (SELECT id FROM mine JOIN runs USING (run)) THEN 'reworded' ELSE 'missing' END AS kind FROM k"""
)
def fidelity_sentence_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the documents hold each test passage verbatim, reworded or not at all."""
    lines = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), F.col("text").alias("line"))
    found = audit.fidelity(lines, table(spark, folder, "documents").filter("text is not null").select("text"))
    return found.select("id", F.md5("line").alias("line"), "kind")


@query(
    f"""WITH q AS (SELECT id AS conv, pos, lower(content) AS t FROM ({SQL_TURNS}) WHERE role = 'user' AND content IS NOT NULL),
u AS (SELECT DISTINCT lower(unit_name) AS name, string_split(lower(unit_name), ' ')[-1] AS word FROM {SQL_CHUNKS} WHERE unit_name <> ''),
f AS (SELECT DISTINCT conv, pos, name FROM (SELECT conv, pos, unnest(list_distinct({sql(SQL_TOKENS, "t")})) AS word FROM q) JOIN u USING (word)), w AS (SELECT DISTINCT conv, pos, name FROM q JOIN u ON contains(t, name)),
n AS (SELECT coalesce(f.conv, w.conv) AS id, coalesce(f.pos, w.pos) AS pos, count(f.name) AS f, count(w.name) AS w, count(CASE WHEN f.name = w.name THEN 1 END) AS hit FROM f FULL JOIN w ON f.conv = w.conv AND f.pos = w.pos AND f.name = w.name GROUP BY 1, 2)
SELECT id, pos, CASE WHEN f = 0 THEN 1.0 ELSE hit / f END::DOUBLE AS precision, CASE WHEN w = 0 THEN 1.0 ELSE hit / w END::DOUBLE AS recall FROM n"""
)
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of finding units by their last word, against whole names, for every question that names or seems to name one."""
    asked = turns(spark, folder).filter("role = 'user' and content is not null").select(F.struct("id", "pos").alias("qid"), F.lower("content").alias("text"))
    names = _chunks(spark, folder).filter("unit_name <> ''").select(F.lower("unit_name").alias("id")).distinct()
    words = asked.select("qid", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    found = words.join(names.select("id", F.element_at(F.split("id", " "), -1).alias("word")), "word").select("qid", "id").distinct()
    wanted = matching.substring_pairs(names.withColumnRenamed("id", "needle"), asked).select("qid", F.col("needle").alias("id")).distinct()
    return audit.retrieval_scores(found, wanted).select("qid.id", "qid.pos", "precision", "recall")
