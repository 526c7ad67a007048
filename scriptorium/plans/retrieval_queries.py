"""Queries over questions and candidates: lexical, dense, fused, ranked, assembled, budgeted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS as S
from scriptorium.functions import text as T
from scriptorium.operators import dense, lexical, rank
from scriptorium.plans.registry import query
from scriptorium.plans.text_queries import SQL_KEY, SQL_STOP, SQL_TOKENS, SQL_TURNS, sql, turns
from scriptorium.session import settle
from scriptorium.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation items as questions."""
    return table(spark, folder, "eval_items").select(F.col("item_id").alias("qid"), "text")


#: BM25 of every evaluation item against every document, as common table expressions that end in ``bm``.
SQL_BM25 = f"""toks AS (SELECT doc_id AS id, {sql(SQL_TOKENS, "coalesce(text, '')")} AS t FROM documents),
size AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM toks) GROUP BY term),
w AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM w) ELSE raw END AS idf FROM w),
asked AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest({sql(SQL_TOKENS, 'text')}) AS term FROM eval_items) GROUP BY ALL),
post AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM toks) GROUP BY ALL),
bm AS (SELECT qid, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / average))), 6) AS score,
  sum(CASE WHEN term IN {SQL_STOP} THEN 0 ELSE 1 END)::BIGINT AS matched FROM post JOIN asked USING (term) JOIN idf USING (term), size GROUP BY qid, id)"""


@query(f"WITH {SQL_BM25} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 30")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 30 best documents of every evaluation item."""
    return lexical.bm25_topk(_documents(spark, folder), _questions(spark, folder), S.lexical_candidates).select("qid", "id", "score", "rank")


SQL_LEXICAL = f"""{SQL_BM25},
best AS (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 30),
terms AS (SELECT qid, count(*) AS terms FROM asked WHERE term NOT IN {SQL_STOP} GROUP BY qid),
lex AS (SELECT qid, id, sim, rank FROM (SELECT qid, id, round(0.40 + (0.55 - 0.40) * score / top, 3) AS sim, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n
  FROM best JOIN terms USING (qid) WHERE score > 0 AND matched / terms >= 0.8) WHERE n <= 5)"""


@query(f"WITH {SQL_LEXICAL} SELECT qid, id, sim FROM lex")
def lexical_search_gated(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with enough of an item's content terms, at most five each."""
    return lexical.lexical_search(_documents(spark, folder), _questions(spark, folder)).select("qid", "id", "sim")


@query(
    f"""WITH {SQL_LEXICAL},
keyed AS (SELECT l.qid, l.id, l.sim, l.rank, d.text, {sql(SQL_KEY, 'd.text')} AS key, coalesce(d.army, d.source, 'Rule') AS label FROM lex l JOIN documents d ON d.doc_id = l.id),
once AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY rank) AS n FROM keyed) WHERE n = 1),
sized AS (SELECT *, floor(len('[' || nth || '] ' || label || chr(10) || coalesce(text, '')) / 4)::BIGINT + CASE WHEN nth > 1 THEN 2 ELSE 0 END AS tokens FROM once),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY qid ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized)
SELECT qid, id, sim, nth AS place, tokens, before FROM run WHERE before < 2800"""
)
def budgeted_context(spark: SparkSession, folder: str) -> DataFrame:
    """The context of every evaluation item: lexical search, contents once, whole rows up to the token budget."""
    found = lexical.lexical_search(_documents(spark, folder), _questions(spark, folder))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce("army", "source", F.lit("Rule")).alias("label"))
    rows = found.join(texts, "id").withColumn("key", T.content_key(F.col("text")))
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), F.asc("id"))
    once = rank.first_per_key(rows.withColumn("pos", F.row_number().over(order))).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("pos")).cast("bigint"))
    kept = rank.soft_budget(once, F.col("label"), F.col("text"), S.context_token_budget, S.token_char_ratio, pos="place")
    return kept.select("qid", "id", "sim", "place", "tokens", "before")


#: Names of chunks in questions of conversations.
SQL_NAMED = r"""named AS (SELECT DISTINCT chunk_id AS id, trim(regexp_replace(lower(string_split(meta['breadcrumb'], '>')[-1]), '[^a-z0-9]+', ' ', 'g')) AS name FROM chunks WHERE meta['breadcrumb'] IS NOT NULL)"""


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).filter("role = 'user'").select(F.struct("id", "pos").alias("qid"), F.col("content").alias("text"))


@query(
    f"""WITH {SQL_NAMED}, asked AS (SELECT id AS conv_id, pos, ' ' || trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')) || ' ' AS q FROM ({SQL_TURNS}) WHERE role = 'user')
SELECT conv_id, pos, id AS chunk_id FROM asked JOIN named ON contains(q, ' ' || name || ' ') WHERE len(string_split(name, ' ')) >= 2"""
)
def exact_phrase_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose name a user's question holds."""
    meta = lambda k: F.try_element_at("meta", F.lit(k))
    named = table(spark, folder, "chunks").filter(meta("breadcrumb").isNotNull()).select(F.col("chunk_id").alias("id"), T.display_name(F.lit(None).cast("string"), meta("breadcrumb")).alias("name")).distinct()
    return lexical.exact_names(named, _asked(spark, folder)).select(F.col("qid.id").alias("conv_id"), F.col("qid.pos").alias("pos"), F.col("id").alias("chunk_id"))


SQL_DENSE = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT qid, vec_id AS id, label, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS cosine FROM q, embeddings WHERE vec_id <> qid),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM pairs) WHERE rank <= {k})"""


def _nearest(spark: SparkSession, folder: str, k: int, threshold: float | None = None) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, searched among all rows."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return dense.dense_topk(vectors, vectors.filter("id % 100 = 0").withColumnRenamed("id", "qid"), k, threshold)


@query(f"WITH {SQL_DENSE.format(k=10)} SELECT qid, id, cosine, rank FROM pool")
def dense_topk_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder, 10)


@query(f"WITH {SQL_DENSE.format(k=48)} SELECT qid, id, cosine, rank FROM pool WHERE cosine >= 0.3")
def dense_topk_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder, S.rerank_candidates, S.similarity_threshold)


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    """Dense candidates with a category, a unit and a stand-in rerank score that a model would give; ``key`` is the content key of the
    document of the same number, of which some are equal."""
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    category = F.when(F.col("label") == 0, S.core_category).when(F.col("label") == 1, S.pack_category).otherwise("Ability")
    rows = _nearest(spark, folder, S.rerank_candidates).join(labels, "id").withColumn("category", category)
    rerank = F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.round(T.sigmoid(8 * F.col("cosine") - 4), 6))
    rows = rows.withColumn("rerank", rerank).withColumn("score", F.round(rank.blended_score(F.col("rerank"), F.col("cosine"), F.col("category")), 6))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), T.content_key(F.col("text")).alias("key"))
    rows = rows.join(texts, "id", "left").withColumn("key", F.coalesce("key", F.col("id").cast("string")))
    return settle(rows.select("qid", "id", F.col("rank").alias("pos"), "cosine", "label", "category", "rerank", "score", "key"), "pool")


SQL_POOL = f"""{SQL_DENSE.format(k=48)},
doc AS (SELECT doc_id AS id, {sql(SQL_KEY, "coalesce(text, '')")} AS key FROM documents),
cand AS (SELECT *, rank AS pos, round(CASE WHEN rerank IS NULL THEN cosine ELSE greatest(rerank, 0.4 * cosine) END + CASE category WHEN 'Muster_Pack' THEN 0.002 WHEN 'Core_Rules' THEN 0.001 ELSE 0 END, 6) AS score FROM (
  SELECT *, CASE label WHEN 0 THEN 'Core_Rules' WHEN 1 THEN 'Muster_Pack' ELSE 'Ability' END AS category, CASE WHEN id % 7 = 0 THEN NULL ELSE round(1 / (1 + exp(-(8 * cosine - 4))), 6) END AS rerank FROM (SELECT pool.*, coalesce(doc.key, pool.id::VARCHAR) AS key FROM pool LEFT JOIN doc USING (id))))"""


@query(f"WITH {SQL_POOL} SELECT qid, id, category, score FROM cand")
def blended_score(spark: SparkSession, folder: str) -> DataFrame:
    return _pool(spark, folder).select("qid", "id", "category", "score")


SQL_RESERVED = f"""{SQL_POOL},
b AS (SELECT *, CASE WHEN score >= max(score) OVER (PARTITION BY qid, label) - 0.05 THEN max(score) OVER (PARTITION BY qid, label) ELSE score END AS bucket FROM cand WHERE label > 1),
p AS (SELECT *, row_number() OVER w AS place, first_value(score) OVER w AS first FROM b WINDOW w AS (PARTITION BY qid, label ORDER BY bucket DESC, cosine DESC, pos)),
units AS (SELECT * FROM p WHERE place = 1 OR (place <= 2 AND (first < 0.1 OR score >= 0.3 * first)))"""


@query(f"WITH {SQL_RESERVED} SELECT qid, id, label, score, place FROM units")
def per_group_reservation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pool(spark, folder).filter("label > 1").withColumn("unit", F.col("label"))
    return rank.reserve_units(rows).select("qid", "id", "label", "score", "place")


@query(
    f"""WITH {SQL_POOL},
once AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY pos) AS n FROM cand),
rfirst AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY pos) AS n FROM cand WHERE label <= 1),
rules AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS r FROM rfirst WHERE n = 1) WHERE r <= 4),
ufirst AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY pos) AS n FROM cand WHERE label > 1),
free AS (SELECT * FROM ufirst u WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.qid = u.qid AND r.key = u.key)),
b AS (SELECT *, CASE WHEN score >= max(score) OVER (PARTITION BY qid, label) - 0.05 THEN max(score) OVER (PARTITION BY qid, label) ELSE score END AS bucket FROM free),
p AS (SELECT *, row_number() OVER w AS place, first_value(score) OVER w AS first FROM b WINDOW w AS (PARTITION BY qid, label ORDER BY bucket DESC, cosine DESC, pos)),
units AS (SELECT * FROM p WHERE place = 1 OR (place <= 2 AND (first < 0.1 OR score >= 0.3 * first))),
own AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, pos) = 1 THEN 1 ELSE 3 END AS tier FROM units),
res AS (SELECT qid, id, key, pos, score, tier FROM own UNION ALL SELECT qid, id, key, pos, score, 2 FROM rules),
rest AS (SELECT c.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS r FROM once c WHERE n = 1 AND score >= 0 AND NOT EXISTS (SELECT 1 FROM res WHERE res.qid = c.qid AND res.key = c.key) AND NOT EXISTS (SELECT 1 FROM own WHERE own.qid = c.qid AND own.label = c.label)),
al AS (SELECT qid, id, pos, score, tier FROM res UNION ALL SELECT rest.qid, id, pos, score, 4 FROM rest LEFT JOIN (SELECT qid, count(*) AS taken FROM res GROUP BY qid) t ON t.qid = rest.qid WHERE r <= greatest(0, 8 - coalesce(taken, 0)))
SELECT qid, id, tier::INTEGER AS tier, score, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, pos) AS place FROM al"""
)
def assemble_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Reserved units, rules and fill, in output order."""
    pool = _pool(spark, folder).withColumn("unit", F.col("label"))
    return rank.assemble(pool.filter("label > 1"), pool.filter("label <= 1"), pool)


@query(
    f"""WITH {SQL_POOL},
named AS (SELECT * REPLACE (id::VARCHAR AS key) FROM cand),
seeds AS (SELECT qid, key, cosine AS bridge, [(id - 1)::VARCHAR, (id + 1)::VARCHAR, (id + 2)::VARCHAR] AS parents, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, key) - 1 AS i FROM named),
f AS (SELECT s.qid, s.key, min(c.score) AS floor FROM (SELECT qid, key, unnest(parents) AS parent FROM seeds) s JOIN named c ON c.qid = s.qid AND c.key = s.parent GROUP BY ALL)
SELECT qid, key, round(floor - 0.02 - i * 0.001, 4) AS override FROM seeds LEFT JOIN f USING (qid, key)"""
)
def parent_cap(spark: SparkSession, folder: str) -> DataFrame:
    """All rows as seeds, kept below their weakest parent; the parents are the rows with neighbouring ids."""
    pool = _pool(spark, folder).withColumn("key", F.col("id").cast("string"))
    parents = F.array(*[(F.col("id") + d).cast("string") for d in (-1, 1, 2)])
    seeds = pool.select("qid", "key", F.col("cosine").alias("bridge"), parents.alias("parent_keys"))
    return rank.cap_below_parents(seeds, pool).select("qid", "key", "override")


@query(
    f"""WITH {SQL_LEXICAL},
doc AS (SELECT doc_id AS id, {sql(SQL_KEY, "coalesce(text, '')")} AS key FROM documents),
a AS (SELECT i.item_id AS qid, v.vec_id AS id, coalesce(doc.key, v.vec_id::VARCHAR) AS key, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM eval_items i JOIN embeddings e ON e.vec_id = i.item_id, embeddings v LEFT JOIN doc ON doc.id = v.vec_id WHERE v.vec_id <> e.vec_id),
d AS (SELECT qid, id, key, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS n FROM a) WHERE n <= 48),
l AS (SELECT lex.qid, lex.id, doc.key, lex.sim AS score FROM lex JOIN doc ON doc.id = lex.id)
SELECT qid, id, score, 'dense' AS origin FROM d UNION ALL SELECT qid, id, score, 'lexical' FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY score DESC, id) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.qid = l.qid AND d.key = l.key)) WHERE n = 1"""
)
def hybrid_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Dense rows of the items that have a vector, then lexical ones of other contents. A vector stands for the document of its number."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"))
    near = dense.dense_topk(vectors, vectors.join(asked, "id").withColumnRenamed("id", "qid"), S.rerank_candidates)
    texts = _documents(spark, folder).select("id", T.content_key(F.col("text")).alias("key"))
    near = near.join(texts, "id", "left").select("qid", "id", F.coalesce("key", F.col("id").cast("string")).alias("key"), F.col("cosine").alias("score"))
    found = lexical.lexical_search(_documents(spark, folder), _questions(spark, folder)).join(texts, "id").select("qid", "id", "key", F.col("sim").alias("score"))
    return dense.fuse(settle(near, "near"), found).select("qid", "id", "score", "origin")


@query(
    f"""WITH m AS (SELECT id, pos, content FROM ({SQL_TURNS})), p AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS place FROM m WHERE starts_with(content, 'Explain')),
n AS (SELECT id, pos - 1 AS pos, place FROM p UNION ALL SELECT id, pos + 1, place FROM p)
SELECT id, pos, min(place) AS place FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = n.id AND p.pos = n.pos) AND EXISTS (SELECT 1 FROM m WHERE m.id = n.id AND m.pos = n.pos) GROUP BY id, pos"""
)
def sequence_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The messages around every request for an explanation."""
    m = turns(spark, folder).select("id", F.col("pos").alias("seq"), "content")
    order = Window.partitionBy("id").orderBy("seq")
    rows = m.filter(F.col("content").startswith("Explain")).select(F.col("id").alias("qid"), F.col("id").alias("group"), "seq", F.row_number().over(order).cast("bigint").alias("place"))
    members = m.select(F.col("id").alias("group"), "seq", "id")
    return rank.sequence_neighbours(rows, members).select("id", F.col("seq").alias("pos"), "place")


@query(
    f"""WITH s AS (SELECT id, pos, floor(len('[' || row_number() OVER (PARTITION BY id ORDER BY pos) || '] ' || role || chr(10) || coalesce(content, '')) / 4)::BIGINT + CASE WHEN row_number() OVER (PARTITION BY id ORDER BY pos) > 1 THEN 2 ELSE 0 END AS tokens FROM ({SQL_TURNS})),
r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s) SELECT id, pos, tokens, before FROM r WHERE before < 120"""
)
def soft_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of each conversation within 120 tokens."""
    return rank.soft_budget(turns(spark, folder), F.col("role"), F.col("content"), 120, by="id").select("id", "pos", "tokens", "before")


@query(f"SELECT id, pos, role FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS n FROM ({SQL_TURNS})) WHERE n <= 6")
def history_trim(spark: SparkSession, folder: str) -> DataFrame:
    return rank.last_rows(turns(spark, folder), "id", "pos", S.max_history_messages).select("id", "pos", "role")


@query(
    f"""WITH a AS ({SQL_POOL.join(['WITH ', ''])} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS x, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS y FROM cand)
SELECT coalesce(o.qid, n.qid) AS qid, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'dropped' ELSE 'moved' END AS change
FROM (SELECT * FROM a WHERE x <= 8) o FULL JOIN (SELECT * FROM a WHERE y <= 8) n ON o.qid = n.qid AND o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.x <> n.y"""
)
def ranking_changes(spark: SparkSession, folder: str) -> DataFrame:
    """How the rerank scores change the eight best."""
    pool = _pool(spark, folder)
    place = lambda by: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), F.asc("id")))
    old, new = (pool.withColumn("place", place(c)).filter("place <= 8") for c in ("cosine", "score"))
    return rank.ranking_changes(old, new)
