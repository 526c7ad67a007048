"""Queries that build, maintain and audit the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS as S
from scriptorium.functions import text as T
from scriptorium.operators import audit, blocks, chunking, depgraph, incremental, matching, name_graph, resolve
from scriptorium.plans import pipeline
from scriptorium.plans.registry import query
from scriptorium.plans.text_queries import SQL_KEY, SQL_STOP, SQL_TOKENS, SQL_TURNS, sql, turns
from scriptorium.sources.conversations import titles
from scriptorium.session import join_small, settle
from scriptorium.sources.tables import table


def meta(key: str) -> Column:
    return F.try_element_at("meta", F.lit(key))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with the metadata that most operators need, delivered copies once."""
    keys = ("army", "faction_id", "category", "unit_name", "priority", "source_id", "edition", "breadcrumb", "card_name", "section_group", "seq")
    return table(spark, folder, "chunks").select("chunk_id", "block_name", "text", *[meta(k).alias(k) for k in keys]).distinct()


SQL_CHUNKS = "(SELECT DISTINCT chunk_id, block_name, text, " + ", ".join(f"meta['{k}'] AS {k}" for k in ("army", "faction_id", "category", "unit_name", "priority", "source_id", "edition", "breadcrumb", "card_name", "section_group", "seq")) + " FROM chunks)"


@query("SELECT s_suppkey, coalesce(n.n_name, s_nationkey::VARCHAR) AS nation, coalesce(r.r_name, 'none') AS region FROM supplier LEFT JOIN nation n ON s_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey")
def dim_lookup_fallback(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks.lookup(table(spark, folder, "supplier"), table(spark, folder, "nation"), "s_nationkey", "n_nationkey", "n_name", "n_nationkey", "nation")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    rows = join_small(rows, nation, ["s_nationkey"], "left")
    rows = join_small(rows, table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], "left")
    return rows.select("s_suppkey", "nation", F.coalesce("r_name", F.lit("none")).alias("region"))


@query(
    """WITH l AS (SELECT l_orderkey, string_agg('- ' || l_partkey || ' x ' || l_quantity::BIGINT, chr(10) ORDER BY l_linenumber::VARCHAR, l_partkey, l_quantity) AS items FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, md5('# Order ' || o_orderkey || chr(10) || '**Customer:** ' || coalesce(c_name, o_custkey::VARCHAR) || '  |  **Status:** ' || o_orderstatus || CASE WHEN items IS NULL THEN '' ELSE chr(10) || chr(10) || '## Items' || chr(10) || items END) AS block
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey"""
)
def entity_block_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """A Markdown block per order, with its items in the order of their numbers as strings."""
    line = F.concat(F.lit("- "), F.col("l_partkey").cast("string"), F.lit(" x "), F.col("l_quantity").cast("bigint").cast("string"))
    items = blocks.child_lines(table(spark, folder, "lineitem"), "l_orderkey", [F.col("l_linenumber").cast("string"), F.col("l_partkey"), F.col("l_quantity")], line, "items")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = table(spark, folder, "orders").join(items.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").join(customers, "o_custkey", "left")
    name = F.coalesce("c_name", F.col("o_custkey").cast("string"))
    block = blocks.markdown(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), [("Customer", name), ("Status", F.col("o_orderstatus"))], [("Items", F.col("items"))])
    return rows.select("o_orderkey", F.md5(block).alias("block"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def child_rollup_sorted_as_string(spark: SparkSession, folder: str) -> DataFrame:
    rolled = blocks.child_lines(table(spark, folder, "lineitem"), "l_orderkey", [F.col("l_linenumber").cast("string"), F.col("l_partkey")], F.col("l_partkey").cast("string"), "parts")
    return rolled.select("l_orderkey", F.replace("parts", F.lit("\n"), F.lit(",")).alias("parts"))


@query(
    """WITH f AS (SELECT l_partkey, s_name, min(l_orderkey) AS o FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT l_partkey, string_agg(s_name, ', ' ORDER BY o, s_name) AS suppliers FROM f GROUP BY l_partkey"""
)
def first_row_group_names(spark: SparkSession, folder: str) -> DataFrame:
    """The suppliers of each part by first order."""
    names = table(spark, folder, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey"), "l_orderkey").join(table(spark, folder, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return blocks.distinct_in_order(names, "l_partkey", "s_name", "l_orderkey", "suppliers")


@query(
    """WITH e AS (SELECT min(snapshot_no) AS lo, max(snapshot_no) AS hi FROM chunk_snapshots), m AS (SELECT snapshot_no AS no, chunk_id AS key, min(md5(coalesce(text, ''))) AS hash FROM chunk_snapshots WHERE snapshot_no IS NOT NULL GROUP BY 1, 2),
o AS (SELECT no + 1 AS no, key, hash FROM m, e WHERE no < hi), n AS (SELECT no, key, hash FROM m, e WHERE no > lo)
SELECT coalesce(o.no, n.no)::INTEGER AS snapshot_no, coalesce(o.key, n.key) AS key, CASE WHEN n.no IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'skipped' ELSE 'written' END AS action FROM o FULL JOIN n ON o.no = n.no AND o.key IS NOT DISTINCT FROM n.key"""
)
def manifest_diff_each(spark: SparkSession, folder: str) -> DataFrame:
    """What every delivery after the first makes one write, skip and remove."""
    rows = table(spark, folder, "chunk_snapshots").select("snapshot_no", "chunk_id", "text")
    old, new = (incremental.manifest(side.withColumn("key", F.struct("snapshot_no", "chunk_id")), "key", "text") for side in incremental.consecutive(rows, "snapshot_no"))
    return incremental.manifest_diff(old, new).select("key.snapshot_no", F.col("key.chunk_id").alias("key"), "action")


@query(
    """WITH e AS (SELECT min(snapshot_no) AS lo, max(snapshot_no) AS hi FROM chunk_snapshots), d AS (SELECT DISTINCT snapshot_no AS no, chunk_id FROM chunk_snapshots WHERE snapshot_no IS NOT NULL),
f AS (SELECT d.no + 1 AS no, chunk_id, NOT EXISTS (SELECT 1 FROM d b WHERE b.no = d.no + 1 AND b.chunk_id IS NOT DISTINCT FROM d.chunk_id) AS gone FROM d, e WHERE d.no < hi),
g AS (SELECT no, count(*) FILTER (WHERE gone) > 0.4::DOUBLE * count(*) AS guarded FROM f GROUP BY no)
SELECT f.no::INTEGER AS snapshot_no, chunk_id FROM f JOIN g ON f.no = g.no WHERE NOT gone OR guarded"""
)
def reconcile_each(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery without chunks that the next one no longer has, unless too many are gone."""
    return incremental.reconcile_each(table(spark, folder, "chunk_snapshots"), "snapshot_no", "chunk_id")


@query(
    """WITH l AS (SELECT chunk_id, max(snapshot_no) AS snapshot_no FROM chunk_snapshots WHERE snapshot_no IS NOT NULL GROUP BY 1)
SELECT chunk_id, snapshot_no, text FROM (SELECT l.chunk_id, l.snapshot_no, c.text, row_number() OVER (PARTITION BY l.chunk_id ORDER BY c.delivered_at DESC NULLS LAST, c.text DESC NULLS LAST) AS n FROM l JOIN chunk_snapshots c ON c.snapshot_no = l.snapshot_no AND c.chunk_id IS NOT DISTINCT FROM l.chunk_id) WHERE n = 1"""
)
def upsert_all(spark: SparkSession, folder: str) -> DataFrame:
    """All deliveries upserted in order, with the number of the last that gave the chunk."""
    return incremental.fold(table(spark, folder, "chunk_snapshots"), "snapshot_no", "chunk_id", "text", "delivered_at")


@query(f"SELECT unit_name, string_agg(DISTINCT army, ',' ORDER BY army) AS armies FROM {SQL_CHUNKS} WHERE unit_name <> '' AND army <> '' GROUP BY unit_name")
def unit_army_map(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.unit_armies(_chunks(spark, folder)).select("unit_name", F.array_join("armies", ",").alias("armies"))


@query(f"SELECT unit_name, army, md5(string_agg(key, '' ORDER BY key)) AS signature FROM (SELECT *, {sql(SQL_KEY, 'text')} AS key FROM {SQL_CHUNKS} WHERE category IN ('Datasheet', 'Ability', 'Datasheet_Section')) GROUP BY unit_name, army")
def variant_signature(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.variant_signatures(_chunks(spark, folder))


SQL_UNITS = f"(SELECT DISTINCT unit_name FROM {SQL_CHUNKS} WHERE unit_name <> '')"


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select(meta("unit_name").alias("unit_name")).filter("unit_name <> ''").distinct()


@query(
    f"""WITH n AS (SELECT unit_name AS name FROM {SQL_UNITS} UNION SELECT string_split(unit_name, ' ')[-1] FROM {SQL_UNITS})
SELECT a.name AS base, b.name AS member FROM n a JOIN n b ON lower(a.name) <> lower(b.name) AND contains(lower(b.name), lower(a.name))"""
)
def chassis_family(spark: SparkSession, folder: str) -> DataFrame:
    """Names of units, and their last words, that are part of other names."""
    units = _units(spark, folder)
    last = units.select(F.element_at(F.split("unit_name", " "), -1).alias("unit_name"))
    return resolve.chassis_families(units.unionByName(last).distinct())


@query(
    f"""WITH q AS (SELECT id, pos, lower(content) AS t FROM ({SQL_TURNS}) WHERE role = 'user'), h AS (SELECT DISTINCT id, pos, lower(unit_name) AS name FROM q JOIN {SQL_UNITS} u ON contains(t, lower(unit_name)))
SELECT id, pos, name FROM h WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.id = h.id AND b.pos = h.pos AND b.name <> h.name AND contains(b.name, h.name))"""
)
def resolve_named_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The units that users' questions name."""
    asked = turns(spark, folder).filter("role = 'user'").select(F.struct("id", "pos").alias("qid"), F.col("content").alias("text"))
    return resolve.named_units(asked, _units(spark, folder).withColumnRenamed("unit_name", "name")).select("qid.id", "qid.pos", "name")


@query()
def find_occurrences_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """The places of those units, without overlaps."""
    asked = turns(spark, folder).filter("role = 'user'").select(F.struct("id", "pos").alias("qid"), F.col("content").alias("text"))
    found = resolve.named_units(asked, _units(spark, folder).withColumnRenamed("unit_name", "name")).groupBy("qid").agg(F.array_sort(F.collect_set("name")).alias("names"))
    spans = matching.greedy_spans(F.lower("text"), F.col("names"))
    return asked.join(found, "qid").select("qid.id", "qid.pos", F.explode(spans).alias("s")).select("id", "pos", "s.start", "s.stop")


@query(f"SELECT token, min(name) AS name FROM (SELECT unit_name AS name, unnest(list_distinct([t for t in regexp_extract_all(lower(unit_name), '[a-z0-9]+') if len(t) > 1])) AS token FROM {SQL_UNITS}) GROUP BY token HAVING count(DISTINCT name) = 1")
def token_unique_owner(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.token_owners(_units(spark, folder).withColumnRenamed("unit_name", "name"))


SQL_RULES = f"""rules AS (SELECT chunk_id AS stem, trim(regexp_replace(lower(substr(string_split(text, chr(10))[1], 3)), '[^a-z0-9]+', ' ', 'g')) AS name, ' ' || trim(regexp_replace(lower(substr(text, 1 + len(string_split(text, chr(10))[1]))), '[^a-z0-9]+', ' ', 'g')) || ' ' AS body
FROM (SELECT chunk_id, max(text) AS text FROM chunks WHERE starts_with(text, '# ') AND meta['category'] IN ('Core_Rules', 'Army_Rule') GROUP BY chunk_id)),
edges AS (SELECT DISTINCT a.stem AS src, b.stem AS dep FROM rules a JOIN rules b ON a.stem <> b.stem AND len(b.name) > 0 AND contains(a.body, ' ' || b.name || ' '))"""


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    """Core and army rules: stem, name (the heading), text (the rest)."""
    rows = table(spark, folder, "chunks").filter(F.col("text").startswith("# ") & meta("category").isin("Core_Rules", "Army_Rule")).groupBy("chunk_id").agg(F.max("text").alias("text"))
    head = F.get(F.split("text", "\n"), F.lit(0))
    return rows.select(F.col("chunk_id").alias("stem"), F.substring(head, F.lit(3), F.length(head)).alias("name"), F.substring("text", 1 + F.length(head), F.length("text")).alias("text"))


@query(f"WITH {SQL_RULES} SELECT src, dep FROM edges")
def depgraph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that name other rules."""
    return depgraph.name_edges(_rules(spark, folder))


@query(f"WITH {SQL_RULES} SELECT src, dep FROM edges UNION SELECT a.src, b.dep FROM edges a JOIN edges b ON a.dep = b.src WHERE a.src <> b.dep")
def depgraph_one_hop(spark: SparkSession, folder: str) -> DataFrame:
    return name_graph.one_hop(name_graph.name_graph(_rules(spark, folder)))


@query(
    f"""WITH {SQL_RULES}, hop AS (SELECT src, dep FROM edges UNION SELECT a.src, b.dep FROM edges a JOIN edges b ON a.dep = b.src WHERE a.src <> b.dep),
c AS (SELECT (SELECT count(*) FROM hop) AS found, (SELECT count(*) FROM edges) AS "true", (SELECT count(*) FROM hop JOIN edges USING (src, dep)) AS hit)
SELECT found, "true", hit, CASE WHEN found = 0 THEN 1.0 ELSE hit / found END::DOUBLE AS precision, CASE WHEN "true" = 0 THEN 1.0 ELSE hit / "true" END::DOUBLE AS recall,
CASE WHEN found + "true" = 0 THEN 1.0 WHEN hit = 0 THEN 0.0 ELSE 2 * (hit / found) * (hit / "true") / ((hit / found) + (hit / "true")) END::DOUBLE AS f1 FROM c"""
)
def depgraph_prf(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of the widened graph against the plain one."""
    return name_graph.one_hop_scores(name_graph.name_graph(_rules(spark, folder)))


_UNIT_CATEGORIES = "('" + "', '".join(S.unit_categories) + "')"
_SQL_CORE = f"contains(q, '{S.pack_name.lower()}') OR regexp_matches(q, '\\b({'|'.join(S.core_words)})\\b') OR " + " OR ".join(f"contains(q, '{p}')" for p in S.core_phrases)
_SQL_STEM = "CASE " + " ".join(f"WHEN ends_with(token, '{x}') AND len(token) - {len(x)} >= 3 THEN token[: len(token) - {len(x)}]" for x in ("ing", "ed", "es", "s")) + " ELSE token END"


@query(
    f"""WITH a AS (SELECT id, pos, lower(content) AS q FROM ({SQL_TURNS}) WHERE role = 'user'),
one AS (SELECT chunk_id, arg_min(category, coalesce(text, '')) AS category, arg_min(unit_name, coalesce(text, '')) AS unit_name, min(text) AS text FROM {SQL_CHUNKS} GROUP BY chunk_id),
units AS (SELECT DISTINCT unit_name AS name FROM one WHERE unit_name <> '' AND category IN {_UNIT_CATEGORIES}),
core AS (SELECT token FROM (SELECT unnest(list_distinct({sql(SQL_TOKENS, 'text')})) AS token FROM one WHERE category = '{S.core_category}') GROUP BY token HAVING count(*) >= 3),
own AS (SELECT token FROM (SELECT name, unnest(list_distinct({sql(SQL_TOKENS, 'name')})) AS token FROM units) GROUP BY token HAVING count(DISTINCT name) <= 40 AND len(token) >= 5 AND token NOT IN {SQL_STOP}),
telling AS (SELECT token FROM own WHERE token NOT IN (SELECT token FROM core) AND {_SQL_STEM} NOT IN (SELECT {_SQL_STEM} FROM core)),
named AS (SELECT DISTINCT a.id, a.pos FROM a JOIN units ON contains(name, ' ') AND contains(q, lower(name)) UNION SELECT DISTINCT id, pos FROM (SELECT id, pos, unnest(list_distinct({sql(SQL_TOKENS, 'q')})) AS token FROM a) JOIN telling USING (token)),
f AS (SELECT a.id, a.pos, arg_min(name, (-len(name), name)) AS faction FROM a JOIN factions ON name <> '' AND contains(q, lower(name)) GROUP BY a.id, a.pos),
r AS (SELECT a.id, a.pos, faction, ({_SQL_CORE}) AS core, named.id IS NOT NULL AS unit FROM a LEFT JOIN f ON f.id = a.id AND f.pos = a.pos LEFT JOIN named ON named.id = a.id AND named.pos = a.pos)
SELECT id, pos, faction, true AS pack_on, CASE WHEN faction IS NOT NULL AND core THEN 'faction+core+pack' WHEN faction IS NOT NULL THEN 'faction+pack' WHEN unit THEN 'all' ELSE 'core+pack' END AS route FROM r
UNION ALL SELECT id, pos, faction, false, CASE WHEN faction IS NOT NULL THEN 'faction' WHEN unit THEN 'all-pack' ELSE 'core' END FROM r"""
)
def route_truth_table(spark: SparkSession, folder: str) -> DataFrame:
    """The filter under which each user's question is searched, with the pack on and off."""
    asked = turns(spark, folder).filter("role = 'user'").select(F.struct("id", "pos").alias("qid"), F.col("content").alias("text"))
    corpus = pipeline.Corpus(_chunks(spark, folder), table(spark, folder, "factions"))
    chunks = settle(pipeline.numbered(corpus.chunks), "numbered")
    both = [pipeline.routed(asked, corpus, chunks, on).select("qid.id", "qid.pos", "faction", F.lit(on).alias("pack_on"), "route") for on in (True, False)]
    return both[0].unionByName(both[1])


@query(f"SELECT chunk_id, category, army FROM {SQL_CHUNKS} WHERE category NOT IN ('Datasheet', 'Ability', 'Datasheet_Section', 'Army_Rule', 'Detachment_Rule') OR category IS NULL OR army IN ('The Foxjiand', 'Free Rasvu')")
def scope_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that stay in scope when two armies are resolved."""
    armies = F.array(F.lit("The Foxjiand"), F.lit("Free Rasvu"))
    return _chunks(spark, folder).filter(resolve.in_scope(F.col("category"), F.col("army"), armies)).select("chunk_id", "category", "army")


@query(
    f"""SELECT id, CASE WHEN len(content) > 60 THEN left(content, 60) || '...' ELSE content END AS title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM ({SQL_TURNS}) WHERE role = 'user') WHERE n = 1"""
)
def conversation_titles(spark: SparkSession, folder: str) -> DataFrame:
    return titles(turns(spark, folder))


@query(
    r"""WITH c AS (SELECT DISTINCT chunk_id, block_name, text, string_split_regex(coalesce(text, ''), '\r\n|\n|\r')[:6] AS head FROM chunks WHERE block_name IS NOT NULL AND text IS NOT NULL),
m AS (SELECT *, [trim(regexp_extract(l, '\*\*Faction:\*\*\s*([^|]+?)\s*(\||$)', 1)) for l in head] AS f, [regexp_extract(l, '\*\*Source:\*\*\s*(\S+)', 1) for l in head] AS s FROM c)
SELECT chunk_id, CASE WHEN starts_with(block_name, 'unit_') THEN 'Datasheet' WHEN starts_with(block_name, 'stratagem_') THEN 'Stratagem' WHEN starts_with(block_name, 'enhancement_') THEN 'Enhancement' WHEN starts_with(block_name, 'army_rule_') THEN 'Army_Rule'
 WHEN starts_with(block_name, 'detachment_rule_') THEN 'Detachment_Rule' WHEN starts_with(block_name, 'core_rules_') THEN 'Core_Rules' WHEN starts_with(block_name, 'muster_pack_') THEN 'Muster_Pack' ELSE 'Unknown' END AS category,
 coalesce([x for x in f if x <> ''][1], '') AS army, coalesce([x for x in s if x <> ''][1], '') AS source_id, CASE WHEN starts_with(head[1], '# ') THEN trim(substr(head[1], 3)) ELSE '' END AS unit_name FROM m"""
)
def block_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata read from block names and first lines."""
    rows = table(spark, folder, "chunks").filter("block_name is not null and text is not null").select("chunk_id", "block_name", "text").distinct()
    m = chunking.block_metadata(F.col("block_name"), F.col("text"), "10e")
    return rows.select("chunk_id", m.alias("m")).select("chunk_id", "m.category", "m.army", "m.source_id", "m.unit_name")


@query()
def block_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all texts taken as blocks."""
    rows = table(spark, folder, "chunks").filter("block_name is not null and text is not null").select(F.col("block_name").alias("stem"), F.col("text").alias("content")).distinct()
    return chunking.block_chunks(rows, "10e")


@query(
    """WITH f AS (SELECT item_id, left(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 55) AS p FROM eval_items), d AS (SELECT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
SELECT item_id, EXISTS (SELECT 1 FROM d WHERE contains(t, p)) AS present FROM f"""
)
def completeness_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Which items' openings the documents hold."""
    wanted = table(spark, folder, "eval_items").select("item_id", "text")
    corpus = table(spark, folder, "documents").select("text")
    return audit.present(wanted, "item_id", "text", corpus, "text")


@query(
    f"""WITH c AS (SELECT DISTINCT chunk_id, category, text FROM {SQL_CHUNKS}) SELECT coalesce(category, 'none') AS category, count(*)::BIGINT AS chunks, count(DISTINCT {sql(SQL_KEY, 'text')})::BIGINT AS contents, sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END)::BIGINT AS empty, round(avg(len(text)), 3) AS average_length FROM c GROUP BY 1"""
)
def coverage_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per category."""
    rows = _chunks(spark, folder).select("chunk_id", "category", "text").distinct()
    return rows.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(
        F.count("*").alias("chunks"),
        F.count_distinct(T.content_key(F.col("text"))).alias("contents"),
        F.sum(F.when(F.col("text").isNull() | (F.trim("text") == ""), 1).otherwise(0)).cast("bigint").alias("empty"),
        F.round(F.avg(F.length("text")), 3).alias("average_length"),
    )


@query("SELECT user_id, event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_counters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
