"""Queries over single texts and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.where import compile_where, in_map
from scriptorium.plans.registry import query
from scriptorium.sources.tables import table

#: DuckDB's counterparts of the text functions; {x} is the text.
SQL_TOKENS = "[t for t in regexp_extract_all(lower({x}), '[a-z0-9]+') if len(t) > 1]"
SQL_STOP = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOPWORDS)) + ")"
SQL_TERMS = f"list_distinct([t for t in regexp_extract_all(lower({{x}}), '[a-z0-9]+') if len(t) > 1 and t not in {SQL_STOP}])"
SQL_BLANK = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL_LINES = r"string_split_regex(coalesce({x}, ''), '\r\n|[\n\r\x0b\x0c\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]')"
SQL_HEADER = "(" + " or ".join(f"starts_with(l, '{h}')" for h in T.HEADERS) + ")"
SQL_CONTENT = f"regexp_replace(regexp_replace(array_to_string([l for l in {SQL_LINES} if not {SQL_HEADER}], ' '), '{SQL_BLANK}', ' ', 'g'), '^ | $', '', 'g')"
SQL_KEY = f"md5({SQL_CONTENT})"


def sql(template: str, x: str) -> str:
    return template.replace("{x}", x)


@query(f"SELECT term, count(*)::BIGINT AS tf, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({sql(SQL_TOKENS, 'text')}) AS term FROM documents) GROUP BY term")
def lexical_tokens_df(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus and document frequency of every token."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    per_text = rows.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_text.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query(f"SELECT item_id, len({sql(SQL_TERMS, 'text')})::BIGINT AS terms FROM eval_items")
def content_terms_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select("item_id", F.size(T.content_terms(F.col("text"))).cast("bigint").alias("terms"))


@query(f"SELECT key, min(chunk_id) AS chunk_id, count(*)::BIGINT AS copies FROM (SELECT chunk_id, {sql(SQL_KEY, 'text')} AS key FROM chunks) GROUP BY key")
def content_key_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first chunk of each content."""
    keyed = table(spark, folder, "chunks").select("chunk_id", T.content_key(F.col("text")).alias("key"))
    return keyed.groupBy("key").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies"))


@query("SELECT chunk_id, md5(text) AS hash, count(*)::BIGINT AS rows FROM chunks GROUP BY ALL")
def content_hash_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").groupBy("chunk_id", F.md5("text").alias("hash")).agg(F.count("*").alias("rows"))


def _sql_expand(x: str) -> str:
    for short, full in T.SYNONYMS:
        x = rf"regexp_replace({x}, '\b{short}\b', '{full}', 'gi')"
    return x


@query(f"SELECT doc_id, md5({_sql_expand('text')}) AS expanded FROM documents")
def expand_query_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(T.expand(F.col("text"))).alias("expanded"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(term, '{s}') AND len(term) - {len(s)} >= 3 THEN term[: len(term) - {len(s)}]" for s in ("ing", "ed", "es", "s")) + " ELSE term END"


@query(f"SELECT {_STEM} AS stem, count(*)::BIGINT AS forms FROM (SELECT DISTINCT unnest({sql(SQL_TOKENS, 'text')}) AS term FROM documents) GROUP BY 1")
def light_stem_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct tokens by their stem."""
    terms = table(spark, folder, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return terms.groupBy(T.light_stem(F.col("term")).alias("stem")).agg(F.count("*").alias("forms"))


def _sql_chain(x: str, steps) -> str:
    for pattern, new in steps:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("'", "''"), new.replace("$1", r"\1").replace("'", "''"))
    return x


def _sql_strip(x: str) -> str:
    x = _sql_chain(x, T._TAGS)
    for entity, new in T._ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, entity, new.replace("'", "''"))
    return _sql_chain(x, T._TIDY)


@query(f"SELECT line_id, md5({_sql_strip('raw')}) AS plain FROM datasheets_csv")
def strip_html_records(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered records without their markup."""
    return table(spark, folder, "datasheets_csv").select("line_id", F.md5(T.strip_html(F.col("raw"))).alias("plain"))


def _sql_clean(x: str) -> str:
    for old, new in ((0xA0, " "), (0x2019, "''"), (0x2018, "''"), (0x201C, '"'), (0x201D, '"'), (0x2013, "-"), (0x2014, "--"), (0x2022, "-")):
        x = f"replace({x}, chr({old}), '{new}')"
    return _sql_chain(x, ((SQL_BLANK, " "), ("^ | $", ""), (r"\s+([.,;:!?)])", "$1"), (r"(\d)\s*\+", "$1+")))


@query(f"SELECT doc_id, md5(coalesce({_sql_clean('text')}, '')) AS clean FROM documents")
def clean_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean"))


@query(
    r"""SELECT id, regexp_replace(left(regexp_replace(regexp_replace(trim(lower(title)), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '[\s_-]+', '_', 'g'), 60), '^_+|_+$', '', 'g') AS slug FROM conversations"""
)
def slugify_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("id", T.slugify(F.col("title")).alias("slug"))


@query(
    f"""SELECT chunk_id, len(s)::BIGINT AS sentences, list_sum([len(x) for x in s])::BIGINT AS characters FROM (
    SELECT chunk_id, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in string_split_regex(regexp_replace(array_to_string([l for l in {sql(SQL_LINES, 'text')} if not starts_with(l, '#') and not starts_with(l, '**')], chr(10)), '([.])\\s+', '\\1' || chr(1), 'g'), chr(1))
      if len(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 15] AS s FROM chunks WHERE text IS NOT NULL) WHERE len(s) > 0"""
)
def rule_sentences(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "chunks").select("chunk_id", T.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    return s.select("chunk_id", F.size("s").cast("bigint").alias("sentences"), total.alias("characters"))


#: The messages of each conversation's last delivery, one row per message.
SQL_TURNS = """SELECT id, p - 1 AS pos, json_extract_string(messages, '$[' || (p - 1) || '].role') AS role, json_extract_string(messages, '$[' || (p - 1) || '].content') AS content
FROM (SELECT *, unnest(generate_series(1, json_array_length(messages)::BIGINT)) AS p FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY id ORDER BY archived DESC, length(messages) DESC, messages DESC) = 1))"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """``id, pos, role, content``: the messages of each conversation's last delivery."""
    best = F.max(F.struct("archived", F.length("messages").alias("n"), "messages")).alias("best")
    latest = table(spark, folder, "conversations").groupBy("id").agg(best)
    messages = F.from_json("best.messages", "array<struct<role:string,content:string>>")
    return latest.select("id", F.posexplode(messages).alias("p", "m")).select("id", F.col("p").cast("bigint").alias("pos"), "m.role", "m.content")


_PARTS = rf"[trim(x) for x in string_split_regex(regexp_replace(q, '\b({T.CLAUSE_MARKERS})\b|[.;,]', chr(1), 'gi'), chr(1)) if len(trim(x)) > 3]"
_OPERATIVE = rf"[x for x in parts if regexp_matches(x, '^({'|'.join(T.INTERROGATIVES)})\b', 'i')][:2]"


@query(
    f"""SELECT id, pos, array_to_string(CASE WHEN len(parts) <= 1 OR len(ops) = 0 THEN [q] WHEN list_contains(ops, q) THEN ops ELSE list_append(ops, q) END, ' | ') AS clauses FROM (
    SELECT *, {_OPERATIVE} AS ops FROM (SELECT *, {_PARTS} AS parts FROM (SELECT id, pos, trim(content) AS q FROM ({SQL_TURNS}) WHERE role = 'user')))"""
)
def segment_query_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """The clauses of every user's question."""
    asked = turns(spark, folder).filter("role = 'user'")
    return asked.select("id", "pos", F.array_join(T.clauses(F.col("content"), 2), " | ").alias("clauses"))


def _sql_meta(key: str) -> str:
    return f"meta['{key}']"


#: name -> (filter, the same as SQL)
WHERE_CASES = {
    "where_eq": ({"category": "Ability"}, f"{_sql_meta('category')} = 'Ability'"),
    "where_ne_null_safe": ({"card_name": {"$ne": "Thorned Retreat"}}, f"{_sql_meta('card_name')} IS DISTINCT FROM 'Thorned Retreat'"),
    "where_and_or": (
        {"$and": [{"$or": [{"category": "Core_Rules"}, {"category": {"$eq": "Army_Rule"}}]}, {"priority": {"$ne": "2"}}]},
        f"({_sql_meta('category')} = 'Core_Rules' OR {_sql_meta('category')} = 'Army_Rule') AND {_sql_meta('priority')} IS DISTINCT FROM '2'",
    ),
    "where_in": ({"faction_id": {"$in": ["FOX", "HUV", "KEM"]}}, f"{_sql_meta('faction_id')} IN ('FOX', 'HUV', 'KEM')"),
    "where_unknown_operator": ({"priority": {"$gt": "1"}}, "false"),
}


def _register_where(name: str, where: dict, condition: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "chunks").filter(compile_where(where, in_map("meta"))).select("chunk_id", "block_name")

    run.__name__ = name
    run.__doc__ = f"Chunks that pass {where}."
    query(f"SELECT chunk_id, block_name FROM chunks WHERE {condition}")(run)


for _name, (_where, _condition) in WHERE_CASES.items():
    _register_where(_name, _where, _condition)
