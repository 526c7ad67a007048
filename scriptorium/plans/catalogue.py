"""The core's queries: those of the training-data problems 1 and 3 here, the others in the modules imported below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import delimited, snapshots
from scriptorium.plans import corpus_queries, question_queries, retrieval_queries, text_queries  # noqa: F401 - they register themselves
from scriptorium.plans.registry import ORACLES, QUERIES, query
from scriptorium.plans.text_queries import SQL_BLANK
from scriptorium.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]

_DELIVERED = (("datasheets_csv", delimited.DATASHEETS), ("datasheets_keywords_csv", delimited.DATASHEETS_KEYWORDS))


def _sql_rejects(name: str, key: str, flag: str | None) -> str:
    """The rejects of one file as SQL: fields by a pattern, not by a CSV reader."""
    value = lambda c: f"""trim((SELECT CASE WHEN len(x) > 1 AND starts_with(x, '"') AND ends_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END FROM (SELECT coalesce(f[len(n) + 1 - list_position(list_reverse(n), '{c}')], '') AS x)), ' ' || chr(9))"""
    tests = [f"NOT regexp_full_match({value(key)}, '[0-9]{{9}}')"] + ([f"lower({value(flag)}) NOT IN ('true', 'false')"] if flag else [])
    return f"""SELECT '{name}' AS table_name, line_id, reason FROM (SELECT line_id, CASE
 WHEN contains(raw, '"') AND NOT regexp_full_match(raw, '(?s:(?:"(?:[^"]|"")*"|[^"|][^|]*|)(?:\\|(?:"(?:[^"]|"")*"|[^"|][^|]*|))*)') THEN 'quoting'
 WHEN n IS NULL OR len(n) = 0 OR NOT (len(f) = len(n) OR (len(f) = len(n) + 1 AND regexp_replace(trim(f[-1], '"'), '{SQL_BLANK}', '', 'g') = '')) THEN 'column_count'
 WHEN {" OR ".join(tests)} THEN 'invalid_value' END AS reason
FROM (SELECT b.*, h.n, regexp_extract_all('|' || raw, '\\|("(?:[^"]|"")*"|[^|]*)', 1) AS f FROM {name} b
 LEFT JOIN (SELECT batch_no, CASE WHEN trim(x[-1]) = '' THEN x[:-2] ELSE x END AS n FROM (SELECT batch_no, [trim(y) for y in string_split(ltrim(min(raw), chr(65279)), '|')] AS x FROM {name} WHERE line_no = 1 GROUP BY batch_no)) h ON h.batch_no = b.batch_no
 WHERE (line_no IS NULL OR line_no <> 1) AND regexp_replace(raw, '{SQL_BLANK}', '', 'g') <> '')) WHERE reason IS NOT NULL"""


@query(_sql_rejects("datasheets_csv", "id", None) + " UNION ALL " + _sql_rejects("datasheets_keywords_csv", "datasheet_id", "is_faction_keyword"))
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected records of both files with the reason."""
    parts = [
        delimited.parse_delivered(table(spark, folder, name), spec, with_fields=False)
        .filter(F.col("reason").isNotNull())
        .select(F.lit(name).alias("table_name"), "line_id", "reason")
        for name, spec in _DELIVERED
    ]
    return parts[0].unionByName(parts[1])


@query()
def p1_valid_datasheets(spark: SparkSession, folder: str) -> DataFrame:
    """Valid rows of Datasheets.csv, typed, with further columns of their header in the map ``others``."""
    names = ["id", "name", "faction_id", "source_id", "role", "loadout", "transport", "leader_head", "leader_footer", "damaged_w", "damaged_description", "virtual"]
    parsed = delimited.parse_delivered(table(spark, folder, "datasheets_csv"), delimited.DATASHEETS)
    return delimited.typed_rows(parsed, delimited.DATASHEETS, names, others="others")


@query()
def p1_valid_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Valid rows of Datasheets_keywords.csv, typed."""
    parsed = delimited.parse_delivered(table(spark, folder, "datasheets_keywords_csv"), delimited.DATASHEETS_KEYWORDS)
    return delimited.typed_rows(parsed, delimited.DATASHEETS_KEYWORDS, ["datasheet_id", "keyword", "is_faction_keyword"])


@query(
    f"""WITH r AS (SELECT snapshot_no AS no, chunk_id, delivered_at, trim(regexp_replace(coalesce(text, ''), '{SQL_BLANK}', ' ', 'g'), ' ') AS t,
  list_sort([e for e in map_entries(coalesce(meta, MAP {{}}::MAP(VARCHAR, VARCHAR))) if coalesce(e.value, '') <> ''])::VARCHAR AS m FROM chunk_snapshots WHERE snapshot_no IS NOT NULL AND chunk_id IS NOT NULL),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY no, chunk_id ORDER BY delivered_at DESC NULLS LAST) = 1),
c AS (SELECT no, lag(no) OVER (ORDER BY no) AS before FROM (SELECT DISTINCT no FROM r)),
o AS (SELECT c.no, chunk_id, t, m FROM l JOIN c ON l.no = c.before), n AS (SELECT l.no, chunk_id, t, m FROM l JOIN c ON l.no = c.no AND c.before IS NOT NULL)
SELECT coalesce(o.no, n.no)::INTEGER AS snapshot_no, coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN o.no IS NULL THEN 'added' WHEN n.no IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.no = n.no AND o.chunk_id = n.chunk_id WHERE o.no IS NULL OR n.no IS NULL OR o.t <> n.t OR o.m <> n.m"""
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks added, removed or changed between consecutive deliveries."""
    return snapshots.snapshot_changes(table(spark, folder, "chunk_snapshots")).withColumnRenamed("key", "chunk_id")


@query()
def p3_changed_values(spark: SparkSession, folder: str) -> DataFrame:
    """The same changes with old and new contents."""
    deliveries = table(spark, folder, "chunk_snapshots")
    out = snapshots.changed_values(deliveries, snapshots.snapshot_changes(deliveries)).withColumnRenamed("key", "chunk_id")
    return out.withColumns({c: F.to_json(F.array_sort(F.map_entries(c))) for c in ("old_meta", "new_meta")})
