"""Predicates on lines of documents, and the labels under which results are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sections of pages that are no rules, by the openings of their slugs.
SKIPPED_SECTIONS = ("books", "contents", "introduction", "hints_and_tips", "example_battlefields", "mission_map_key", "mission_generator", "card_decks", "only_war")

# How worked examples open, and what they hold within their first 400 characters.
EXAMPLE_LEAD = r"^(This|The same) (model|unit|VEHICLE|MONSTER)\b|^A The "
EXAMPLE_WORDS = r"has a [A-Z][a-z]+ characteristic of \d|is selected to (fight|shoot|charge)|has declared a charge|begins the (Movement|Shooting|Charge|Fight) phase"

# Remnants of scripts and controls in page text.
NOISE = ("{", "gtag", "noindex", "googletag", "maltsev", "function(", "press 'confirm'", "press confirm", "show gambit cards")


def is_skipped_section(slug: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in SKIPPED_SECTIONS]), lambda x: F.startswith(slug, x))


def looks_like_example(text: Column) -> Column:
    return text.rlike(EXAMPLE_LEAD) | F.substring(text, 1, 400).rlike(EXAMPLE_WORDS)


def is_noise(line: Column) -> Column:
    low = F.lower(line)
    return F.exists(F.array(*[F.lit(x) for x in NOISE]), lambda x: F.contains(low, x))


def caps_lead(line: Column) -> Column:
    """Whether two of the first six words are in capitals."""
    words = F.slice(F.filter(F.split(line, r"\s+"), lambda w: w != ""), 1, 6)
    return F.size(F.filter(words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))) >= 2


def query_name(name: Column) -> Column:
    """A heading as a question: without its number and typographic quotes."""
    return F.trim(F.translate(F.regexp_replace(name, r"^\s*\d+\.\s*", ""), "‘’", ""))


def source_label(provenance: Column, cosine: Column) -> Column:
    """How a row came into the pool."""
    shown = F.concat(F.lit("`"), cosine.cast("string"), F.lit("`"))
    return (
        F.when(provenance == "unit_slice", "unit slice (named unit)")
        .when(provenance == "named_rule", "named army/detachment rule slice")
        .when(provenance == "dep_seed", "dependency seed (child)")
        .when(provenance == "seq_neighbor", "sequence neighbor (child)")
        .when(provenance == "lexical", F.concat(F.lit("lexical "), F.coalesce(shown, F.lit("`None`"))))
        .when(cosine.isNull(), "metadata fetch")
        .when(cosine == 0, "metadata fetch (cosine `0.0`)")
        .otherwise(F.concat(F.lit("cosine "), shown))
    )


def is_child(provenance: Column) -> Column:
    """Whether a row was pulled in by another, behind which it is shown."""
    return provenance.isin("dep_seed", "seq_neighbor")


def rank_label(rank_score: Column, rerank: Column, provenance: Column) -> Column:
    """The score that ordered a row, and the reranker's own where the two differ."""
    own = F.round(rerank, 3).cast("string")
    code = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    score = code(rank_score.cast("string"))
    bare = F.when(rerank.isNotNull(), code(own)).otherwise(F.concat(F.lit("not reranked"), F.when(provenance == "seq_neighbor", " (sequence neighbor)").otherwise("")))
    return F.when(rank_score.isNull(), bare).when(rerank.isNotNull() & (F.abs(rerank - rank_score) > 0.01), F.concat(score, F.lit("  (cross-encoder "), code(own), F.lit(")"))).otherwise(score)


def display_time(iso: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """An ISO time for display; what is none is shown as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), pattern), iso)
