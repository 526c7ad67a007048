"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count as content; "not", "never" and "no" do.
STOPWORDS = (
    "the a an is are was were be been being do does did how what which who whom when where why can could should would "
    "will shall may might i me my we our you your it its they them to of in on at for and or as if that this these those "
    "with from by about into than then each other too so up out off over work works rule rules does got get"
).split()

# Openings of lines that are headers of a chunk, not text.
HEADERS = ("#", "**Unit:**", "**Faction:**", "**Category:**", "**Source:**")

# Line ends.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Abbreviations and variants, replaced one after the other.
SYNONYMS = (
    ("invul", "invulnerable save"),
    ("inv save", "invulnerable save"),
    ("fnp", "feel no pain"),
    ("sticky", "sticky objectives"),
    ("saves", "saving throws"),
    ("reserves", "reinforcements"),
    ("overwatch", "overwatch"),
    ("ap", "armour penetration"),
    ("oc", "objective control"),
    ("ds", "deep strike"),
    ("deep strike", "deep strike"),
    ("transhuman", "transhuman physiology"),
    ("battleshocked", "battle-shock"),
    ("battle shocked", "battle-shock"),
    ("battleshock", "battle-shock"),
    ("battle shock", "battle-shock"),
    ("brick", "unit"),
)

# What separates the clauses of a question, and what opens an operative one.
CLAUSE_MARKERS = "after|before|once|when|whenever|while|if|unless|assuming|given that|provided|so that|in order to|then|and then|but"
INTERROGATIVES = "how what can could does do did is are may would should which when where will whose who".split()


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row. Inside lambdas an outer expression would be computed again for
    every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 longer than one character, in order, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def content_terms(text: Column) -> Column:
    """Distinct tokens that are no stopwords."""
    return F.array_except(tokens(text), F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)]))


def phrase_form(text: Column) -> Column:
    """Alphanumeric words in lower case, one blank between and around them: for whole-phrase tests."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def is_header(line: Column) -> Column:
    test = line.startswith(HEADERS[0])
    for opening in HEADERS[1:]:
        test = test | line.startswith(opening)
    return test


def content_text(text: Column) -> Column:
    """The text without header lines, whitespace collapsed."""
    lines = F.filter(F.split(text, LINE_END), lambda line: ~is_header(line))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), r"(?U)\s+", " "), "^ | $", "")


def content_key(text: Column) -> Column:
    """The identity of a text's content; null counts as empty."""
    return F.md5(content_text(F.coalesce(text, F.lit(""))))


def display_name(rule_name: Column, breadcrumb: Column) -> Column:
    """The rule's own name: the last part of its breadcrumb, in phrase form without the outer blanks."""
    raw = F.coalesce(F.nullif(rule_name, F.lit("")), breadcrumb, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(F.element_at(F.split(raw, ">"), -1)), "[^a-z0-9]+", " "))


def expand(text: Column, pairs: Sequence[tuple[str, str]] = SYNONYMS) -> Column:
    """Replace whole words, in the order of the pairs; later ones see earlier results."""
    for short, full in pairs:
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(short)}\b", full)
    return text


def light_stem(token: Column) -> Column:
    """Strip the first of ing, ed, es, s that leaves three characters."""
    out = F.when(F.lit(False), token)
    for suffix in ("ing", "ed", "es", "s"):
        fits = token.endswith(suffix) & (F.length(token) - len(suffix) >= 3)
        out = out.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix)))
    return out.otherwise(token)


def safe(value: Column, fallback: str = "—") -> Column:
    """The trimmed value, or the fallback for null and sentinels."""
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(trimmed.isNull() | trimmed.isin("", "nan", "None"), F.lit(fallback)).otherwise(trimmed)


#: Order matters: lists and breaks become separators before tags go; blanks are tidied last.
_TAGS = ((r"<li[^>]*>", ""), (r"\s*</li\s*>", ", "), (r"\s*<br\s*/?>", " "), (r"\s*</?ul[^>]*>", " "), (r"<[^>]+>", " "))
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'))
_TIDY = (
    (r"\s+", " "), (r"^\s+|\s+$", ""), (r":\s*,", ":"), (r"(?:\s*,){2,}", ","), (r"\s*,\s*", ", "), (r"[\s,]+$", ""),
    (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+([.;:!?])", "$1"),
)


def strip_html(text: Column) -> Column:
    """Markup to plain text; list items become comma-separated."""
    for pattern, new in _TAGS:
        text = F.regexp_replace(text, pattern, new)
    for entity, new in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(new))
    for pattern, new in _TIDY:
        text = F.regexp_replace(text, pattern, new)
    return text


def clean_text(text: Column) -> Column:
    """Typographic characters to plain ones, blanks collapsed, closing punctuation and dice notation re-joined."""
    for old, new in (("\xa0", " "), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("•", "-")):
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern, new in ((r"(?U)\s+", " "), (r"^ | $", ""), (r"\s+([.,;:!?)])", "$1"), (r"(\d)\s*\+", "$1+")):
        text = F.regexp_replace(text, pattern, new)
    return F.coalesce(text, F.lit(""))


def slugify(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s-]", ""), r"(?U)[\s_-]+", "_")
    return F.regexp_replace(F.substring(slug, 1, 60), "^_+|_+$", "")


def sentences(text: Column, least: int = 15) -> Column:
    """Sentences longer than ``least`` characters, without header lines."""
    prose = F.array_join(F.filter(F.split(text, LINE_END), lambda line: ~line.startswith("#") & ~line.startswith("**")), "\n")
    parts = F.transform(F.split(prose, r"(?<=[.])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) > least)


def clauses(question: Column, most: int) -> Column:
    """The first ``most`` clauses of a question that open like a question, and the whole question last; only the whole one if
    it has one clause or none of that kind."""
    whole = F.regexp_replace(question, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(whole, rf"(?i)[.;,]|\b(?:{CLAUSE_MARKERS})\b"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 3)
    operative = F.slice(F.filter(parts, lambda p: p.rlike(rf"(?i)^(?:{'|'.join(INTERROGATIVES)})\b")), 1, most)
    kept = F.when(F.array_contains(operative, whole), operative).otherwise(F.array_append(operative, whole))
    return F.when((F.size(parts) <= 1) | (F.size(operative) == 0), F.array(whole)).otherwise(kept)


def token_estimate(text: Column, ratio: int = 4) -> Column:
    return F.floor(F.length(text) / ratio).cast("bigint")


def strip_reasoning(text: Column) -> Column:
    """Without closed, then unclosed think blocks; the raw text if nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))
    return F.when(bare == "", text).otherwise(bare)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
