"""Rule blocks (one Markdown text each) to chunks: metadata, cards, sub-rules, abilities, sections. All array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.functions.text import LINE_END, bind

# File name prefixes and their categories; the pack's prefix follows from its category.
CATEGORIES = (
    ("unit_", "Datasheet"),
    ("stratagem_", "Stratagem"),
    ("enhancement_", "Enhancement"),
    ("army_rule_", "Army_Rule"),
    ("detachment_rule_", "Detachment_Rule"),
    ("core_rules_", "Core_Rules"),
)
TITLE_PREFIXES = ("Stratagem: ", "Enhancement: ", "Army Rule: ", "Detachment Rule: ")
# Sections that become chunks of their own, and their headings.
SECTIONS = (("transport", "Transport"), ("keywords", "Keywords"), ("composition", "Unit Composition"), ("options", "Wargear Options"), ("damaged", "Damaged"))
CARD = r"^\*\*([^*]+)\*\*\s*$"
LEAD = r"^([A-Z][A-Z'’\-]{1,}(?: [A-Z][A-Z'’\-]+){0,3}) ([A-Z][a-z].*)$"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def block_metadata(stem: Column, content: Column, edition: str, s: Settings = SETTINGS) -> Column:
    """A struct: doc_id, army, category, unit_name, priority, source_id, edition. Faction and source come from the first six
    lines, the name from the heading; an errata mark within 400 characters raises the priority."""
    prefixes = (*CATEGORIES, (s.pack_category.lower() + "_", s.pack_category))
    category, rest = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for prefix, name in prefixes:
        category = category.when(stem.startswith(prefix), name)
        rest = rest.when(stem.startswith(prefix), F.substring(stem, F.lit(len(prefix) + 1), F.length(stem)))
    category, rest = category.otherwise("Unknown"), rest.otherwise(stem)
    head = F.slice(lines_of(content), 1, 6)
    # The first six lines are searched one by one; the first hit counts.
    pick = lambda pattern: F.coalesce(F.get(F.filter(F.transform(head, lambda line: F.trim(F.regexp_extract(line, pattern, 1))), lambda v: v != ""), F.lit(0)), F.lit(""))
    first = F.get(lines_of(content), F.lit(0))
    title = F.when(first.startswith("# "), F.trim(F.substring(first, F.lit(3), F.length(first)))).otherwise("")
    bare = F.when(F.lit(False), title)
    for prefix in TITLE_PREFIXES:
        bare = bare.when(title.startswith(prefix), F.substring(title, F.lit(len(prefix) + 1), F.length(title)))
    return F.struct(
        F.concat(F.lower(category), F.lit("_"), rest).alias("doc_id"),
        pick(r"\*\*Faction:\*\*\s*([^|]+?)\s*(?:\||$)").alias("army"),
        category.alias("category"),
        bare.otherwise(title).alias("unit_name"),
        F.when(F.substring(content, 1, 400).contains("*(errata)*"), 2).otherwise(1).alias("priority"),
        pick(r"\*\*Source:\*\*\s*(\S+)").alias("source_id"),
        F.lit(edition).alias("edition"),
    )


def _parts(lines: Column, marks: Column) -> Column:
    """The lines from each mark (0-based, sorted) up to the next, joined and trimmed."""
    return F.transform(marks, lambda m, i: trimmed(F.array_join(F.slice(lines, m + 1, F.coalesce(F.get(marks, i + 1), F.size(lines)) - m), "\n")))


def _marks(lines: Column, test) -> Column:
    return F.filter(F.transform(lines, lambda line, i: F.when(test(trimmed(line)), i)), lambda i: i.isNotNull())


def split_cards(content: Column) -> Column:
    """Array of (name, body) of a deck: at least three lines that are one bold name; text before the first is dropped."""

    def cards(lines: Column) -> Column:
        def from_marks(marks: Column) -> Column:
            names = F.transform(marks, lambda m: F.trim(F.regexp_extract(trimmed(F.get(lines, m)), CARD, 1)))
            found = F.arrays_zip(names.alias("name"), _parts(lines, marks).alias("body"))
            return F.when(F.size(marks) >= 3, found).otherwise(F.slice(found, 1, 0))

        return bind(_marks(lines, lambda line: line.rlike(CARD)), from_marks)

    return bind(lines_of(content), cards)


def split_subrules(content: Column) -> Column:
    """A struct: ``parent``, the text before the first sub-rule, and ``rules``, the array of (name, body) of at least two
    sub-rules, each led by a name in capitals of four characters or more. Null and an empty array otherwise."""

    def split(lines: Column) -> Column:
        def from_marks(marks: Column) -> Column:
            names = F.transform(marks, lambda m: F.regexp_extract(trimmed(F.get(lines, m)), LEAD, 1))
            rules = F.arrays_zip(names.alias("name"), _parts(lines, marks).alias("body"))
            enough = F.size(marks) >= 2
            parent = F.when(enough, trimmed(F.array_join(F.slice(lines, F.lit(1), F.get(marks, F.lit(0))), "\n")))
            return F.struct(parent.alias("parent"), F.when(enough, rules).otherwise(F.slice(rules, 1, 0)).alias("rules"))

        return bind(_marks(lines, lambda line: F.length(F.regexp_extract(line, LEAD, 1)) >= 4), from_marks)

    return bind(lines_of(content), split)


ABILITY = r"(?m)\*\*([^*()\n]+?)\*\*[^\n]*\n> ([^\n]+)"


def abilities(content: Column, least: int = 20) -> Column:
    """Array of (i, name, body): a bold name and the quoted line below it; short ones are skipped, but counted in ``i``."""
    name, body = (F.regexp_extract_all(content, F.lit(ABILITY), F.lit(g)) for g in (1, 2))
    numbered = F.transform(F.arrays_zip(name.alias("name"), body.alias("body")), lambda x, i: F.struct(i.alias("i"), F.trim(x["name"]).alias("name"), F.trim(x["body"]).alias("body")))
    return F.filter(numbered, lambda x: (x["name"] != "") & (F.length(x["body"]) >= least))


def sections(content: Column, least: int = 20) -> Column:
    """Array of (type, heading, body) of the known sections, each up to the next heading or the end."""
    found = [F.struct(F.lit(kind).alias("type"), F.lit(heading).alias("heading"), trimmed(F.regexp_extract(content, rf"(?s)## {heading}\n(.*?)(?=\n## |\z)", 1)).alias("body")) for kind, heading in SECTIONS]
    return F.filter(F.array(*found), lambda x: F.length(x["body"]) >= least)


def block_chunks(blocks: DataFrame, edition: str, sequences: dict[str, list[str]] | None = None, s: Settings = SETTINGS) -> DataFrame:
    """All chunks of ``blocks`` (stem, content): ``chunk_id, text, category, army, unit_name, priority, source_id, edition,
    card_name, rule_name, section_type, section_group, seq``. Decks become cards, else bundles become a parent and sub-rules,
    else the block stays whole; datasheets also give abilities and sections. Members of a sequence carry their place
    unless they are sub-rules."""
    b = blocks.filter("content is not null").withColumn("m", block_metadata(F.col("stem"), F.col("content"), edition, s))
    b = b.withColumn("bundle", split_subrules(F.col("content")))
    parent, rules = F.col("bundle.parent"), F.col("bundle.rules")
    is_rule = F.col("m.category").isin(s.core_category, s.pack_category)
    none = F.lit(None).cast("string")
    cards = F.when(is_rule, split_cards(F.col("content"))).otherwise(F.slice(split_cards(F.col("content")), 1, 0))
    b = b.withColumn("cards", cards).withColumn("rules", F.when(is_rule & (F.size("cards") == 0), rules).otherwise(F.slice(rules, 1, 0))).withColumn("parent", parent)
    group, seq = none, F.lit(None).cast("int")
    for name, members in (sequences or {}).items():
        for i, member in enumerate(members):
            group, seq = F.when(F.col("stem") == member, name).otherwise(group), F.when(F.col("stem") == member, i + 1).otherwise(seq)
    base = ["m.category", "m.army", "m.unit_name", "m.priority", "m.source_id", "m.edition"]

    def rows(df: DataFrame, chunk_id: Column, text: Column, **more: Column) -> DataFrame:
        extra = {"card_name": none, "rule_name": none, "section_type": none, "section_group": none, "seq": F.lit(None).cast("int")} | more
        out = df.select(chunk_id.alias("chunk_id"), text.alias("text"), *base, *[v.alias(k) for k, v in extra.items() if k != "category"])
        return out.withColumn("category", more["category"]) if "category" in more else out

    doc = F.col("m.doc_id")
    whole_text = F.when(F.size("rules") > 0, F.col("parent")).otherwise(F.col("content"))
    whole = rows(b.filter(F.size("cards") == 0).filter(whole_text != ""), doc, whole_text, section_group=group, seq=seq)
    card = rows(b.select("*", F.posexplode("cards").alias("i", "c")), F.concat(doc, F.lit("_card"), F.col("i")), F.col("c.body"), card_name=F.col("c.name"), section_group=group, seq=seq)
    rule = rows(b.select("*", F.posexplode("rules").alias("i", "c")), F.concat(doc, F.lit("_sub"), F.col("i")), F.col("c.body"), rule_name=F.col("c.name"))
    sheets = b.filter(F.col("m.category") == "Datasheet")
    header = lambda title: F.concat(F.lit("# "), title, F.lit("\n**Unit:** "), F.col("m.unit_name"), F.lit("  |  **Faction:** "), F.col("m.army"), F.lit("\n\n"), F.col("c.body"))
    ability = rows(sheets.select("*", F.explode(abilities(F.col("content"))).alias("c")), F.concat(F.lit("ability_"), doc, F.lit("_"), F.col("c.i")), header(F.concat(F.lit("Ability: "), F.col("c.name"))), category=F.lit("Ability"))
    section = rows(
        sheets.select("*", F.explode(sections(F.col("content"))).alias("c")), F.concat(F.lit("section_"), F.col("c.type"), F.lit("_"), doc),
        header(F.concat(F.col("m.unit_name"), F.lit(" — "), F.col("c.heading"))), category=F.lit("Datasheet_Section"), section_type=F.col("c.type"),
    )
    out = whole
    for part in (card, rule, ability, section):
        out = out.unionByName(part)
    return out
