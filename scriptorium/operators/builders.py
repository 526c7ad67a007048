"""Documents from relational rows: one Markdown block per unit, stratagem, enhancement, army rule and detachment rule.

Every child table is rolled up to one string per parent before it is joined, so children do not multiply. Lines that do
not apply are null and drop out. Tables are those of the delivered files, all columns strings; missing ones may be left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.blocks import child_lines, distinct_in_order, lookup
from scriptorium.session import join_small

DASH = "—"
#: The kinds of abilities that have a section, in order.
ABILITY_KINDS = ("Datasheet", "Wargear", "Faction", "Core")


def given(value: Column) -> Column:
    """The trimmed value, null where it is missing or a sentinel."""
    clean = T.safe(value, "")
    return F.when((clean != "") & (clean != DASH), clean)


def plain(value: Column) -> Column:
    """``given`` without markup, null where nothing is left."""
    return F.nullif(T.strip_html(given(value)), F.lit(""))


def shown(value: Column) -> Column:
    return T.safe(value, DASH)


def cat(*parts: str | Column) -> Column:
    """Parts in a row; null if one is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def block(*lines: Column) -> Column:
    """The lines that are not null, one below the other."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def section(title: str, body: Column, *more: Column) -> Column:
    """A heading, its body and a blank line; null without a body."""
    return F.when(body.isNotNull(), block(F.lit(f"## {title}"), body, *more, F.lit("")))


def live_datasheets(datasheets: DataFrame) -> DataFrame:
    """Without virtual ones, which have no rules of their own."""
    return datasheets.filter(F.upper(T.safe(F.col("virtual"), "")) != "TRUE")


def source_dates(rows: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Adds ``date``, the errata date of the row's source or else its version, null without either, and ``errata``."""
    first = sources.groupBy(F.col("id").alias(key)).agg(F.min_by(F.struct("errata_date", "version"), F.struct("errata_date", "version")).alias("__s"))
    joined = join_small(rows, first, [key], "left")
    errata = given(F.col("__s.errata_date"))
    return joined.withColumn("date", F.coalesce(errata, given(F.col("__s.version")))).withColumn("errata", errata.isNotNull()).drop("__s")


def filled_abilities(abilities_of: DataFrame, abilities: DataFrame) -> DataFrame:
    """Abilities of units whose blank names and descriptions are taken from the table of abilities by ``ability_id``."""
    known = abilities.groupBy(F.col("id").alias("ability_id")).agg(F.min_by(F.struct("name", "description"), F.struct("name", "description")).alias("__k"))
    joined = join_small(abilities_of, known, ["ability_id"], "left")
    return joined.withColumn("name", F.coalesce(given(F.col("name")), F.col("__k.name"))).withColumn("description", F.coalesce(given(F.col("description")), F.col("__k.description"))).drop("__k")


def real_rules(abilities: DataFrame, factions: DataFrame) -> DataFrame:
    """Abilities of real factions only; those of none are core rules."""
    return join_small(abilities, factions.select(F.col("id").alias("faction_id")).distinct(), ["faction_id"], "left_semi")


def _joined_list(rows: DataFrame, out: str) -> DataFrame:
    item = F.array_sort(F.collect_list(F.struct("pos", "keyword")))
    return rows.groupBy("datasheet_id").agg(F.array_join(F.transform(item, lambda x: x["keyword"]), ", ").alias(out))


def unit_blocks(tables: dict[str, DataFrame]) -> DataFrame:
    """``stem, content`` of every datasheet that is not virtual. ``tables``: datasheets, factions, and where there are any
    source, models, composition, costs, wargear, options, abilities_of, abilities, keywords (with ``pos``, the order of
    keywords). Children are ordered by ``line`` as a string."""
    rows = lookup(live_datasheets(tables["datasheets"]), tables["factions"], "faction_id", "id", "name", "id", "faction_name")
    rows = source_dates(rows, tables["source"]) if "source" in tables else rows.withColumn("date", F.lit(None).cast("string")).withColumn("errata", F.lit(False))
    c = F.col
    noted = lambda v, note: F.concat(shown(c(v)), F.coalesce(cat(" (", given(c(note)), ")"), F.lit("")))
    row = lambda *cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    dice = F.coalesce(cat(given(c("dice")), "× "), F.lit("")) if "wargear" in tables else None
    cost, what = given(c("cost")), plain(c("description"))
    ability = lambda: block(
        F.concat(cat("**", F.coalesce(given(c("name")), F.lit("(Unnamed)")), "**"), F.coalesce(cat(" *(applies to: ", given(c("model")), ")*"), F.lit("")), F.coalesce(cat(" — ", given(c("parameter"))), F.lit(""))),
        cat("> ", plain(c("description"))), F.lit(""))
    children = {
        "models": (["line", "name"], lambda: row(shown(c("name")), *[shown(c(k)) for k in ("M", "T", "Sv")], noted("inv_sv", "inv_sv_descr"), *[shown(c(k)) for k in ("W", "Ld", "OC")], noted("base_size", "base_size_descr"))),
        "composition": (["line", "description"], lambda: cat("- ", T.strip_html(shown(c("description"))))),
        "costs": (["line", "description"], lambda: F.when(what.isNotNull() & cost.isNotNull(), cat("- ", what, ": **", cost, " pts**")).otherwise(cat("- ", cost, " pts"))),
        "wargear": (["line", "line_in_wargear"], lambda: block(row(F.concat(dice, shown(c("name"))), *[shown(c(k)) for k in ("range", "type", "A", "BS_WS", "S", "AP", "D")]), cat("|   | *", plain(c("description")), "* | | | | | | |"))),
        "options": (["line", "description"], lambda: cat("- ", T.strip_html(shown(c("description"))))),
    }
    for name, (order, line) in children.items():
        if name in tables:
            rolled = child_lines(tables[name], "datasheet_id", [c(o) for o in order], line(), f"__{name}")
            rows = rows.join(rolled.withColumnRenamed("datasheet_id", "id"), "id", "left")
        else:
            rows = rows.withColumn(f"__{name}", F.lit(None).cast("string"))
    if "abilities_of" in tables:
        filled = filled_abilities(tables["abilities_of"], tables["abilities"])
        for kind in ABILITY_KINDS:
            rolled = child_lines(filled.filter(c("type") == kind), "datasheet_id", [c("line"), c("name")], ability(), f"__of_{kind}")
            rows = rows.join(rolled.withColumnRenamed("datasheet_id", "id"), "id", "left")
    kinds = [F.when(c(f"__of_{k}").isNotNull(), block(F.lit(f"## {k} Abilities"), c(f"__of_{k}"))) for k in ABILITY_KINDS] if "abilities_of" in tables else []
    words = []
    if "keywords" in tables:
        own = F.upper(F.col("is_faction_keyword").cast("string")) == "TRUE"
        named = tables["keywords"].filter(c("keyword").isNotNull())
        for out, part in (("__faction_words", named.filter(own)), ("__other_words", named.filter(~F.coalesce(own, F.lit(False))))):
            rows = rows.join(_joined_list(part, out).withColumnRenamed("datasheet_id", "id"), "id", "left")
        lines = F.nullif(block(cat("**Faction:** ", c("__faction_words")), cat("**Other:** ", c("__other_words"))), F.lit(""))
        words = [section("Keywords", lines)]
    content = block(
        cat("# ", shown(c("name"))),
        cat("**Faction:** ", c("faction_name"), "  |  **Role:** ", T.safe(c("role"), ""), "  |  **Source:** ", T.safe(c("source_id"), "")),
        cat("**Version/Errata Date:** ", c("date"), F.when(c("errata"), " *(errata)*").otherwise("")),
        F.lit(""),
        section("Stats", F.when(c("__models").isNotNull(), block(F.lit("| Model | M | T | Sv | Inv | W | Ld | OC | Base |"), F.lit("|---|---|---|---|---|---|---|---|---|"), c("__models")))),
        section("Unit Composition", c("__composition")),
        section("Points Costs", c("__costs")),
        section("Wargear", F.when(c("__wargear").isNotNull(), block(F.lit("| Weapon | Range | Type | A | BS/WS | S | AP | D |"), F.lit("|---|---|---|---|---|---|---|---|"), c("__wargear")))),
        section("Wargear Options", c("__options")),
        *kinds,
        section("Leader", plain(c("leader_head")), cat("\n", plain(c("leader_footer")))),
        section("Loadout", plain(c("loadout"))),
        section("Transport", plain(c("transport"))),
        section("Damaged", cat("*Damaged threshold: ", given(c("damaged_w")), " wounds remaining*"), cat("> ", plain(c("damaged_description")))),
        *words,
    )
    return rows.select(F.concat(F.lit("unit_"), shown(c("id"))).alias("stem"), content.alias("content"))


def _card(title: Column, facts: Column, *lines: Column) -> Column:
    """A heading, its facts, further lines, the legend and the description."""
    return block(title, facts, *lines, cat("*", given(F.col("legend")), "*"), F.lit(""), plain(F.col("description")), F.lit(""))


def _with_faction(rows: DataFrame, factions: DataFrame) -> DataFrame:
    return lookup(rows, factions, "faction_id", "id", "name", "id", "faction_name")


def stratagem_blocks(stratagems: DataFrame, factions: DataFrame) -> DataFrame:
    """``stem, content``; rows: id, name, faction_id, type, cp_cost, turn, phase, detachment, legend, description."""
    c = F.col
    facts = cat("**Faction:** ", c("faction_name"), "  |  **Type:** ", T.safe(c("type"), ""), "  |  **Cost:** ", T.safe(c("cp_cost"), ""), " CP")
    when = cat("**When:** ", given(c("turn")), F.coalesce(cat(" — ", given(c("phase"))), F.lit("")))
    content = _card(cat("# Stratagem: ", shown(c("name"))), facts, cat("**Detachment:** ", given(c("detachment"))), when)
    return _with_faction(stratagems, factions).select(cat("stratagem_", shown(c("id"))).alias("stem"), content.alias("content"))


def enhancement_blocks(enhancements: DataFrame, factions: DataFrame) -> DataFrame:
    """``stem, content``; rows: id, name, faction_id, cost, detachment, legend, description."""
    c = F.col
    facts = cat("**Faction:** ", c("faction_name"), "  |  **Cost:** ", T.safe(c("cost"), ""), " pts")
    content = _card(cat("# Enhancement: ", shown(c("name"))), facts, cat("**Detachment:** ", given(c("detachment"))))
    return _with_faction(enhancements, factions).select(cat("enhancement_", shown(c("id"))).alias("stem"), content.alias("content"))


def army_rule_blocks(abilities: DataFrame, factions: DataFrame) -> DataFrame:
    """``stem, content`` per id of the abilities of real factions; rows: id, name, faction_id, legend, description, pos. The first row of
    an id counts, with the names of all its factions in order."""
    rows = _with_faction(real_rules(abilities, factions), factions)
    names = distinct_in_order(rows, "id", "faction_name", "pos", "faction_names")
    first = rows.groupBy("id").agg(F.min_by(F.struct("name", "legend", "description"), "pos").alias("r")).select("id", "r.*")
    c = F.col
    content = _card(cat("# Army Rule: ", shown(c("name"))), cat("**Faction:** ", c("faction_names"), "  |  **Type:** Army Rule"))
    return first.join(names, "id").select(cat("army_rule_", shown(c("id"))).alias("stem"), content.alias("content"))


def detachment_rule_blocks(rules: DataFrame, factions: DataFrame) -> DataFrame:
    """``stem, content``; rows: id, name, faction_id, detachment, legend, description."""
    c = F.col
    facts = F.concat(cat("**Faction:** ", c("faction_name"), "  |  **Type:** Detachment Rule"), F.coalesce(cat("  |  **Detachment:** ", given(c("detachment"))), F.lit("")))
    content = _card(cat("# Detachment Rule: ", shown(c("name"))), facts)
    return _with_faction(rules, factions).select(cat("detachment_rule_", shown(c("id"))).alias("stem"), content.alias("content"))
