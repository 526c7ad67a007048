"""Blocks against their expected text."""

from scriptorium.operators import builders as B


def frame(spark, columns, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in columns.split()))


def test_unit_block(spark):
    sheet = "id name faction_id role loadout transport leader_head leader_footer damaged_w damaged_description source_id virtual"
    tables = {
        "datasheets": frame(spark, sheet, ["1", "Guard", "F", "Core", "a <b>bow</b>", None, "May join:<ul><li>X</li></ul>", "nan", "4", "<i>-1</i> Aim", "S", "false"], ["2", "Ghost", "F", *[None] * 9], ["3", "Virtual", "F", *[None] * 8, "true"]),
        "factions": frame(spark, "id name", ["F", "Fox"], ["G", "Gnu"]),
        "source": frame(spark, "id errata_date version", ["S", "2024-01-01", "1.0"]),
        "models": frame(spark, "datasheet_id line name M T Sv inv_sv inv_sv_descr W Ld OC base_size base_size_descr", ["1", "10", "B", *["5"] * 3, None, None, *["1"] * 3, "25", ""], ["1", "1", "A", *["6"] * 3, "4", "once", *["2"] * 3, "32", "oval"]),
        "costs": frame(spark, "datasheet_id line description cost", ["1", "1", "5 models", "90"], ["1", "2", "", "20"], ["1", "3", "x", None]),
        "wargear": frame(spark, "datasheet_id line line_in_wargear dice name description range type A BS_WS S AP D", ["1", "1", "1", "D6", "bow", "slow", *["1"] * 7]),
        "abilities_of": frame(spark, "datasheet_id line type ability_id name description model parameter", ["1", "1", "Core", "9", "", "", None, "6\""], ["1", "2", "Datasheet", None, "Own", "A <b>text</b>", "Chief", None], ["1", "3", "Other", None, "No", "x", None, None]),
        "abilities": frame(spark, "id name description", ["9", "Deep", "From below"]),
        "keywords": spark.createDataFrame([("1", "FOX", "true", 2), ("1", "Foot", "false", 1), ("1", "Elite", None, 3), ("1", None, "true", 4)], "datasheet_id string, keyword string, is_faction_keyword string, pos int"),
    }
    got = {r.stem: r.content for r in B.unit_blocks(tables).collect()}
    assert set(got) == {"unit_1", "unit_2"}
    assert got["unit_1"] == (
        "# Guard\n**Faction:** Fox  |  **Role:** Core  |  **Source:** S\n**Version/Errata Date:** 2024-01-01 *(errata)*\n\n"
        "## Stats\n| Model | M | T | Sv | Inv | W | Ld | OC | Base |\n|---|---|---|---|---|---|---|---|---|\n| A | 6 | 6 | 6 | 4 (once) | 2 | 2 | 2 | 32 (oval) |\n| B | 5 | 5 | 5 | — | 1 | 1 | 1 | 25 |\n\n"
        "## Points Costs\n- 5 models: **90 pts**\n- 20 pts\n\n"
        "## Wargear\n| Weapon | Range | Type | A | BS/WS | S | AP | D |\n|---|---|---|---|---|---|---|---|\n| D6× bow | 1 | 1 | 1 | 1 | 1 | 1 | 1 |\n|   | *slow* | | | | | | |\n\n"
        "## Datasheet Abilities\n**Own** *(applies to: Chief)*\n> A text\n\n## Core Abilities\n**Deep** — 6\"\n> From below\n\n"
        "## Leader\nMay join: X\n\n## Loadout\na bow\n\n## Damaged\n*Damaged threshold: 4 wounds remaining*\n> -1 Aim\n\n## Keywords\n**Faction:** FOX\n**Other:** Foot, Elite\n"
    )
    assert got["unit_2"] == "# Ghost\n**Faction:** Fox  |  **Role:**   |  **Source:** \n"
    bare = B.unit_blocks({"datasheets": tables["datasheets"].limit(0), "factions": tables["factions"]})
    assert bare.count() == 0


def test_cards(spark):
    factions = frame(spark, "id name", ["F", "Fox"], ["G", "Gnu"])
    one = lambda df: {r.stem: r.content for r in df.collect()}
    got = one(B.stratagem_blocks(frame(spark, "id name faction_id type cp_cost turn phase detachment legend description", ["1", "Feint", "F", "Ruse", "1", "Yours", "Move", "Wall", "Old tale", "A<br>b"], ["2", None, "Z", *[None] * 7]), factions))
    assert got["stratagem_1"] == "# Stratagem: Feint\n**Faction:** Fox  |  **Type:** Ruse  |  **Cost:** 1 CP\n**Detachment:** Wall\n**When:** Yours — Move\n*Old tale*\n\nA b\n"
    assert got["stratagem_2"] == "# Stratagem: —\n**Faction:** Z  |  **Type:**   |  **Cost:**  CP\n\n"
    got = one(B.enhancement_blocks(frame(spark, "id name faction_id cost detachment legend description", ["1", "Horn", "G", "15", "", None, "Loud"]), factions))
    assert got["enhancement_1"] == "# Enhancement: Horn\n**Faction:** Gnu  |  **Cost:** 15 pts\n\nLoud\n"
    rules = spark.createDataFrame([("7", "Oath", "G", None, "One", 1), ("7", "Oath", "F", "x", "Two", 2), ("7", "Oath", "G", None, "Three", 3), ("8", "Core", None, None, "x", 4), ("9", "Odd", "Z", None, "x", 5)], "id string, name string, faction_id string, legend string, description string, pos int")
    assert one(B.army_rule_blocks(rules, factions)) == {"army_rule_7": "# Army Rule: Oath\n**Faction:** Gnu, Fox  |  **Type:** Army Rule\n\nOne\n"}
    got = one(B.detachment_rule_blocks(frame(spark, "id name faction_id detachment legend description", ["1", "Wrath", "F", "Wall", None, None]), factions))
    assert got["detachment_rule_1"] == "# Detachment Rule: Wrath\n**Faction:** Fox  |  **Type:** Detachment Rule  |  **Detachment:** Wall\n\n"
