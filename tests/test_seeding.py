from pyspark.sql import functions as F

from scriptorium.operators import rules as R
from scriptorium.operators import seeding as S
from scriptorium.operators.scorers import HashedTerms

EMBED = HashedTerms(256)


def chunks(spark):
    rows = [
        (1, "core_rules_charge_phase", "Core_Rules", "Core > Charge Phase", "# Charge\nA charge ends within engagement range of the target. Models keep unit coherency at all times. Nothing else is said of banners here."),
        (2, "core_rules_engagement_range", "Core_Rules", "Core > Engagement Range", "# Engagement Range\nOne inch around a model is close."),
        (3, "core_rules_unit_coherency", "Core_Rules", "Core > Unit Coherency", "# Coherency\nStay together in a group."),
        (4, "core_rules_deep_strike", "Core_Rules", "Core > Deep Strike", "# Deep Strike\nSet up anywhere from below."),
        (5, "ability_guard_1", "Ability", None, "**Unit:** Guard\nThis unit has Deep Strike from the second round."),
        (6, "unit_guard", "Datasheet", None, "# Guard\nThe bow of this unit has sustained hits and deep strike in its table."),
        (7, "army_rule_1", "Army_Rule", None, "# Army Rule: Oath of Stone\n**Faction:** Fox  |  **Type:** Army Rule\n\nStand."),
        (8, "detachment_rule_1", "Detachment_Rule", None, "# Detachment Rule: Wall\n**Faction:** Fox  |  **Detachment:** Iron Ring\n\nHold."),
        (9, "pack_1", "Muster_Pack", "Pack > Deep Strike Missions", "# Pack\nDeep things."),
    ]
    return spark.createDataFrame(rows, "id bigint, chunk_id string, category string, breadcrumb string, text string")


def with_pool(spark, ids, score=0.9):
    keyed = S.T.content_key(F.col("text"))
    return chunks(spark).filter(F.col("id").isin(ids)).select(F.lit(1).cast("bigint").alias("qid"), "id", keyed.alias("key"), "category", "breadcrumb", F.lit(score).alias("score"))


def asked(spark, text):
    return spark.createDataFrame([(1, text)], "qid bigint, text string")


def test_definitions_need_a_naming_sentence_near_the_question(spark):
    edges = spark.createDataFrame([("charge_phase", "engagement_range"), ("charge_phase", "unit_coherency"), ("charge_phase", "none")], "src string, dep string")
    got = S.definitions(asked(spark, "Which charge ends within engagement range of the target?"), with_pool(spark, [1]), chunks(spark), edges, EMBED).collect()
    assert [(r.id, r.stem) for r in got] == [(2, "engagement_range")] and got[0].bridge > 0.9 and len(got[0].parent_keys) == 1
    assert S.definitions(asked(spark, "banners?"), with_pool(spark, [1]), chunks(spark), edges, EMBED).count() == 0
    assert S.definitions(asked(spark, "Which charge ends within engagement range of the target?"), with_pool(spark, [1], 0.2), chunks(spark), edges, EMBED).count() == 0
    assert S.definitions(asked(spark, None), with_pool(spark, []), chunks(spark), edges.limit(0), EMBED).count() == 0


def test_referenced_rules(spark):
    ability = S.referenced_rules(asked(spark, "What may the guard do?"), with_pool(spark, [5]), chunks(spark), EMBED).collect()
    assert [(r.id, r.bridge) for r in ability] == [(4, 0.9)]
    assert S.referenced_rules(asked(spark, "can it charge?"), with_pool(spark, [6]), chunks(spark), EMBED).count() == 0
    near = S.referenced_rules(asked(spark, "bow of this unit has sustained hits deep strike table"), with_pool(spark, [6]), chunks(spark), EMBED).collect()
    assert [r.id for r in near] == [4]
    assert S.referenced_rules(asked(spark, "x"), with_pool(spark, [5], 0.44), chunks(spark), EMBED).count() == 0
    assert S.referenced_rules(asked(spark, "x"), with_pool(spark, [4, 5]), chunks(spark), EMBED).count() == 0  # there already


def test_rule_index(spark):
    crumbs, payloads = S.rule_index(chunks(spark), pack_on=False)
    assert crumbs.count() == 4 and {r.stem for r in payloads.collect()} == {"charge_phase", "engagement_range", "unit_coherency", "deep_strike"}
    assert {r.stem for r in S.name_index(S.rule_index(chunks(spark))[1]).filter(F.col("pattern").contains("deep")).collect()} == {"deep_strike"}
    df = spark.createDataFrame([("normal_moves",), ("12_shooting_steps",), ("a.b",), ("fight_phase",)], "s string")
    assert [r[0] for r in df.select(S.surface(F.col("s"))).collect()] == ["(?i)normal move", "(?i)shooting step", r"(?i)a\.b", "(?i)fight phase"]
    assert [r[0] for r in df.select(S.is_phase_pointer(F.col("s"))).collect()] == [False, True, False, True]


def test_named_rules_and_slice(spark):
    hits = lambda q: sorted(r.id for r in R.named_rules(asked(spark, q), chunks(spark)).collect())
    assert hits("Does the OATH OF STONE end?") == [7] and hits("In an iron ring?") == [8] and hits("wall?") == [8] and hits("nothing") == [] and hits(None) == []
    got = {r.id: (r.provenance, round(r.cosine, 3)) for r in R.rules_slice(asked(spark, "set up anywhere from below by the oath of stone"), chunks(spark), EMBED, 2, pack_on=False).collect()}
    assert got[7] == ("named_rule", 0.0) and got[4][0] == "dense" and set(got) <= {1, 2, 3, 4, 7}
