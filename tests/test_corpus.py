from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import audit, blocks, chunking, depgraph, incremental, resolve
from scriptorium.sources import html

DECK = "intro\n**One**\nfirst\n**Two** \nsecond\n**Three**\nthird\n"
BUNDLE = "# Core\nhead\nDEEP STRIKE Some units wait.\nmore\nFALL BACK Other units go.\nA Single word."
SHEET = "# Old Guard\n**Faction:** Red Host  |  **Source:** S1\n**(Unnamed)**\n> long enough description here\n**Thin**\n> " + "d" * 19 + "\n**Aura** x\n> " + "d" * 20 + "\n## Transport\n" + "t" * 20 + "\n## Keywords\n" + "k" * 19


def test_chunkers(spark):
    df = spark.createDataFrame([("core_rules_deck", DECK), ("core_rules_bundle", BUNDLE), ("unit_7", SHEET), ("muster_pack_two", "**A**\nx\n**B**\ny"), ("odd", ""), ("none", None)], "stem string, content string")
    rows = {r.chunk_id: r for r in chunking.block_chunks(df, "10e", {"seq": ["core_rules_deck", "core_rules_bundle"]}).collect()}
    assert {"core_rules_deck_card0", "core_rules_deck_card2", "core_rules_bundle", "core_rules_bundle_sub0", "core_rules_bundle_sub1", "datasheet_7", "ability_datasheet_7_1", "section_transport_datasheet_7", "muster_pack_two"} <= set(rows)
    assert len(rows) == 10 and rows["core_rules_deck_card1"].card_name == "Two" and rows["core_rules_deck_card1"].text == "**Two** \nsecond" and rows["core_rules_deck_card1"].seq == 1
    assert rows["core_rules_bundle"].text == "# Core\nhead" and rows["core_rules_bundle"].seq == 2 and rows["core_rules_bundle_sub0"].seq is None
    assert rows["core_rules_bundle_sub1"].text.endswith("A Single word.") and rows["ability_datasheet_7_1"].category == "Ability"
    sheet = rows["datasheet_7"]
    assert (sheet.army, sheet.source_id, sheet.unit_name, sheet.priority, sheet.category) == ("Red Host", "S1", "Old Guard", 1, "Datasheet")


def test_errata_mark_within_400(spark):
    df = spark.createDataFrame([("unit_a", "x" * 380 + "*(errata)*"), ("unit_b", "x" * 400 + "*(errata)*")], "stem string, content string")
    assert [r.priority for r in chunking.block_chunks(df, "10e").orderBy("chunk_id").collect()] == [2, 1]


def test_incremental(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "key string, text string")
    old, new = incremental.manifest(rows(("a", "1"), ("b", "1"), ("c", None)), "key", "text"), incremental.manifest(rows(("a", "1"), ("b", "2"), ("d", "1"), ("d", "1"), ("c", None)), "key", "text")
    assert {r.key: r.action for r in incremental.manifest_diff(old, new).collect()} == {"a": "skipped", "b": "written", "c": "skipped", "d": "written"}
    merged = incremental.upsert(rows(("a", "1"), ("b", "1")), rows(("b", "2")), "key")
    assert {tuple(r) for r in merged.collect()} == {("a", "1"), ("b", "2")}
    live = rows(*[(str(i), "x") for i in range(10)])
    kept = incremental.reconcile(live, live.filter("key <> '3'"), "key")
    assert kept.count() == 9 and incremental.reconcile(kept, live.filter("key <> '3'"), "key").count() == 9
    assert incremental.reconcile(live, live.limit(0), "key").count() == 10
    with pytest.raises(incremental.TooManyOrphans):
        incremental.reconcile(live, live.limit(0), "key", strict=True)
    children = spark.createDataFrame([("x1", "x", "h"), ("y1", "y", "h"), ("y2", "y", "n")], "key string, parent string, hash string")
    state = lambda *x: spark.createDataFrame(list(x), "key string, hash string")
    todo = incremental.changed_children(children, state(("x", "1"), ("y", "1")), state(("x", "2"), ("y", "1")), state(("x1", "h"), ("y1", "h"), ("y2", "o")))
    assert {r.key for r in todo.collect()} == {"x1", "y2"}
    changed, stamp = incremental.source_changed(None, rows(("v", "1")), "text")
    assert changed and incremental.source_changed(stamp, rows(("v", "1")), "text") == (False, stamp)


def test_resolution(spark):
    asked = spark.createDataFrame([(1, "Can the Old Guard Pikes charge a Wolf?"), (2, None)], "qid int, text string")
    names = spark.createDataFrame([("Guard",), ("Old Guard",), ("wolf",), (None,)], "name string")
    assert {tuple(r) for r in resolve.named_units(asked, names).collect()} == {(1, "old guard"), (1, "wolf")}
    assert {tuple(r) for r in resolve.chassis_families(names.withColumnRenamed("name", "unit_name")).collect()} == {("Guard", "Old Guard")}
    assert {tuple(r) for r in resolve.token_owners(names).collect()} == {("old", "Old Guard"), ("wolf", "wolf")}
    core = spark.createDataFrame([(i, "wolves burning old") for i in range(3)], "id int, text string")
    assert [r.token for r in resolve.distinctive_tokens(spark.createDataFrame([("Burned Marksmen",), ("Old",)], "name string"), core, ["with"]).collect()] == ["marksmen"]


def test_routes_keep_the_pack_out(spark):
    faction = F.when(F.col("f") != "", F.col("f"))
    df = spark.createDataFrame([(f, c, a) for f in ("", "red") for c in ("Core_Rules", "Muster_Pack", "Ability", None) for a in ("red", None)], "f string, c string, a string")
    for text in ("core rule?", "hello"):
        for unit in (True, False):
            for on in (True, False):
                route = resolve.route(F.lit(text), faction, F.lit(unit), on, ["core rule"], ["vp"], "Pack")
                kept = df.filter(resolve.admits(route, F.col("c"), F.col("a"), faction))
                assert on or kept.filter("c = 'Muster_Pack'").count() == 0
    assert df.filter(resolve.in_scope(F.col("c"), F.col("a"), F.array().cast("array<string>"))).count() == df.count()


def test_clarification_is_pure():
    families = {"Guard": {"blue": ("Guard",), "red": ("Guard", "Old Guard")}, "Wolf": {"red": ("Wolf",)}, "Ghost": {}}
    queue = resolve.clarification_queue([("Guard", 8, 13), ("Wolf", 20, 24), ("Ghost", 30, 35)], families, None, ())
    assert resolve.next_question(queue) == (0, "army", ("blue", "red")) and queue[1].unit == "Wolf" and queue[2].skipped
    assert resolve.next_question(resolve.choose(queue, 0, "blue")) is None and queue[0].army is None
    red = resolve.choose(queue, 0, "red")
    assert resolve.next_question(red) == (0, "variant", ("Guard", "Old Guard"))
    assert resolve.rewrite("Can the Guard fight Wolf now?", resolve.choose(red, 0, "Old Guard")[:1]) == "Can the Old Guard (red) fight Wolf now?"
    assert resolve.rewrite("Can the wolf howl?", resolve.clarification_queue([("Wolf", None, None)], families, None, ())) == "Can the Wolf (red) howl?"
    assert resolve.rewrite("Who?", resolve.clarification_queue([("Wolf", None, None)], families, None, ())) == "Who? Wolf (red)"
    assert resolve.clarification_queue([("Ghost", 0, 5)], families, None, ()) is None and resolve.next_question(resolve.choose(queue, 0, None)) is None
    assert resolve.decide(("a", "b"), None, ("b", "c")) == ("auto", ("b",)) and resolve.decide(("a",), "b", ()) == ("skip", ())
    assert resolve.decide(("a", "b", "c"), None, ("c", "a")) == ("ask", ("a", "c")) and resolve.decide(("a", "b"), "b", ()) == ("auto", ("b",))
    assert resolve.highlight("Can the guard go?", "Guard") == "Can the **guard** go?" and resolve.highlight("x", "y") == "x"
    for wrong in ((queue, 0, "green"), (red, 0, "blue")):
        with pytest.raises(ValueError):
            resolve.choose(*wrong)


def test_units_that_questions_name(spark):
    asked = spark.createDataFrame([(1, "Do the Stone Guards move?"), (2, "What do harriers do?"), (3, "Who moves?"), (4, None)], "qid int, text string")
    phrases, tokens = spark.createDataFrame([("Stone Guard",), ("Who",)], "name string"), spark.createDataFrame([("harriers",)], "token string")
    assert {r.qid for r in resolve.names_a_unit(asked, phrases, tokens).collect()} == {1, 2}
    factions, words = spark.createDataFrame([("Fox", 1), ("Gnu", 2)], "name string, pos int"), spark.createDataFrame([("FOX", "Gnu", 1), ("Red", "Fox", 2), ("red", "Gnu", 3)], "keyword string, faction string, pos int")
    assert {r.word: r.faction for r in resolve.faction_words(factions, words).collect()} == {"fox": "Gnu", "gnu": "Gnu", "red": "Gnu"}
    chassis = spark.createDataFrame([("Guard", "Old Guard")], "base string, member string")
    signatures = spark.createDataFrame([("Guard", "red", "x"), ("Old Guard", "red", "y"), ("Guard", "blue", "z"), ("Old Guard", "blue", "z")], "unit_name string, army string, signature string")
    units = signatures.select("unit_name", "army")
    got = {(r.ref, r.army): r.members for r in resolve.families(chassis, signatures, units).collect()}
    assert got["Guard", "red"] == ["Guard", "Old Guard"] and got["Guard", "blue"] == ["Guard"] and got["Old Guard", "blue"] == ["Old Guard"]


def test_graph(spark):
    rules = spark.createDataFrame([("a", "Alpha Move", "see beta move."), ("b", "Beta Move", "then Gamma-Ray!"), ("c", "Gamma Ray", "alone, alphamove"), ("d", None, None)], "stem string, name string, text string")
    edges = depgraph.name_edges(rules)
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("b", "c")}
    wide = depgraph.with_one_hop(edges)
    assert {tuple(r) for r in wide.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    s = depgraph.edge_scores(wide, edges).first()
    assert (round(s.precision, 3), s.recall, s.f1) == (0.667, 1.0, 0.8) and depgraph.edge_scores(edges.limit(0), edges.limit(0)).first().f1 == 1.0
    graph = depgraph.parse_graph('{"_meta": ["x"], "a": ["b", "z"]}', spark)
    assert {tuple(r) for r in depgraph.dangling(graph, rules).collect()} == {("a", "z")} and depgraph.parse_graph("no json", spark).count() == 0


def test_seeding(spark):
    parents = spark.createDataFrame([(1, "k1", "a", 0.9), (1, "k2", "b", 0.8)], "qid int, key string, stem string, score double")
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("a", "z")], "src string, dep string")
    payloads = spark.createDataFrame([("x", "ix", "kx"), ("y", "iy", "ky"), ("z", "iz", "kz")], "stem string, id string, key string")
    bridges = spark.createDataFrame([(1, "k1", "x", 0.6), (1, "k1", "y", 0.3), (1, "k1", "z", 0.9)], "qid int, key string, dep string, bridge double")
    present = spark.createDataFrame([(1, "kz")], "qid int, key string")
    got = depgraph.seed_definitions(parents, edges, payloads, bridges, present).collect()
    assert [(r.stem, r.bridge, r.parent_keys) for r in got] == [("x", 0.6, ["k1", "k2"])]


def test_audits(spark):
    source = spark.createDataFrame([("One two three four five six seven.",), (None,)], "text string")
    lines = spark.createDataFrame([(1, "two THREE, four five"), (2, "one two three four five zero"), (3, "nothing of that kind"), (4, "short")], "id int, line string")
    assert {r.id: r.kind for r in audit.fidelity(lines, source).collect()} == {1: "verbatim", 2: "reworded", 3: "missing"}
    found, wanted = (spark.createDataFrame(x, "qid int, id string") for x in ([(1, "a"), (1, "b"), (2, "c")], [(1, "a"), (3, "d")]))
    got = {r.qid: (r.precision, r.recall) for r in audit.retrieval_scores(found, wanted).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, 1.0), 3: (1.0, 0.0)}


def test_blocks(spark):
    dim = spark.createDataFrame([("f1", "Red", 1), ("f1", "Blue", 2), ("f2", "nan", 1)], "id string, name string, pos int")
    rows = blocks.lookup(spark.createDataFrame([("f1",), ("f2",), ("f3",), (None,)], "fid string"), dim, "fid", "id", "name", "pos", "out")
    assert {r.fid: r.out for r in rows.collect()} == {"f1": "Red", "f2": "f2", "f3": "f3", None: None}
    children = spark.createDataFrame([("a", "2", "x"), ("a", "10", "y"), ("a", "2", "x"), (None, "1", "z")], "k string, line string, t string")
    assert [tuple(r) for r in blocks.child_lines(children, "k", [F.col("line")], F.col("t"), "out").collect()] == [("a", "y\nx\nx")]
    assert blocks.missing_columns(children, {"k", "q"}) == {"q"}


PAGE = """<html><head><style>h2{}</style></head><body><nav><h2>Menu</h2></nav><h1>T</h1><h2>Charge</h2><p>Roll <img src="/i/d6.png"> + and move your models <b>now</b> .
<p>Unclosed paragraph with &amp; sign here<ul><li>first item<li>second item</ul><table><tr><td>A<td>B</tr><tr><td>A<td>B</tr></table><h4>Lead</h4>
<h2>Tiny</h2><p>short</p><h3>Charge</h3><p>A further paragraph of the same section, added to it as it is long enough to stay.</p><div class="ad"><h2>Buy</h2></div></body>"""


def test_pages(spark):
    rows = html.page_sections(spark.createDataFrame([("u", PAGE), ("n", None), ("e", ""), ("b", "<p <<>")], "url string, html string")).collect()
    assert [(r.url, r.slug) for r in rows] == [("u", "charge")]
    assert rows[0].text.split("\n")[:5] == ["Roll 6+ and move your models now.", "Unclosed paragraph with & sign here", "- first item", "- second item", "A | B"]
    assert rows[0].text.endswith("long enough to stay.")


def test_every_delivery_counts(spark, tmp_path):
    from scriptorium.plans.catalogue import QUERIES

    deliveries = {1: "abcde", 2: "abcdf", 3: "af", 5: "ag"}  # from 2 to 3 more than the limit is gone; 4 is empty
    rows = [(n, c, f"{c}{n // 3}") for n, cs in deliveries.items() for c in cs] + [(1, None, "x"), (2, None, "x"), (None, "z", "z")]
    rows = [(*r, datetime(2024, 1, 2)) for r in rows] + [(5, "g", "zz", datetime(2024, 1, 1))]  # an outdated version, delivered earlier
    spark.createDataFrame(rows, "snapshot_no int, chunk_id string, text string, delivered_at timestamp").write.parquet(str(tmp_path / "chunk_snapshots.parquet"))
    got = {name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("manifest_diff_each", "reconcile_each", "upsert_all")}
    actions = {2: {"skipped": "abcd", "removed": "e", "written": "f"}, 3: {"written": "af", "removed": "bcd"}, 4: {"removed": "af"}, 5: {"written": "ag"}}
    want = {(n, c, a) for n, by in actions.items() for a, cs in by.items() for c in cs}
    assert got["manifest_diff_each"] == want | {(2, None, "skipped"), (3, None, "removed")}
    assert got["reconcile_each"] == {(2, c) for c in "abcd"} | {(3, c) for c in "abcdf"} | {(2, None), (3, None)} | {(4, "a"), (4, "f")}
    assert got["upsert_all"] == {("a", 5, "a1"), ("g", 5, "g1"), ("f", 3, "f1"), ("e", 1, "e0"), (None, 2, "x")} | {(c, 2, c + "0") for c in "bcd"}
