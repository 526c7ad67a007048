import pytest
from pyspark.sql import functions as F

from scriptorium.functions import labels as L
from scriptorium.operators import maintenance as M
from scriptorium.operators.incremental import TooManyOrphans
from scriptorium.operators.scorers import Refused, answer_or_retry


def test_collections_switch_at_once(spark, tmp_path):
    store = M.Collections(spark, f"file://{tmp_path}/c")
    assert store.open("10e", "chunk_id string").count() == 0 and store.current("10e") is None
    for version in ("a", "b"):
        store.replace("10e", spark.createDataFrame([(version,)], "chunk_id string"), version)
    assert [r[0] for r in store.open("10e", "chunk_id string").collect()] == ["b"] and store.open("10e", "chunk_id string", reset=True).count() == 0
    assert store.open("11e", "chunk_id string").count() == 0
    M.archive(spark.createDataFrame([(1,)], "x int"), f"{tmp_path}/a", "s1")
    M.archive(spark.createDataFrame([(2,)], "x int"), f"{tmp_path}/a", "s2")
    assert spark.read.parquet(f"{tmp_path}/a").groupBy("snapshot").count().count() == 2


def test_sweeps_touch_only_what_they_own(spark):
    old = spark.createDataFrame([("unit_1", "a"), ("unit_2", "b"), ("core_1", "c")], "key string, hash string")
    new = spark.createDataFrame([("unit_1", "x"), ("unit_3", "d")], "key string, hash string")
    got = {r.key: r.action for r in M.owned_sweep(old, new, ("unit_",)).collect()}
    assert got == {"unit_1": "written", "unit_2": "removed", "unit_3": "written", "core_1": "skipped"}
    old = spark.createDataFrame([("p", "k1", "a"), ("q", "k2", "b"), ("r", "k3", "c")], "page string, key string, hash string")
    pages = spark.createDataFrame([("p", True), ("q", False)], "page string, fetched boolean")
    got = {r.key: r.action for r in M.page_sweep(old, old.limit(0), pages).collect()}
    assert got == {"k1": "removed", "k2": "skipped", "k3": "skipped"}


def test_ingest_upserts_and_sweeps(spark):
    block = lambda name, text: (name, f"# {name}\n**Faction:** Fox\n\n{text}")
    first = spark.createDataFrame([block(f"army_rule_{i}", f"Rule {i}.") for i in range(6)], "stem string, content string")
    empty = M.block_chunks(first, "10e").limit(0)
    live, actions = M.ingest(empty, first, "10e")
    assert live.count() == 6 and {r.action for r in actions.collect()} == {"written"} and M.valid_ids(first, "10e").count() == 6
    second = spark.createDataFrame([block(f"army_rule_{i}", f"Rule {i if i else 'new'}.") for i in range(5)], "stem string, content string")
    now, actions = M.ingest(live, second, "10e")
    assert now.count() == 5 and sorted(r.action for r in actions.collect()) == ["removed", *["skipped"] * 4, "written"]
    assert now.filter(F.col("text").contains("Rule new")).count() == 1
    few = second.limit(1)
    assert M.ingest(live, few, "10e")[0].count() == 6  # too much gone
    with pytest.raises(TooManyOrphans):
        M.ingest(live, few, "10e", strict=True)


def test_audit_gates(spark, tmp_path):
    audit = M.Audit({"recall": 0.9, "coverage": 0.5}, {"recall": 0.95})
    assert audit.write(spark, str(tmp_path), "r1") == ["coverage"]
    with pytest.raises(M.GateFailed):
        audit.write(spark, str(tmp_path), "r2", strict=True)
    assert spark.read.text(f"{tmp_path}/log").count() == 2 and "r2" in spark.read.text(f"{tmp_path}/latest").first()[0]


def test_steps_in_order():
    def run(scraped=0, changed=False, complete=True, force=False):
        done = []
        steps = M.Steps(lambda: done.append("scrape") or scraped, lambda: (changed, "m"), lambda: done.append("download") or complete, lambda: done.append("build") or 1, lambda: done.append("ingest"), lambda m: done.append(m))
        return M.sync(steps, force), done

    assert run() == ("idle", ["scrape"]) and run(scraped=2) == ("done", ["scrape", "ingest"])
    assert run(changed=True) == ("done", ["scrape", "download", "build", "ingest", "m"]) == run(force=True)
    assert run(changed=True, complete=False) == ("partial", ["scrape", "download"])
    assert M.scrape_targets("http://x/", "10e", {"core": "/rules"})[0]["url"] == "http://x/rules" and len(M.stamp()) == 19


def test_labels(spark):
    one = lambda column, *values: [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]
    assert one(L.is_skipped_section, "books", "books_2", "rules", "", None) == [True, True, False, False, None]
    assert one(L.looks_like_example, "The same unit moves", "x is selected to fight", "Roll a die", "y" * 400 + " has declared a charge") == [True, True, False, False]
    assert one(L.is_noise, "a { b", "GTAG('x')", "Roll") == [True, True, False] and one(L.caps_lead, "CORE CONCEPTS are", "A ROLL of", "no", "") == [True, False, False, False]
    assert one(L.query_name, "2. Wound ‘Roll’", "Save", None) == ["Wound Roll", "Save", None]
    assert one(L.display_time, "2024-05-06T07:08:09", "soon", None) == ["2024-05-06 07:08", "soon", None]
    df = spark.createDataFrame([("dense", 0.5, 0.9, 0.2), ("dense", None, None, None), ("lexical", 0.41, 0.3, 0.3), ("seq_neighbor", 0.0, None, None), ("x", 0.0, None, 0.7)], "p string, c double, r double, k double")
    got = df.select(L.source_label(F.col("p"), F.col("c")), L.rank_label(F.col("r"), F.col("k"), F.col("p")), L.is_child(F.col("p"))).collect()
    assert [r[0] for r in got] == ["cosine `0.5`", "metadata fetch", "lexical `0.41`", "sequence neighbor (child)", "metadata fetch (cosine `0.0`)"]
    assert [r[1] for r in got] == ["`0.9`  (cross-encoder `0.2`)", "not reranked", "`0.3`", "not reranked (sequence neighbor)", "`0.7`"] and [r[2] for r in got] == [False] * 3 + [True, False]


def test_reduced_retry():
    class Busy:
        asked = 0

        def answer(self, messages):
            self.asked += 1
            if len(messages) > 1:
                raise Refused("too long")
            return "ok"

    assert answer_or_retry(Busy(), lambda: [{}, {}], lambda: [{}]) == "ok"
    with pytest.raises(Refused):
        answer_or_retry(Busy(), lambda: [{}, {}], lambda: [{}, {}])
