import pytest
from pyspark.sql import functions as F

from scriptorium.operators.scorers import CoverageReranker, HashedTerms
from scriptorium.plans import pipeline
from scriptorium.sources import conversations, files
from scriptorium.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id|name|\n1| x |\n2||\n", encoding="utf-8")
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["id", "name"] and [tuple(r) for r in rows.orderBy("id").collect()] == [("1", "x"), ("2", None)]
    assert files.read_delimited(spark, str(tmp_path / "none.csv"), ["a"]).columns == ["a"]
    folder = tmp_path / "blocks"
    folder.mkdir()
    (folder / "unit_1.md").write_text("# A\nb")
    (folder / "skip.txt").write_text("x")
    blocks = files.read_blocks(spark, str(folder))
    assert [tuple(r) for r in blocks.collect()] == [("unit_1", "# A\nb")]
    out = str(tmp_path / "out")
    assert [r.action for r in files.write_changed(blocks, None, out).collect()] == ["written"] and spark.read.parquet(out).count() == 1


def test_stream_folds_late_and_repeated_rows(spark, tmp_path):
    landing, target, state = (str(tmp_path / x) for x in ("landing", "target", "state"))
    rows = lambda *x: spark.createDataFrame(list(x), "key string, version int, text string")
    first = rows(("a", 2, "new"), ("b", 1, "b"))
    first.write.parquet(landing)
    run = lambda: ingest.stream_upserts(spark, landing, first.schema, "key", "version", target, state).awaitTermination(120)
    run()
    rows(("a", 1, "late"), ("b", 1, "b"), ("c", 1, "c")).write.mode("append").parquet(landing)
    run()
    assert {tuple(r) for r in ingest.current(spark, target).collect()} == {("a", 2, "new"), ("b", 1, "b"), ("c", 1, "c")}
    assert ingest.current(spark, str(tmp_path / "nothing")) is None


def test_windowed_counts(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    counts = ingest.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", "event_type")
    assert counts.agg(F.sum("n")).first()[0] == events.count()


def test_conversation_store(spark, data):
    raw = spark.read.parquet(f"{data}/conversations.parquet")
    store = conversations.latest(raw)
    assert store.count() == raw.select("id").distinct().count() and store.filter("edition is null").count() == 0
    row = store.filter("messages <> '[]'").first()
    assert conversations.messages_of(store, row.id, row.user_name).count() > 0 and conversations.messages_of(store, row.id, "nobody else").count() == 0
    ids = [r.id for r in conversations.listing(store, row.user_name, row.edition).collect()]
    assert ids == sorted(ids, reverse=True) and row.id in ids
    history = spark.createDataFrame([(i, "user", str(i)) for i in range(9)], "pos int, role string, content string")
    messages = conversations.prompt("s", history, "c", "q")
    assert [m["content"] for m in messages] == ["s\n\nc", "3", "4", "5", "6", "7", "8", "q"]


CHUNKS = [
    ("core_1", "Deep Strike lets units arrive from reserve late.", "Core_Rules", "", "", "Core > Deep Strike", "seq", "1"),
    ("core_2", "After arrival units may not charge.", "Core_Rules", "", "", "Core > Arrival Note", "seq", "2"),
    ("pack_1", "Deep strike arrival scores in this pack.", "Muster_Pack", "", "", "Pack > Deep Strike", None, None),
    ("unit_1", "Old Guard carry pikes and may use deep strike.", "Datasheet", "red", "Old Guard", None, None, None),
    ("unit_2", "Old Guard pikes reach far.", "Ability", "red", "Old Guard", None, None, None),
    ("none", None, None, None, None, None, None, None),
]


@pytest.mark.parametrize("pack_on", [True, False])
def test_pipeline(spark, pack_on):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string, category string, army string, unit_name string, breadcrumb string, section_group string, seq string")
    asked = spark.createDataFrame([(1, "Can the Old Guard use deep strike?"), (2, "unrelated words"), (3, None)], "qid bigint, text string")
    factions = spark.createDataFrame([("Red",), ("Blue",), (None,)], "name string")
    corpus = pipeline.Corpus(chunks, factions, spark.createDataFrame([("core_1", "core_2")], "src string, dep string"))
    rows = pipeline.build_context(asked, corpus, pack_on).orderBy("qid", "place").collect()
    ids = [r.chunk_id for r in rows if r.qid == 1]
    assert ids[0] == "unit_1" and "core_1" in ids and ("pack_1" in ids) == pack_on
    assert ids.index("core_2") == ids.index("core_1") + 1
    assert not [r for r in rows if r.qid == 3] and (pack_on or not [r for r in rows if r.chunk_id == "pack_1"])
    if pack_on:
        bare = pipeline.build_context(asked, corpus, pack_on, pipeline.Models(reranker=None)).filter("qid = 1").collect()
        assert {r.chunk_id for r in bare} == set(ids)


def test_routes_of_questions(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string, category string, army string, unit_name string, breadcrumb string, section_group string, seq string")
    corpus = pipeline.Corpus(chunks, spark.createDataFrame([("Red",), ("Red Host",)], "name string"))
    asked = spark.createDataFrame([(1, "Does the red host win?"), (2, "red victory points"), (3, "What do Old Guard do?"), (4, "hello"), (5, None)], "qid bigint, text string")
    got = {r.qid: (r.faction, r.route) for r in pipeline.routed(asked, corpus, pipeline.numbered(chunks), True).collect()}
    assert got == {1: ("Red Host", "faction+pack"), 2: ("Red", "faction+core+pack"), 3: (None, "all"), 4: (None, "core+pack"), 5: (None, "core+pack")}


def test_scorers(spark):
    df = spark.createDataFrame([("deep strike", "a deep well"), ("", None)], "q string, t string")
    assert [r[0] for r in df.select(CoverageReranker().score(F.col("q"), F.col("t"))).collect()][0] == 0.0
    assert sum(df.select(HashedTerms(16).embed(F.col("q")).alias("v")).first().v) == 2.0


def test_joins_with_small_and_skewed_sides(spark):
    from pyspark.sql import functions as F

    from scriptorium.session import fits_broadcast, join_skewed, join_small

    left = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(500).select(F.col("id").alias("k"), F.repeat(F.lit("é"), 10).alias("t"))
    want = sorted((r.k, r.v, r.t) for r in left.join(right, "k").collect())
    for got in (join_skewed(left, right, "k", hot_rows=100), join_skewed(left, right, "k"), join_small(left, right, ["k"]), join_small(left, right, ["k"], max_bytes=100), join_small(left, right, ["k"], max_rows=10)):
        assert sorted((r.k, r.v, r.t) for r in got.collect()) == want
    assert join_skewed(left, right, "k", "left", hot_rows=100).count() == 3000
    assert fits_broadcast(right) and not fits_broadcast(right, max_bytes=500 * 20) and not fits_broadcast(right, max_rows=499)
