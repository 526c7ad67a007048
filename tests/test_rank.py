from pyspark.sql import functions as F

from scriptorium.config import Settings
from scriptorium.operators import dense, lexical, rank


def test_blended_score(spark):
    df = spark.createDataFrame([(None, 0.5, "x", None), (0.9, 0.5, "Core_Rules", None), (0.1, 0.5, "Muster_Pack", None), (0.1, 0.5, "x", 0.3), (None, None, None, None)], "r double, c double, k string, o double")
    on, off = ([x[0] for x in df.select(rank.blended_score(F.col("r"), F.col("c"), F.col("k"), F.col("o"), p)).collect()] for p in (True, False))
    assert [round(x, 6) for x in on] == [0.5, 0.901, 0.202, 0.3, 0.0] and round(off[2], 6) == 0.2


def test_segment_maxpool_never_demotes(spark):
    df = spark.createDataFrame([(1, "a", 0, True, 0.5), (1, "a", 1, False, 2.0), (1, "b", 0, True, 0.5)], "qid int, id string, segment int, whole boolean, x double")
    got = {r.id: r.rerank for r in rank.segment_maxpool(df).collect()}
    assert got["a"] > got["b"] and abs(got["b"] - 0.6224593) < 1e-6


def test_reservation(spark):
    rows = [(1, "a", "u", 0.90, 0.1, 1), (1, "b", "u", 0.88, 0.9, 2), (1, "c", "u", 0.5, 0.9, 3), (1, "d", "v", 0.9, 0.1, 4), (1, "e", "v", 0.2, 0.1, 5), (1, "f", "w", 0.05, 0.1, 6), (1, "g", "w", 0.001, 0.1, 7)]
    got = {r.id: r.place for r in rank.reserve_units(spark.createDataFrame(rows, "qid int, id string, unit string, score double, cosine double, pos int")).collect()}
    assert got == {"b": 1, "a": 2, "d": 1, "f": 1, "g": 2}


def test_assembly_fills_to_top_k(spark):
    schema = "qid int, id string, key string, unit string, pos int, score double"
    units = spark.createDataFrame([(1, "u0", "kr0", "u", 0, 0.9, 0.3), (1, "u1", "k1", "u", 1, 0.5, 0.2), (1, "u2", "k2", "u", 2, 0.4, 0.1), (1, "u9", "k2", "u", 9, 0.5, 0.9)], schema + ", cosine double")
    rules = spark.createDataFrame([(1, f"r{i}", f"kr{i}", None, i, 0.9 - i / 100) for i in range(6)], schema)
    main = spark.createDataFrame([(1, f"m{i}", f"km{i}", None if i else "u", i, 0.8 - i / 100) for i in range(9)] + [(1, "dup", "km1", None, 99, 0.99), (2, "only", "x", None, 1, 0.1)], schema)
    rows = rank.assemble(units, rules, main).orderBy("qid", "place").collect()
    assert [r.id for r in rows if r.qid == 1] == ["u1", "r0", "r1", "r2", "r3", "u2", "m1", "m2"] and [r.id for r in rows if r.qid == 2] == ["only"]


def test_cap_below_parents(spark):
    pool = spark.createDataFrame([(1, "p", 1, 0.9), (1, "p", 2, 0.7), (1, "q", 3, 0.8)], "qid int, key string, pos int, score double")
    seeds = spark.createDataFrame([(1, "s", 0.6, ["p", "q"]), (1, "t", 0.5, ["zz"]), (1, "v", 0.4, ["q"])], "qid int, key string, bridge double, parent_keys array<string>")
    assert {r.key: r.override for r in rank.cap_below_parents(seeds, pool).collect()} == {"s": 0.68, "t": None, "v": 0.778}


def test_budget_is_monotone_and_keeps_the_crossing_row(spark):
    rows = spark.createDataFrame([(1, i, "x" * 40) for i in range(6)] + [(2, 0, None)], "qid int, pos int, text string")
    kept = [rank.soft_budget(rows, F.lit("l"), F.col("text"), b).groupBy("qid").count().collect() for b in (1, 20, 1000)]
    assert [{r.qid: r["count"] for r in k} for k in kept] == [{1: 1, 2: 1}, {1: 2, 2: 1}, {1: 6, 2: 1}]


def test_neighbours(spark):
    rows = spark.createDataFrame([(1, "g", 2, 1), (1, "g", 3, 2)], "qid int, group string, seq int, place int")
    members = spark.createDataFrame([("g", i, f"m{i}") for i in range(1, 6)], "group string, seq int, id string")
    assert {(r.id, r.place) for r in rank.sequence_neighbours(rows, members).collect()} == {("m1", 1), ("m4", 2)}


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "the deep strike rule"), (2, None), (3, ""), (4, "deep deep water")], "id int, text string")
    asked = spark.createDataFrame([(1, "Deep strike"), (2, ""), (3, None), (4, "nothing here")], "qid int, text string")
    got = {(r.qid, r.id): r for r in lexical.bm25_topk(docs, asked, 9).collect()}
    blocked = lexical.bm25_topk(docs, asked, 9, max_cells=1)
    assert sorted(map(tuple, blocked.collect())) == sorted(map(tuple, got.values()))
    assert set(got) == {(1, 1), (1, 4)} and got[1, 1].matched == 2
    assert [(r.id, r.sim) for r in lexical.lexical_search(docs, asked).collect()] == [(1, 0.55)]
    assert lexical.bm25_topk(docs.limit(0), asked, 9).count() == 0 and lexical.bm25_topk(docs, asked.limit(0), 9).count() == 0


def test_exact_names_come_first(spark):
    named = spark.createDataFrame([(1, "deep strike"), (2, "strike"), (3, "one two three")], "id int, name string")
    asked = spark.createDataFrame([(1, "Does Deep-Strike work?"), (2, "one two"), (3, None)], "qid int, text string")
    assert [tuple(r) for r in lexical.exact_names(named, asked).collect()] == [(1, 1)]


def test_dense_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    m[5] = 0
    m[7] = m[8]
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(99, None), (98, [1.0])], "id bigint, vector array<double>")
    q = v.filter("id in (0, 7, 5)").withColumnRenamed("id", "qid")
    got = {}
    for r in dense.dense_topk(v, q, 4, block=2).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for i in (0, 7, 5):
        c = np.round(u @ u[i], 6)
        assert got[i] == [j for j in sorted(range(60), key=lambda j: (-c[j], j)) if j != i][:4]
    assert dense.dense_topk(v.limit(0), q, 4).count() == 0 and dense.dense_topk(v, q.limit(0), 4).count() == 0


def test_settings_reach_the_operators(spark):
    rows = [(1, "a", "u", 0.9, 0.1, 1), (1, "b", "u", 0.9, 0.9, 2)]
    df = spark.createDataFrame(rows, "qid int, id string, unit string, score double, cosine double, pos int")
    assert rank.reserve_units(df, Settings(unit_chunks_per_unit=1)).count() == 1


def test_whole_pool_is_seeded(spark, data):
    from scriptorium.plans.catalogue import QUERIES

    most = QUERIES["parent_cap"](spark, data).groupBy("qid").count().agg(F.max("count")).first()[0]
    assert most == Settings().rerank_candidates
