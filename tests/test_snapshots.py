from datetime import datetime

from scriptorium.operators import snapshots as S

SCHEMA = "snapshot_no int, chunk_id string, block_name string, text string, meta map<string,string>, delivered_at timestamp, key string, change string"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def rows(spark, *data):
    return spark.createDataFrame([(n, c, "b", t, m, at, "x", "y") for n, c, t, m, at in data], SCHEMA)


def test_changes(spark):
    df = rows(
        spark,
        (1, "same", "a b", {"k": "v", "e": ""}, T1), (2, "same", " a\n\tb ", {"k": "v"}, T1),
        (1, "text", "a", {}, T1), (2, "text", "b", {}, T1),
        (1, "meta", "a", {"k": "1"}, T1), (2, "meta", "a", {"k": "2"}, T1),
        (1, "gone", "a", None, T1), (2, "new", None, None, None),
        (1, "old", "x", None, T1), (2, "old", "y", None, T1), (2, "old", "x", None, T2),
        (1, "twice", "x", None, T1), (1, "twice", "x", None, T1), (2, "twice", "x", None, T1),
        (1, "nbsp", "a b", None, T1), (2, "nbsp", "a b", None, T1), (1, None, "a", None, T1), (1, "long", "x " * 100_000, None, T1), (2, "long", "x  " * 100_000, None, T1),
        (1, "null", None, None, T1), (2, "null", "", {"k": None}, T1),
    )
    changes = S.snapshot_changes(df, buckets=3)
    got = {(r.snapshot_no, r.key): r.change for r in changes.collect()}
    assert got == {(2, "text"): "changed", (2, "meta"): "changed", (2, "gone"): "removed", (2, "new"): "added"}
    values = {r.key: r for r in S.changed_values(df, changes).collect()}
    assert (values["text"].old_text, values["text"].new_text) == ("a", "b") and values["gone"].new_text is None and values["meta"].new_meta == {"k": "2"}


def test_only_existing_numbers_are_deliveries(spark):
    df = rows(spark, (20240101, "a", "x", None, T1), (20250101, "a", "y", None, T1), (20250101, "b", "z", None, T1), (None, "c", "x", None, T1))
    changes = S.snapshot_changes(df, buckets=2)
    assert {(r.snapshot_no, r.key, r.change) for r in changes.collect()} == {(20250101, "a", "changed"), (20250101, "b", "added")}
    assert {r.key: (r.old_text, r.new_text) for r in S.changed_values(df, changes).collect()} == {"a": ("x", "y"), "b": (None, "z")}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("snapshot_index")]


def test_empty_and_single(spark):
    assert S.snapshot_changes(rows(spark)).count() == 0
    assert S.snapshot_changes(rows(spark, (1, "a", "x", None, T1)), buckets=2).count() == 0


def test_index_join_needs_no_shuffle(spark, data):
    from scriptorium.sources.tables import table

    df = table(spark, data, "chunk_snapshots")
    index = S.SnapshotIndex(spark, "chunk_id", {"h": S.text_hash(df["text"])}, df["delivered_at"], 4)
    assert index.apply(df.filter("snapshot_no = 1")) is None
    new = index._write(index.build(df.filter("snapshot_no = 2")))
    plan = index.probe(new)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    first = index._live
    assert index.apply(df.filter("snapshot_no = 2")).count() > 0 and index._live != first and not spark.catalog.tableExists(first[0])
    index.close()
