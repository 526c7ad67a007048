"""Changes between full snapshots, by a bucketed key-to-hash index of the last one.

The index holds the key and two content hashes of each record, never the contents. A new snapshot is reduced to the same
form, written as a table bucketed and sorted by key, and joined with the index bucket by bucket, without a shuffle of
either. Old and new values are fetched only for the keys that changed. Then the new table becomes the index and the old one is
dropped.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import join_small, new_folder, release, remove_folder, settle

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def text_hash(text: Column) -> Column:
    """Equal for texts that differ only in runs of whitespace; null counts as empty."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.xxhash64(F.trim(flat), F.lit("text"))


def map_hash(meta: Column) -> Column:
    """Equal for maps with the same values under the same keys, in any order; an empty or null value is an absent key."""
    kept = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull() & (v != ""))
    return F.xxhash64(F.to_json(F.array_sort(F.map_entries(kept))), F.lit("map"))


@dataclass
class SnapshotIndex:
    """``apply`` each full snapshot in turn. ``content`` gives the hashes that tell whether a record changed."""

    spark: SparkSession
    key: str
    content: dict[str, Column]
    version: Column
    buckets: int
    _live: tuple[str, str] | None = None

    def build(self, snapshot: DataFrame) -> DataFrame:
        """One row per key: the row with the latest version counts; of several the one with the greatest hashes. Rows
        without a key are left out, as no later row could match them."""
        hashes = [c.alias(name) for name, c in self.content.items()]
        rows = snapshot.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), self.version.alias("version"), *hashes)
        best = F.max(F.struct("version", *self.content)).alias("best")
        return rows.groupBy("key").agg(best).select("key", *[F.col(f"best.{c}").alias(c) for c in self.content])

    def _write(self, index: DataFrame) -> tuple[str, str]:
        name = f"snapshot_index_{uuid.uuid4().hex}"
        path = new_folder(self.spark, name)
        # The aggregation has already spread the keys by the hash that buckets use, so a bucket is about one file.
        index.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).option("compression", "zstd").saveAsTable(name)
        return name, path

    def probe(self, new: tuple[str, str]) -> DataFrame:
        """The changes of a written index against the live one as ``key, change``, bucket by bucket."""
        a, b = self.spark.table(self._live[0]).alias("a"), self.spark.table(new[0]).alias("b")
        same = F.lit(True)
        for c in self.content:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        change = F.when(F.col("a.key").isNull(), ADDED).when(F.col("b.key").isNull(), REMOVED).when(~same, CHANGED)
        joined = a.join(b.hint("merge"), F.col("a.key") == F.col("b.key"), "full_outer")
        return joined.select(F.coalesce("a.key", "b.key").alias("key"), change.alias("change")).filter(F.col("change").isNotNull())

    def apply(self, snapshot: DataFrame) -> DataFrame | None:
        """The changes against the last snapshot as ``key, change``, written to the shared folder, or None for the first. The snapshot's
        index takes the place of the last one, which is dropped."""
        new = self._write(self.build(snapshot))
        changes = None if self._live is None else settle(self.probe(new), "changes")
        self.close()
        self._live = new
        return changes

    def close(self) -> None:
        if self._live:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._live[0]}")
            remove_folder(self.spark, self._live[1])
        self._live = None


def snapshot_changes(snapshots: DataFrame, number: str = "snapshot_no", key: str = "chunk_id", buckets: int | None = None) -> DataFrame:
    """Changes between every two consecutive deliveries, as ``snapshot_no`` (of the later one), ``key``, ``change``. Deliveries are
    consecutive if no row has a number between theirs; rows without a number belong to none. Columns: ``number, key, text,
    meta, delivered_at``; others do not count. ``buckets``: of the index, by default as many as shuffle partitions. Only the
    distinct numbers reach the driver. The table is read once, to reduce each row to its hashes."""
    spark = snapshots.sparkSession
    hashed = snapshots.filter(F.col(number).isNotNull()).select(F.col(number).cast("int").alias("number"), F.col(key).alias("key"), "delivered_at", text_hash(F.col("text")).alias("text_hash"), map_hash(F.col("meta")).alias("meta_hash"))
    hashed = settle(hashed, "snapshot_hashes", ["number"])
    result = spark.createDataFrame([], "snapshot_no int, key string, change string")
    index = SnapshotIndex(spark, "key", {c: F.col(c) for c in ("text_hash", "meta_hash")}, F.col("delivered_at"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    for (n,) in hashed.select("number").distinct().orderBy("number").collect():
        changes = index.apply(hashed.filter(F.col("number") == n))
        if changes is not None:
            result = result.unionByName(changes.select(F.lit(n).cast("int").alias("snapshot_no"), "key", "change"))
    index.close()
    release(hashed)
    return result


def changed_values(snapshots: DataFrame, changes: DataFrame, number: str = "snapshot_no", key: str = "chunk_id") -> DataFrame:
    """The changes with ``old_text, old_meta, new_text, new_meta``, fetched from the deliveries for changed keys only. Up to 300,000
    of them are sent to the tasks that read the deliveries, whose texts then are not shuffled unless changed; of more, the
    deliveries are joined by key."""
    numbers = [n for (n,) in snapshots.select(F.col(number).cast("int").alias("n")).filter("n is not null").distinct().orderBy("n").collect()]
    before = F.create_map(*[F.lit(x) for pair in zip(numbers[1:], numbers) for x in pair]) if len(numbers) > 1 else F.create_map().cast("map<int,int>")
    changes = settle(changes.select("snapshot_no", "key", "change").withColumn("before", F.try_element_at(before, F.col("snapshot_no"))), "changes")
    needed = settle(changes.select("key", F.explode(F.array("before", "snapshot_no")).alias("no")).distinct(), "changed_keys")
    latest = F.max_by(F.struct("text", "meta"), F.struct("delivered_at", text_hash(F.col("text")), map_hash(F.col("meta"))))
    rows = snapshots.select(F.col(key).alias("key"), F.col(number).cast("int").alias("no"), "text", "meta", "delivered_at")
    values = join_small(rows, needed, ["key", "no"], "left_semi", max_rows=300_000, salts=1).groupBy("key", "no").agg(latest.alias("v"))
    values = settle(values, "changed_values")
    old = values.select("key", F.col("no").alias("before"), F.col("v.text").alias("old_text"), F.col("v.meta").alias("old_meta"))
    new = values.select("key", F.col("no").alias("snapshot_no"), F.col("v.text").alias("new_text"), F.col("v.meta").alias("new_meta"))
    return changes.join(old, ["key", "before"], "left").join(new, ["key", "snapshot_no"], "left").select("snapshot_no", "key", "change", "old_text", "old_meta", "new_text", "new_meta")
