"""Incremental maintenance: what to write by content hash, upserts, deletes, and a guarded sweep of orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings


def manifest(rows: DataFrame, key: str, content: str) -> DataFrame:
    """``key, hash``; of a key given several times the least hash, so that the result does not depend on order. Null content counts as empty."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.min(F.md5(F.coalesce(F.col(content), F.lit("")))).alias("hash"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``key, action``: written (new or another hash), skipped (same hash), removed."""
    a, b = old.select("key", F.col("hash").alias("old")), new.select("key", F.col("hash").alias("new"))
    action = F.when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "skipped").otherwise("written")
    return a.join(b, "key", "full_outer").select("key", action.alias("action"))


def changed_children(children: DataFrame, old_parents: DataFrame, new_parents: DataFrame, old_children: DataFrame) -> DataFrame:
    """Children (key, parent, hash) to write: their parent changed, or their own hash did, or they are new."""
    parents = manifest_diff(old_parents, new_parents).filter("action = 'written'").select(F.col("key").alias("parent"), F.lit(True).alias("moved"))
    own = old_children.select("key", F.col("hash").alias("old"))
    joined = children.join(parents, "parent", "left").join(own, "key", "left")
    return joined.filter(F.coalesce("moved", F.lit(False)) | ~F.col("hash").eqNullSafe(F.col("old"))).select(*children.columns)


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return target.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def delete(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti")


def consecutive(rows: DataFrame, number: str) -> tuple[DataFrame, DataFrame]:
    """The rows of every delivery but the last under the next number, and those of every delivery but the first. Numbers without
    rows in between are empty deliveries; rows without a number belong to none."""
    ends = F.broadcast(rows.agg(F.min(number).alias("__first"), F.max(number).alias("__last")))
    both = rows.filter(F.col(number).isNotNull()).crossJoin(ends)
    old, new = both.filter(F.col(number) < F.col("__last")), both.filter(F.col(number) > F.col("__first"))
    return old.withColumn(number, (F.col(number) + 1).cast(rows.schema[number].dataType)).select(*rows.columns), new.select(*rows.columns)


def fold(rows: DataFrame, number: str, key: str, value: str, delivered: str) -> DataFrame:
    """``key, number, value``: what is left after the deliveries were upserted in the order of their numbers. Of a key given
    several times in one delivery the row delivered last counts, of several the greatest value."""
    best = F.max(F.struct(number, delivered, value)).alias("__best")
    return rows.filter(F.col(number).isNotNull()).groupBy(key).agg(best).select(key, F.col(f"__best.{number}"), F.col(f"__best.{value}"))


class TooManyOrphans(RuntimeError):
    pass


def reconcile(live: DataFrame, valid: DataFrame, key: str, s: Settings = SETTINGS, strict: bool = False) -> DataFrame:
    """``live`` without the rows whose key no source row gives any more. If they are more than ``orphan_share_limit`` of all, the
    source is likelier broken than so much gone: nothing is removed (or TooManyOrphans is raised)."""
    orphans = live.select(key).join(valid.select(key).distinct(), key, "left_anti")
    gone, total = orphans.count(), live.count()
    if total and gone > s.orphan_share_limit * total:
        if strict:
            raise TooManyOrphans(f"{gone} of {total} rows")
        return live
    return delete(live, orphans, key)


def reconcile_each(rows: DataFrame, number: str, key: str, s: Settings = SETTINGS) -> DataFrame:
    """``number, key``: ``reconcile`` of every delivery with the next one, whose number the kept keys bear."""
    live, valid = (side.select(number, key).distinct() for side in consecutive(rows.select(number, key), number))
    same = (F.col("l." + number) == F.col("v." + number)) & F.col("l." + key).eqNullSafe(F.col("v." + key))
    found = live.alias("l").join(valid.alias("v"), same, "left").select("l." + number, "l." + key, F.col("v." + number).isNull().alias("__gone"))
    share = found.groupBy(number).agg((F.sum(F.col("__gone").cast("bigint")) > s.orphan_share_limit * F.count("*")).alias("__guarded"))
    return found.join(F.broadcast(share), number).filter(~F.col("__gone") | F.col("__guarded")).select(number, key)


def source_changed(old_hash: str | None, stamp: DataFrame, column: str) -> tuple[bool, str]:
    """Whether a one-row version table differs from the stored hash, and the new hash, to be stored once all went well."""
    new = stamp.agg(F.md5(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), "\n"), F.lit("")))).first()[0]
    return new != old_hash, new
