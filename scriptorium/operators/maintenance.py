"""Keeping collections current: one table of chunks per edition, guarded sweeps, archives, audits, and the order of the steps."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.operators.chunking import block_chunks
from scriptorium.operators.incremental import manifest, manifest_diff, reconcile
from scriptorium.session import settle


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@dataclass(frozen=True)
class Collections:
    """The chunks of each edition below ``root``, each version in a folder of its own; a small text file names the current one."""

    spark: SparkSession
    root: str

    def _pointer(self, edition: str) -> str:
        return f"{self.root}/{edition}/current"

    def current(self, edition: str) -> str | None:
        """The folder of the edition's current version."""
        pointer = self._pointer(edition)
        if not path_exists(self.spark, pointer):
            return None
        return self.spark.read.text(pointer).agg(F.max("value")).first()[0]

    def open(self, edition: str, schema: str, reset: bool = False) -> DataFrame:
        """The edition's chunks, empty if there are none yet or if they are to be built anew."""
        folder = None if reset else self.current(edition)
        return self.spark.createDataFrame([], schema) if folder is None else self.spark.read.parquet(folder)

    def replace(self, edition: str, rows: DataFrame, version: str) -> str:
        """Write ``rows`` as the version and then point to it: readers see the old version or the new one, never a part. Earlier versions
        stay as the archive."""
        folder = f"{self.root}/{edition}/versions/{version}"
        rows.write.option("compression", "zstd").parquet(folder)
        self.spark.createDataFrame([(folder,)], "value string").coalesce(1).write.mode("overwrite").text(self._pointer(edition))
        return folder


def archive(rows: DataFrame, root: str, snapshot: str) -> None:
    """Keep a delivery as it came, in a partition of its own, before the next replaces it."""
    rows.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(root)


def owned_sweep(old: DataFrame, new: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """``key, action`` of two manifests (key, hash) that several producers share: only keys with one of this producer's prefixes are
    removed; those of others are skipped."""
    mine = F.lit(False)
    for prefix in prefixes:
        mine = mine | F.col("key").startswith(prefix)
    action = F.when((F.col("action") == "removed") & ~mine, "skipped").otherwise(F.col("action"))
    return manifest_diff(old, new).select("key", action.alias("action"))


def page_sweep(old: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """``key, action`` of two manifests (page, key, hash); what a page no longer gives is removed only if the page was fetched. ``pages``:
    page, fetched."""
    a, b = old.select("page", "key", F.col("hash").alias("was")), new.select("page", "key", F.col("hash").alias("is"))
    joined = a.join(b, ["page", "key"], "full_outer").join(pages.select("page", F.col("fetched").alias("ok")), "page", "left")
    gone = F.col("is").isNull()
    action = F.when(gone & F.coalesce("ok", F.lit(False)), "removed").when(gone | F.col("was").eqNullSafe(F.col("is")), "skipped").otherwise("written")
    return joined.select("page", "key", action.alias("action"))


def valid_ids(blocks: DataFrame, edition: str) -> DataFrame:
    """``chunk_id`` of every chunk that the blocks (stem, content) give now: rules, abilities and sections alike."""
    return block_chunks(blocks, edition).select("chunk_id").distinct()


def ingest(live: DataFrame, blocks: DataFrame, edition: str, s: Settings = SETTINGS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The collection (chunk_id, text and further columns of ``block_chunks``) brought up to the blocks, and ``key, action``: changed and new
    chunks are upserted, orphans swept unless they are too many."""
    fresh = settle(block_chunks(blocks, edition), "fresh_chunks")
    actions = settle(manifest_diff(manifest(live, "chunk_id", "text"), manifest(fresh, "chunk_id", "text")), "actions")
    written = actions.filter("action = 'written'").select(F.col("key").alias("chunk_id"))
    kept = live.join(written, "chunk_id", "left_anti").unionByName(fresh.join(written, "chunk_id", "left_semi"), allowMissingColumns=True)
    return reconcile(kept, fresh.select("chunk_id"), "chunk_id", s, strict), actions


class GateFailed(RuntimeError):
    pass


@dataclass
class Audit:
    """Figures of one run, kept as lines of JSON; ``least`` are the gates."""

    least: dict[str, float]
    figures: dict[str, float] = field(default_factory=dict)

    def failed(self) -> list[str]:
        """Gates that are not met; a figure that was not taken fails."""
        return [k for k, v in self.least.items() if not self.figures.get(k, float("-inf")) >= v]

    def write(self, spark: SparkSession, root: str, run: str, strict: bool = False) -> list[str]:
        """Append the run's figures under ``root`` and make them the latest; with ``strict`` a failed gate raises once they are written.
        The collection itself is never touched."""
        failed = self.failed()
        line = json.dumps({"run": run, "figures": self.figures, "failed": failed}, sort_keys=True)
        df = spark.createDataFrame([(line,)], "value string").coalesce(1)
        df.write.mode("append").text(f"{root}/log")
        df.write.mode("overwrite").text(f"{root}/latest")
        if failed and strict:
            raise GateFailed(", ".join(failed))
        return failed


@dataclass(frozen=True)
class Steps:
    """The steps of one edition. ``download`` tells whether all files came; ``changed`` tells whether the source is new and the mark to
    store once all went well."""

    scrape: Callable[[], int]
    changed: Callable[[], tuple[bool, str]]
    download: Callable[[], bool]
    build: Callable[[], int]
    ingest: Callable[[], None]
    store_mark: Callable[[str], None]


def sync(steps: Steps, force: bool = False) -> str:
    """Scrape; if the source changed, download and build; ingest if either gave something. A partial download ends the run before anything
    is built, and the mark is stored last, so that a failed run is repeated. Returns what happened: idle, partial or done."""
    scraped = steps.scrape()
    changed, mark = steps.changed()
    if changed or force:
        if not steps.download():
            return "partial"
        steps.build()
    elif not scraped:
        return "idle"
    steps.ingest()
    if changed or force:
        steps.store_mark(mark)
    return "done"


def scrape_targets(base_url: str, edition: str, pages: dict[str, str]) -> list[dict[str, str]]:
    """The pages of an edition as rows: key, url, edition, prefix of their blocks."""
    return [{"key": key, "url": f"{base_url.rstrip('/')}/{path.lstrip('/')}", "edition": edition, "prefix": f"{key}_"} for key, path in sorted(pages.items())]


def stamp(at: datetime | None = None) -> str:
    """A sortable name of a moment, in UTC."""
    return (at or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%S")
