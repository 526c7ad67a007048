"""Files: delimited text of all-string columns, Markdown blocks, dependency graphs; and block sinks by hash."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators.incremental import manifest, manifest_diff


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, separator: str = "|") -> DataFrame:
    """Every column a trimmed string; a byte-order mark and blank-named columns are dropped. With ``columns``, a missing file is an
    empty table of those."""
    try:
        df = spark.read.option("header", True).option("sep", separator).option("inferSchema", False).option("multiLine", True).csv(path)
    except AnalysisException as error:
        if columns is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    named = [(c, c.replace("﻿", "").strip()) for c in df.columns]
    keep = [(raw, name) for raw, name in named if name and not name.startswith("_c")]
    return df.select(*[F.trim(F.col(f"`{raw}`")).alias(name) for raw, name in keep])


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, content`` of the Markdown files of a folder."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(F.url_decode(F.regexp_replace(name, r"\.md$", "")).alias("stem"), F.col("value").alias("content"))


def write_changed(blocks: DataFrame, old: DataFrame | None, path: str) -> DataFrame:
    """Write the blocks (stem, content) whose hash differs from the old manifest to ``path`` (parquet, appended) and return
    ``key, action`` for all. The manifest belongs next to the data: store it only after this returns."""
    new = manifest(blocks, "stem", "content")
    actions = manifest_diff(old if old is not None else new.limit(0), new)
    todo = actions.filter("action = 'written'").select(F.col("key").alias("stem"))
    blocks.join(todo, "stem", "left_semi").write.mode("append").parquet(path)
    return actions
