"""Exact nearest neighbours by cosine, for a stated set of query vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, block: int = 512, same: bool = True) -> DataFrame:
    """``qid, id, cosine, rank``: the ``k`` nearest ``vectors`` (id, vector) of each query (qid, vector), itself (equal id)
    left out unless ``same`` is off, as it is where queries and vectors are numbered apart; ties by id. Cosines are rounded to six digits before ranking; a zero vector has cosine 0. The commonest length of the
    queries counts, of several the greatest; null vectors and those of another length take no part. ``threshold`` filters on the cosine after ranking.

    Each task multiplies its batches with a block of queries and passes on only its own ``k`` best per query, so the shuffle
    does not grow with the vectors per task. Queries are sent out in blocks of ``block``. If the queries have ``tags`` (array of
    BIGINT), each finds only the vectors that have one of them in their own ``tags``, before the cut to ``k``.
    """
    spark = vectors.sparkSession
    schema = "qid bigint, id bigint, cosine double"
    parts = spark.createDataFrame([], schema)
    lengths = queries.filter("vector is not null and qid is not null").groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    width, count = common if common is not None else (0, 0)
    queries = queries.filter(F.size("vector") == width)
    tagged = "tags" in queries.columns
    blocks = max(1, math.ceil(count / block))
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "vector", *(["tags"] if tagged else [])).collect()
        if not rows:
            continue
        tags = np.unique([t for r in rows for t in r[2] or []]).astype(np.int64) if tagged else np.zeros(0, np.int64)
        wanted = np.array([np.isin(tags, r[2] or []) for r in rows]) if tagged else None
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), _unit(np.array([r[1] for r in rows], np.float64).reshape(len(rows), width)), tags, wanted))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
            qids, matrix, tags, wanted = sent.value
            best_c, best_i = np.zeros((len(qids), 0)), np.zeros((len(qids), 0), np.int64)
            for batch in batches:
                table = pa.table(batch)
                ids, lists = table["id"].to_numpy(), table["vector"].combine_chunks()
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if not len(ids):
                    continue
                cosine = np.round(matrix @ _unit(flat.reshape(len(ids), width)).T, 6)
                if wanted is not None:
                    cosine[~_allowed(table["tags"].combine_chunks(), tags, wanted)] = -np.inf
                if same:
                    cosine[qids[:, None] == ids[None, :]] = -np.inf
                c, i = np.hstack([best_c, cosine]), np.hstack([best_i, np.broadcast_to(ids, cosine.shape)])
                order = np.lexsort((i, -c), axis=1)[:, :k]
                best_c, best_i = np.take_along_axis(c, order, 1), np.take_along_axis(i, order, 1)
            keep = np.isfinite(best_c)
            owner = np.repeat(qids, keep.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(best_i[keep], pa.int64()), pa.array(best_c[keep] + 0.0)], ["qid", "id", "cosine"])

        parts = parts.unionByName(vectors.filter(F.size("vector") == width).select("id", "vector", *(["tags"] if tagged else [])).mapInArrow(nearest, schema))
    by = Window.partitionBy("qid").orderBy(F.desc("cosine"), F.asc("id"))
    ranked = parts.withColumn("rank", F.row_number().over(by).cast("bigint")).filter(F.col("rank") <= k)
    return ranked if threshold is None else ranked.filter(F.col("cosine") >= threshold)


def _allowed(lists: pa.ListArray, tags: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Queries x vectors: whether they have a tag in common. ``tags``: those of the queries, sorted; ``wanted``: queries x tags."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(tags, flat), max(0, len(tags) - 1))
    has = np.zeros((len(lists), len(tags)), np.float32)
    if len(tags):
        known = tags[at] == flat
        has[owner[known], at[known]] = 1
    return wanted.astype(np.float32) @ has.T > 0


def fuse(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Dense rows (qid, id, key, score), then lexical ones whose content key no dense row and no earlier lexical row has."""
    fresh = lexical.join(dense.select("qid", "key").distinct(), ["qid", "key"], "left_anti")
    by = Window.partitionBy("qid", "key").orderBy(F.desc("score"), F.asc("id"))
    once = fresh.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")
    return dense.withColumn("origin", F.lit("dense")).unionByName(once.withColumn("origin", F.lit("lexical")))
