"""BM25 and the gated lexical search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings
from scriptorium.functions import text as T
from scriptorium.functions.arrow import bounded
from scriptorium.functions.wordhash import code_points, mix, run_hashes
from scriptorium.session import join_small, settle

_PLAIN = np.zeros(0x110000, bool)
_PLAIN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (runs of a-z and 0-9, lower-cased, of two characters at least) of all texts in order, and the number of each
    one's text."""
    lowered = [(t or "").lower() for t in texts]
    points = code_points("\n".join(lowered))
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))])
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _PLAIN[points]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    long = ends - starts > 1
    starts, ends = starts[long], ends[long]
    return run_hashes(mix(points.astype(np.uint64) + np.uint64(0x51ED27)), starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def vocabulary(documents: DataFrame) -> DataFrame:
    """``term, df, length``, written once: the number of texts with each token. The row with the empty term has the number of texts and
    of all tokens. Counts are summed in the tasks that read the texts before anything is shuffled."""
    tokens = documents.select(T.tokens(F.col("text")).alias("t"))
    terms = tokens.select(F.size("t").alias("size"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("term"))
    length = F.sum(F.when(F.col("term") == "", F.col("size")).otherwise(0)).cast("bigint").alias("length")
    return settle(terms.groupBy("term").agg(F.count("*").alias("df"), length), "vocabulary")


def bm25_topk(documents: DataFrame, questions: DataFrame, k: int, s: Settings = SETTINGS, max_cells: int = 5 << 20) -> DataFrame:
    """``qid, id, score, matched, rank``: the ``k`` best documents with a common token of each question, ties by id. ``documents``: id BIGINT,
    text; ``questions``: qid BIGINT, text. Repeated question tokens count repeatedly; ``matched`` is the number of distinct content
    terms in common. Scores are rounded to six digits before ranking, so that equal texts tie.

    Each task scores its documents against a block of questions and passes on only its own ``k`` best per question: neither
    postings nor scored pairs are shuffled. A block has as many questions as ``max_cells`` of its table of terms and questions
    allow, which bounds what is sent out, and reads the documents once.
    """
    spark = documents.sparkSession
    schema = "qid bigint, id bigint, score double, matched bigint"
    parts = spark.createDataFrame([], schema)
    words = vocabulary(documents)
    whole = words.filter("term = ''").first()
    if whole is None:
        return parts.withColumn("rank", F.lit(0).cast("bigint"))
    raw = F.log(F.lit(whole["df"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = words.filter("term <> ''").select("term", raw.alias("raw"))
    average = whole["length"] / whole["df"]
    floor = s.bm25_epsilon * (idf.agg(F.avg("raw")).first()[0] or 0.0)
    asked = questions.filter("qid is not null").select("qid", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    asked = settle(join_small(idf, asked, ["term"]).select("qid", "term", "times", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")), "asked")
    stop = set(T.STOPWORDS)
    held, count = asked.agg(F.count("*"), F.count_distinct("qid")).first()
    blocks = max(1, math.ceil(count / max(1, math.isqrt(max_cells * count // max(1, held)))))
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        qids, terms = np.array(sorted({r["qid"] for r in rows})), sorted({r["term"] for r in rows})
        hashes, _ = token_hashes(terms)
        order = np.argsort(hashes)
        column = {t: i for i, t in enumerate(np.array(terms)[order].tolist())}
        place = {q: i for i, q in enumerate(qids.tolist())}
        # Per term: its weight in each question, whether the question has it, and whether it is a content term of the question.
        table = np.zeros((len(terms), 3, len(qids)))
        for r in rows:
            table[column[r["term"]], :, place[r["qid"]]] = r["times"] * r["idf"] * (s.bm25_k1 + 1), 1, r["term"] not in stop
        sent = spark.sparkContext.broadcast((qids, hashes[order], table))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, terms, table = sent.value
            n = len(qids)
            best = [np.zeros((n, 0)), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)]
            for batch in batches:
                for part in bounded(iter([batch]), "text", 1 << 20):
                    for ids, scores, matched in _scored(part, terms, table, average, s):
                        joined = [np.hstack(x) for x in zip(best, (scores, np.broadcast_to(ids, scores.shape), matched))]
                        top = np.lexsort((joined[1], -joined[0]), axis=1)[:, :k]
                        best = [np.take_along_axis(x, top, 1) for x in joined]
            keep = np.isfinite(best[0])
            columns = [pa.array(np.repeat(qids, keep.sum(axis=1)), pa.int64()), pa.array(best[1][keep]), pa.array(best[0][keep] + 0.0), pa.array(best[2][keep])]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "id", "score", "matched"])

        parts = parts.unionByName(documents.filter("id is not null").select("id", "text").mapInArrow(score, schema))
    return top_per_question(parts, k)


def _scored(batch: pa.RecordBatch, terms: np.ndarray, table: np.ndarray, average: float, s: Settings, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ids``, and ``scores`` and ``matched`` as questions x documents; a document without a common token scores minus infinity."""
    hashes, owner = token_hashes(batch.column("text").to_pylist())
    length = np.bincount(owner, minlength=batch.num_rows)
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    hit = terms[at] == hashes
    pairs, tf = np.unique(owner[hit] * len(terms) + at[hit], return_counts=True)
    owner, term = pairs // len(terms), pairs % len(terms)
    weight = tf / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * length[owner] / average))
    ids = batch.column("id").to_numpy()
    docs, first = np.unique(owner, return_index=True)
    ends = np.append(first[1:], len(owner))
    step = max(1, cells // (3 * table.shape[2]))
    begin = 0
    while begin < len(docs):  # slices bound the memory of the products
        end = max(begin + 1, int(np.searchsorted(ends, first[begin] + step, side="right")))
        span = slice(first[begin], ends[end - 1])
        rows = table[term[span]]
        rows[:, 0] *= weight[span, None]
        sums = np.add.reduceat(rows, first[begin:end] - first[begin], axis=0)
        scores = np.where(sums[:, 1] > 0, np.round(sums[:, 0], 6), -np.inf)
        yield ids[docs[begin:end]], scores.T, sums[:, 2].T.astype(np.int64)
        begin = end


def top_per_question(scored: DataFrame, k: int, order: list | None = None) -> DataFrame:
    """The ``k`` best rows of each question with their ``rank``."""
    by = Window.partitionBy("qid").orderBy(*(order or [F.desc("score"), F.asc("id")]))
    return scored.withColumn("rank", F.row_number().over(by).cast("bigint")).filter(F.col("rank") <= k)


def lexical_search(documents: DataFrame, questions: DataFrame, exact: DataFrame | None = None, s: Settings = SETTINGS, admitted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``qid, id, sim, step`` of at most ``lexical_inject_max`` documents per question: first those whose name the question
    holds (``exact``: qid, id), then the best by BM25 that hold enough of the question's content terms. The cut to
    ``lexical_candidates`` comes before the gate; the pseudo-similarity is relative to the best score of the whole corpus. ``admitted`` keeps those
    of its ``qid, id`` rows that pass a filter; it comes after that cut too."""
    terms = questions.select("qid", F.size(T.content_terms(F.col("text"))).alias("terms")).filter("terms > 0")
    best = bm25_topk(documents, questions, s.lexical_candidates, s)
    top = best.withColumn("top", F.max("score").over(Window.partitionBy("qid"))).filter("score > 0")
    gated = (admitted(top) if admitted else top).join(terms, "qid").filter(F.col("matched") / F.col("terms") >= s.lexical_min_overlap)
    span = s.lexical_sim_ceiling - s.lexical_sim_floor
    second = gated.select("qid", "id", F.round(s.lexical_sim_floor + span * F.col("score") / F.col("top"), 3).alias("sim"), F.lit(2).alias("step"), "rank")
    if exact is None:
        joined = second
    else:
        first = (admitted(exact.select("qid", "id")) if admitted else exact.select("qid", "id")).distinct().join(terms, "qid", "left_semi").select("qid", "id", F.lit(s.lexical_sim_ceiling).alias("sim"), F.lit(1).alias("step"), F.lit(0).cast("bigint").alias("rank"))
        joined = first.unionByName(second.join(first, ["qid", "id"], "left_anti"))
    by = Window.partitionBy("qid").orderBy("step", "rank", "id")
    return joined.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= s.lexical_inject_max).select("qid", "id", "sim", "step")


def word_runs(words: Column, longest: int) -> Column:
    """All runs of 2 to ``longest`` words of an array of two at least."""
    upto = F.sequence(F.lit(2), F.least(F.size(words), F.lit(longest)))
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.flatten(F.transform(upto, runs))


def exact_names(named: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, id`` where the question holds the whole name, of two words or more, as words. ``named``: id, name (phrase form
    without outer blanks). An equi-join on word runs in one pass over the questions, not a nested loop."""
    names = named.filter(F.size(F.split("name", " ")) >= 2)
    longest = names.agg(F.max(F.size(F.split("name", " ")))).first()[0]
    if longest is None:
        return questions.join(named, F.lit(False)).select("qid", "id")
    words = questions.select("qid", F.split(F.trim(T.phrase_form(F.col("text"))), " ").alias("w")).filter(F.size("w") >= 2)
    runs = words.select("qid", F.explode(F.array_distinct(word_runs(F.col("w"), longest))).alias("name"))
    return runs.join(names.select("id", "name"), "name").select("qid", "id").distinct()
