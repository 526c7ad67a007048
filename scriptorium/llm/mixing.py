"""Mixing sources to target shares of tokens, each document at most a given number of times.

Every document gets a hash. Taking a source's documents with a hash under a threshold takes a share of it that needs no
sort, and a larger budget takes a superset of a smaller one. Token sums by source and hash range, a few hundred numbers per
source, tell which range holds the threshold; only that range is summed again, finer, until it holds one hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrow import bounded
from scriptorium.session import join_small, settle


def tokenizer_path(name: str) -> str:
    """The place of an installed public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed value: the published split pattern of the byte-level vocabulary below.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class MixSpec:
    """Tokens are those of the byte-level BPE vocabulary in ``ranks_file`` (a path; by default the installed public
    byte_bpe_50k.tiktoken). ``range_bits``: hash bits told apart in one pass. ``total_tokens``: size of the mixture; None
    takes the largest that the repeats allow."""

    ranks_file: str | None = None
    range_bits: int = 8
    total_tokens: int | None = None
    seed: int = 17


HASH_BITS = 62
_ENCODINGS: dict[str, object] = {}


def encoding(ranks_file: str):
    """The tokenizer, loaded once per worker."""
    if ranks_file not in _ENCODINGS:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[ranks_file] = tiktoken.Encoding("byte_bpe", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_file]


def normal_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def count_tokens(documents: DataFrame, spec: MixSpec) -> DataFrame:
    """``doc_id, source, text`` -> ``doc_id, source, tokens, h`` with a hash of ``HASH_BITS`` bits. Null texts have no tokens."""
    path = spec.ranks_file or tokenizer_path("byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in bounded(batches, "text"):
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    sized = documents.select("doc_id", "source", "text").mapInArrow(count, "doc_id bigint, source string, tokens bigint")
    return sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(spec.seed), "doc_id"), 64 - HASH_BITS))


@dataclass
class Plan:
    """For one source: ``copies`` of every document and one more of those with ``h < threshold``."""

    source: str
    target_share: float
    available: int
    budget: int
    max_repeats: int
    copies: int = 0
    threshold: int = 0


def budgets(available: dict[str, int], targets: list[tuple[str, float, int]], total: int | None) -> list[Plan]:
    """A budget per source. Sources without tokens, share or repeats cannot contribute; the shares of the others are scaled
    to 1, and the total is the largest that no source's repeats fall short of."""
    able = [(s, w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and available.get(s, 0) > 0]
    weight = sum(w for _, w, _ in able)
    most = min((available[s] * r * weight / w for s, w, r in able), default=0)
    size = most if total is None else min(total, most)
    plans = [Plan(s, w or 0.0, available.get(s, 0), 0, r or 0) for s, w, r in targets]
    for plan in plans:
        if any(plan.source == s for s, _, _ in able):
            plan.budget = int(size * plan.target_share / weight + 1e-6)
            plan.copies = min(plan.budget // plan.available, plan.max_repeats)
    return plans


def find_thresholds(sized: DataFrame, plans: list[Plan], spec: MixSpec) -> None:
    """Set the thresholds: the largest for which the documents below stay within what the copies leave of the budget. Each
    pass sums only the ranges that still hold a threshold: at most 2 ** range_bits sums per source reach the driver."""
    open_ranges = {p.source: (0, HASH_BITS, p.budget - p.copies * p.available) for p in plans if p.copies < p.max_repeats and p.budget > p.copies * p.available}
    thresholds = {p.source: p for p in plans}
    while open_ranges:
        test, place = F.lit(False), F.lit(None).cast("bigint")
        for source, (low, bits, _) in open_ranges.items():
            inside = (F.col("source") == source) & (F.shiftright("h", bits) == (low >> bits))
            test, place = test | inside, F.when(inside, F.shiftright("h", max(0, bits - spec.range_bits))).otherwise(place)
        sums: dict[str, list[tuple[int, int]]] = {s: [] for s in open_ranges}
        for source, part, tokens in sized.filter(test).groupBy("source", place.alias("part")).agg(F.sum("tokens")).collect():
            sums[source].append((part, tokens))
        following = {}
        for source, (low, bits, left) in open_ranges.items():
            finer = max(0, bits - spec.range_bits)
            threshold = low + (1 << bits)
            for part, tokens in sorted(sums[source]):
                if tokens > left:
                    threshold = part << finer
                    if finer:
                        following[source] = (threshold, finer, left)
                    break
                left -= tokens
            thresholds[source].threshold = threshold
        open_ranges = following


@dataclass
class Mixture:
    """``documents``: doc_id, source, tokens, copies (at least 1). ``report``: one row per wanted source; ``scaled_target`` is its target's
    share among the sources that have documents, which the actual share should meet."""

    documents: DataFrame
    report: DataFrame


def mix(documents: DataFrame, targets: DataFrame, spec: MixSpec = MixSpec()) -> Mixture:
    """Mix ``documents`` (doc_id, text, source) to ``targets`` (source, target_share, max_repeats). Sources are compared
    trimmed and lower-cased. Documents of a source without a target, or of none, are not used. If a wanted source has no
    documents, its share goes to the others in proportion and is reported as 0. A source named twice in the targets counts
    by the sum of its shares and the least of its repeats. Empty tables give an empty mixture.

    Texts are read once, for their tokens; after that only numbers are. The targets must be few (they are collected)."""
    spark = documents.sparkSession
    wanted = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null")
    rows = wanted.groupBy("source").agg(F.sum("target_share"), F.min("max_repeats")).orderBy("source").collect()
    known = documents.withColumn("source", normal_source(F.col("source"))).filter(F.col("source").isin([r[0] for r in rows]))
    sized = settle(count_tokens(known, spec), "tokens")
    available = {s: n or 0 for s, n in sized.groupBy("source").agg(F.sum("tokens")).collect()}
    plans = budgets(available, [tuple(r) for r in rows], spec.total_tokens)
    find_thresholds(sized, plans, spec)
    schema = "source string, target_share double, max_repeats int, available_tokens bigint, copies int, threshold bigint"
    table = spark.createDataFrame([(p.source, p.target_share, p.max_repeats, p.available, p.copies, p.threshold) for p in plans], schema)
    planned = join_small(sized, table.select("source", F.col("copies").alias("full"), "threshold"), ["source"])
    copies = F.col("full") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    chosen = planned.select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).filter("copies > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    filled = table.agg(F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).alias("filled"))
    scaled = F.when(F.col("available_tokens") > 0, F.col("target_share") / F.nullif("filled", F.lit(0.0))).otherwise(0.0)
    report = table.join(used, "source", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(filled)).select(
        "source", "target_share", scaled.alias("scaled_target"), (F.coalesce("tokens", F.lit(0)) / F.nullif("all_tokens", F.lit(0))).alias("actual_share"), "max_repeats",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"),
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), "available_tokens",
    )
    return Mixture(chosen, report)
