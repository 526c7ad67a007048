"""Substring joins without a nested loop, and names found in texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import bind
from scriptorium.session import fits_broadcast, settle

try:
    import ahocorasick
except ModuleNotFoundError:  # then all needles go the way of many
    ahocorasick = None

GRAM = 3
#: Needles are searched in blocks of about so many characters, each in one pass over the texts; beyond so many blocks by their rarest runs.
BLOCK_CHARS, MAX_BLOCKS = 4 << 20, 8


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters. The text is split into characters once, as taking substrings by place reads
    a text from its start each time."""
    starts = lambda c: F.when(F.size(c) >= size, F.sequence(F.lit(0), F.greatest(F.size(c) - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    runs = lambda c: F.transform(starts(c), lambda i: F.concat(*[F.get(c, i + k) for k in range(size)]))
    return F.array_distinct(bind(F.filter(F.split(text, ""), lambda c: c != ""), runs))


def substring_pairs(needles: DataFrame, texts: DataFrame, needle: str = "needle", text: str = "text", block_chars: int = BLOCK_CHARS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """All (needle row, text row) pairs in which the needle occurs in the text. Null and empty needles match nothing, null texts hold
    nothing. Other columns must not share names.

    The distinct needles form automata, one per block of ``block_chars`` characters, and each block reads the texts once, without a
    shuffle. Beyond ``max_blocks`` blocks every needle is looked up under its rarest run of three characters by an equi-join, then tested.
    """
    words = settle(needles.select(F.col(needle).alias("__n")).filter(F.length("__n") > 0).distinct(), "needles")
    chars = words.agg(F.sum(F.length("__n") + 8)).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    found = _by_automata(words, texts, text, blocks) if ahocorasick and blocks <= max_blocks else _by_rarest_run(words, texts, text)
    named = needles.filter(F.length(needle) > 0)
    named = F.broadcast(named) if fits_broadcast(named) else named
    return found.join(named, F.col("__n") == F.col(needle)).drop("__n")


_AUTOMATA: dict[int, object] = {}


def _automaton(number: int, words: list[str]):
    """Built once per worker; a worker keeps the last few."""
    if number not in _AUTOMATA:
        while len(_AUTOMATA) > 3:
            _AUTOMATA.pop(next(iter(_AUTOMATA)))
        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        _AUTOMATA[number] = automaton
    return _AUTOMATA[number]


def _by_automata(words: DataFrame, texts: DataFrame, text: str, blocks: int) -> DataFrame:
    spark = texts.sparkSession
    schema = T.StructType([*texts.schema.fields, T.StructField("__n", T.StringType())])
    result = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = words if blocks == 1 else words.filter(F.pmod(F.xxhash64("__n"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([r[0] for r in part.collect()])
        if not sent.value:
            continue

        def search(batches: Iterator[pa.RecordBatch], sent=sent, number=sent._jbroadcast.id()) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(number, sent.value)
            for batch in batches:
                rows, hits = [], []
                for row, value in enumerate(batch.column(text).to_pylist()):
                    if value:
                        own = {word for _, word in automaton.iter(value)}
                        rows += [row] * len(own)
                        hits += own
                if rows:
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(hits, pa.string())], [*batch.schema.names, "__n"])

        result = result.unionByName(texts.mapInArrow(search, schema))
    return result


def _by_rarest_run(words: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Few candidates fail the test, as the rarest run is met by few texts; numbers of texts are shuffled instead of texts."""
    sizes = sorted(r[0] for r in words.select(F.least(F.lit(GRAM), F.length("__n")).alias("s")).distinct().collect())
    own = F.array().cast("array<string>")
    for k in sizes:
        own = F.when(F.least(F.lit(GRAM), F.length("__n")) == k, grams(F.col("__n"), k)).otherwise(own)
    runs = words.select("__n", F.explode(own).alias("__g"))
    common = runs.groupBy("__g").agg(F.count("*").alias("__c"))
    rarest = runs.join(common, "__g").groupBy("__n").agg(F.min_by("__g", F.struct("__c", "__g")).alias("__g"))
    every = F.concat(F.array().cast("array<string>"), *[grams(F.col(text), k) for k in sizes])
    numbered = settle(texts.withColumn("__id", F.monotonically_increasing_id()), "texts")
    pairs = numbered.select("__id", F.explode(every).alias("__g")).join(rarest, "__g").select("__id", "__n").distinct()
    return numbered.join(pairs, "__id").drop("__id").filter(F.contains(F.col(text), F.col("__n")))


def maximal_hits(hits: DataFrame, by: list[str], name: str) -> DataFrame:
    """Drop names that are part of a longer name found for the same ``by``."""
    grouped = hits.select(*by, name).distinct().groupBy(*by).agg(F.collect_set(name).alias("__names"))
    n = F.col("__name")
    kept = grouped.select(*by, F.explode(F.filter("__names", lambda a: ~F.exists("__names", lambda b: (a != b) & F.contains(b, a)))).alias("__name"))
    return kept.select(*by, n.alias(name))


def greedy_spans(text: Column, names: Column) -> Column:
    """Non-overlapping occurrences of the names in the text as (start, stop) from 1, the earliest first and of those the longest.
    A fold, as whether a span is kept depends on those kept before."""
    spans = F.flatten(F.transform(names, lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: (F.length(n) > 0) & (F.substring(text, i, F.length(n)) == n)),
        lambda i: F.struct(i.alias("start"), (-F.length(n)).alias("size")))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    step = lambda s, x: F.when(x["start"] > s["end"], F.struct(
        (x["start"] - x["size"] - 1).alias("end"),
        F.array_append(s["out"], F.struct(x["start"].alias("start"), (x["start"] - x["size"] - 1).alias("stop"))).alias("out"))).otherwise(s)
    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["out"])
