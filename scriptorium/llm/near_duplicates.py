"""Near-duplicate texts: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Each text becomes the set of its distinct runs of ``k`` adjacent words. Texts with equal sets form one class and are
handled once, so any number of exact copies costs one signature. Signatures come from a one-permutation pass; an
empty bin borrows from a bin chosen by a hash of its number and the attempt (optimal densification). Bands of the
signature are bucket keys. In a bucket every class is linked only to one centre, another one in each bucket, so that a bucket
of n classes gives n - 1 candidate pairs. Where a member is by its sketch not similar to the centre, a bucket of a few classes is compared pair by
pair; a larger one is split by a further signature value and linked to new centres, in a few rounds. Candidates whose sketches differ too much are dropped
before any text is read; the rest is verified on the exact sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrow import bounded
from scriptorium.functions.wordhash import mix, words_of
from scriptorium.llm.components import components
from scriptorium.session import join_skewed, join_small, release, rows_within, settle


#: Signature values of which a sketch holds two bits each, in two numbers of 64 bits.
SKETCHED = 60


@dataclass(frozen=True)
class NearDuplicateSpec:
    """``shingle`` words per run, Jaccard ``threshold``, ``min_words`` below which a text takes no part. The signature has
    ``bins`` values of 16 bits in bands of ``rows``. 120 values in 20 bands of 6 rows let a pair of similarity 0.8 share a bucket
    with probability 0.998; 60 values in 20 bands of 3 do so for 0.6 with 0.994. A candidate is read only if the similarity that two bits
    of each of 60 values show is within ``slack`` standard deviations of the threshold, which loses 3 in 100,000 pairs at the threshold itself. ``rounds`` of finer
    buckets follow the first where a class is by its signature not similar to the centre, and buckets of up to ``small_bucket`` classes are then compared pair by pair. Groups of up to ``small_group`` classes are compared within pair by pair, larger ones through
    the rarest runs of each text, which loses no pair either; ``hot_rows`` is the size from which a key is spread."""

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 5
    bins: int = 120
    rows: int = 6
    slack: float = 4.0
    rounds: int = 1
    small_group: int = 64
    hot_rows: int = 100_000
    small_bucket: int = 8

    @property
    def least_estimate(self) -> float:
        p = 0.25 + 0.75 * self.threshold
        return self.threshold - self.slack * sqrt(p * (1 - p) / SKETCHED) / 0.75


#: Rules text of chunks, as the task states it: word pairs and 0.6.
CHUNK_SPEC = NearDuplicateSpec(shingle=2, threshold=0.6, min_words=20, bins=60, rows=3)


def distinct_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in one array, its bounds per text, and the number of words per text."""
    words = words_of(texts)
    hashes, first = words.shingles(k)
    owner = words.text_of()[first] if len(first) else np.zeros(0, np.int64)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        keep = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1)), np.diff(words.bounds)


def one_permutation(hashes: np.ndarray, bounds: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """The densified minima, texts x bins; a text without shingles gets zeros."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    filled = sizes > 0
    out = np.zeros((n, bins), np.uint64)
    if not filled.any():
        return out
    h = mix(hashes ^ mix(np.array([seed], np.uint64)))
    cell = np.repeat(np.arange(n), sizes) * bins + (h >> np.uint64(40)).astype(np.int64) % bins
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    has = np.zeros(n * bins, bool)
    flat = out.reshape(-1)
    flat[cell[first]], has[cell[first]] = h[first], True
    open_cells = np.flatnonzero(~has & np.repeat(filled, bins))
    attempt = 0
    while len(open_cells):
        attempt += 1
        column = (open_cells % bins).astype(np.uint64)
        donor = (mix(column * np.uint64(0x9E3779B1) + np.uint64(attempt * 1_000_003 + seed)) % np.uint64(bins)).astype(np.int64)
        source = open_cells - open_cells % bins + donor
        found = has[source]
        flat[open_cells[found]] = flat[source[found]]
        open_cells = open_cells[~found]
    return out


def name_hash(name: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(repr(name).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(bounds.astype(np.int64), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))


def signatures(rows: DataFrame, spec: NearDuplicateSpec) -> DataFrame:
    """``id, part, body`` -> ``id, part, node, body_key, signature, s0, s1`` of the texts long enough; ``node`` is a 64-bit hash of the part
    and the shingle set, so texts of one part with equal sets share it; ``body_key`` a hash of the body, by which it is found
    again; ``signature`` has two bytes per value, ``s0`` and ``s1`` two bits of the first 60."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str | None, int] = {}
        for batch in bounded(batches, "body", 1 << 20):
            table = pa.table(batch)
            texts, parts = table["body"].to_pylist(), table["part"].to_pylist()
            hashes, bounds, words = distinct_sets(texts, spec.shingle)
            salt = np.array([seeds.get(p) or seeds.setdefault(p, name_hash(p)) for p in parts], np.uint64)
            prefix = np.zeros((2, len(hashes) + 1), np.uint64)
            np.cumsum(mix(hashes), out=prefix[0, 1:])
            np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=prefix[1, 1:])
            sums = prefix[:, bounds[1:]] - prefix[:, bounds[:-1]]
            node = mix(mix(sums[0] ^ salt) + sums[1])
            minima = one_permutation(hashes, bounds, spec.bins, 1)
            values = (minima & np.uint64(0xFFFF)).astype(">u2")
            half = SKETCHED // 2
            bits = np.zeros((len(texts), SKETCHED), np.uint64)
            used = min(SKETCHED, spec.bins)
            bits[:, :used] = minima[:, :used] >> np.uint64(20) & np.uint64(3)
            shifts = np.arange(half, dtype=np.uint64) * np.uint64(2)
            sketch = [(bits[:, h : h + half] << shifts).sum(axis=1, dtype=np.uint64).view(np.int64) for h in (0, half)]
            out = pa.table({"id": table["id"], "part": table["part"], "node": pa.array(node.view(np.int64)), "body_key": table["body_key"], "signature": pa.array([v.tobytes() for v in values], pa.binary()), "s0": pa.array(sketch[0]), "s1": pa.array(sketch[1])})
            keep = pa.array((words >= spec.min_words) & (np.diff(bounds) > 0))
            yield from out.filter(keep).combine_chunks().to_batches()

    keyed = rows.select("id", "part", "body", F.xxhash64("body").alias("body_key"))
    return keyed.mapInArrow(sign, "id string, part string, node bigint, body_key bigint, signature binary, s0 bigint, s1 bigint")


def estimate(x: tuple[Column, Column], y: tuple[Column, Column]) -> Column:
    """The similarity that two sketches show: a quarter of the values of unlike sets agree in two bits."""
    apart = F.lit(0)
    for a, b in zip(x, y):
        differ = a.bitwiseXOR(b)
        apart = apart + F.bit_count(differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(0x0555555555555555)))
    return (1 - apart / SKETCHED - 0.25) / 0.75


def cells_of(classes: DataFrame, spec: NearDuplicateSpec) -> DataFrame:
    """``node, s0, s1, key``: the buckets of each class."""
    bands = classes.select("node", "s0", "s1", "part", "signature", F.explode(F.sequence(F.lit(0), F.lit(spec.bins // spec.rows - 1))).alias("band"))
    values = F.substring("signature", F.col("band") * (2 * spec.rows) + 1, F.lit(2 * spec.rows))
    return bands.select("node", "s0", "s1", F.xxhash64("part", "band", values).alias("key"))


def _finer(cells: DataFrame, classes: DataFrame, spec: NearDuplicateSpec, turn: int) -> DataFrame:
    """The cells in buckets split by one more signature value, the same one for a whole bucket."""
    at = F.pmod(F.col("key") + turn, F.lit(spec.bins)) * 2 + 1
    value = F.substring("signature", at.cast("int"), F.lit(2))
    return cells.join(classes.select("node", "signature"), "node").select("node", "s0", "s1", F.xxhash64("key", value).alias("key"))


def star_edges(cells: DataFrame, classes: DataFrame, spec: NearDuplicateSpec) -> tuple[DataFrame, DataFrame]:
    """``key, centre, n`` of the buckets with several classes, and ``node, s0, s1, key, centre, estimate``: each class of such a bucket but
    the centre itself, with its estimated similarity to the centre."""
    # node XOR key orders each bucket differently, so that no class is the centre everywhere.
    stars = cells.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("centre"), F.count("*").alias("n")).filter("n > 1")
    stars = stars.withColumn("centre", F.col("centre").bitwiseXOR(F.col("key")))
    stars = settle(stars.join(classes.select(F.col("node").alias("centre"), F.col("s0").alias("c0"), F.col("s1").alias("c1")), "centre"), "stars")
    joined = join_skewed(cells, stars.drop("n"), "key", hot=stars.filter(F.col("n") > spec.hot_rows), hot_rows=spec.hot_rows).filter("centre <> node")
    close = estimate((F.col("s0"), F.col("s1")), (F.col("c0"), F.col("c1")))
    return stars, settle(joined.select("node", "s0", "s1", "key", "centre", close.alias("estimate")), "star_edges")


def _with_both(pairs: DataFrame, values: DataFrame, spec: NearDuplicateSpec) -> DataFrame:
    """``a, b, x, y``: settled pairs with the value (second column of ``values``) of either class. A centre with very many edges is spread."""
    left, right = values.toDF("a", "x"), values.toDF("b", "y")
    if rows_within(pairs, spec.hot_rows):  # no key can be hot
        return pairs.join(left, "a").join(right, "b")
    hot = {c: pairs.groupBy(c).agg(F.count("*").alias("n")).filter(F.col("n") > spec.hot_rows) for c in "ab"}
    return join_skewed(join_skewed(pairs, left, "a", hot=hot["a"]), right, "b", hot=hot["b"])


def jaccards(x: list[str], y: list[str], k: int) -> np.ndarray:
    """The exact similarity of the shingle sets of each two texts."""
    n = len(x)
    hashes, bounds, _ = distinct_sets([*x, *y], k)
    sizes = np.diff(bounds)
    owner = np.repeat(np.concatenate([np.arange(n), np.arange(n)]), sizes)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    twice = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    common = np.bincount(o[1:][twice], minlength=n)
    return common / np.maximum(1, sizes[:n] + sizes[n:] - common)


def verified(pairs: DataFrame, bodies: DataFrame, spec: NearDuplicateSpec) -> DataFrame:
    """Those of the pairs ``a, b`` whose exact sets reach the threshold, with ``similarity``; ``bodies``: node, body."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "x", 1 << 20):
            if batch.num_rows:
                similarity = jaccards(batch.column("x").to_pylist(), batch.column("y").to_pylist(), spec.shingle)
                out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similarity)], ["a", "b", "similarity"])
                yield out.filter(pa.array(similarity >= spec.threshold - 1e-12))

    return _with_both(pairs, bodies.select("node", "body"), spec).mapInArrow(compare, "a bigint, b bigint, similarity double")


@dataclass
class NearDuplicates:
    """``members``: id, part, node (one row per id and class). ``groups``: node, component of the classes with a similar
    other class. ``links``: a, b, similarity of verified star edges, which span the groups. ``bodies``: node, body of all classes that
    had a likely partner, those of the groups among them."""

    members: DataFrame
    groups: DataFrame
    links: DataFrame
    classes: DataFrame
    bodies: DataFrame
    spec: NearDuplicateSpec

    def pairs(self) -> DataFrame:
        """All similar pairs ``a, b, similarity`` of classes of one group."""
        return _pairs_within(self)


def _bodies(rows: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    keys = settle(classes.join(nodes, "node", "left_semi").select("node", "body_key"), "body_keys")
    source = rows.filter(F.col("body").isNotNull()).select(F.xxhash64("body").alias("body_key"), "body")
    # Keys are 16 bytes each: this many are broadcast so that the texts are not shuffled.
    found = join_small(source, keys, ["body_key"], max_rows=300_000, max_bytes=12 << 20, salts=1)
    return found.groupBy("node").agg(F.min("body").alias("body"))


def near_duplicates(rows: DataFrame, spec: NearDuplicateSpec) -> NearDuplicates:
    """Similar texts among ``id, part, body`` rows; only texts of one ``part`` (null is a part of its own) are compared.
    Rows given twice count once; an id with several texts is in several classes. Null and short texts take no part.
    An empty table gives empty results. Similar classes end up in one group through verified star edges.
    """
    signed = settle(signatures(rows, spec), "signatures")
    members = signed.select("id", "part", "node").distinct()
    classes = settle(signed.groupBy("node").agg(*(F.min(c).alias(c) for c in ("part", "signature", "body_key", "s0", "s1"))), "classes")
    # The first cells are cheaper to derive again than to write and read.
    cells, likely = cells_of(classes, spec), None
    pair = (F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    for turn in range(spec.rounds + 1):
        stars, edges = star_edges(cells, classes, spec)
        found = edges.filter(F.col("estimate") >= spec.least_estimate).select(*pair)
        likely = found if likely is None else likely.unionByName(found)
        if turn == spec.rounds:
            break
        # Buckets in which a class is not similar to the centre may hide pairs of the others.
        failed = edges.filter(F.col("estimate") < spec.threshold).select("key").distinct()
        busy = settle(failed.join(stars.filter("n > 2"), "key"), "busy")
        if rows_within(busy, 0):
            break
        crowd = join_skewed(edges.select("node", "s0", "s1", "key"), busy.select("key", "n"), "key", hot=busy.filter(F.col("n") > spec.hot_rows))
        crowd = settle(crowd.unionByName(busy.select(F.col("centre").alias("node"), F.col("c0").alias("s0"), F.col("c1").alias("s1"), "key", "n")), "crowd")
        few = crowd.filter(F.col("n") <= spec.small_bucket)
        a, b = (few.select("key", F.col("node").alias(c), F.col("s0").alias(f"{c}0"), F.col("s1").alias(f"{c}1")) for c in "ab")
        near = estimate((F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1"))) >= spec.least_estimate
        likely = likely.unionByName(a.join(b, "key").filter("a < b").filter(near).select("a", "b"))
        cells = settle(_finer(crowd.filter(F.col("n") > spec.small_bucket), classes, spec, turn), "cells")
    likely = settle(likely.distinct(), "likely")
    bodies = settle(_bodies(rows, classes, likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "bodies")
    links = settle(verified(likely, bodies, spec), "verified")
    groups = settle(components(links, "a", "b"), "groups")
    return NearDuplicates(members, groups, links, classes, bodies, spec)


def _pairs_within(found: NearDuplicates) -> DataFrame:
    spec, groups = found.spec, found.groups
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    large = settle(sizes.filter(F.col("n") > spec.small_group).select("component"), "large_groups")
    few = groups.join(sizes.filter(F.col("n") <= spec.small_group).select("component"), "component")
    left, right = few.select("component", F.col("node").alias("a")), few.select("component", F.col("node").alias("b"))
    pairs = left.join(right, "component").filter("a < b").select("a", "b")
    bodies = found.bodies
    if not rows_within(large, 0):
        many = groups.join(large, "component")
        pairs = pairs.unionByName(_prefix_pairs(many.join(bodies, "node"), spec))
    x, y = (found.classes.select(F.col("node").alias(c), F.struct("s0", "s1").alias(f"{c}s")) for c in "ab")
    near = estimate(*((F.col(f"{c}s.s0"), F.col(f"{c}s.s1")) for c in "ab")) >= spec.least_estimate
    likely = settle(pairs.join(x, "a").join(y, "b").filter(near).select("a", "b"), "likely_within")
    return verified(likely, bodies, spec)


def _prefix_pairs(rows: DataFrame, spec: NearDuplicateSpec) -> DataFrame:
    """The pairs ``a < b`` of one component that can reach the threshold, from ``component, node, body``: of two sets with similarity t,
    each a list in one order, the first |x| - ceil(t |x|) + 1 members have one in common. The order is from the rarest in
    the component on, so few texts share those."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body", 1 << 20):
            hashes, bounds, _ = distinct_sets(batch.column("body").to_pylist(), spec.shingle)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))
            sizes = pa.array(np.repeat(np.diff(bounds), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([batch.column("component").take(owner), batch.column("node").take(owner), pa.array(hashes.view(np.int64)), sizes], ["component", "node", "token", "size"])

    tokens = settle(rows.select("component", "node", "body").mapInArrow(sets, "component bigint, node bigint, token bigint, size bigint"), "tokens")
    tokens = tokens.withColumn("key", F.xxhash64("component", "token"))
    counts = tokens.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # A run that no other text of the component has leads each list; it makes no pair.
    shared = join_skewed(tokens, counts, "key", hot_rows=spec.hot_rows).select("node", "key", "size", "n")
    lists = shared.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("list"))
    alone = F.col("size") - F.size("list")
    prefix = F.col("size") - F.ceil(F.col("size") * spec.threshold - 1e-9) + 1 - alone
    keys = settle(lists.filter(prefix > 0).select("node", "size", F.explode(F.transform(F.slice("list", F.lit(1), F.least(F.size("list"), prefix).cast("int")), lambda x: x["key"])).alias("key")), "prefixes")
    a, b = keys.select("key", F.col("node").alias("a"), F.col("size").alias("p")), keys.select("key", F.col("node").alias("b"), F.col("size").alias("q"))
    near = (F.col("p") >= F.col("q") * spec.threshold) & (F.col("q") >= F.col("p") * spec.threshold)
    return join_skewed(a, b, "key", hot_rows=spec.hot_rows).filter("a < b").filter(near).select("a", "b").distinct()


def similar_ids(found: NearDuplicates) -> DataFrame:
    """All pairs ``id_a < id_b`` of distinct ids with similar or equal texts."""
    ids = found.members.select("id", "node")
    equal = ids.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    pairs = found.pairs().select("a", "b").unionByName(equal)
    both = pairs.join(ids.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    ordered = both.filter("x <> y and (a <> b or x < y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return ordered.distinct()


def labelled_members(found: NearDuplicates) -> DataFrame:
    """One row per id and class: ``id, part, class_id`` and ``group_id``, the class's own id if nothing is similar."""
    out = found.members.join(found.groups, "node", "left")
    return out.select("id", "part", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("group_id"))


#: Openings of the header lines that are no rules text.
HEADER_LINES = ("#", "**Unit:**", "**Faction:**", "**Category:**", "**Source:**")


def rules_body(text: Column) -> Column:
    def is_header(line: Column) -> Column:
        test = F.lit(False)
        for opening in HEADER_LINES:
            test = test | line.startswith(opening)
        return test

    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~is_header(line)), "\n")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as ``id, part, body``: the edition trimmed and lower-cased, 10e where absent."""
    edition = F.lower(F.regexp_replace(F.try_element_at("meta", F.lit("edition")), r"(?U)^\s+|\s+$", ""))
    return chunks.filter(F.col("chunk_id").isNotNull()).select(F.col("chunk_id").alias("id"), F.coalesce(edition, F.lit("10e")).alias("part"), rules_body(F.col("text")).alias("body"))
