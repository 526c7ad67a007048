"""Scores for abusive, hateful or sexual language, by non-negative positive-unlabelled learning.

Documents are scored by their worst passage. The classifier is linear over hashed words, word pairs and letter triples of a passage, after
undoing common disguises. It is fitted in numpy on documents that raters agree to be toxic (positive) and on a bounded
sample of the rest (unlabelled, so with some toxic ones among it); its boundary comes from all documents' scores: the risk of the unlabelled is corrected by the share of
positives among them, and kept from going below zero. Which passages of a toxic document are the toxic ones is not
labelled either; it is settled by alternating between choosing passages and fitting.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrow import bounded
from scriptorium.functions.wordhash import code_points, mix, run_hashes
from scriptorium.llm.mixing import normal_source
from scriptorium.session import settle


@dataclass(frozen=True)
class ToxicitySpec:
    """``max_positive`` and ``max_unlabelled`` bound the documents fitted on (those with the least hash of their id);
    ``hash_bits`` the weights. A document whose score reaches ``threshold`` is toxic."""

    max_positive: int = 1500
    max_unlabelled: int = 4000
    hash_bits: int = 18
    rounds: int = 5
    steps: int = 30
    decay: float = 2e-5
    threshold: float = 0.5
    seed: int = 5


# Digits and signs that stand for letters inside words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"}
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_GAPS, _ENDS = " .-_*·", ".!?…;"
# Bits of the table of characters. Word characters are letters (ALPHA or not: also such as ²), and digits.
_ALPHA, _WORD, _LETTER, _GAP, _SIGN, _MARK, _END, _SPACE = (1 << i for i in range(8))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kinds of each code point, as bits. From 0x40000 on there are no letters, digits, blanks or combining marks."""
    table = np.zeros(0x110000, np.uint8)
    chars = [chr(i) for i in range(0x40000)]
    for bit, test in ((_ALPHA, str.isalpha), (_WORD, str.isalnum), (_SPACE, str.isspace)):
        table[: len(chars)][np.fromiter(map(test, chars), bool, len(chars))] |= bit
    words = np.flatnonzero(table & _WORD)
    table[words[np.fromiter((not chars[i].isdecimal() for i in words), bool, len(words))]] |= _LETTER
    table[: len(chars)][np.fromiter(map(unicodedata.combining, chars), np.int64, len(chars)) > 0] |= _MARK
    for bit, signs in ((_GAP, _GAPS), (_SIGN, "".join(LEET)), (_END, _ENDS)):
        table[[ord(c) for c in signs]] |= bit
    return table


def plain_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the undisguised texts, joined by line ends, and their kinds; text i begins at the i-th offset.
    Line ends belong to no disguise, so all texts are searched at once; only places that may be changed are looked at one by one."""
    folded = []
    for t in texts:
        t = (t or "").lower()
        folded.append(t if t.isascii() else unicodedata.normalize("NFKD", _HIDDEN.sub("", t)))
    points = code_points("\n".join(folded)).copy()
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in folded), np.int64, len(folded)))])
    kinds = _kinds()[points]

    def drop(places: np.ndarray) -> None:
        nonlocal points, kinds, offsets
        if len(places):
            keep = np.ones(len(points), bool)
            keep[places] = False
            points, kinds, offsets = points[keep], kinds[keep], offsets - np.searchsorted(places, offsets)

    drop(np.flatnonzero((kinds & _MARK) != 0))
    # Letters without a word character beside them; three or more with one or two gaps between each are one word.
    word = np.zeros(len(kinds) + 2, bool)
    word[1:-1] = kinds & _WORD
    alone = np.flatnonzero(((kinds & _LETTER) != 0) & ~(word[:-2] | word[2:]))
    step = np.diff(alone)
    gap = (kinds & _GAP) != 0
    linked = np.zeros(len(step) + 2, bool)
    linked[1:-1] = (step == 2) | (step == 3)
    near = np.flatnonzero(linked[1:-1])
    linked[near + 1] = gap[alone[near] + 1] & gap[alone[near + 1] - 1]
    joins = np.flatnonzero(linked[1:-1] & (linked[:-2] | linked[2:]))
    drop(np.union1d(alone[joins] + 1, alone[joins + 1] - 1))
    # Signs between letters, and @ or $ that begin a word of letters.
    signs = np.flatnonzero((kinds & _SIGN) != 0)
    if len(signs):
        around = np.zeros(len(kinds) + 3, np.uint8)
        around[1:-2] = kinds
        opens = np.concatenate([[True], np.diff(signs) != 1])
        closes = np.concatenate([opens[1:], [True]])
        within = (around[signs[opens]] & around[signs[closes] + 2] & _LETTER) != 0
        swap = within[np.cumsum(opens) - 1]
        first = ((points[signs] == 64) | (points[signs] == 36)) & (around[signs] & _WORD == 0) & (around[signs + 2] & around[signs + 3] & _LETTER != 0)
        swap = signs[swap | first]
        letters = points[swap]
        for sign, letter in LEET.items():
            letters[points[swap] == ord(sign)] = ord(letter)
        points[swap], kinds[swap] = letters, _kinds()[letters]
    return points, kinds, offsets


def _string(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def undisguise(text: str | None) -> str:
    """Lower-case text without accents and hidden characters; letters set apart are joined, signs that stand for letters are
    replaced inside words. Masked letters (``*``) stay."""
    return _string(plain_points([text])[0])


class Passages:
    """The features of many texts' passages: ``ids`` flat, passage p has ``ids[bounds[p]:bounds[p + 1]]``, text i has the
    passages ``texts[i]:texts[i + 1]``."""

    def __init__(self, texts: list[str | None], bits: int) -> None:
        points, kinds, offsets = plain_points(texts)
        letter = np.zeros(len(points) + 2, bool)
        letter[1:-1] = kinds & _ALPHA
        # A mask counts as part of a word if letters stand on its left.
        inner = letter.copy()
        stars = np.flatnonzero(points == 42) + 1
        for _ in range(8):
            inner[stars] |= inner[stars - 1]
        turns = np.diff(inner.astype(np.int8))
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        mixed = mix(points.astype(np.uint64) + np.uint64(0x77))
        words = run_hashes(mixed, starts, ends)
        cuts = np.flatnonzero(((kinds[:-1] & _END) != 0) & ((kinds[1:] & _SPACE) != 0) | (points[:-1] == 10))
        line = np.searchsorted(cuts, starts)  # passage number, with gaps
        line_first = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
        passage = np.cumsum(line_first) - 1
        n = int(passage[-1]) + 1 if len(passage) else 0
        owner = np.searchsorted(offsets, starts[line_first], side="right") - 1
        self.texts = np.searchsorted(owner, np.arange(len(texts) + 1))
        before = np.concatenate([[np.uint64(1)], words[:-1]]) if len(words) else words
        before = np.where(line_first, np.uint64(1), before)
        pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + words)
        # Triples of the letters of each word with its two ends.
        left, right = np.zeros_like(mixed), np.zeros_like(mixed)
        left[1:], right[:-1] = mixed[:-1], mixed[1:]
        left[starts], right[ends - 1] = 3, 5
        left *= np.uint64(31)
        left += mixed * np.uint64(7)
        right *= np.uint64(17)
        left += right
        triples = mix(left)[inner[1:-1]]
        letters = np.concatenate([[0], np.cumsum(ends - starts)])
        # A masked word is known by its first and last letter. Bold marks end a word, masks lie within.
        masked = np.zeros(len(words), bool)
        masked[np.searchsorted(starts, stars[inner[stars]] - 1, side="right") - 1] = True
        flags = np.flatnonzero(masked & letter[1:-1][np.maximum(ends, 1) - 1]) if len(words) else np.zeros(0, np.int64)
        masks = mix(mixed[starts[flags]] * np.uint64(13) + mixed[ends[flags] - 1])
        shift = np.uint64(64 - bits)
        grid = np.arange(n + 1)
        word_bounds, mask_bounds = (np.searchsorted(w, grid) for w in (passage, passage[flags]))
        triple_bounds = letters[word_bounds]
        #: (feature ids in order of passages, bounds per passage)
        self.blocks = [
            ((words >> shift).astype(np.int32), word_bounds),
            ((pairs >> shift).astype(np.int32), word_bounds),
            ((triples >> shift).astype(np.int32), triple_bounds),
            ((masks >> shift).astype(np.int32), mask_bounds),
            (np.full(len(flags), 1, np.int32), mask_bounds),
        ]
        self.count = n
        self.scale = 1 / np.sqrt(sum(np.diff(b) for _, b in self.blocks) + 8.0)
        self.spans = (starts[line_first], ends[np.concatenate([line_first[1:], [True]])]) if n else (starts, ends)
        self.points = points

    def text_of(self) -> np.ndarray:
        """The text's number of each passage."""
        return np.repeat(np.arange(len(self.texts) - 1), np.diff(self.texts))

    def select(self, chosen: np.ndarray) -> Passages:
        """Only the chosen passages, for fitting."""
        part = object.__new__(Passages)
        part.count, part.scale, part.blocks = len(chosen), self.scale[chosen], []
        for ids, bounds in self.blocks:
            sizes = np.diff(bounds)[chosen]
            total = np.concatenate([[0], np.cumsum(sizes)])
            part.blocks.append((ids[np.repeat(bounds[chosen] - total[:-1], sizes) + np.arange(total[-1])], total))
        return part

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per passage the sum of ``values`` over its features."""
        out = np.zeros(self.count)
        for ids, bounds in self.blocks:
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                out[full] += np.add.reduceat(values[ids], bounds[full])
        return out

    def spread(self, per_passage: np.ndarray, size: int) -> np.ndarray:
        """Per feature the sum of ``per_passage`` over its occurrences."""
        out = np.zeros(size)
        for ids, bounds in self.blocks:
            out += np.bincount(ids, np.repeat(per_passage, np.diff(bounds)), size)
        return out

    def spread_texts(self, size: int) -> np.ndarray:
        """Per feature the number of texts that have it."""
        owner = self.text_of()
        keys = np.unique(np.concatenate([np.repeat(owner, np.diff(b)) * size + i.astype(np.int64) for i, b in self.blocks]))
        return np.bincount(keys % size, minlength=size)

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return self.sums(weights) * self.scale + bias

    def string(self, p: int) -> str:
        return _string(self.points[self.spans[0][p] : self.spans[1][p]])

    def worst(self, margins: np.ndarray) -> np.ndarray:
        """The largest margin of each text's passages, minus infinity for a text without any."""
        out = np.full(len(self.texts) - 1, -np.inf)
        full = np.flatnonzero(np.diff(self.texts))
        if len(full):
            out[full] = np.maximum.reduceat(margins, self.texts[full])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: The margins' histogram, the same for every table: a count of wordless texts, then bins of 0.1; the outer two hold what lies beyond.
_LOW, _STEP, _BINS = -20.0, 0.1, 400
_CENTRES = _LOW + _STEP * (np.arange(_BINS) + 0.5)


def histogram(margins: np.ndarray) -> np.ndarray:
    place = np.floor((np.where(np.isfinite(margins), margins, 0.0) - _LOW) / _STEP).clip(0, _BINS - 1).astype(np.int64) + 1
    return np.bincount(np.where(np.isfinite(margins), place, 0), minlength=_BINS + 1)


def valley(positive: np.ndarray, unlabelled: np.ndarray, share: float, width: float = 0.4) -> float:
    """Where, between the middle of the unlabelled and that of the positive documents, both together become nearly as rare as
    they get: the first place with at most 2.5 times the least density, as disguised toxic texts trail towards the others. 0
    if the two do not lie apart. Both are histograms and are normalised, the positive one then to ``share``; how many of either there
    are does not count."""
    p, u = positive[1:], unlabelled[1:]
    if not p.sum() or not u.sum():
        return 0.0
    p, u = p / p.sum(), u / u.sum()
    low, high = (_CENTRES[np.searchsorted(np.cumsum(x), 0.5 - 1e-9)] for x in (u, p))
    if not low < high:
        return 0.0
    grid = np.linspace(low, high, 101)
    density = np.exp(-0.5 * ((_CENTRES - grid[:, None]) / width) ** 2) @ (share * p + u)
    return float(grid[np.flatnonzero(density <= 2.5 * density.min() + 1e-9)[0]])


#: The histograms of the toxic and of the other documents' margins under a model.
Census = Callable[["ToxicityModel"], tuple[np.ndarray, np.ndarray]]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    spec: ToxicitySpec

    @staticmethod
    def fit(positive: list[str], unlabelled: list[str], prior: float, spec: ToxicitySpec, census: Census | None = None) -> ToxicityModel:
        """``prior``: the most that the share of toxic documents among the unlabelled ones may be. ``census`` gives the
        histograms of the whole table, from which the last prior and the boundary come; without it they come from the texts."""
        p, u = Passages(positive, spec.hash_bits), Passages(unlabelled, spec.hash_bits)
        size = 1 << spec.hash_bits
        model = ToxicityModel(np.zeros(size), -10.0, spec)
        if not p.count or not u.count:
            return model
        # A feature of a single toxic document, such as a name, cannot be told from chance.
        shared = p.spread_texts(size) >= min(2, len(positive))
        # First choice of passages: features much more frequent in toxic documents than elsewhere.
        freq_p, freq_u = p.spread(np.ones(p.count), size) / p.count, u.spread(np.ones(u.count), size) / u.count
        ratio = np.where(shared, np.log((freq_p + 0.5 / p.count) / (freq_u + 0.5 / p.count)), 0.0)
        scores = p.sums(ratio) * p.scale**2
        verdicts, prior = prior, prior / 2
        for round_no in range(spec.rounds):
            last = round_no == spec.rounds - 1
            chosen = model._choose(p, scores, first=round_no == 0)
            # Toxic passages among the unlabelled ones, if their toxic documents are like the positive ones.
            share = min(0.5, prior * (len(chosen) / max(1, len(positive))) * len(unlabelled) / u.count)
            model = model._descend(p.select(chosen), u, share, shared, spec.steps * (1 + 2 * last))
            scores, others = p.margins(model.weights, model.bias), u.worst(u.margins(model.weights, model.bias))
            if census and round_no >= spec.rounds - 2:
                counts = census(model)
            else:
                counts = histogram(p.worst(scores)), histogram(others)
            # The estimated share moves the bias; the boundary is put where documents are rarest. The positive ones weigh as
            # the least prior: by the estimated one, a boundary too low would raise the prior, which would lower it again.
            shift = valley(*counts, verdicts / 5)
            # It stays below 0, so that a passage of unknown words alone is not toxic.
            shift = max(shift, model.bias + 0.1)
            model.bias -= shift
            scores = scores - shift
            # Raters judge a chosen sample, so the share of toxic verdicts is only a bound of the share among the rest.
            prior = min(verdicts, max(verdicts / 5, float(counts[1][1:][_CENTRES > shift].sum() / counts[1].sum())))
        return model

    def _choose(self, p: Passages, scores: np.ndarray, first: bool) -> np.ndarray:
        """The worst passage of each positive document, and others that are clearly toxic."""
        full = np.flatnonzero(np.diff(p.texts))
        best = np.array([p.texts[i] + scores[p.texts[i] : p.texts[i + 1]].argmax() for i in full])
        if first:
            return best
        # Documents without any passage near the boundary are taken for wrong labels.
        near = best[scores[best] > 0]
        return np.union1d(near if len(near) else best, np.flatnonzero(scores > 0.5))

    def _descend(self, p: Passages, u: Passages, share: float, allowed: np.ndarray, steps: int) -> ToxicityModel:
        """Minimise share * E_p[loss(+)] + max(0, E_u[loss(-)] - share * E_p[loss(-)]) with the logistic loss, by Adam."""
        size = len(self.weights)
        w, b = np.zeros(size), -2.0
        m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
        lift = 0.3 / max(share, 1e-6)  # the scale of the loss does not matter; this keeps its parts comparable
        for step in range(1, steps + 1):
            zp, zu = p.margins(w, b), u.margins(w, b)
            sp, su = _sigmoid(zp), _sigmoid(zu)
            negative = np.logaddexp(0, zu).mean() - share * np.logaddexp(0, zp).mean()
            gp, gu = share * (sp - 1) / p.count, su / u.count
            if negative > 0:
                gp -= share * sp / p.count
            else:  # climb back slowly, as the non-negative estimator does
                gp, gu = gp + 0.1 * share * sp / p.count, -0.1 * gu
            gp, gu = gp * lift, gu * lift
            g = (p.spread(gp * p.scale, size) + u.spread(gu * u.scale, size)) * allowed + self.spec.decay * w
            gb = gp.sum() + gu.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            b -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-7)
        return ToxicityModel(w, float(b), self.spec)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        passages = Passages(texts, self.spec.hash_bits)
        worst = passages.worst(passages.margins(self.weights, self.bias))
        return np.where(np.isfinite(worst), _sigmoid(worst), 0.0)


def verdicts(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` by majority of the raters' non-null verdicts; ties give null."""
    votes = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("mean"))
    return votes.select("doc_id", F.when(F.col("mean") > 0.5, 1).when(F.col("mean") < 0.5, 0).alias("toxic"))


def _least(rows: DataFrame, bound: int, seed: int) -> list[str]:
    """The texts of ``bound`` documents with the least hash, in that order."""
    return [r[0] for r in rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(bound).select("text").collect()]


def fit_model(documents: DataFrame, labels: DataFrame, spec: ToxicitySpec, census: Census | None = None) -> ToxicityModel:
    """Fit on documents that raters find toxic and on a sample of the others. The class prior is the share of toxic
    verdicts among the judged documents, or less if ``census`` finds less."""
    judged = verdicts(labels)
    toxic, count = judged.agg(F.sum("toxic"), F.count("toxic")).first()
    prior = (toxic or 0) / count if count else 0.0
    rows = documents.filter("text is not null").select("doc_id", "text")
    positive = _least(rows.join(judged.filter("toxic = 1"), "doc_id", "left_semi"), spec.max_positive, spec.seed)
    ids = documents.filter("text is not null").select("doc_id").join(judged.filter("toxic = 1"), "doc_id", "left_anti")
    chosen = ids.orderBy(F.xxhash64(F.lit(spec.seed), "doc_id"), "doc_id").limit(spec.max_unlabelled)
    unlabelled = [r[0] for r in rows.join(F.broadcast(chosen), "doc_id", "left_semi").orderBy("doc_id").select("text").collect()]
    return ToxicityModel.fit(positive, unlabelled, prior, spec, census)


def raw_margins(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, source, margin`` of every document by its worst passage, before the bias; null for wordless texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 18):
            passages = Passages(batch.column("text").to_pylist(), shared.value.spec.hash_bits)
            worst = passages.worst(passages.margins(shared.value.weights, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(worst, mask=~np.isfinite(worst))], ["doc_id", "source", "margin"])

    return documents.select("doc_id", "source", "text").mapInArrow(score, "doc_id bigint, source string, margin double")


def table_histograms(margins: DataFrame, labels: DataFrame, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The histograms of all documents that raters find toxic, and of all others; at most some hundred rows reach the driver."""
    toxic = verdicts(labels).filter("toxic = 1").select("doc_id", F.lit(1).alias("toxic"))
    place = F.least(F.greatest(F.floor((F.col("margin") + F.lit(bias - _LOW)) / _STEP), F.lit(0)), F.lit(_BINS - 1)) + 1
    rows = margins.join(toxic, "doc_id", "left").groupBy(F.coalesce("toxic", F.lit(0)).alias("toxic"), F.when(F.col("margin").isNull(), 0).otherwise(place).alias("place")).count()
    out = np.zeros((2, _BINS + 1), np.int64)
    for r in rows.collect():
        out[r["toxic"], r["place"]] = r["count"]
    return out[1], out[0]


def score_documents(documents: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec()) -> DataFrame:
    """``doc_id, source, score, toxic`` of every document, from its whole text. Null and wordless texts score 0. Without any
    confirmed toxic document every score is about 0. All documents are scored before the last fit, for the prior, and
    after it, for the boundary; the margins of the second time are written, so the result needs no third."""
    written: list[DataFrame] = []

    def census(model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
        written[:] = [settle(raw_margins(documents, model), "margins")]
        return table_histograms(written[0], labels, model.bias)

    model = fit_model(documents, labels, spec, census)
    margins = written[0] if written else raw_margins(documents, model)
    z = F.least(F.greatest(F.col("margin") + F.lit(float(model.bias)), F.lit(-40.0)), F.lit(40.0))
    scored = margins.select("doc_id", "source", F.coalesce(1 / (1 + F.exp(-z)), F.lit(0.0)).alias("score"))
    return scored.withColumn("toxic", F.col("score") >= spec.threshold)


def rates_by_source(scored: DataFrame, source: Column | None = None) -> DataFrame:
    """``source, documents, toxic_documents, rate``; sources compared trimmed and lower-cased, null is a group of its own."""
    named = scored.select(normal_source(F.col("source") if source is None else source).alias("source"), F.col("toxic").cast("int").alias("t"))
    out = named.groupBy("source").agg(F.count("*").alias("documents"), F.sum("t").cast("bigint").alias("toxic_documents"))
    return out.withColumn("rate", F.col("toxic_documents") / F.col("documents"))
