"""Which of a few languages a short text is in, from word rates of the whole corpus.

Texts that hold enough function words of one language count their words for it. The counts live in a table of fixed size,
indexed by word hash, so it can be summed over any number of messages and sent to the executors whatever the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from scriptorium.functions.wordhash import Words, code_points, words_of

BUCKETS = 1 << 17

#: Frequent function words of each language. Words that are common in another of the languages are left out.
FUNCTION_WORDS = {
    "en": "the and is are to with which may when if for from by has how does what their it its that this not before after would".split(),
    "de": "der das und ist nicht den dem bei wie ein eine einen zu auf sind wenn ich wird werden im auch oder nur haben näher".split(),
    "es": "el los las del y por para con una se cuando como cómo sin está qué durante más pero esta este sus cuánto".split(),
    "fr": "le et une du au aux qui ne pas pour sur dans quand vous pendant mais avec cette sont leur ou où combien".split(),
}
LANGUAGES = list(FUNCTION_WORDS)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % BUCKETS


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a capital, and whether a digit."""
    points = [chr(i) for i in range(0x110000)]
    return np.fromiter((c.isupper() for c in points), bool, len(points)), np.fromiter((c.isdigit() for c in points), bool, len(points))


@dataclass
class CasedWords:
    """Words of several texts with their buckets; ``capital`` and ``digit`` tell of a word's first character, ``first`` whether it
    opens its text. ``plain`` words are no numbers and no names: capitalised words, mostly names, count only where they open
    a text or where most words are in capitals."""

    words: Words
    owner: np.ndarray
    bucket: np.ndarray
    capital: np.ndarray
    digit: np.ndarray
    first: np.ndarray
    plain: np.ndarray


def cased_words(texts: list[str | None]) -> CasedWords:
    words = words_of(texts)
    owner = words.text_of()
    # A few characters change their number when lower-cased; such a text is taken without its case.
    kept = ((t, t.lower()) for t in (t or "" for t in texts))
    points = code_points("\n".join(t if len(t) == len(low) else low for t, low in kept))
    upper, digits = _kinds()
    starts, last = words.starts, words.ends - 1
    capital = upper[points[starts]] if len(starts) else np.zeros(0, bool)
    loud_word = capital & upper[points[last]] & (last > starts) if len(starts) else capital
    digit = digits[points[starts]] if len(starts) else capital
    many = np.bincount(owner, loud_word, len(texts)) * 2 > np.diff(words.bounds)
    first = np.arange(len(starts)) == words.bounds[:-1][owner] if len(starts) else capital
    plain = ~digit & (~capital | first | many[owner]) if len(starts) else capital
    return CasedWords(words, owner, buckets(words.hashes), capital, digit, first, plain)


@lru_cache(maxsize=1)
def _function_table() -> np.ndarray:
    table = np.zeros((BUCKETS, len(LANGUAGES)))
    for k, name in enumerate(LANGUAGES):
        table[buckets(words_of(FUNCTION_WORDS[name]).hashes), k] = 1
    return table


def by_text(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Sums of rows of ``values`` per text."""
    return np.stack([np.bincount(owner, values[:, k], texts) for k in range(values.shape[1])], axis=1)


def language_counts(cased: CasedWords, texts: int) -> np.ndarray:
    """Languages x buckets: plain words of the texts that clearly belong to one language by their function words."""
    marks = by_text(_function_table()[cased.bucket] * cased.plain[:, None], cased.owner, texts)
    ranked = np.sort(marks, axis=1)
    clear = (ranked[:, -1] >= 3) & (ranked[:, -1] >= 2 * ranked[:, -2] + 1)
    language = marks.argmax(axis=1)
    use = cased.plain & clear[cased.owner]
    cells = language[cased.owner[use]] * BUCKETS + cased.bucket[use]
    return np.bincount(cells, minlength=len(LANGUAGES) * BUCKETS).reshape(len(LANGUAGES), BUCKETS)


@dataclass
class LanguageModel:
    """``evidence``: buckets x languages, how far a word speaks against each language, from 0 for the language in which it is most
    frequent to ``-LIMIT``. Rates are smoothed by a share that is the same in all languages, so rare words, and words
    common to languages, say nothing."""

    evidence: np.ndarray
    LIMIT = 4.0

    @staticmethod
    def of(counts: np.ndarray) -> LanguageModel:
        seeded = counts.T + 2 * _function_table()
        totals = seeded.sum(axis=0)
        rates = np.log(seeded / totals + 0.5 / max(500.0, totals.min()))
        return LanguageModel(np.maximum(rates - rates.max(axis=1, keepdims=True), -LanguageModel.LIMIT).astype(np.float32))

    def words(self, cased: CasedWords) -> np.ndarray:
        return self.evidence[cased.bucket] * cased.plain[:, None]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Texts x languages; the language with the greatest score, 0 at most, is the likeliest."""
        cased = cased_words(texts)
        return by_text(self.words(cased), cased.owner, len(texts))


def leader(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest language of each row and its lead over the second."""
    ranked = np.sort(scores, axis=1)
    return scores.argmax(axis=1), ranked[:, -1] - ranked[:, -2]
