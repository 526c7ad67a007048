"""Defective question and reply pairs: a conditional random field tags the clauses of each reply as answer, refusal, echo,
foreign or unfinished; what the tags cover decides the pair's defect.

No pair comes labelled, so the tagger is trained on replies of a bounded sample of conversations, taken as answers unless
all their clauses are worded like refusals, and on copies of them damaged in known ways: cut off, put behind or replaced by
the question, swapped for a reply in another language, replaced by a refusal. Refusals are composed from the openings, cores
and closings listed below. Word rates of the languages, word frequencies of clauses and the ends of list items are counted
over all pairs, in a table of fixed size.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrow import bounded
from scriptorium.functions.wordhash import mix, words_of
from scriptorium.llm.crf import ChainCRF, Sequences
from scriptorium.llm.languages import BUCKETS, LANGUAGES, LanguageModel, buckets, by_text, cased_words, language_counts, leader
from scriptorium.session import settle

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: What stands for no text once punctuation is gone.
SENTINELS = {"", "nan", "none", "null", "na", "nil", "undefined", "nothing", "empty"}

#: Openings, cores and closings of refusals, by language.
REFUSALS = {
    "en": (
        ["", "", "Sorry, ", "I'm sorry, but ", "Unfortunately ", "I apologise, but ", "As an assistant, ", "Thanks for asking. "],
        ["I can't help with that", "I cannot answer this question", "I am unable to answer that", "I won't answer this", "I must decline", "I have to decline this request", "I'd rather not say", "I am not allowed to discuss this", "I'm not permitted to talk about that", "this is outside what I can do", "that is not something I can talk about", "my instructions do not allow me to answer", "no answer can be given here", "my guidelines forbid an answer", "ruling on this is not for me", "I have been told not to give rulings", "this falls outside my task", "you will have to ask someone else", "it is not my place to judge this", "I will pass on this one", "I don't feel able to rule on this"],
        ["", "", "Is there anything else?", "Can I help with another question?", "I hope you understand.", "Please ask the organiser.", "Please try another topic.", "My guidelines do not let me say more."],
    ),
    "de": (
        ["", "Tut mir leid, ", "Leider ", "Entschuldigung, ", "Tut mir leid: "],
        ["dabei kann ich nicht helfen", "das kann ich nicht beantworten", "diese Frage darf ich nicht beantworten", "dazu möchte ich nichts sagen", "darüber darf ich nicht sprechen", "ich muss das ablehnen", "hierzu gebe ich keine Auskunft", "es ist mir nicht erlaubt zu antworten"],
        ["", "", "Gibt es sonst noch etwas?", "Bitte frag die Leitung.", "Ich bitte um Verständnis.", "Frag bitte jemand anderen."],
    ),
    "es": (
        ["", "Lo siento, ", "Por desgracia, ", "Perdona, ", "Lamentablemente, "],
        ["no puedo ayudarte con eso", "no puedo responder a esta pregunta", "prefiero no responder", "no se me permite hablar de esto", "tengo que negarme a contestar", "no me corresponde decidir eso", "mis normas me impiden responder"],
        ["", "", "¿Necesitas algo más?", "Pregunta al organizador.", "Espero que lo entiendas.", "Prueba con otro tema."],
    ),
    "fr": (
        ["", "Désolé, ", "Malheureusement, ", "Pardon, ", "Je regrette, mais "],
        ["je ne peux pas vous aider", "je ne peux pas répondre à cette question", "je préfère ne pas répondre", "il m'est interdit de parler de cela", "je dois refuser de me prononcer", "ce n'est pas à moi d'en juger", "mes consignes m'empêchent de répondre"],
        ["", "", "Puis-je aider autrement ?", "Adresse-toi à l'arbitre.", "J'espère que tu comprends.", "Essaie un autre sujet."],
    ),
}


#: Words by which a clause speaks of its speaker, denies, and names what an adviser does.
SPEAKER = "i my me myself ich mir mich mein meine meiner yo me mi mis conmigo je j m me moi mes mon".split()
DENIAL = "not no cannot can't t won unable never nothing decline refuse outside forbid forbids rather nicht kein keine nichts nie ablehnen weigern verboten untersagt ungern no nunca negarme negar impiden prohibido imposible prefiero ne pas n jamais refuser interdit empêchent impossible préfère".split()
ADVISING = "answer answers help rule ruling rulings judge say saying tell discuss discussing talk assist decide advise comment beantworten antworten antwort auskunft helfen sagen sprechen entscheiden responder respuesta ayudar ayudarte contestar hablar decidir opinar répondre réponse aider parler juger prononcer décider dire".split()


@dataclass(frozen=True)
class ReplySpec:
    """``train_conversations`` bounds the sample that the tagger is fitted on; ``hash_bits`` the features; ``min_foreign``
    is the share of a reply in another language from which it counts as such, ``min_refusal`` the share of refusing among
    refusing and answering text. ``rounds``: fits, each on labels cleaned by the one before. A reply can be foreign only if
    another language leads by ``language_lead`` (natural logarithm) and by ``language_margin`` per known word, with two
    words of its own at least; it can be an echo only if it holds half of the question's word pairs, or most of its words."""

    train_conversations: int = 700
    hash_bits: int = 15
    epochs: int = 4
    rounds: int = 3
    min_refusal: float = 0.4
    min_foreign: float = 0.5
    language_lead: float = 5.0
    language_margin: float = 0.7
    seed: int = 11


_CLAUSE = re.compile(r"[^\n]*?[.!?…](?:[\"'”’»)\]*_]+)?(?=\s)|[^\n]+")
_MARKER = re.compile(r"\s*(?:[-*•–]|\(?\d{1,3}[.)])\s+")
_WHOLE_LINE = re.compile(r"\s*(?:\*\*.*\*\*|#+ .*)\s*")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def clauses(text: str) -> list[str]:
    """Sentences, and lines that are list items, table rows or headings as a whole."""
    out = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        if _MARKER.match(line) or line.lstrip().startswith("|") or _WHOLE_LINE.fullmatch(line):
            out.append(line.strip())
        else:
            out += [c.strip() for c in _CLAUSE.findall(line) if c.strip()]
    return out


def _norm(text: str) -> list[str]:
    return [w.replace("’", "'").lower() for w in _WORDS.findall(text)]


def _unclosed(text: str) -> bool:
    return any(text.count(a) > text.count(b) for a, b in (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("“", "”")))


ENDINGS = "proper cut item citation unclosed row open_row heading bare_marker open_mark symbol".split()
OPEN_ENDS = {"unclosed", "open_row", "bare_marker", "open_mark", "cut"}
_PROPER = re.compile(r"[.!?…][\"'”’»)\]*_]*$")


def ending(clause: str) -> str:
    """The form of a clause's end."""
    if _unclosed(clause):
        return "unclosed"
    if clause.endswith("]"):
        return "citation"
    if clause.startswith("|"):
        return "row" if clause.endswith("|") else "open_row"
    if re.fullmatch(r"\*\*.+\*\*|#+ .+", clause):
        return "heading"
    if _MARKER.match(clause + " ") and not _WORDS.search(_MARKER.sub("", clause + " ", count=1)):
        return "bare_marker"
    if _PROPER.search(clause):
        return "proper"
    if clause[-1] in ",;:(-–—/&":
        return "open_mark"
    if not (clause[-1].isalnum() or clause[-1] in "\"'”’»*)+%°|_"):
        return "symbol"
    if _MARKER.match(clause):
        return "item"
    return "cut"


ITEM_CELLS = 1 << 14


def item_tokens(item: str) -> list[str]:
    """A list item's tokens without its marker; digits are alike, and so are possessives."""
    tokens = re.sub(r"\d", "#", _MARKER.sub("", item, count=1).lower()).split()
    return ["'s" if t.endswith(("'s", "’s")) else t for t in tokens]


def _item_cells(tokens: list[str]) -> np.ndarray:
    values = np.array([hash_name(t) for t in tokens], np.uint64)
    return (values % np.uint64(ITEM_CELLS)).astype(np.int64)


def hash_name(name: str) -> int:
    out = 0xCBF29CE484222325
    for byte in name.encode("utf-8", "surrogatepass"):
        out = (out ^ byte) * 0x100000001B3 % (1 << 64)
    return out ^ (out >> 29)


@dataclass
class CorpusCounts:
    """Counts over all pairs, of fixed size: ``words`` languages x buckets; ``clauses`` of replies that hold a word of each bucket, and
    their ``total``; tokens of list items that another item follows, at their ``ends`` and ``inside`` them."""

    words: np.ndarray
    clauses: np.ndarray
    total: int
    ends: np.ndarray
    inside: np.ndarray

    @staticmethod
    def zeros() -> CorpusCounts:
        return CorpusCounts(np.zeros((len(LANGUAGES), BUCKETS), np.int64), np.zeros(BUCKETS, np.int64), 0, np.zeros(ITEM_CELLS, np.int64), np.zeros(ITEM_CELLS, np.int64))

    def add(self, pairs: list[tuple[str | None, str | None]]) -> CorpusCounts:
        texts = [t for p in pairs for t in p if t]
        self.words += language_counts(cased_words(texts), len(texts))
        parts = [clauses(a) for _, a in pairs if a and not is_empty(a)]
        flat = [c for p in parts for c in p]
        words = words_of(flat)
        cells = np.unique(words.text_of() * BUCKETS + buckets(words.hashes))
        self.clauses += np.bincount(cells % BUCKETS, minlength=BUCKETS)
        self.total += len(flat)
        for p in parts:
            for item, after in zip(p, p[1:]):
                if _MARKER.match(item) and _MARKER.match(after) and (tokens := item_tokens(item)):
                    cells = _item_cells(tokens)
                    self.ends[cells[-1]] += 1
                    np.add.at(self.inside, cells[:-1], 1)
        return self

    def cells(self) -> pa.RecordBatch:
        """The counts other than 0 as ``cell, n``."""
        flat = np.concatenate([self.words.reshape(-1), self.clauses, [self.total], self.ends, self.inside])
        at = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["cell", "n"])

    @staticmethod
    def of(cells: pa.Table) -> CorpusCounts:
        k = len(LANGUAGES) * BUCKETS
        flat = np.zeros(k + BUCKETS + 1 + 2 * ITEM_CELLS, np.int64)
        flat[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        words, held, total, ends, inside = np.split(flat, [k, k + BUCKETS, k + BUCKETS + 1, k + BUCKETS + 1 + ITEM_CELLS])
        return CorpusCounts(words.reshape(len(LANGUAGES), BUCKETS), held, int(total[0]), ends, inside)

    def item_cut(self, item: str) -> bool:
        """Whether a list item's last word stands inside other items and never at their end, or in no other at all. Only items followed
        by others are counted, as these are whole. Few items tell nothing."""
        tokens = item_tokens(item)
        if not tokens or self.ends.sum() < 200:
            return False
        last = _item_cells(tokens[-1:])[0]
        ends, inside = self.ends[last], self.inside[last]
        if ends + inside == 0:
            return tokens[-1].isalpha() and item.split()[-1].islower()
        return ends * 50 < inside


def word_set(words: list[str]) -> np.ndarray:
    return np.unique(words_of(words).hashes)


def _bins(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([0.0, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95]), x, side="left")


def _rate(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


@dataclass
class Features:
    rows: Sequences
    """Per position: ``rows``, ``barred`` labels, the share of words ``known`` from the question, and whether the clause speaks as a
    refusal does without naming any fact (``declining``). Per pair: whether the reply is ``foreign``."""

    rows: Sequences
    barred: np.ndarray
    known: np.ndarray
    foreign: np.ndarray
    declining: np.ndarray


class Featurizer:
    """Features of whole batches of pairs. Those of form have numbers of their own, words and pairs of words are hashed above."""

    FORM = 1024

    def __init__(self, counts: CorpusCounts, spec: ReplySpec) -> None:
        self.counts, self.spec, self.size = counts, spec, 1 << spec.hash_bits
        self.language = LanguageModel.of(counts.words)
        rng = random.Random(spec.seed)
        composed = words_of([c for k in REFUSALS for _ in range(150) for c in clauses(_refusal(rng, k))])
        cells = np.unique(composed.text_of() * BUCKETS + buckets(composed.hashes))
        refusing = np.bincount(cells % BUCKETS, minlength=BUCKETS) / max(1, len(composed.bounds) - 1)
        # A word in under half a percent of the corpus's clauses says little by its absence from the composed refusals.
        self.likeness = np.log((refusing + 0.005) / (counts.clauses / max(1, counts.total) + 0.005)).astype(np.float32)
        self.lexicon = [word_set(x) for x in (SPEAKER, DENIAL, ADVISING)]

    def like(self, parts: list[str]) -> np.ndarray:
        """How much likelier each clause's words are in composed refusals than in the corpus: mean logarithm."""
        words = words_of(parts)
        return _rate(np.bincount(words.text_of(), self.likeness[buckets(words.hashes)], len(parts)), np.diff(words.bounds))

    def of(self, questions: list[str], parts: list[list[str]]) -> Features:
        """``parts``: the clauses of each reply, one at least."""
        n = len(questions)
        sizes = np.array([len(p) for p in parts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = [c for p in parts for c in p]
        m, pair = len(flat), np.repeat(np.arange(n), sizes)
        cased = cased_words(questions + flat)
        words, split = cased.words, int(cased.words.bounds[n])
        owner, asker = cased.owner[split:] - n, cased.owner[:split]
        length = np.diff(words.bounds)[n:]
        salt = mix(np.arange(1, n + 1).astype(np.uint64))
        asked = np.unique(words.hashes[:split] ^ salt[asker])
        told = words.hashes[split:] ^ salt[pair[owner]]
        in_question = np.isin(told, asked)
        runs, start = words.shingles(2)
        run_owner = cased.owner[start]
        asked_runs, first_run = np.unique(runs[run_owner < n] ^ salt[run_owner[run_owner < n]], return_index=True)
        per_question = np.bincount(run_owner[run_owner < n][first_run], minlength=n)
        runs, run_owner = runs[run_owner >= n], run_owner[run_owner >= n] - n
        told_runs = runs ^ salt[pair[run_owner]]
        echoed = np.isin(told_runs, asked_runs)
        runs_in = np.bincount(run_owner, minlength=m)
        echo = _rate(np.bincount(run_owner, echoed, m), runs_in)
        known = _rate(np.bincount(owner, in_question, m), length)
        held_runs = np.bincount(_owners(told_runs[echoed], pair[run_owner[echoed]]), minlength=n)
        held_words = np.bincount(_owners(told[in_question], pair[owner[in_question]]), minlength=n)
        asked_words = np.bincount(_owners(words.hashes[:split] ^ salt[asker], asker), minlength=n)
        cover = np.minimum(1, np.bincount(run_owner, echoed, m) / np.maximum(1, per_question)[pair])

        # The language of each question and of what its reply says besides the question.
        voice = self.language.words(cased)
        spoken_scores = by_text(voice[:split], asker, n)
        spoken, sure = leader(spoken_scores)
        own = by_text(voice[split:], owner, m)
        whole = by_text(own * (echo < 0.75)[:, None], pair, n)
        spoken = np.where(sure > 0.5, spoken, whole.argmax(axis=1))
        other, _ = leader(whole)
        lead = whole.max(axis=1) - whole[np.arange(n), spoken]
        told_voice = voice[split:] * (echo < 0.75)[owner][:, None]
        telling = told_voice.min(axis=1) < -1
        speakers = pair[owner]
        support = np.bincount(speakers, told_voice[np.arange(len(owner)), other[speakers]] - told_voice[np.arange(len(owner)), spoken[speakers]] > 1, n)
        foreign = (lead >= self.spec.language_lead) & (support >= 2) & (lead >= self.spec.language_margin * np.bincount(speakers, telling, n)) & (sure > 0.5)
        clause_lead = _language_bin(own, spoken[pair])
        whole_lead = _language_bin(whole, spoken)[pair]

        last = np.zeros(m, np.int64)
        last[bounds[1:] - 1] = 1
        opening = np.zeros(m, np.int64)
        opening[bounds[:-1]] = 1
        end, is_open, items = (np.zeros(m, np.int64) for _ in range(3))
        broken = np.zeros(m, bool)
        for i, p in zip(bounds[1:] - 1, parts):
            kind = ending(p[-1])
            if kind == "item":
                kind = "cut" if self.counts.item_cut(p[-1]) else kind
                items[i] = 1 + (len(p) > 1 and bool(_MARKER.match(p[-2])))
            end[i], is_open[i] = ENDINGS.index(kind) + 1, kind in OPEN_ENDS
            broken[i] = is_open[i] and (kind != "cut" or length[i] > 3)  # a word or two may do without a full stop
        spoken_of = [np.isin(words.hashes[split:], x) for x in self.lexicon]
        has = [np.bincount(owner, x, m) > 0 for x in spoken_of]
        speech = has[0] + 2 * has[1] + 4 * has[2]
        digit = cased.digit[split:]
        name = ~cased.plain[split:] & ~digit & ~np.any(spoken_of, axis=0)
        facts = (np.bincount(owner, digit, m) > 0) + 2 * (np.bincount(owner, name, m) > 0)
        likeness = _rate(np.bincount(owner, self.likeness[cased.bucket[split:]], m), length)
        like = np.searchsorted([-1.5, -1.0, -0.6, -0.3, 0.0, 0.3, 0.6], likeness)
        few = np.minimum(length, 6)
        form = [
            (np.zeros(m, np.int64), 1), (last, 2), (opening, 2), (few, 7), (_bins(echo), 8), (_bins(known), 8), (_bins(echo) * 5 + np.minimum(length, 4), 40), (_bins(cover), 8),
            (clause_lead, 16), (whole_lead, 16), (clause_lead * 16 + whole_lead, 256), (end, 12), (is_open, 2), (items, 3), (speech, 8), (facts, 4), (speech * 4 + facts, 32), (like, 8), (like * 4 + facts, 32),
        ]
        ids, at = [], 0
        for values, count in form:
            ids.append(values + at)
            at += count
        shape = np.stack(ids, axis=1)
        room = np.uint64(self.size - self.FORM)
        firsts, lasts = np.flatnonzero(np.diff(owner, prepend=-1)), np.flatnonzero(np.diff(owner, append=m))
        hashed = np.concatenate([words.hashes[split:], runs, mix(words.hashes[split:][firsts] + np.uint64(1)), mix(words.hashes[split:][lasts] + np.uint64(2))])
        place = np.concatenate([owner, run_owner, owner[firsts], owner[lasts]])
        cells = np.unique(place * self.size + self.FORM + (hashed % room).astype(np.int64))
        all_ids = np.concatenate([shape.reshape(-1), cells % self.size])
        all_places = np.concatenate([np.repeat(np.arange(m), shape.shape[1]), cells // self.size])
        order = np.argsort(all_places, kind="stable")
        ptr = np.concatenate([[0], np.cumsum(np.bincount(all_places, minlength=m))])

        barred = np.zeros((m, 5), bool)
        barred[:, UNFINISHED] = is_open == 0  # only a clause with an open end can be unfinished
        barred[:, FOREIGN] = ~foreign[pair]
        repeats = (held_runs >= 0.5 * np.maximum(1, per_question)) | (held_words >= 0.8 * np.maximum(1, asked_words))
        barred[:, ECHO] = ~(repeats[pair] & ((known >= 0.5) | (length <= 3)))
        # What breaks off, only gives back the question, or speaks another language throughout is no answer whatever its words.
        barred[:, ANSWER] = broken | (repeats[pair] & (echo > 0.85) & (length > 3)) | (foreign[pair] & (clause_lead > 9))
        return Features(Sequences(all_ids[order], ptr, bounds), barred, known, foreign, (speech == 7) & (facts == 0))


def _owners(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The owner of each distinct key; equal keys have equal owners."""
    return owner[np.unique(keys, return_index=True)[1]]


def _language_bin(scores: np.ndarray, spoken: np.ndarray) -> np.ndarray:
    """0-7: the spoken language leads by so much; 8-15: another one does."""
    own = scores[np.arange(len(scores)), spoken]
    rest = scores.copy()
    rest[np.arange(len(scores)), spoken] = -np.inf
    lead = rest.max(axis=1) - own
    return np.where(lead > 0, 8 + _bins(lead / 12), _bins(-lead / 12))


def is_empty(reply: str | None) -> bool:
    return reply is None or re.sub(r"[\W_]+", "", reply).lower() in SENTINELS


def _refusal(rng: random.Random, language: str) -> str:
    openings, cores, closings = REFUSALS[language]
    opening = rng.choice(openings)
    core = rng.choice(cores)
    core = core if opening.endswith(", ") or opening.endswith("but ") else core[0].upper() + core[1:]
    parts = [f"{opening}{core}." if opening else core[0].upper() + core[1:] + "."]
    if rng.random() < 0.25:
        again = rng.choice(cores)
        parts.append(again[0].upper() + again[1:] + ".")
    closing = rng.choice(closings)
    text = " ".join([*parts, closing] if closing else parts)
    return text.upper() if rng.random() < 0.08 else text


#: What a reply puts before the question that it gives back.
ECHO_LEADS = ["> ", '"', "Q: ", "Question: ", "You asked: ", "Your question was: ", "Frage: ", "Du fragst: ", "Pregunta: ", "Question posée : "]


def _altered(rng: random.Random, question: str) -> str:
    """The question, perhaps slightly changed."""
    kind = rng.randrange(8)
    words = question.split(" ")
    if kind == 0:
        return question.lower()
    if kind == 1:
        return question.upper()
    if kind == 2 and len(words) > 3:
        del words[rng.randrange(len(words))]
        return " ".join(words)
    if kind == 3:
        return question.rstrip("?. ") + "."
    if kind == 4:
        return f"**{question}**" if rng.random() < 0.5 else f"{question} {question}"
    if kind == 5:
        return rng.choice(ECHO_LEADS) + question
    return question


def training_cases(good: list[tuple[str, str]], features: Featurizer, rng: random.Random) -> list[tuple[str, list[str], list[int]]]:
    """(question, clauses, labels) from replies that hold no mere refusal: as they are, and damaged copies."""
    if not good:
        return []
    parts = [clauses(a) for _, a in good]
    seen = features.of([q for q, _ in good], parts)
    spoken, sure = leader(features.language.scores([q for q, _ in good]))
    language, clear = leader(features.language.scores([a for _, a in good]))
    by_language = [[a for (_, a), k, lead in zip(good, language, clear) if k == x and lead > 5] for x in range(len(LANGUAGES))]
    cases = []
    for n, (question, reply) in enumerate(good):
        span = slice(seen.rows.bounds[n], seen.rows.bounds[n + 1])
        labels = np.where((seen.known[span] > 0.8) & ~seen.barred[span, ECHO], ECHO, FOREIGN if seen.foreign[n] else ANSWER)
        if not seen.barred[span, UNFINISHED][-1]:
            labels[-1] = UNFINISHED
        labels = labels.tolist()
        cases.append((question, parts[n], labels))
        draw = rng.random()
        if draw < 0.30:  # cut off
            at = rng.randrange(max(1, len(reply) // 3), max(2, len(reply)))
            short = clauses(reply[:at].rstrip() + rng.choice(["", "", "", ",", " and", " (", ":", " the"]))
            if short and ending(short[-1]) in OPEN_ENDS:
                cases.append((question, short, [ANSWER] * (len(short) - 1) + [UNFINISHED]))
        elif draw < 0.55:  # the question alone, or before the answer
            echo = clauses(_altered(rng, question))
            rest = parts[n] if rng.random() < 0.4 else []
            cases.append((question, echo + rest, [ECHO] * len(echo) + (labels if rest else [])))
        elif draw < 0.70:  # in another language
            others = [k for k in range(len(LANGUAGES)) if k != spoken[n] and by_language[k]]
            if others and sure[n] > 0.5:
                foreign = clauses(rng.choice(by_language[rng.choice(others)]))
                cut = ending(foreign[-1]) in OPEN_ENDS
                cases.append((question, foreign, [FOREIGN] * (len(foreign) - cut) + [UNFINISHED] * cut))
        elif draw < 0.90:
            refusal = clauses(_refusal(rng, LANGUAGES[spoken[n]] if sure[n] > 0.5 else "en"))
            cases.append((question, refusal, [REFUSAL] * len(refusal)))
    return cases


@dataclass
class ReplyTagger:
    features: Featurizer
    crf: ChainCRF
    spec: ReplySpec

    @staticmethod
    def train(pairs: list[tuple[str | None, str | None]], spec: ReplySpec, counts: CorpusCounts | None = None) -> ReplyTagger:
        """``counts``: of all pairs, by default of those given."""
        features = Featurizer(counts or CorpusCounts.zeros().add(pairs), spec)
        known = [(q, a) for q, a in pairs if a and q and not is_empty(a)]
        safe = [not x for x in doubtful(features, known)]
        good = [p for p, s in zip(known, safe) if s]
        refused: list[tuple[str, str]] = []
        tagger = ReplyTagger(features, ChainCRF.empty(features.size, 5), spec)
        for _ in range(spec.rounds):
            rng = random.Random(spec.seed)
            cases = [c for c in training_cases(good, features, rng) if c[1]]
            for language in REFUSALS:  # so that a small or one-sided sample knows them too
                cases += [("", c, [REFUSAL] * len(c)) for c in (clauses(_refusal(rng, language)) for _ in range(120))]
            cases += [(q, c, [REFUSAL] * len(c)) for q, c in ((q, clauses(a)) for q, a in refused)]
            seen = features.of([q for q, *_ in cases], [c for _, c, _ in cases])
            tagger.crf = ChainCRF.empty(features.size, 5).fit(seen.rows, np.concatenate([x for *_, x in cases]), spec.epochs, seed=spec.seed)
            # What this fit takes for refusals among the sample's replies teaches the next their wording.
            tags = tagger.defects(known)
            refused = [p for p, d in zip(known, tags) if d == "refusal"]
            good = [p for p, d, s in zip(known, tags, safe) if d != "refusal" and s]
        return tagger

    def defects(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        out: list[str | None] = ["empty" if is_empty(a) else None for _, a in pairs]
        todo = [i for i, d in enumerate(out) if d is None]
        if not todo:
            return out
        parts = [clauses(pairs[i][1]) for i in todo]
        seen = self.features.of([pairs[i][0] or "" for i in todo], parts)
        tags = self.crf.label(seen.rows, seen.barred)
        for n, i in enumerate(todo):
            out[i] = self.judge(parts[n], tags[seen.rows.bounds[n] : seen.rows.bounds[n + 1]].tolist())
        return out

    def judge(self, parts: list[str], tags: list[int]) -> str | None:
        """The defect by what each tag covers, in characters."""
        cover = [0] * 5
        for part, tag in zip(parts, tags):
            cover[tag] += len(part)
        if tags[-1] == UNFINISHED:
            return "truncated"
        if cover[FOREIGN] >= self.spec.min_foreign * sum(cover):
            return "other_language"
        if cover[REFUSAL] and cover[REFUSAL] >= self.spec.min_refusal * (cover[REFUSAL] + cover[ANSWER]):
            return "refusal"
        if cover[ECHO] and not cover[ANSWER]:
            return "copy"
        return None


def doubtful(features: Featurizer, pairs: list[tuple[str, str]]) -> list[bool]:
    """Whether each reply may be a mere refusal, and so is no safe example of an answer."""
    if not pairs:
        return []
    parts = [clauses(a) for _, a in pairs]
    seen = features.of([q for q, _ in pairs], parts)
    scores = features.like([c for p in parts for c in p])
    out = []
    for n, (_, reply) in enumerate(pairs):
        own = scores[seen.rows.bounds[n] : seen.rows.bounds[n + 1]]
        worded = len(_norm(reply)) > 2 and own.max() > 0.2 and own.mean() > -0.2
        out.append(bool(worded or seen.declining[seen.rows.bounds[n] : seen.rows.bounds[n + 1]].any()))
    return out


def question_pairs(conversations: DataFrame) -> DataFrame:
    """``conv_id, pair_no, question, reply``: the n-th user message and the assistant message right after it. Of one id the
    row with the latest ``archived`` counts, of several the longest. Rows without an id, without messages or with unreadable
    ones give no pairs."""
    best = F.max(F.struct("archived", F.length("messages").alias("n"), "messages")).alias("best")
    latest = conversations.filter(F.col("id").isNotNull()).select("id", "archived", "messages").groupBy("id").agg(best)
    turns = latest.select(F.col("id").alias("conv_id"), F.from_json("best.messages", "array<struct<role:string,content:string>>").alias("m"))
    role = lambda m: F.lower(F.trim(m["role"]))
    joined = F.transform("m", lambda m, i: F.struct(role(m).alias("role"), m["content"].alias("question"), F.when(role(F.get("m", i + 1)) == "assistant", F.get("m", i + 1)["content"]).alias("reply")))
    asked = turns.select("conv_id", F.posexplode(F.filter(joined, lambda t: t["role"] == "user")).alias("pos", "t"))
    return asked.select("conv_id", (F.col("pos") + 1).cast("int").alias("pair_no"), "t.question", "t.reply")


def corpus_counts(pairs: DataFrame) -> CorpusCounts:
    """The counts over all pairs. Each task sums its own; what reaches the driver is bounded by the size of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = CorpusCounts.zeros()
        for batch in bounded(batches, "reply"):
            counts.add(list(zip(batch.column("question").to_pylist(), batch.column("reply").to_pylist())))
        yield counts.cells()

    cells = pairs.select("question", "reply").mapInArrow(count, "cell bigint, n bigint")
    return CorpusCounts.of(cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow())


def tag_pairs(conversations: DataFrame, spec: ReplySpec = ReplySpec()) -> DataFrame:
    """``conv_id, pair_no, question, reply, defect`` of every pair; ``defect`` is null or one of empty, truncated, refusal,
    copy, other_language. The tagger is fitted on the pairs of the ``spec.train_conversations`` conversations with the least
    hash of their id; the counts that it rests on and the tagging read all pairs."""
    spark = conversations.sparkSession
    pairs = settle(question_pairs(conversations), "reply_pairs")
    chosen = pairs.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(spec.train_conversations)
    sample = pairs.join(F.broadcast(chosen), "conv_id", "left_semi").orderBy("conv_id", "pair_no").select("question", "reply").collect()
    tagger = spark.sparkContext.broadcast(ReplyTagger.train([tuple(r) for r in sample], spec, corpus_counts(pairs)))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "reply"):
            rows = list(zip(batch.column("question").to_pylist(), batch.column("reply").to_pylist()))
            defects = tagger.value.defects(rows) if rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(defects, pa.string())], [*batch.schema.names, "defect"])

    return pairs.mapInArrow(tag, "conv_id bigint, pair_no int, question string, reply string, defect string")
