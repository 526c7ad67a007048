"""Mixtures by their sums, reply defects and toxicity by held-out accuracy."""

import json
import random
import re
import time
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import mixing as M
from scriptorium.llm import replies as R
from scriptorium.llm import toxicity as X


def test_mixture_meets_shares(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 40)), rng.choice(["Big", " big ", "big", "small"]) if i % 9 else "tiny", "x") for i in range(900)]
    docs += [(5000, None, "big", "x"), (5001, "", "big", "x"), (5002, "a b", None, "x"), (5003, "a b", "other", "x"), (5004, "word " * 3000, "small", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small", 0.3, 3), ("tiny", 0.15, 2), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixture = M.mix(df, targets)
    report = {r.source: r for r in mixture.report.collect()}
    largest = 3001 / sum(r.tokens for r in report.values())
    for name, share in (("big", 0.5), ("small", 0.3), ("tiny", 0.15)):
        assert abs(report[name].scaled_target - share / 0.95) < 1e-9 and abs(report[name].actual_share - share / 0.95) <= largest and report[name].most_copies <= report[name].max_repeats
    assert report["none"].actual_share == 0.0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    rows = mixture.documents.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and sum(r.tokens * r.copies for r in rows if r.source == "small") == report["small"].tokens
    smaller = M.mix(df, targets, M.MixSpec(total_tokens=3000)).documents
    assert smaller.join(mixture.documents, "doc_id", "left_anti").count() == 0  # nested budgets
    assert M.mix(df.limit(0), targets).documents.count() == 0 and M.mix(df, targets.limit(0)).report.count() == 0


def test_thresholds_are_the_largest_that_fit(spark):
    sized = spark.createDataFrame([(i, "s", 10, (i * 2654435761 * 97) % (1 << M.HASH_BITS)) for i in range(500)] + [(900 + i, "s", 10, 12345) for i in range(3)], "doc_id bigint, source string, tokens bigint, h bigint")
    total = 5030
    for budget in (0, 5, 10, 995, 2500, 5029, 5030):
        plan = M.Plan("s", 1.0, total, budget, 1, copies=budget // total)
        M.find_thresholds(sized, [plan], M.MixSpec())
        taken = sum(r.tokens for r in sized.filter(F.col("h") < plan.threshold).collect()) if plan.copies < 1 else total
        assert taken <= budget and budget - taken <= 30


def good_replies(rng, n):
    subjects, verbs = ["The tall guard", "A marked unit", "Every banner", "The old mortar"], ["moves six inches", "strikes before the other side", "holds the gate until dawn", "loses one point of nerve"]
    return [" ".join(f"{rng.choice(subjects)} {rng.choice(verbs)}{rng.choice(['', ' when the bell rings', ' if the ford is open'])}." for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def test_replies_on_held_out_pairs():
    rng = random.Random(2)
    ask = lambda i: f"Can unit number {i} cross the {rng.choice(['ford', 'gate', 'hill'])} before step {i % 7}?"
    train = [(ask(i), a) for i, a in enumerate(good_replies(rng, 400))]
    tagger = R.ReplyTagger.train(train, R.ReplySpec(epochs=3, rounds=1))
    q = "Can unit number 999 cross the ford before step 3?"
    cases = [(a, None) for a in good_replies(rng, 60)] + [(f"{q} {a}", None) for a in good_replies(rng, 20)]
    cases += [(a[: len(a) - 9], "truncated") for a in good_replies(rng, 40)] + [(q, "copy"), (q.upper(), "copy"), (f"> {q}", "copy")]
    cases += [("I'm sorry, but I cannot help with that request.", "refusal"), ("Lo siento, no puedo responder.", "refusal"), ("Leider darf ich diese Frage nicht beantworten.", "refusal")]
    cases += [("Der Turm ist nicht für die Garde, wenn sie auf dem Hügel steht und wird nicht bewegt.", "other_language"), ("La garde ne peut pas passer la porte quand elle est sur la colline.", "other_language")]
    got = tagger.defects([(q, a) for a, _ in cases])
    wrong = [(a, want, g) for (a, want), g in zip(cases, got) if want != g]
    assert len(wrong) <= 0.06 * len(cases), wrong
    empties = [None, "", " \n", "—", "N/A", "nan", "None.", "...", "\xa0"]
    assert tagger.defects([(q, a) for a in empties] + [(None, "Yes."), ("", "x")])[: len(empties)] == ["empty"] * len(empties)


def test_pairs_of_conversations(spark):
    m = lambda *x: json.dumps([{"role": r, "content": c} for r, c in x])
    rows = [
        (1, m(("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")), "2024-02"), (1, m(("user", "a")), "2024-01"), (2, m(("user", "a"), ("user", "b"), ("assistant", None)), "2024"),
        (3, "[]", "x"), (4, None, "x"), (5, "broken", "x"), (None, m(("user", "a")), "x"), (6, m(("assistant", "z")), None), (7, m(("user", "w " * 100_000), ("assistant", "v " * 100_000)), "x"), (1, m(("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")), "2024-02"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, messages string, archived string, reply string")
    got = {(r.conv_id, r.pair_no): (r.question, r.reply) for r in R.question_pairs(df).collect()}
    assert {k: v for k, v in got.items() if k[0] != 7} == {(1, 1): ("a", "b"), (1, 2): ("c", None), (2, 1): ("a", None), (2, 2): ("b", None)}
    defects = {(r.conv_id, r.pair_no): r.defect for r in R.tag_pairs(df).collect()}
    assert defects[1, 2] == defects[2, 1] == defects[2, 2] == "empty" and len(defects) == 5
    assert R.tag_pairs(df.limit(0)).count() == 0


def corpus(rng, n, toxic_share):
    calm = ["The guard holds the gate", "I painted my banner green", "Roll two dice for the mortar", "What a fool I was to forget the ford"]
    bad = ["you are a worthless zorp", "go home you filthy zorp", "all those blargs are vermin", "shut your mouth blarg"]
    docs = []
    for _ in range(n):
        lines = [f"{rng.choice(calm)} {rng.choice(['today', 'again', 'at dawn', 'in round two'])}." for _ in range(rng.randrange(2, 7))]
        toxic = rng.random() < toxic_share
        if toxic:
            lines.insert(rng.randrange(len(lines)), rng.choice(bad) + rng.choice(["!", ".", "..."]))
        docs.append((" ".join(lines), toxic))
    return docs


def test_toxicity_on_held_out_documents():
    rng = random.Random(6)
    positive = [t for t, y in corpus(rng, 120, 1.0)]
    unlabelled = [t for t, _ in corpus(rng, 900, 0.05)]
    model = X.ToxicityModel.fit(positive, unlabelled, 0.1, X.ToxicitySpec(hash_bits=15))
    test = corpus(rng, 400, 0.2)
    found = model.scores([t for t, _ in test]) >= 0.5
    truth = np.array([y for _, y in test])
    assert (found & truth).sum() >= 0.9 * truth.sum() and (found & ~truth).sum() <= 0.03 * len(test)
    assert (model.scores(["Calm day. go home you filthy z.o.r.p", "You are a w0rthless z​orp"]) >= 0.5).all()
    assert (model.scores([None, "", " \n", "..."]) == 0).all()


def test_undisguise():
    assert X.undisguise("F.O.O.L and f o o l") == "fool and fool" and X.undisguise("Bl4rg b@d $illy") == "blarg bad silly"
    assert X.undisguise("café​ 12 3x") == "cafe 12 3x" and X.undisguise(None) == ""


# The disguises and ends of passages as patterns, which decide what the scan of code points must find.
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*·]{1,2}[^\W\d_](?![^\W_])){2,}")
LEET_WORD = re.compile(r"[013457@$!€|](?:(?<=[^\W\d_].)[013457@$!€|]*(?=[^\W\d_])|(?<=[@$])(?<![^\W_].)(?=[^\W\d_]{2}))")
ENDS = re.compile(r"[.!?…;]+(?=\s|$)|\n")


def undisguised_by_patterns(text):
    t = (text or "").lower()
    if not t.isascii():
        t = re.sub("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]", "", t)
        t = re.sub("[^\x00-\x7f]+", lambda m: "".join(c for c in m.group() if not unicodedata.combining(c)), unicodedata.normalize("NFKD", t))
    t = SPACED.sub(lambda m: re.sub(r"[\W_]", "", m.group()), t)
    return LEET_WORD.sub(lambda m: "".join(X.LEET[c] for c in m.group()), t)


def test_scan_finds_what_the_patterns_do():
    rng, signs = random.Random(4), "ab e I1 0@$!|€.*-_·;…?\n\t éñ\u0301\u200b\u00ad²٣ⅷΣσﬁ中\x1c3457xY"
    texts = ["".join(rng.choice(signs[: rng.choice([6, 14, len(signs)])]) for _ in range(rng.randrange(50))) for _ in range(4000)]
    plain = [undisguised_by_patterns(t) for t in texts]
    assert [X.undisguise(t) for t in texts] == plain
    # All at once as one by one, cut where the patterns cut.
    points, _, offsets = X.plain_points([*texts, None])
    assert X._string(points) == "\n".join([*plain, ""]) and offsets.tolist()[:-1] == np.cumsum([0] + [len(t) + 1 for t in plain]).tolist()
    got, parts = X.Passages(texts, 15), [[p for p in ENDS.split(t) if any(c.isalpha() for c in p)] for t in plain]
    assert np.diff(got.texts).tolist() == [len(p) for p in parts] and all(got.string(i) in p for i, p in enumerate(sum(parts, [])))
    chars = [chr(i) for i in range(0x110000)]
    for bit, pattern in ((X._WORD, r"[^\W_]"), (X._LETTER, r"[^\W\d_]"), (X._SPACE, r"\s")):
        assert np.flatnonzero(X._kinds() & bit).tolist() == [i for i, c in enumerate(chars) if re.match(pattern, c)]
    assert np.flatnonzero(X._kinds() & X._ALPHA).tolist() == [i for i, c in enumerate(chars) if c.isalpha()]
    assert np.flatnonzero(X._kinds() & X._MARK).tolist() == [i for i, c in enumerate(chars) if unicodedata.combining(c)]


def test_features_cost_less_than_the_patterns(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]

    def least(work):
        seconds = []
        for _ in range(5):
            began = time.process_time()
            work()
            seconds.append(time.process_time() - began)
        return min(seconds)

    features = least(lambda: [X.Passages(texts[i : i + 180], 18) for i in range(0, len(texts), 180)])
    assert features < least(lambda: [sum(1 for _ in ENDS.finditer(undisguised_by_patterns(t))) for t in texts])


def test_scores_of_tables(spark):
    rng = random.Random(7)
    docs = [(i, t, rng.choice([" Forum", "forum", None]), y) for i, (t, y) in enumerate(corpus(rng, 300, 0.3))] + [(900, None, "forum", False), (901, "", "forum", False), (902, "calm word " * 50_000, "faq", False)]
    df = spark.createDataFrame([(i, t, s, 0.5) for i, t, s, _ in docs], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(y), "a") for i, _, _, y in docs[:150]] + [(0, None, "b"), (None, 1, "c"), (77777, 1, "a")], "doc_id bigint, toxic int, rater string")
    scored = X.score_documents(df, labels, X.ToxicitySpec(hash_bits=15))
    assert scored.count() == len(docs) and scored.filter("doc_id >= 900 and toxic").count() == 0
    rates = {r.source: r for r in X.rates_by_source(scored).collect()}
    assert set(rates) == {"forum", None, "faq"} and sum(r.documents for r in rates.values()) == len(docs)
    assert X.score_documents(df, labels.limit(0)).filter("toxic").count() == 0 and X.score_documents(df.limit(0), labels).count() == 0


def test_boundary_does_not_hang_on_sizes():
    rng = np.random.default_rng(3)
    # Two crowds with a long slope between them.
    p, u = np.concatenate([rng.normal(3, 1, 400), rng.uniform(-3, 3, 200)]), np.concatenate([rng.normal(-5, 1, 3000), rng.uniform(-4, 3, 60)])
    at = X.valley(X.histogram(p), X.histogram(u), 0.03)
    assert -5 < at < 3 and at == X.valley(X.histogram(np.repeat(p, 10)), X.histogram(u), 0.03) == X.valley(X.histogram(p), X.histogram(np.repeat(u, 10)), 0.03)
    assert X.histogram(np.array([-np.inf, -99.0, 99.0])).nonzero()[0].tolist() == [0, 1, 400]


def test_boundary_and_prior_come_from_all_documents(spark, monkeypatch):
    rng = random.Random(8)
    docs = list(enumerate(corpus(rng, 400, 0.2))) + [(900, (None, False))]
    df = spark.createDataFrame([(i, t, "forum") for i, (t, _) in docs], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int(y), "a") for i, (_, y) in docs[:200]], "doc_id bigint, toxic int, rater string")
    seen, plain = [], X.valley
    monkeypatch.setattr(X, "valley", lambda p, u, *rest: seen.append((int(np.sum(p)), int(np.sum(u)))) or plain(p, u, *rest))
    X.score_documents(df, labels, X.ToxicitySpec(hash_bits=15, max_positive=20, max_unlabelled=60))
    toxic = sum(y for _, (_, y) in docs[:200])
    assert seen[-2:] == [(toxic, len(docs) - toxic)] * 2 and seen[0] == (20, 60)


def test_sample_is_not_cut_for_memory():
    assert (X.ToxicitySpec().max_positive, X.ToxicitySpec().max_unlabelled) == (1500, 4000)


def test_short_replies_are_not_foreign():
    rng = random.Random(5)
    ask = lambda i: f"Does unit number {i} hold the {rng.choice(['ford', 'gate', 'hill'])} once step {i % 7} is over, or only before?"
    spanish = ["La torre no está lista para el asalto y los guardias esperan.", "Cuando el rival coloca una ficha, la torre pierde un punto.", "Los guardias no cruzan el vado durante la fase."]
    train = [(ask(i), a) for i, a in enumerate(good_replies(rng, 300))] + [("¿Cuánto avanzan los guardias durante la fase de tiro?", rng.choice(spanish)) for _ in range(60)]
    tagger = R.ReplyTagger.train(train, R.ReplySpec(epochs=3, rounds=1))
    q = "Does unit number 7 hold the ford once step 3 is over, or only before?"
    short = ["No.", "No, only once.", "Yes, both do.", "Si.", "2 tokens.", "No. In order:\n1. Check Reach\n2. Move 3 inches"]
    assert "other_language" not in tagger.defects([(q, a) for a in short])
    assert tagger.defects([(q, spanish[0]), (q, spanish[2])]) == ["other_language"] * 2


def test_refusals_in_held_out_words(monkeypatch):
    """Whole cores that the composed refusals lack are recognised by what they say; recall is stated in the README."""
    cores = R.REFUSALS["en"][1]
    held = cores[::3]
    monkeypatch.setitem(R.REFUSALS, "en", (R.REFUSALS["en"][0], [c for c in cores if c not in held], R.REFUSALS["en"][2]))
    rng = random.Random(9)
    known = good_replies(rng, 300) + [f"{rng.choice(['Sorry, the words are clear.', 'I am not able to find any bar on this.', 'You cannot play Slow Harvest twice.'])} {a}" for a in good_replies(rng, 90)]
    known += [f"I can't find a bar on rust tokens, so {n} of them may stay." for n in range(30)]
    tagger = R.ReplyTagger.train([(f"May banner {i} cross the ford?", a) for i, a in enumerate(known)], R.ReplySpec())
    got = tagger.defects([("May banner 9 cross the ford?", c[0].upper() + c[1:] + ".") for c in held])
    assert got.count("refusal") >= 0.7 * len(held), [c for c, g in zip(held, got) if g != "refusal"]
    calm = ["I can't see a limit in the text, so 10 of them are fine.", "You cannot use Early Covenant twice. The guard moves six inches.", "Sorry, the text is plain here. The tall guard moves six inches."]
    assert tagger.defects([("May banner 9 cross the ford?", a) for a in calm]) == [None] * 3


def test_last_list_items_cut_off():
    rng = random.Random(3)
    item = lambda: rng.choice([f"- Check {rng.choice(['Reach', 'Guard'])}", f"- tall hook, {rng.randrange(2, 20)} inches", f"- Place one {rng.choice(['rust', 'smoke'])} token", f"- Guard {rng.randrange(2, 9)}+"])
    counts = R.CorpusCounts.zeros().add([("q", "In order:\n" + "\n".join(item() for _ in range(5))) for _ in range(100)])
    assert not any(counts.item_cut(item()) for _ in range(50))
    assert all(counts.item_cut(x) for x in ("- Place one", "- Place one rust", "- tall hook, 9 inch", "- tall"))
    assert not R.CorpusCounts.zeros().item_cut("- Place one")  # too few items to tell


def test_defects_do_not_hang_on_the_sample(spark):
    """Of five training samples none changes a defect's count by more than two percent of all defects."""
    rows = R.question_pairs(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).select("conv_id", "question", "reply").collect()
    pairs, ids = [(r.question, r.reply) for r in rows], sorted({r.conv_id for r in rows})
    counts, seen = R.CorpusCounts.zeros().add(pairs), []
    for s in range(5):
        chosen = set(random.Random(s).sample(ids, len(ids) * 3 // 4))
        tagger = R.ReplyTagger.train([p for p, r in zip(pairs, rows) if r.conv_id in chosen], R.ReplySpec(), counts)
        got = tagger.defects(pairs)
        seen.append({d: got.count(d) for d in ("empty", "truncated", "refusal", "copy", "other_language")})
    total = max(sum(x.values()) for x in seen)
    assert all(max(x[d] for x in seen) - min(x[d] for x in seen) <= max(1, 0.02 * total) for d in seen[0]), seen
