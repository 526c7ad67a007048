"""Near-duplicates, components, pieces and leaks against brute force."""

import random
import re
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import leaks as L
from scriptorium.llm import near_duplicates as N
from scriptorium.llm import split as S
from scriptorium.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def variants(rng, words, n):
    out = [words]
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(w)
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(25):
        for k, w in enumerate(variants(rng, [rng.choice(WORDS) for _ in range(rng.randrange(20, 90))], rng.randrange(0, 7))):
            rows.append((f"{g}-{k}", rng.choice(["a", "b", None]), " ".join(w)))
    rows += [("copy", "a", rows[0][2]), rows[1], ("n", "a", None), ("e", "a", ""), ("short", "a", "one two"), ("0-0", "a", rows[3][2])]
    rows += [(f"hot{i}", "a", "the same text again " * 6) for i in range(60)] + [("long", "b", " ".join(WORDS * 200))]
    spec = N.CHUNK_SPEC
    found = N.near_duplicates(spark.createDataFrame(rows, "id string, part string, body string"), spec)
    got = {(r.id_a, r.id_b) for r in N.similar_ids(found).collect()}
    sets = [(i, p, frozenset(zip(w, w[1:]))) for i, p, t in set(rows) if t and len(w := re.findall(r"[^\W_]+", t.lower())) >= 20]
    want = {}
    for x in range(len(sets)):
        for y in range(x):
            (i, p, a), (j, q, b) = sets[x], sets[y]
            if i != j and p == q:
                want[min(i, j), max(i, j)] = max(want.get((min(i, j), max(i, j)), 0), len(a & b) / len(a | b))
    assert got <= {k for k, v in want.items() if v >= 0.6}
    sure = {k for k, v in want.items() if v >= 0.65}
    assert len(sure - got) <= 0.01 * len(sure)
    labelled = N.labelled_members(found).collect()
    assert len({r.class_id for r in labelled if r.id.startswith("hot")}) == 1 and {r.id for r in labelled} == {i for i, _, _ in sets}
    # Groups taken as large, and keys as hot, give the same pairs.
    forced = N.near_duplicates(spark.createDataFrame(rows, "id string, part string, body string"), replace(spec, small_group=2, hot_rows=5))
    assert {(r.id_a, r.id_b) for r in N.similar_ids(forced).collect()} == got
    empty = N.near_duplicates(spark.createDataFrame([], "id string, part string, body string"), spec)
    assert N.similar_ids(empty).count() == 0 and N.labelled_members(empty).count() == 0


def test_long_chain_and_hot_family(spark):
    """A chain of 5,000 classes, each similar to the next ones only, and a family of 600 that all share half of their runs."""
    rng = random.Random(11)
    long = [f"c{rng.randrange(10**6)}" for _ in range(5000 * 8 + 60)]
    chain = [(f"c{i:04}", "a", " ".join(long[i * 8 : i * 8 + 60])) for i in range(5000)]
    base = [f"h{i}" for i in range(60)]
    fresh = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    family = [(f"h{i:03}", "b", " ".join(base + fresh(40))) for i in range(600)]
    for i in range(0, 120, 2):  # planted pairs of similarity about 0.7
        words = family[i][2].split()
        family[i + 1] = (family[i + 1][0], "b", " ".join(words[:82] + fresh(18)))
    found = N.near_duplicates(spark.createDataFrame(chain + family, "id string, part string, body string"), N.CHUNK_SPEC)
    got = {(r.id_a, r.id_b) for r in N.similar_ids(found).collect()}
    near = {(f"c{i:04}", f"c{i + 1:04}") for i in range(4999)}
    assert near <= got and {x for x in got if x[0][0] == "c"} == near
    planted = {(f"h{i:03}", f"h{i + 1:03}") for i in range(0, 120, 2)}
    assert len(planted - got) <= 0.02 * len(planted), len(planted - got)
    groups = {r.id: r.group_id for r in N.labelled_members(found).collect()}
    assert len({groups[i] for i, *_ in chain}) == 1


def test_one_permutation_estimates_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64) for n in (120, 40, 40))
    both = [np.sort(np.concatenate([common, x])) for x in (a, b)]
    values = np.concatenate([N.one_permutation(np.concatenate(both), np.array([0, 160, 320]), 200, s) for s in range(8)], axis=1)
    assert abs((values[0] == values[1]).mean() - 0.6) < 0.06
    assert (N.one_permutation(np.zeros(0, np.uint64), np.array([0, 0]), 8, 1) == 0).all()


def test_chunk_rows_take_edition_and_body(spark):
    df = spark.createDataFrame([("a", "# H\n**Unit:** x\nbody # no\n#gone", {"edition": " 10E "}), ("b", None, None), (None, "x", {})], "chunk_id string, text string, meta map<string,string>")
    assert sorted(map(tuple, N.chunk_rows(df).collect())) == [("a", "10e", "body # no"), ("b", "10e", None)]


PIECES = st.lists(st.sampled_from(["word", "a", "Sentence end. ", "\n\n", "\n", "\n- item ", " ", "x" * 30, "é😀", "! "]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_pieces_make_up_the_text(text):
    spec = S.SplitSpec(limit=120, overlap=20)
    pieces = S.split_text(text, spec)
    assert "".join(p[o:] for p, o, _ in pieces) == text
    assert all(len(p) <= 120 and 0 <= o <= 20 for p, o, _ in pieces)
    for (before, _, level), (piece, o, _) in zip(pieces, pieces[1:]):
        assert before.endswith(piece[:o])
        if level == S.INSIDE:
            assert not re.search(r"\s", before[-2:] + piece[o : o + 1])
        if o and o < len(before):
            own = before[len(before) - min(20, len(before)) :]
            if re.search(r"(?<!\S)\S", before[-21:][1:] if len(before) > 20 else before) and before[-o - 1] != "":
                assert before[-o - 1].isspace() or o == len(own)


def test_cuts_prefer_strong_boundaries():
    text = ("One sentence here. " * 60).strip() + "\n\n" + ("Another sentence follows. " * 60).strip()
    pieces = S.split_text(text, S.SplitSpec())
    assert len(pieces) == 2 and pieces[0][2] == S.PARAGRAPH and pieces[0][0].endswith("\n\n")
    assert [len(p) for p, _, _ in S.split_text("x" * 5000, S.SplitSpec())] and all(level in (S.INSIDE, S.PARAGRAPH) for *_, level in S.split_text("x" * 5000, S.SplitSpec()))
    assert all(level in (S.BLANK, S.PARAGRAPH) for *_, level in S.split_text("word " * 1000, S.SplitSpec()))
    with pytest.raises(ValueError):
        S.SplitSpec(10, 10)


def test_split_rows(spark):
    rows = [("a", "x " * 2000, 1), ("a", "x " * 2000, 1), ("b", "short", 1), ("c", None, 1), ("d", "y" * 2400, 1), ("e", "😀" * 2401, 1), (None, "z " * 1300, 1), ("long", "Words in lines.\n" * 60_000, 1)]
    got = S.split_oversized(spark.createDataFrame(rows, "id string, text string, piece int"))
    by = {r.id: r for r in got.groupBy("id").agg(F.max("pieces").alias("n"), F.count("*").alias("rows"), F.max(F.length("piece")).alias("most")).collect()}
    assert set(by) == {"a", "e", None, "long"} and all(r.n == r.rows and r.most <= 2400 for r in by.values())
    assert S.split_oversized(spark.createDataFrame([], "id string, text string")).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS[:60]) for _ in range(rng.randrange(5, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "Über ÉTÉ " * 8)]
    items += [(93, items[3][1])]
    docs = []
    for d in range(120):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            source = rng.choice(items[:30])[1].split()
            at, n = rng.randrange(len(source)), rng.randrange(8, 20)
            words[len(words) // 2 : len(words) // 2] = source[at : at + n]
        docs.append((d, "\n> ".join(words).upper() if d % 3 else ", ".join(words), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (1, docs[1][1], "x"), (502, "über - été " * 9, "x"), (503, "w " * 200_000 + items[5][1], "x")]
    runs = lambda t: {tuple(w[i : i + 12]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 11)}
    want = {(d, i) for d, t, _ in docs for i, u in items if runs(t) & runs(u)}
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")
    for spec in (L.LeakSpec(), L.LeakSpec(block_chars=1000)):
        assert {(r.doc_id, r.item_id) for r in L.find_leaks(a, b, spec).collect()} == want
    share = lambda t, k: {tuple(w[i : i + k]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - k + 1)}
    texts, names = {}, dict(items)
    for d, t, _ in docs:
        texts.setdefault(d, []).append(t)
    for r in L.find_leaks(a, b).collect():
        parts = share(names[r.item_id], 5)
        assert any(abs(len(parts & share(t, 5)) / len(parts) - r.containment) < 1e-9 for t in texts[r.doc_id])
    assert (502, 92) in want and L.find_leaks(a, b.limit(0)).count() == 0 and L.find_leaks(a.limit(0), b).count() == 0


def test_item_index_is_small():
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(rng.randrange(8, 400)))) for i in range(1500)]
    chars = sum(len(t) for _, t in items)
    index = L.ItemIndex(items, L.LeakSpec(), slice_chars=1 << 16)
    assert chars > 1 << 20 and index.memory() < 8 * chars
    whole = L.ItemIndex(items, L.LeakSpec())
    assert [p.upper for p in index.partitions] == [p.upper for p in whole.partitions] and len(index.partitions) > 3
    assert all((a.values == b.values).all() and (a.item == b.item).all() for a, b in zip(index.partitions, whole.partitions))
