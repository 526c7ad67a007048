import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import matching as M


def test_substring_pairs_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    needles = [word(rng.randrange(0, 6)) for _ in range(60)] + [None]
    texts = [word(rng.randrange(0, 40)) for _ in range(80)] + [None, "", "x" * 20_000]
    n = spark.createDataFrame(list(enumerate(needles)), "a int, needle string")
    t = spark.createDataFrame(list(enumerate(texts)), "b int, text string")
    want = {(i, j) for i, x in enumerate(needles) for j, y in enumerate(texts) if x and y is not None and x in y}
    assert {(r.a, r.b) for r in M.substring_pairs(n, t).collect()} == want
    for ways in ({"block_chars": 100}, {"max_blocks": 0}):  # several automata, and none
        assert {(r.a, r.b) for r in M.substring_pairs(n, t, **ways).collect()} == want
    assert M.substring_pairs(n.limit(0), t).count() == 0 and M.substring_pairs(n, t.limit(0)).count() == 0


def test_maximal_hits(spark):
    hits = spark.createDataFrame([(1, "guard"), (1, "old guard"), (1, "wolf"), (2, "guard")], "q int, name string")
    assert {tuple(r) for r in M.maximal_hits(hits, ["q"], "name").collect()} == {(1, "old guard"), (1, "wolf"), (2, "guard")}


@settings(max_examples=15, deadline=None)
@given(st.text("ab", min_size=0, max_size=12), st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=3, unique=True))
def test_greedy_spans(spark, text, names):
    spans = sorted((i, -len(n)) for n in names for i in range(len(text)) if text.startswith(n, i))
    want, end = [], 0
    for i, size in spans:
        if i >= end:
            want.append((i + 1, i - size))
            end = i - size
    df = spark.createDataFrame([(text, names)], "t string, n array<string>")
    assert [tuple(s) for s in df.select(M.greedy_spans(F.col("t"), F.col("n")).alias("s")).first().s] == want
