import pytest
from pyspark.sql import functions as F

from scriptorium.config import SETTINGS, Settings, check
from scriptorium.functions import text as T
from scriptorium.operators.where import OPERATORS, compile_where, in_map, operators_of


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.tokens, "A fly-by: 4+ of X2!", ["fly", "by", "of", "x2"]),
        (T.content_terms, "How does the move not move", ["move", "not"]),
        (T.content_text, "# Head\n**Unit:** x\r\n a  b c \n", "a b c"),
        (T.phrase_form, "It's Big!", " it s big "),
        (T.safe, " nan ", "—"), (T.safe, None, "—"), (T.safe, " a ", "a"),
        (T.strip_html, "<ul><li>A</li><li>B</li></ul> end <a>x</a> .", "A, B, end x."),
        (T.strip_html, "&amp;lt; ( a ) : <ul>,", "< (a):"),
        (T.clean_text, "4 + dice , “quoted” — x", '4+ dice, "quoted" -- x'), (T.clean_text, None, ""),
        (T.slugify, " Hello, World -- Two_three ", "hello_world_two_three"),
        (T.light_stem, "burning", "burn"), (T.light_stem, "does", "doe"), (T.light_stem, "as", "as"),
        (T.expand, "AP and invul with DS", "armour penetration and invulnerable save with deep strike"),
        (T.strip_reasoning, "<think>a</think> b <think> c", "b"), (T.strip_reasoning, "<think>a", "<think>a"),
        (T.sentences, "# H\nThe first long sentence. Short. Another quite long one.", ["The first long sentence.", "Another quite long one."]),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, f, value) == want


def test_clauses(spark):
    cut = lambda q: one(spark, lambda c: T.clauses(c, 2), q)
    assert cut("Can it move?") == ["Can it move?"]
    q = "After I charge, how far can I pile in?"
    assert cut(q) == ["how far can I pile in?", q]
    assert cut("models, and weapons") == ["models, and weapons"]
    assert len(cut("How a bc, what a bc, why, which a bc")) == 3


def test_display_name(spark):
    assert one(spark, T.display_name, None, "Core > Deep Strike!") == "deep strike"
    assert one(spark, T.display_name, "Own", "Core > X") == "own"


def test_where(spark):
    df = spark.createDataFrame([(1, {"k": "x"}), (2, {"k": "y"}), (3, {}), (4, None)], "id int, m map<string,string>")
    ids = lambda w: [r.id for r in df.filter(compile_where(w, in_map("m"))).orderBy("id").collect()]
    assert ids({"k": "x"}) == [1] and ids({"k": {"$ne": "x"}}) == [2, 3, 4] and ids({}) == ids(None) == [1, 2, 3, 4]
    assert ids({"k": {"$in": ["x", "y"]}}) == [1, 2] and ids({"k": {"$in": []}}) == [] and ids({"k": {"$gt": "a"}}) == []
    assert ids({"$or": [{"k": "x"}, {"k": {"$eq": "y"}}]}) == [1, 2] and ids({"$and": [{"k": "x"}, {"k": "y"}]}) == []
    assert operators_of({"$and": [{"a": {"$ne": 1}}, {"$or": [{"b": 2}]}]}) == {"$and", "$or", "$ne"} <= OPERATORS


def test_settings():
    check(SETTINGS)
    with pytest.raises(ValueError) as e:
        check(Settings(top_k=1, default_edition="9e"))
    assert "top_k" in str(e.value) and "edition" in str(e.value)
