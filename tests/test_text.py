import pytest
from pyspark.sql import functions as F

from fathomline.functions import ranking, text


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("glob, like", [("src/**/*.ts", "src/%.ts"), ("a_b", r"%a\_b%"), ("x?.py", "x_.py"), ("**/t*", "%/t%"), ("50%", r"%50\%%")])
def test_globs(glob, like):
    assert text.glob_to_like(glob) == like


def test_glob_underscore_is_literal(spark):
    df = spark.createDataFrame([("a_b.py",), ("axb.py",)], "p string")
    assert [r.p for r in df.where(text.glob_match(F.col("p"), ["a_b"])).collect()] == ["a_b.py"]


def test_expansion_and_tokens(spark):
    assert one(spark, text.expand_query(F.col("q")), q="getUserById HTMLElement a_b-c") == "getUserById get User By Id HTMLElement HTML Element a_b-c a b c"
    assert one(spark, text.name_tokens(F.col("q")), q="HTTPServer myName_x") == ["httpserver", "my", "name", "x"]
    assert one(spark, text.snippet(F.col("q")), q="\n  \n  a   b\nc") == "a b"
    assert one(spark, text.preview(F.col("q")), q="x" * 201) == "x" * 200 + "..."
    assert one(spark, text.intents(F.col("q")), q="Handle the ERROR of a database query") == ["error_handling", "database"]
    assert one(spark, text.folders(F.col("q")), q="a\\b/c.py") == ["a", "b"]


def test_null_inputs(spark):
    for f in (text.preview, text.name_tokens, text.expand_query):
        assert one(spark, f(F.col("q")), q=None) is None
    assert one(spark, text.snippet(F.col("q")), q=None) == ""


def test_rank_score(spark):
    score = lambda kind, name: one(spark, F.round(ranking.rank_score(F.lit(0.8), F.lit("UserHandler"), F.col("k"), F.col("n"), F.lit("a.py"), F.array().cast("array<string>"), F.lit("")), 6), k=kind, n=name)
    assert score("class", "UserHandler") == pytest.approx(0.8 * 1.15 * 1.4)
    assert score("module", "helpers") == pytest.approx(0.8 * 0.92)


def test_sigmoid_and_softmax(spark):
    r = spark.range(1).select(ranking.sigmoid(F.lit(100.0)), ranking.yes_no(F.lit(1.0), F.lit(1.0))).first()
    assert r[0] == pytest.approx(1 / (1 + 2.718281828**-20)) and r[1] == pytest.approx(0.5)
