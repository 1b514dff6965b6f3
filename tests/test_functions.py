"""Columns functions by hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import arxiv, parse, rouge, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given, want",
    [("naïve Bayes GPT-4 x_y2 über straße a1b déjà-vu", ["bayes", "gpt", "vu"]), ("Thherou's 3d foo_bar É é", ["thherou", "s"]), ("", []), ("ABC abc", ["abc", "abc"])],
)
def test_tokens(spark, given, want):
    assert one(spark, text.tokens(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [("2101.03935", (2021, 1)), ("0704.0001", (2007, 4)), ("9901.00001", (1999, 1)), ("2113.00001", None), ("cs/0505003", (2005, 5)), ("math.GT/0309136", None)])
def test_year_month(spark, given, want):
    got = one(spark, arxiv.year_month(F.lit(given)))
    assert (got and tuple(got)) == want
    assert one(spark, arxiv.month_start(F.lit(given))) == ("%04d-%02d-01" % want if want else "")


@pytest.mark.parametrize(
    "date, before, drop_missing, keep_missing",
    [("", "2020-05", False, True), (None, "2020-05", False, True), ("2020-05-31", "2020-05-01", True, True), ("2020-06-01", "2020-05", False, False), ("2020-06-01", "", False, True), ("", "", False, True), ("2020-06-01", None, True, True), ("", None, True, True)],
)
def test_month_cutoff(spark, date, before, drop_missing, keep_missing):
    d, b = F.lit(date).cast("string"), F.lit(before).cast("string")
    assert one(spark, arxiv.month_ok(d, b, False)) is drop_missing
    assert one(spark, arxiv.month_ok(d, b, True)) is keep_missing


def test_cleaners(spark):
    assert one(spark, text.clean_content(F.lit(" high-\n level \n-x\n\na  b "))) == "high-level -x a b"
    assert one(spark, text.clean_content(F.lit(None).cast("string"))) == ""
    assert one(spark, text.clean_common(F.lit("{\\alpha} exam- ple \\beta x"))) == "example  x"
    assert one(spark, text.clean_title(F.lit("2023d. Api-bank: A {benchmark} &; ok..,"))) == "Api-bank: A benchmark ok"
    assert one(spark, text.clean_filename(F.lit('a<b>:"c/\\|?*  d'))) == "abc d"
    assert len(one(spark, text.clean_filename(F.lit("x" * 500)))) == 200
    assert one(spark, text.clean_article(F.lit("a=-1[1], mathbb{R}.Next 1.5"))) == "a1 {R}. Next 1.5"
    assert one(spark, text.letters_key(F.lit("A-b 1 É!"))) == "abé"
    assert one(spark, text.citation_filename(F.lit("p"))) == "cited_p.json"


def test_ids(spark):
    assert one(spark, arxiv.strip_version(F.lit(" 2101.00001v12 "))) == "2101.00001"
    assert one(spark, arxiv.strip_version(F.lit("solv-int/9901001"))) == "solv-int/9901001"
    assert one(spark, arxiv.id_from_url(F.lit("https://ARXIV.org/abs/hep-th/9901001"))) == "hep-th/9901001"
    assert one(spark, arxiv.id_from_url(F.lit("https://x.org/1234.5678"))) is None
    assert one(spark, arxiv.mapped_id(F.lit(""), F.array(F.lit("a"), F.lit("b/2101.12345v2"), F.lit("1999.1111")))) == "2101.12345"


def test_keys_and_json(spark):
    lines = "1. abc\n- def\n3D scene\nab\n" + "x" * 101 + "\n\n• dots"
    assert one(spark, parse.query_keys(F.lit(f"<sub_queries>{lines}</sub_queries>"))) == ["abc", "def", "D scene", "dots"]
    assert one(spark, parse.query_keys(F.lit("<a>one two</a>\n2 three"))) == ["one two", "three"]
    schema = "STRUCT<a:INT>"
    for given, want in (('<think>{"a": 1}</think><t> {"a": 2} </t>', 2), ('```json\n{"a": 3}\n```', 3), ('x {"a": 4} y', 4), ("nothing", None), ("<t>{bad</t>", None)):
        got = one(spark, parse.json_record(F.lit(given), "t", schema))
        assert (got and got.a) == want


def test_authors_bib_and_citations(spark):
    a = F.array(F.array(F.lit("Doe"), F.lit("Jane"), F.lit("Jr")), F.array(F.lit("Plato"), F.lit(""), F.lit("")), F.array().cast("array<string>"))
    assert one(spark, parse.author_names(a)) == ["Jane Doe Jr", "Plato"]
    bib = "@article{k1,\n author={x},\n TITLE = {On {GPT} models},\n}\n@misc{k2, title={B}}"
    assert [tuple(x) for x in one(spark, parse.bib_entries(F.lit(bib)))] == [("k1", "On {GPT} models"), ("k2", "B")]
    assert tuple(one(spark, parse.citation_parts(F.array(F.lit("A"), F.lit("T\nx"), F.lit("J"))))) == ("A", "T x", "J")
    assert tuple(one(spark, parse.citation_parts(F.array(F.lit("A and B. 2020. Title here. Journal, 2"))))) == ("A and B.", "Title here", "Journal, 2")


def test_rouge(spark):
    def brute(a, b):
        x, y = a.lower().split(), b.lower().split()
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        n = t[-1][-1]
        return 2 * n / (len(x) + len(y)) if x and y else 0.0

    rng = random.Random(3)
    long = [" ".join(rng.choices("abcdefgh", k=n)) for n in (61, 62, 63, 124, 125, 200, 3)]
    df = spark.createDataFrame([(a, b) for a in long for b in long], "a string, b string")
    for r in df.select("a", "b", rouge.rouge_l(F.col("a"), F.col("b")).alias("f")).collect():  # one number of bits, full ones, and several
        assert abs(r.f - brute(r.a, r.b)) < 1e-12
    for a, b in (("a b c d", "a c d e"), ("the cat sat", "The cat sat"), ("", "x"), ("a a b", "b a a"), ("x", "y")):
        assert abs(one(spark, rouge.rouge_l(F.lit(a), F.lit(b))) - brute(a, b)) < 1e-12


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.normalise(a)) == [0.6, 0.8] and one(spark, vectors.normalise(b)) == [0.0, 0.0]
    assert one(spark, vectors.cosine(a, a)) == 1.0 and one(spark, vectors.cosine(a, b)) == 0.0
