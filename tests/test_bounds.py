"""Searches that leave out what cannot matter, against the whole search."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bounds, cells, search
from lodestone.operators.index import TermIndex, build_term_index, load_term_index, save_term_index

WORDS = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]


def corpus(spark, n, seed=1):
    """Papers whose words are as unevenly common as in prose, with copies (ties), missing dates and an empty one."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    texts = [" ".join(rng.choices(WORDS, weights, k=rng.randrange(3, 40))) for _ in range(n)]
    texts[n // 2 : n // 2 + 10] = [texts[0]] * min(10, n - n // 2)
    rows = [(i, i, "", t, "" if i % 7 == 0 else f"20{10 + i % 10}-0{1 + i % 9}-01", f"a{i}") for i, t in enumerate(texts)] + [(n, n, "", "", "2011-01-01", "a")]
    return spark.createDataFrame(rows, "paper_id long, ord long, title string, abstract string, date string, arxiv_id string").repartition(3)


def queries(spark, seed=2):
    rng = random.Random(seed)
    rows = [(q, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)) + rng.choices(WORDS[:6], k=3)), rng.choice([None, "2014-03", "2012-01"])) for q in range(25)]
    return spark.createDataFrame([*rows, (90, "title abstract", None), (91, "zzzz", None), (92, "", None), (93, "bal bal bal", "")], "qid long, query string, before_date string")


def rows(page):
    return sorted((r.qid, r["rank"], r.paper_id, round(r.score, 7)) for r in page.collect())


@pytest.mark.parametrize(("n", "k"), [(900, 5), (900, 1), (60, 10), (4, 10), (1, 3)])
def test_bounded_search_equals_the_whole(spark, n, k):
    """Also in corpora so small that common terms take from a score, and with fewer papers than k."""
    index, asked = build_term_index(corpus(spark, n)), queries(spark)
    assert rows(search.page(bounds.best(index, asked, k), k)) == rows(search.page(search.bm25_scores(index, asked), k))


def test_exclusions_and_pages(spark):
    index, asked = build_term_index(corpus(spark, 500)), queries(spark)
    whole = search.bm25_scores(index, asked)
    for out in (search.page(whole, 4).select("qid", "paper_id"), search.page(whole, 4).select("qid", "arxiv_id")):
        got = bounds.best(index, asked, 8, lambda s, out=out: search.without(s, out))
        assert rows(search.page(got, 4, 4)) == rows(search.page(search.without(whole, out), 4, 4))


def test_postings_are_left_out(spark):
    """Of the postings of common words few take part in a sum."""
    index = build_term_index(corpus(spark, 4000))
    asked = spark.createDataFrame([(1, " ".join([*WORDS[:4], *WORDS[120:126]]), None)], "qid long, query string, before_date string")
    counts: dict = {}
    page = search.page(bounds.best(index, asked, 2, counts=counts), 2)
    whole = bounds.asked_terms(index, asked).agg(F.sum("df")).first()[0]
    assert rows(page) == rows(search.page(search.bm25_scores(index, asked), 2))
    assert counts["postings"] < whole / 2


def test_search_by_either_way(spark, monkeypatch):
    """Beyond a number of postings the search takes bounds; shuffles instead of broadcasts give the same."""
    index, asked = build_term_index(corpus(spark, 300)), queries(spark)
    plain = rows(search.search(asked, "bm25", index, top_k=6))
    monkeypatch.setattr(search, "PLAIN_POSTINGS", 10)
    assert rows(search.search(asked, "bm25", index, top_k=6)) == plain
    monkeypatch.setattr(bounds, "BROADCAST_ROWS", 0)
    assert rows(search.search(asked, "bm25", index, top_k=6)) == plain


def test_saved_index(spark, tmp_path):
    index, asked = build_term_index(corpus(spark, 200)), queries(spark)
    save_term_index(index, str(tmp_path / "index"), buckets=5)
    again = load_term_index(spark, str(tmp_path / "index"))
    assert isinstance(again, TermIndex) and len(list((tmp_path / "index" / "postings").glob("bucket=*"))) == 5
    assert rows(search.page(bounds.best(again, asked, 5), 5)) == rows(search.page(bounds.best(index, asked, 5), 5))


# Vectors in cells.


def vectors(spark, n, d=6, seed=3):
    """Clustered vectors of many lengths, copies, missing dates, and rows without a usable vector."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 3) for _ in range(d)] for _ in range(8)]
    rows = [(i, i, "" if i % 5 == 0 else f"20{10 + i % 10}-0{1 + i % 9}-01", f"a{i}", [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, n + i, "2011-01-01", f"b{i}", rows[0][4]) for i in range(n // 3)] if rows else []
    rows += [(9001, 9001, "", "c", None), (9002, 9002, "", "c", [1.0] * (d - 1)), (9003, 9003, "", "c", [None] * d), (9004, 9004, "", "c", [0.0] * d)]
    return spark.createDataFrame(rows, "paper_id long, ord long, date string, arxiv_id string, embedding array<float>").repartition(3)


def vector_queries(spark, d=6, seed=5):
    rng = random.Random(seed)
    rows = [(q, [rng.gauss(0, 3) for _ in range(d)], rng.choice([None, "2013-05", ""])) for q in range(15)]
    return spark.createDataFrame([*rows, (90, [0.0] * d, None), (91, None, None), (92, [1.0] * (d + 1), None)], "qid long, embedding array<float>, before_date string")


def pages(scores, k, offset=0):
    return sorted((r.qid, r["rank"], r.paper_id, r.score and round(r.score, 6)) for r in search.page(scores, k, offset).collect())


@pytest.mark.parametrize(("n", "k"), [(600, 5), (600, 40), (30, 10), (0, 3)])
def test_cells_equal_the_whole(spark, n, k):
    rows, asked = vectors(spark, n), vector_queries(spark)
    held = cells.build_cells(rows)
    for keep_missing in (True, False):
        assert pages(cells.best_vectors(held, asked, k, keep_missing), k) == pages(search.vector_scores(rows, asked, keep_missing), k)


def test_cells_with_exclusions_and_shuffles(spark, monkeypatch):
    rows, asked = vectors(spark, 400), vector_queries(spark)
    whole = search.vector_scores(rows, asked)
    out = search.page(whole, 4).select("qid", "paper_id")
    want = pages(search.without(whole, out), 4, 2)
    assert pages(search.vector_best(rows, asked, 6, excluded=out), 4, 2) == want
    monkeypatch.setattr(bounds, "BROADCAST_ROWS", 0)
    assert pages(search.vector_best(rows, asked, 6, excluded=out), 4, 2) == want


def test_cells_are_left_out_and_saved(spark, tmp_path):
    """Of clustered vectors a small share is compared; loaded cells answer the same; no plan compares all with all."""
    rows, asked = vectors(spark, 3000), vector_queries(spark).where("qid < 90")
    held = cells.build_cells(rows, path=str(tmp_path / "cells"))
    counts: dict = {}
    plain = pages(cells.best_vectors(held, asked, 5, counts=counts), 5)
    assert counts["products"] < 15 * 4000 / 3
    got = cells.best_vectors(cells.load_cells(spark, str(tmp_path / "cells")), asked, 5)
    assert pages(got, 5) == plain
    for df in (got, search.vector_scores(rows, asked)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
