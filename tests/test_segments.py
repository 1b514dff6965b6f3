"""An index kept up in segments against one built anew."""

import random

import pytest

from lodestone.operators import bounds, index, search, segments

COLUMNS = "paper_id long, ord long, title string, abstract string, date string, arxiv_id string"


def paper(i, rng):
    words = " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randrange(1, 20)))
    return (i, i, f"T {words[:5]}" if i % 9 else None, words if i % 11 else "", "" if i % 5 == 0 else "2015-03-01", f"id{i}")


def same(spark, path, corpus):
    want = index.build_term_index(spark.createDataFrame(list(corpus.values()), COLUMNS))
    got = segments.load(spark, path)
    key = lambda t, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.select(*c).collect())
    for name, columns in (("terms", ("term", "df", "idf")), ("stats", ("n", "avgdl", "mean_idf")), ("postings", ("term", "paper_id", "ord", "date", "arxiv_id", "dl", "tf")), ("blocks", ("term", "level", "n", "most"))):
        assert key(getattr(got, name), *columns) == key(getattr(want, name), *columns), name
    q = spark.createDataFrame([(1, "aa bb cc title", None), (2, "dd dd unknown", "2016-01")], "qid long, query string, before_date string")
    page = lambda i: key(search.page(search.bm25_scores(i, q)), "qid", "rank", "paper_id", "score")
    assert page(got) == page(want) == key(search.page(bounds.best(got, q, 10)), "qid", "rank", "paper_id", "score")


def test_changes_equal_an_index_built_anew(spark, tmp_path):
    rng, path = random.Random(3), f"file://{tmp_path}/i"
    corpus = {i: paper(i, rng) for i in range(1, 120)}
    frame = lambda rows: spark.createDataFrame(list(rows), COLUMNS)
    segments.change(path, frame(corpus.values()))
    new = {i: paper(i, rng) for i in (3, 4, 11, 200)}  # replaced twice, one new
    corpus.update(new)
    segments.change(path, frame(new.values()), gone=spark.createDataFrame([(5,), (999,)], "paper_id long"))
    del corpus[5]
    back = {i: paper(i, rng) for i in (3, 5)}
    corpus.update(back)
    # A paper both new and gone is new; one without a token goes from the index.
    corpus[7] = (7, 7, None, "", "", "id7")
    segments.change(path, frame([*back.values(), corpus[7]]), gone=spark.createDataFrame([(5,)], "paper_id long"))
    same(spark, path, corpus)
    # What broke off before its manifest never happened.
    segments.paper_postings(frame([paper(500, rng)])).withColumn("seg", segments.F.lit(4)).write.parquet(f"{path}/4/postings")
    assert segments.merge(spark, path, 0.5) == 2 and segments.merge(spark, path, 0.5) == 0
    same(spark, path, corpus)
    segments.change(path, frame([]), gone=spark.createDataFrame([(200,), (3,)], "paper_id long"))
    del corpus[200], corpus[3]
    same(spark, path, corpus)


def test_a_small_change_writes_little(spark, tmp_path):
    rng, path = random.Random(4), f"file://{tmp_path}/i"
    frame = lambda ids: spark.createDataFrame([paper(i, rng) for i in ids], COLUMNS)
    segments.change(path, frame(range(1, 501)))
    segments.change(path, frame(range(1000, 1005)))
    rows = [spark.read.parquet(f"{path}/{n}/postings").count() for n in (1, 2)]
    assert 0 < rows[1] < 0.03 * rows[0]
    assert spark.read.parquet(f"{path}/1/gone", f"{path}/2/gone").count() == 0


def test_empty_index(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    assert segments.load(spark, path).postings.count() == 0
    segments.change(path, spark.createDataFrame([], COLUMNS))
    assert segments.load(spark, path).terms.count() == 0
    with pytest.raises(FileExistsError):
        segments.commit(spark, f"{path}/manifest/1", "again")
