"""Retrieval and metrics against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus, index, metrics, search
from lodestone.plans import agents, evaluate, workflow


@pytest.fixture(scope="module")
def papers(spark):
    rng = random.Random(0)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "xyz"]
    rows = []
    for i in range(60):
        words = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 30)))
        rows.append((i, i, f"T {words[:8]}", words, "" if i % 7 == 0 else f"20{10 + i % 10}-0{1 + i % 9}-01", f"id{i}"))
    rows += [(60, 60, "", "", "2011-01-01", "id60"), (61, 61, None, None, None, "id61"), (62, 62, "T ax", rows[5][3], rows[5][4], "id62"), (63, 63, "T ax", rows[5][3], rows[5][4], "id63")]
    return spark.createDataFrame(rows, "paper_id long, ord long, title string, abstract string, date string, arxiv_id string")


def brute_bm25(papers, query):
    docs = {}
    for r in papers.collect():
        if r.title or r.abstract:
            t = [x for x in re.findall(r"\w+", f"title: {r.title or ''} abstract: {r.abstract or ''}".lower()) if re.fullmatch("[a-z]+", x)]
            if t:
                docs[r.paper_id] = t
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for t in docs.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    raw = {x: math.log(n - d + 0.5) - math.log(d + 0.5) for x, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {x: v if v >= 0 else 0.25 * mean for x, v in raw.items()}
    q = [x for x in re.findall(r"\w+", query.lower()) if re.fullmatch("[a-z]+", x)]
    out = {}
    for p, t in docs.items():
        s = sum(idf.get(x, 0) * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for x in q)
        if s > 0:
            out[p] = s
    return sorted(out.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))


QUERY = "ax by ax title unknown cz"


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, QUERY, None), (2, "!!!", None), (3, QUERY, "2014-05"), (4, QUERY, "")], "qid long, query string, before_date string")


def test_bm25_pages_cutoffs_and_ties(papers, queries):
    idx = index.build_term_index(papers)
    want = brute_bm25(papers, QUERY)
    got = search.search(queries, "bm25", idx, top_k=15, offset=5).where("qid = 1").orderBy("rank").collect()
    assert [(r.rank, r.paper_id) for r in got] == [(5 + i, p) for i, (p, _) in enumerate(want[5:20])]
    assert all(abs(r.score - dict(want)[r.paper_id]) < 1e-9 for r in got)
    every = search.bm25_scores(idx, queries)
    dates = {r.paper_id: r.date for r in papers.collect()}
    assert {r.paper_id for r in every.where("qid = 3").collect()} == {p for p, _ in want if dates[p] and dates[p][:7] <= "2014-05"}
    assert every.where("qid IN (2, 4)").count() == 0


def test_exclusion_before_rank_and_ground_truth(spark, papers, queries):
    idx = index.build_term_index(papers)
    want = [p for p, _ in brute_bm25(papers, QUERY)]
    banned = spark.createDataFrame([(1, want[0]), (1, want[3])], "qid long, paper_id long")
    scores = search.without(search.bm25_scores(idx, queries.where("qid = 1")), banned)
    left = [p for p in want if p not in (want[0], want[3])]
    truth = spark.createDataFrame([(1, left[4]), (1, want[0]), (2, 5)], "qid long, paper_id long")
    got = {(r.qid, r.paper_id): (r.rank, r.total) for r in search.ground_truth_ranks(scores, truth).collect()}
    assert got == {(1, left[4]): (4, len(left) - 1), (1, want[0]): (570205, len(left) - 1), (2, 5): (570205, 0)}
    one = {r.paper_id: r.rank for r in search.ground_truth_ranks(scores, truth.where("qid = 1"), one_based_offset=3, missing=None).collect()}
    assert one == {left[4]: 2, want[0]: len(left) + 1}


def test_hybrid_prefers_vector_order_in_ties(spark):
    rows = "qid long, paper_id long, ord long, date string, arxiv_id string, score double"
    v = spark.createDataFrame([(1, 1, 1, "", "a", 1.0), (1, 2, 2, "", "b", 0.5)], rows)
    b = spark.createDataFrame([(1, 3, 3, "", "c", 8.0), (1, 2, 2, "", "b", 4.0)], rows)
    got = search.page(search.hybrid_scores(v, b)).orderBy("rank").collect()
    assert [(r.paper_id, r.score) for r in got] == [(1, 0.5), (2, 0.5), (3, 0.5)]


def test_index_round_trip(spark, papers, queries, tmp_path):
    idx = index.build_term_index(papers)
    index.save_term_index(idx, str(tmp_path / "i"))
    back = index.load_term_index(spark, str(tmp_path / "i"))
    a, b = (sorted((r.qid, r.rank, r.paper_id) for r in search.search(queries, "bm25", i).collect()) for i in (idx, back))
    assert a == b and index.available_methods(back, None) == ["bm25"]
    assert index.total_papers(papers).first().total == 64 and index.paper_by_id(papers, 3).count() == 1


def test_set_metrics_of_empty_sets(spark):
    t = spark.createDataFrame([(1, 5), (1, 6)], "qid long, paper_id long")
    hits = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 1, 7), (2, 1, 1, 9)], "qid long, iter int, sq_id int, paper_id long")
    got = {r.qid: r for r in metrics.iteration_metrics(t, hits, hits.limit(0)).collect()}
    assert (got[1].recall, got[1].precision, got[1].retrieval_recall, got[1].retrieval_precision) == (0.0, 0.0, 0.5, 0.5)
    assert (got[1].discarded_ratio, got[1].missed_gt_ratio, got[1].discarded_gt_share) == (0.5, 0.5, 1.0)
    assert got[2].total_gt == 0 and got[2].retrieval_recall == 0.0


def test_carry_forward(spark):
    v = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.5)], "qid long, iter int, x double")
    assert [r.x for r in metrics.carry_forward(v, 5, ["x"]).orderBy("iter").collect()] == [0.2, 0.5, 0.5, 0.5, 0.5]


def test_rank_history(spark):
    ranks = spark.createDataFrame([(1, 1, 1, 7, 3), (1, 2, 1, 7, 570205), (1, 1, 1, 8, 3), (1, 2, 1, 8, 40), (1, 1, 2, 9, 25)], "qid long, iter int, sq_id int, paper_id long, rank long")
    chosen = spark.createDataFrame([(1, 1, 1, 7)], "qid long, iter int, sq_id int, paper_id long")
    got = {(r.iter, r.paper_id): (r.rank, r.distance) for r in metrics.rank_history(ranks, chosen).collect()}
    assert got == {(1, 7): (3, 0.97), (2, 7): (3, 0.97), (1, 8): (3, 0.97), (2, 8): (40, 0.6), (1, 9): (25, 0.75)}


def test_plan_rules(spark):
    states = spark.createDataFrame([(1, i, 1, 0, "one", 10, "derive") for i in (1, 2, 3)] + [(1, 1, 2, 0, "two", 10, "derive")], workflow.STATE)
    plan = spark.createDataFrame(
        [(1, 0, "continue", 1, ""), (1, 1, "continue", 2, ""), (1, 2, "derive", None, "new"), (1, 3, "expand", 2, ""), (1, 4, "expand", 2, "more"), (1, 5, "continue", 9, ""), (1, 6, "other", 2, "x"), (2, 0, "derive", 0, "first")],
        "qid long, item int, link_type string, source_id int, text string",
    ).withColumn("target_k", F.lit(25))
    got = sorted((r.qid, r.sq_id, r.source, r.text, r.target_k) for r in workflow.resolve_plan(plan, states, 4).collect())
    assert got == [(1, 2, 0, "two", 10), (1, 3, 0, "new", 10), (1, 4, 2, "more", 10), (2, 1, 0, "first", 10)]
    paths = {(r.sq_id, r.path) for r in workflow.subquery_paths(spark.createDataFrame([(1, 1, 1, 0, "", 1, ""), (1, 1, 2, 1, "", 1, ""), (1, 1, 3, 2, "", 1, "")], workflow.STATE)).collect()}
    assert paths == {(1, "0/1"), (2, "0/1/2"), (3, "0/1/2/3")}


def test_deep_research_and_resume(spark, papers):
    idx = index.build_term_index(papers)
    q = spark.createDataFrame([(0, 1, QUERY, None), (1, 2, "hx", None), (2, 3, "none", None)], "idx long, qid long, query string, before_date string")
    truth = spark.createDataFrame([(1, 5), (2, 8)], "qid long, paper_id long")

    def planner(i, states):
        if i == 1:
            return q.select("qid", F.lit(0).alias("item"), F.lit("derive").alias("link_type"), F.lit(0).alias("source_id"), F.col("query").alias("text"), F.lit(4).alias("target_k"))
        return q.where("qid = 1").select("qid", F.lit(0).alias("item"), F.lit("continue").alias("link_type"), F.lit(1).alias("source_id"), F.lit("").alias("text"), F.lit(4).alias("target_k"))

    def run_all(rows):
        return workflow.deep_research(idx, rows.select("qid", "query", "before_date"), truth, planner, lambda c: c.where("rank % 2 = 0"), 2, finished=lambda i, states: q.where(f"qid = 2 AND {i} = 2").select("qid"))

    run = run_all(q)
    want = [p for p, _ in brute_bm25(papers, QUERY)]
    first = [r.paper_id for r in run.retrieved.where("qid = 1 AND iter = 1").orderBy("rank").collect()]
    assert first == want[:4]
    kept = [p for p in want if p not in (want[0], want[2])]
    assert [r.paper_id for r in run.retrieved.where("qid = 1 AND iter = 2").orderBy("rank").collect()] == kept[4:8]
    assert {r.qid: r.status for r in run.status.collect()} == {1: "finished", 2: "complete", 3: "failed"}
    every, total = evaluate.evaluate(q, None, run_all, truth, 3)
    part, _ = evaluate.evaluate(q.where("idx = 0"), None, run_all, truth, 3)
    again, total2 = evaluate.evaluate(q, part, run_all, truth, 3)
    assert sorted(map(str, every.select(sorted(every.columns)).collect())) == sorted(map(str, again.select(sorted(again.columns)).collect()))
    assert sorted(map(str, total.collect())) == sorted(map(str, total2.collect())) and total.count() == 3


def test_model_plugins(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, prompt string")

    def ask(p):
        if p == "b":
            raise ValueError
        return '<planner_output>{"subqueries":[{"link_type":"derive","source_id":0,"text":"t","target_k":3}],"is_complete":false}</planner_output>'

    assert [tuple(r) for r in agents.planned(agents.call_model(prompts, ask)).collect()] == [(1, 0, "derive", 0, "t", 3)]
    answers = spark.createDataFrame([(1, 2, 'x {"selected": ["p1", "p1"], "overview": "o"}')], "qid long, sq_id int, response string")
    assert [tuple(r) for r in agents.chosen(answers).collect()] == [(1, 2, "p1")]
    c = spark.createDataFrame([(1,), (2,), (3,)], "paper_id long")
    texts = spark.createDataFrame([(1, "x"), (2, "y")], "paper_id long, browsing_content string")
    read = lambda mode, before=None: {r.paper_id: r.browsing_content for r in agents.browsed(c, c.where("paper_id = 2"), texts, mode, before).collect()}
    assert read("NONE") == {1: None, 2: None, 3: None} and read("PRE_ENRICH") == {1: "x", 2: "y", 3: None} and read("REFRESH") == {1: None, 2: "y", 3: None}
    assert read("INCREMENTAL", texts.where("paper_id = 1")) == {1: "x", 2: "y", 3: None}
    cache = spark.createDataFrame([(1, "m", "old"), (2, "other", "no")], "paper_id long, model string, summary string")
    every, new = agents.summarised(c, cache, "m", lambda p: p.withColumn("summary", F.lit("new")))
    assert {r.paper_id: r.summary for r in every.collect()} == {1: "old", 2: "new", 3: "new"} and new.count() == 2


def test_corpus_build(spark):
    kind = "arxiv_id string, title string, abstract string, date string, authors array<string>, category array<string>, url string, source string"
    a = spark.createDataFrame([("1", "T", "", "d", ["x"], [], "", "A"), ("2", "U", "u", "", [], [], "", "A")], kind)
    b = spark.createDataFrame([("1", "", "b", "", [], [], "", "B"), ("3", "V", None, "", [], [], "", "B")], kind)
    got = {r.arxiv_id: r for r in corpus.merge_papers(a, b).collect()}
    assert (got["1"].title, got["1"].abstract, got["1"].authors, got["1"].source) == ("T", "b", ["x"], "B") and got["2"].source == "A" and len(got) == 3
    both, missing = corpus.enrich(a, spark.createDataFrame([("1", "", "new", None, ["y"], None, "u", "E")], kind))
    one = {r.arxiv_id: r for r in both.collect()}["1"]
    assert (one.title, one.abstract, one.date, one.authors) == ("", "new", "d", ["y"]) and [r.arxiv_id for r in missing.collect()] == ["2"]
    ids = spark.createDataFrame([(1, "a1"), (2, "a2")], "corpusid long, arxiv_id string")
    q = spark.createDataFrame([(1, "x", [2, 1]), (2, "y", [1, 9]), (3, "z", [])], "qid long, query string, corpusids array<long>")
    assert {r.qid: r.gt for r in corpus.mapped_queries(q, ids).collect()} == {1: ["a2", "a1"], 3: []}
    refs = spark.createDataFrame([(1, "m1", "no"), (2, None, "Learning to rank documents with many features"), (3, None, "Other things")], "ref_id long, arxiv_id string, title string")
    meta = spark.createDataFrame([("m1", "First"), ("m2", "Learning to rank documents with many feature")], "arxiv_id string, title string")
    assert {r.ref_id: (r.arxiv_id, r.how) for r in corpus.reference_lookup(refs, meta).collect()} == {1: ("m1", "id"), 2: ("m2", "title"), 3: (None, "empty")}
    titled = corpus.titled_papers(spark.createDataFrame([("2101.00001", "A b!")], "arxiv_id string, title string"), spark.createDataFrame([("A-B", "abs")], "title string, abstract string"))
    assert tuple(titled.first()) == ("2101.00001", "A-B", "abs", "2021-01-01")


def rouge(a, b):
    x, y = a.lower().split(), b.lower().split()
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, v in enumerate(x):
        for j, w in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if v == w else max(t[i][j + 1], t[i + 1][j])
    return 2 * t[-1][-1] / (len(x) + len(y)) if x and y else 0.0


def test_similar_titles_lose_no_pair(spark):
    """All pairs by the usual table, among titles with repeated, common and changed words."""
    rng = random.Random(3)
    base = [[rng.choice("the of a on deep learning net ranks with for xy qq".split() + [f"w{k}" for k in range(30)]) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    made = {" ".join(b) for b in base}
    for b in base:
        c = list(b)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(c) + 1)
            c[k:k] = [rng.choice(["new", "the"])] if rng.random() < 0.5 else []
            if len(c) > 1 and rng.random() < 0.5:
                del c[rng.randrange(len(c))]
        made.add(" ".join(c))
    titles = sorted(made) + [""]
    half = spark.createDataFrame([(t,) for t in titles], "t string")
    got = {(r.t, r.u): r.sim for r in corpus.similar_titles(half, half).collect()}
    want = {(a, b): rouge(a, b) for a in titles for b in titles if rouge(a, b) > 0.85}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want) and any(a != b for a, b in want)


def test_holding(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["a", "bb", "c-d", "e,"]) for _ in range(n))
    docs = [(i, words(rng.randrange(0, 60))) for i in range(40)] + [(40, None), (41, "")]
    passages = [(i, rng.choice(docs[:40])[1][rng.randrange(5) : rng.randrange(6, 50)]) for i in range(30)] + [(30, "bb"), (31, None), (32, "never there at all here")]
    got = {tuple(r) for r in corpus.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")).collect()}
    assert got == {(i, d) for i, p in passages for d, t in docs if p is not None and t is not None and p in t}


def test_long_paths_and_papers(spark, papers):
    deep = spark.createDataFrame([(1, k, k, k - 1, "", 1, "") for k in range(1, 12)] + [(1, 1, 20, 99, "", 1, "")], workflow.STATE)
    got = {r.sq_id: r.path for r in workflow.subquery_paths(deep).collect()}
    assert got == {k: "/".join(map(str, range(k + 1))) for k in range(1, 12)}
    chain = [(q, k, k, (k - 1) if k > 1 or q == 1 else 300, "", 1, "") for q in (1, 2) for k in range(1, 301)]  # the second is a circle
    chain += [(3, 1, k, k // 2, "", 1, "") for k in range(1, 64)]  # and a tree
    got = {(r.qid, r.sq_id): (r.level, r.path) for r in workflow.subquery_paths(spark.createDataFrame(chain, workflow.STATE)).collect()}
    tree = lambda k: f"{tree(k // 2)}/{k}" if k else "0"
    assert got == {(1, k): (k, "/".join(map(str, range(k + 1)))) for k in range(1, 301)} | {(3, k): (k.bit_length(), tree(k)) for k in range(1, 64)}
    assert [r.ord for r in corpus.first_papers(papers, 3).orderBy("ord").collect()] == [0, 1, 2] and corpus.first_papers(papers, None).count() == papers.count()


def test_exclusion_by_arxiv_id(spark):
    scores = spark.createDataFrame([(1, 1, 1, "", "x", 3.0), (1, 2, 2, "", "x", 2.0), (1, 3, 3, "", None, 1.0), (2, 1, 1, "", "x", 1.0)], "qid long, paper_id long, ord long, date string, arxiv_id string, score double")
    left = search.without(scores, spark.createDataFrame([(1, "x")], "qid long, arxiv_id string"))
    assert {(r.qid, r.paper_id) for r in left.collect()} == {(1, 3), (2, 1)}


def test_browsing_modes(spark):
    found = spark.createDataFrame([(1, 1, s, p, p, 1.0) for s in (1, 2) for p in range(4)], "qid long, iter int, sq_id int, paper_id long, rank long, score double")
    contents = spark.createDataFrame([(p, "good" if p % 2 else "bad") for p in range(4)], "paper_id long, browsing_content string")
    wants = lambda c: c.where("sq_id = 1 AND paper_id < 2")
    keep = lambda c: c.where("paper_id = 0 AND browsing_content IS NULL OR browsing_content = 'good'")
    kept = lambda mode: sorted((r.sq_id, r.paper_id) for r in workflow.selection(found, keep, workflow.Browsing(mode, contents, wants)).collect())
    assert kept("NONE") == [(1, 0), (2, 0)] and kept("PRE_ENRICH") == [(1, 1), (1, 3), (2, 1), (2, 3)]
    assert kept("INCREMENTAL") == [(1, 0), (1, 1), (2, 0)] and kept("REFRESH") == [(1, 1), (2, 0)]


def test_research_from_model_answers(spark, papers):
    """A planner that answers in text: each answer is asked for once an iteration, and a query ends where its plan is complete."""
    idx = index.build_term_index(papers)
    q = spark.createDataFrame([(1, QUERY, None), (2, QUERY, None)], "qid long, query string, before_date string")
    asked = []

    def ask(i, states):
        asked.append(i)
        plan = '<planner_output>{"subqueries": [{"link_type": "derive", "source_id": 0, "text": "%s", "target_k": 3}], "is_complete": %s}</planner_output>'
        return q.select("qid", F.when((F.col("qid") == 1) & F.lit(i == 2), plan % (QUERY, "true")).otherwise(plan % (QUERY, "false")).alias("response"))

    planner, finished = agents.answering_planner(ask)
    run = workflow.deep_research(idx, q, spark.createDataFrame([(1, 5)], "qid long, paper_id long"), planner, agents.keep_all, 3, finished=finished)
    assert asked == [1, 2, 3]
    assert {(r.qid, r.status) for r in run.status.collect()} == {(1, "complete"), (2, "finished")}
    assert {(r.qid, r.iter) for r in run.states.collect()} == {(1, 1), (2, 1), (2, 2), (2, 3)}
