"""Readers, writers and streams on small files."""

import json
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.sources import batches, readers, writers
from lodestone.streaming import history


def test_paper_db_and_bench(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps({"b": {"arxiv_id": "b", "title": "B", "authors": ["x"]}, "a": {"arxiv_id": "a", "abstract": "A"}}))
    got = readers.paper_db(spark, str(tmp_path / "db.json")).orderBy("ord").collect()
    assert [(r.paper_id, r.ord, r.title, r.abstract, r.authors) for r in got] == [("b", 0, "B", None, ["x"]), ("a", 1, None, "A", None)]
    (tmp_path / "bench.jsonl").write_text("\n".join(json.dumps({"qid": f"q{i}", "query": "x", "gt_label": [1]}) for i in range(5)) + "\n")
    assert [(r.idx, r.qid) for r in readers.bench(spark, str(tmp_path / "bench.jsonl")).orderBy("idx").collect()] == [(i, f"q{i}") for i in range(5)]
    (tmp_path / "pub.jsonl").write_text(json.dumps({"query_id": "q", "query": "x", "gt_arxiv_ids": ["1", "2"], "date_constraint": "2020-05-03", "source": "s"}))
    row = readers.published_bench(spark, str(tmp_path / "pub.jsonl")).first()
    assert ([c.arxiv_id for c in row.cited_paper], row.gt_label, row.date, row.qid) == (["1", "2"], [1, 1], "2020-05", "q")


def test_other_readers(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"id":"1","title":"a\\n b","abstract":"x","authors":"A, B","authors_parsed":[]}\nbad line\n{"title":"no id"}\n')
    assert [(r.title, r.authors) for r in readers.raw_records(spark, str(tmp_path / "raw.jsonl")).collect()] == [("a b", ["A", "B"])]
    for n in ("ref_1", "ref_2"):
        (tmp_path / f"{n}.json").write_text(json.dumps({"1": {"id": n, "title": n}}))
    assert sorted((r.key, r.title) for r in readers.citation_files(spark, str(tmp_path / "ref_*.json")).collect()) == [("ref_1-1", "ref_1"), ("ref_2-1", "ref_2")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m1", json.dumps({"title": "T", "abstract": "A"}))
        z.writestr("m2", "broken")
    assert [tuple(r) for r in readers.zip_members(spark, str(tmp_path / "z.zip")).collect()] == [("m1", "T", "A")]
    (tmp_path / "q1.jsonl").write_text(json.dumps({"qid": "1", "question": "w", "answer_arxiv_id": ["a"]}))
    assert readers.academic_queries(spark, [str(tmp_path / "q1.jsonl"), str(tmp_path / "missing.jsonl")], "A").count() == 1
    feed = "<feed><entry><id>http://arxiv.org/abs/hep-th/9901001v2</id><title>A\n  b</title><summary>s</summary><published>1999-01-02T00:00:00Z</published><author><name>X</name></author><author><name>Y</name></author><category term='c'/></entry></feed>"
    (tmp_path / "a.xml").write_text(feed)
    assert tuple(readers.atom_entries(spark, str(tmp_path / "a.xml")).first()) == ("hep-th/9901001", "A b", "s", "1999-01-02", ["X", "Y"], ["c"])
    (tmp_path / "cache.jsonl").write_text('{"paper_id":"1","model":"m","summary":"old"}\n???\n{"paper_id":"1","model":"m","summary":"new"}\n')
    assert [tuple(r) for r in readers.summary_cache(spark, str(tmp_path / "cache.jsonl")).collect()] == [("1", "m", "new")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    writers.append_new(rows.where("k = 1"), str(tmp_path / "t"), "k")
    writers.append_new(rows, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    writers.json_lines(rows, str(tmp_path / "j"))
    writers.json_lines(rows.withColumn("idx", F.col("k") - 2), str(tmp_path / "j2"), append=True)
    assert readers.checkpoint_rows(spark, str(tmp_path / "j2"), "idx long, v string").count() == 1
    names = spark.createDataFrame([("avg_avg_distance_iter_1", 0.5), ("avg_distance_iter_1", 9.0), ("avg_x", 1.0)], "name string, value double")
    assert {r.key: r.value for r in writers.summary_record(names).collect()} == {"distance_iter_1": 0.5, "x": 1.0}
    made = []

    def build():
        made.append(1)
        return rows, rows

    for _ in range(2):
        assert [t.count() for t in readers.cached_pair(spark, str(tmp_path / "pair"), build)] == [2, 2]
    assert made == [1]


def test_streams(spark, tmp_path):
    """Events in three files, a batch each and out of order: the stream's history is that of all events at once."""
    rng = random.Random(8)
    rows = [(q, p, i, rng.choice([None, *range(200)]), rng.random() < 0.15) for q in (1, 2) for p in range(12) for i in range(1, 6) for _ in range(rng.randrange(3))]
    rng.shuffle(rows)
    schema = "qid long, paper_id long, iter int, rank long, selected boolean"
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = history.latest(history.run_once(history.rank_history(stream), str(tmp_path / "ranks"), "update", str(tmp_path / "c1")))
    want = metrics.rank_history(events.select("qid", "iter", "paper_id", "rank"), events.where("selected"))
    key = lambda df: sorted((r.qid, r.paper_id, r.iter, r["rank"]) for r in df.collect())
    assert key(got) == key(want)
    # A later run goes on from its checkpoint.
    spark.createDataFrame([(1, 0, 9, 0, True), (7, 7, 1, 3, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    again = history.latest(history.run_once(history.rank_history(stream), str(tmp_path / "ranks"), "update", str(tmp_path / "c1")))
    assert {(7, 7, 1, 3), (1, 0, 9, 0)} <= set(key(again)) and len(key(again)) == len(key(got)) + 2
    assert history.run_once(history.exclusions(stream), str(tmp_path / "gone"), "append", str(tmp_path / "c2")).count() == events.where("selected").select("qid", "paper_id").distinct().count() + (0 if events.where("selected AND qid = 1 AND paper_id = 0").count() else 1)


def test_upsert_in_batches(spark, tmp_path):
    """A run that breaks after batch 2 goes on without reading done batches; a later run's rows win; a repeated call writes nothing."""
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(100)], "k long, v string")
    path, seen = str(tmp_path / "table"), []

    def breaking(batch):
        if len(seen) == 2:
            raise RuntimeError("broken off")
        seen.append(sorted(r.k for r in batch.collect()))
        return batch

    with pytest.raises(RuntimeError):
        batches.upsert(rows, path, "k", 1, breaking, 20)
    assert batches.current(spark, path, "k").count() == sum(map(len, seen)) < 100
    left = []
    never = rows.where(F.raise_error(F.lit("the rows are staged")).isNull())  # only a first call reads them
    assert batches.upsert(never, path, "k", 1, lambda b: (left.append(sorted(r.k for r in b.collect())), b)[1], 20) == 3
    assert sorted(sum(seen + left, [])) == list(range(100)) and len(seen) == 2
    assert batches.upsert(never, path, "k", 1, breaking, 20) == 0
    assert batches.upsert(spark.createDataFrame([(5, "new"), (500, "more")], "k long, v string"), path, "k", 2) in (1, 2)
    got = {r.k: r.v for r in batches.current(spark, path, "k").collect()}
    assert len(got) == 101 and got[5] == "new" and got[500] == "more" and got[6] == "v6"




def test_batches_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """A batch meets others under way; when one fails in its task, those are completed and marked, and the next call writes the others only."""
    monkeypatch.setattr(batches, "AT_ONCE", 2, raising=False)
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(200)], "k long, v string")
    path, started = str(tmp_path / "table"), tmp_path / "started"
    started.mkdir()

    def meeting(parts):
        for part in parts:
            (started / str(part.k.min())).touch()
            until = time.time() + 15
            while len(list(started.iterdir())) < 2:
                if time.time() > until:
                    raise RuntimeError("alone")
                time.sleep(0.05)
            if (part.k == 7).any() and not (tmp_path / "mended").exists():
                raise RuntimeError("broken off")
            yield part.assign(v=part.v.str.upper())

    with pytest.raises(Exception, match="broken off"):
        batches.upsert(rows, path, "k", 1, lambda b: b.coalesce(1).mapInPandas(meeting, b.schema), 20)
    marks = len(list((tmp_path / "table" / "done").glob("[0-9]*")))
    assert 0 < marks < 10 and 0 < batches.current(spark, path, "k").where("k <> 7").count() == batches.current(spark, path, "k").count() < 200
    (tmp_path / "mended").touch()
    assert batches.upsert(rows.limit(0), path, "k", 1, lambda b: b.coalesce(1).mapInPandas(meeting, b.schema), 20) == 10 - marks
    assert {(r.k, r.v) for r in batches.current(spark, path, "k").collect()} == {(k, f"V{k}") for k in range(200)}


def test_batches_share_no_local_properties(spark, tmp_path, monkeypatch):
    """Spark changes the properties of a thread in each write, so every write under way has a copy of its own."""
    made, copied = [], batches.inheritable_thread_target
    monkeypatch.setattr(batches, "inheritable_thread_target", lambda f: made.append(1) or copied(f))
    rows = spark.createDataFrame([(k, "v") for k in range(60)], "k long, v string")
    assert batches.upsert(rows, str(tmp_path / "table"), "k", 1, batch_rows=20) == len(made) == 3
