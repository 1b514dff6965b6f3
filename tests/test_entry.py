"""The driver contract on a tiny scale factor."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 50


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_entry_and_some_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    assert entry.entry(spark).count() > 0
    c = duckdb.connect()
    for t in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    for name in ("bm25_exclude_page2", "gt_rank", "cumulative_metrics", "rank_history", "merged_papers", "resolved_plan", "query_keys"):
        df = entry.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        want = c.sql(entry.oracle_sql()[name])
        at = [want.columns.index(x) for x in columns]
        assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name
