"""Every registered search query against its SQL in DuckDB; the entry module without the corpus subpackage."""

import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from sealframe.plans.queries import QUERIES, SQL
from tests.conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(repr(tuple(r[c] for c in columns)) for r in got.collect()) == Counter(map(repr, want.fetchall()))


def test_bm25_orders_by_relevance(spark, small):
    rows = QUERIES["match_bm25"](spark, small).collect()
    scores = [r["score"] for r in rows]
    assert scores == sorted(scores, reverse=True) and all(s > 0 for s in scores)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    """A copy of the repository without it still imports; an error inside it would not be hidden."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'term_eq' in q and not any(x.startswith('op') or x == 'pipeline' for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
