"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or v != v:
            return ""
        return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_says_what_its_sql_says(spark, duck, sf, name):
    got, wanted = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


#: What no SQL says, and the test that holds it against something else.
ELSEWHERE = {
    "f16_coreference": "test_rules", "g24_ontology_alignment": "test_all_names", "g4_louvain": "test_communities", "v25_agentic_rounds": "test_agentic",
    **{f"op{n}_": f"llm/test_{name}" for n, name in ((2, "text_operators"), (3, "text_operators"), (4, "corpus_operators"), (5, "text_operators"), (6, "corpus_operators"), (7, "text_operators"), (8, "corpus_operators"), (9, "corpus_operators"), (11, "periodic_runs"), (13, "language_model"))},
    "pipeline": "llm/test_corpus_operators",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, sf, name):
    """It has a test of its own, and rows."""
    assert any(name == k or k.endswith("_") and name.startswith(k) for k in ELSEWHERE)
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0
