"""A cross-section of the queries against their SQL on the smallest tables."""

import duckdb
import pytest

from plumbline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["recall_at_k", "hybrid_rrf_rerank", "answer_em_f1", "parse_citations", "attr_prf_at_k", "leakage_components", "challenge_missing_hop", "amendment_chain_violations", "wilson_interval", "ablation_arc_jsd", "disagreement_reasons", "challenge_evidence_edit", "percentile_arithmetic", "run_key_intersection"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    a = catalog.queries()[name](spark, SF).toPandas()
    b = sql.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda x: sorted(tuple(str(v) for v in r) for r in x[cols].itertuples(index=False, name=None))
    assert rows(a) == rows(b)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_gates_equal_sql(spark, sql):
    got = catalog.queries()["rerank_retention_gates"](spark, SF)
    found = sql.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()['rerank_retention_gates']})").fetchall()
    assert {tuple(r) for r in got.collect()} == set(found) and len(found) == 3
