"""Registered queries against their SQL twins, on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", ("op1_suffix_array_dedup", "op4_embedding_near_dedup", "op6_decontamination", "op9_ngram_jaccard_join"))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from kinlink.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    cols = sorted(rel.columns)
    want = sorted(str([dict(zip(rel.columns, r, strict=True))[c] for c in cols]) for r in rel.fetchall())
    df = QUERIES[name](spark, D)
    assert sorted(df.columns) == cols
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want
