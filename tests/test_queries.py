"""A few registered queries against their SQL twins, on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"
NAMES = ("match_scan_global", "match_scope_strict", "redecide_preview", "evaluation_metrics", "column_profile", "composite_merge", "manual_review_wide", "value_mapping", "field_scores", "inspect_columns", "ann_topk", "match_auto", "workbook_import", "evaluation_report")


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from kinlink.queries import load

    queries, sql = load()
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    rel = con.sql(sql[name])
    cols = sorted(rel.columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(show(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    df = queries[name](spark, D)
    assert sorted(df.columns) == cols
    assert sorted(tuple(show(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_texts_that_sql_cannot_score(spark):
    """Likeness of all pairs of names, against the same by hand."""
    from difflib import SequenceMatcher

    from kinlink.queries import load

    queries, _ = load()
    ratio = lambda a, b: 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()
    for r in queries["score_fuzzy"](spark, D).collect():
        assert r["score"] == pytest.approx(ratio(r["s"], r["t"]), abs=1e-6)
    for r in queries["score_hybrid"](spark, D).collect():
        a, b = set(r["s"].split()), set(r["t"].split())
        part = 1.0 if r["s"] in r["t"] or r["t"] in r["s"] else 0.0
        assert r["score"] == pytest.approx(max(ratio(r["s"], r["t"]), len(a & b) / len(a | b), part), abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_compatibility_forms_and_sample(spark):
    import hashlib
    import unicodedata

    from pyspark.sql import functions as F

    from kinlink.queries import load

    queries, _ = load()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for r in queries["norm_nfkc"](spark, D).collect():
        assert r["v"] == hashlib.md5(unicodedata.normalize("NFKC", texts[r["doc_id"]]).encode()).hexdigest()
    line = spark.read.parquet(f"{D}/lineitem.parquet").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_partkey").withColumn("h", F.xxhash64(F.lit(20260915), "k")).collect()
    want = sorted((r["h"], r["k"], r["l_partkey"]) for r in line)[:4096]
    got = [(r["k"], r["l_partkey"]) for r in queries["reservoir_sample"](spark, D).collect()]
    assert sorted(got) == sorted(x[1:] for x in want)
