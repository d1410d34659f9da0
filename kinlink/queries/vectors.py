"""Queries of vector operators over all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.functions import vectors as V
from kinlink.operators import retrieval
from kinlink.queries import query

DIM = 64


def emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("vector"))


E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
U = E + ", u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)"
Q = "list_transform(v, lambda x: CAST(greatest(-7, least(7, round_even(x / list_max(list_transform(v, lambda y: abs(y))) * 7, 0))) AS INTEGER))"


@query("vec_normalize", f"WITH {U} SELECT id, round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS n2 FROM u")
def vec_normalize(spark, d):
    n = emb(spark, d).withColumn("v", V.normalize(F.col("vector")))
    return n.select("id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), F.round(V.dot(F.col("v"), F.col("v")), 6).alias("n2"))


@query("quantize_int8", f"WITH {E} SELECT id, array_to_string(list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(x * 127, 0))) AS INTEGER)), ',') AS q FROM e")
def quantize_int8(spark, d):
    return emb(spark, d).select("id", F.array_join(V.int8(F.col("vector")).cast("array<string>"), ",").alias("q"))


@query("quantize_q4", f"WITH {E} SELECT id, array_to_string({Q}, ',') AS q FROM e")
def quantize_q4(spark, d):
    return emb(spark, d).select("id", F.array_join(V.q4(F.col("vector")).cast("array<string>"), ",").alias("q"))


@query("sign_pack", f"WITH {E} SELECT id, array_to_string(list_transform(range(0, 8), lambda b: CAST(list_sum(list_transform(range(0, 8), lambda i: CASE WHEN v[b * 8 + i + 1] >= 0 THEN 1 << i ELSE 0 END)) AS INTEGER)), ',') AS q FROM e")
def sign_pack(spark, d):
    return emb(spark, d).select("id", F.array_join(V.sign_bytes(F.col("vector")).cast("array<string>"), ",").alias("q"))


@query("bbq_coarse_score", f"WITH {E}, q AS (SELECT id, {Q} AS q FROM e), l AS (SELECT vec_id AS id, label FROM embeddings) SELECT a.id AS q_id, count(*) AS n, max(s) AS best, CAST(sum(s) AS BIGINT) AS total FROM (SELECT q.id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q[i] >= 0) = (e.v[i] >= 0) THEN abs(q[i]) ELSE 0 END))::BIGINT AS s FROM q JOIN l lq ON lq.id = q.id JOIN l le ON le.label = lq.label JOIN e ON e.id = le.id) a GROUP BY 1")
def bbq_coarse_score(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", V.doubles(F.col("embedding")).alias("vector"))
    return retrieval.coarse_within_labels(e, DIM)


KNN = f"WITH {U}, s AS (SELECT a.id AS q_id, b.id AS t_id, round(list_inner_product(a.v, b.v), 6) AS similarity FROM u a, u b) SELECT q_id, t_id, similarity, CAST(row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, t_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"


@query("knn_exact_topk", KNN)
def knn_exact_topk(spark, d):
    return retrieval.topk(emb(spark, d), emb(spark, d), 10, DIM).select("q_id", "t_id", "similarity", "rank")


COARSE = "CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: CASE WHEN (a.q[i] >= 0) = (b.v[i] >= 0) THEN abs(a.q[i]) ELSE 0 END)) AS BIGINT)"
FINE = "round(list_inner_product(a.v, list_transform(b.v, lambda x: greatest(-127, least(127, round_even(x * 127, 0))) / 127.0)), 6)"
W = f"w AS (SELECT id, v, {Q} AS q FROM u)"
TWO = f"WITH {U}, {W}, c AS (SELECT a.id AS q_id, b.id AS t_id, {COARSE} AS coarse, {FINE} AS similarity FROM w a, u b), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY coarse DESC, t_id) <= 40) SELECT q_id, t_id, coarse, similarity, CAST(row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, t_id) AS INTEGER) AS rank FROM k QUALIFY rank <= 10"


@query("bbq_two_stage_topk", TWO)
def bbq_two_stage_topk(spark, d):
    return retrieval.topk(emb(spark, d), emb(spark, d), 10, DIM, oversample=4).select("q_id", "t_id", "coarse", "similarity", "rank")


@query("knn_recall", f"WITH a AS ({TWO}), x AS ({KNN}), p AS (SELECT x.q_id, max(CASE WHEN x.rank = 1 AND a.rank = 1 THEN 1 ELSE 0 END) AS top1, " + ", ".join(f"count(*) FILTER (x.rank <= {k} AND a.rank <= {k}) / count(*) FILTER (x.rank <= {k}) AS r{k}" for k in (1, 3, 5, 10)) + " FROM x LEFT JOIN a ON a.q_id = x.q_id AND a.t_id = x.t_id GROUP BY 1) SELECT count(*) AS queries, round(avg(top1), 6) AS top1_hit_rate, " + ", ".join(f"round(avg(r{k}), 6) AS recall_at_{k}" for k in (1, 3, 5, 10)) + " FROM p")
def knn_recall(spark, d):
    return retrieval.recall(bbq_two_stage_topk(spark, d), knn_exact_topk(spark, d))


CODES = "[" + ", ".join("[" + ", ".join(map(str, p)) + "]" for p in V.lsh_positions(DIM)) + "]"
BUCKETS = f'buckets AS (SELECT id, CAST(t - 1 AS INTEGER) AS "table", CAST(list_sum(list_transform(range(1, 17), lambda j: CASE WHEN v[p[t][j] + 1] >= 0 THEN 1 << (j - 1) ELSE 0 END)) AS INTEGER) AS code FROM e, (SELECT {CODES} AS p), range(1, 49) r(t))'


@query("lsh_buckets", f'WITH {E}, {BUCKETS} SELECT id, "table", code FROM buckets')
def lsh_buckets(spark, d):
    return retrieval.lsh_buckets(emb(spark, d), DIM)


@query("lsh_candidates", f'WITH {E}, {BUCKETS}, probes AS (SELECT id AS q_id, "table", unnest([code] || list_transform(range(0, 16), lambda j: xor(code, CAST(1 << j AS INTEGER)))) AS code FROM buckets), h AS (SELECT q_id, id AS t_id, count(*) AS n_tables FROM probes JOIN buckets USING ("table", code) GROUP BY 1, 2) SELECT q_id, count(*) AS pool, CAST(sum(n_tables) AS BIGINT) AS hits FROM h GROUP BY 1')
def lsh_candidates(spark, d):
    return retrieval.lsh_candidates(emb(spark, d), emb(spark, d), DIM).groupBy("q_id").agg(F.count("*").alias("pool"), F.sum("n_tables").alias("hits"))


PROBES = 'probes AS (SELECT id AS q_id, "table", unnest([code] || list_transform(range(0, 16), lambda j: xor(code, CAST(1 << j AS INTEGER)))) AS code FROM buckets)'


@query("ann_topk", f'WITH {U}, {BUCKETS}, {PROBES}, sizes AS (SELECT "table", code, count(*) AS size FROM buckets GROUP BY 1, 2), occ AS (SELECT q_id, coalesce(sum(size), 0) AS n FROM probes LEFT JOIN sizes USING ("table", code) GROUP BY 1), fit AS (SELECT q_id FROM occ WHERE n > 0 AND n <= 1074), h AS (SELECT DISTINCT q_id, id AS t_id, false AS scanned FROM probes JOIN buckets USING ("table", code) WHERE q_id IN (SELECT q_id FROM fit) UNION ALL SELECT u.id, e.id, true FROM u, e WHERE u.id NOT IN (SELECT q_id FROM fit)), {W}, c AS (SELECT q_id, t_id, scanned, {COARSE} AS coarse, {FINE} AS similarity FROM h JOIN w a ON a.id = q_id JOIN u b ON b.id = t_id), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY coarse DESC, t_id) <= 40) SELECT q_id, t_id, coarse, similarity, scanned, CAST(row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, t_id) AS INTEGER) AS rank FROM k QUALIFY rank <= 10')
def ann_topk(spark, d):
    return retrieval.ann_topk(emb(spark, d), emb(spark, d), 10, DIM, limit=50)


@query("vector_index_rows", f"WITH {U}, l AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS group_code FROM embeddings WHERE vec_id % 7 > 0) SELECT id, group_code, array_to_string(list_transform(range(0, 8), lambda b: CAST(list_sum(list_transform(range(0, 8), lambda i: CASE WHEN v[b * 8 + i + 1] >= 0 THEN 1 << i ELSE 0 END)) AS INTEGER)), ',') AS signs, array_to_string(list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(x * 127, 0))) AS INTEGER)), ',') AS int8 FROM l JOIN u USING (id)")
def vector_index_rows(spark, d):
    t = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("group_code"), F.when(F.col("vec_id") % 7 > 0, "text").otherwise("").alias("text"), F.col("embedding").alias("vector"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return retrieval.index_rows(t, DIM).select("id", "group_code", join("signs"), join("int8"))


@query("cache_rekey", "WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND text <> ''), f AS (SELECT text IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL) AS old, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) AS new FROM t) SELECT count(*) AS unique_texts, count(*) FILTER (old) AS legacy_vectors_found, count(*) FILTER (NOT old) AS legacy_vectors_missing, count(*) FILTER (old AND NOT new) AS migrated, count(*) FILTER (old AND new) AS already_present FROM f")
def cache_rekey(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda df, scope: df.where("text is not null").select(retrieval.text_key(F.col("text"), scope).alias("key"), F.array(F.lit(0.0)).alias("vector")).dropDuplicates(["key"])
    cache = key(t.where("lang = 'en'"), "old").unionByName(key(t.where("doc_id % 3 = 0"), "new"))
    return retrieval.cache_rekey(t, cache, "old", "new")[1]


HEX = "list_transform(range(0, 32), lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS INTEGER) / 127.5 - 1)"


@query("embed_deterministic", f"WITH t AS (SELECT doc_id, sha256(encode(text) || '\\x00\\x00\\x00\\x00'::BLOB) AS h FROM documents), r AS (SELECT doc_id, {HEX} AS v FROM t) SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[32] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM r")
def embed_deterministic(spark, d):
    v = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", V.deterministic_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[31], 6).alias("last"))


@query("embedding_cache_misses", "SELECT DISTINCT sha256('\\x00'::BLOB || encode(text)) AS key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def embedding_cache_misses(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    key = F.sha2(F.concat(F.lit(b"\x00"), F.encode("text", "UTF-8")), 256).alias("key")
    return retrieval.cache_misses(t, t.where("lang = 'en'").select(key)).select("key")


@query("embedding_degenerate_check", f"WITH {E}, s AS (SELECT i, stddev_pop(v[i]) AS s, count(*) AS n FROM e, range(1, 65) r(i) GROUP BY 1) SELECT max(n) AS row_count, round(max(s), 6) AS largest_std, max(n) >= 8 AND max(s) < 1e-8 AS degenerate FROM s")
def embedding_degenerate_check(spark, d):
    return retrieval.degenerate(emb(spark, d), DIM)


NAMES = f"names AS (SELECT name, list_transform({HEX}, lambda x: x / n) AS v FROM (SELECT name, h, sqrt(list_sum(list_transform({HEX}, lambda x: x * x))) AS n FROM (SELECT DISTINCT p_name AS name, sha256(encode(p_name) || '\\x00\\x00\\x00\\x00'::BLOB) AS h FROM part)))"
CATALOG = "catalog AS (SELECT min(p_partkey) AS t_ord, CAST(min(p_partkey) AS VARCHAR) AS group_code, p_name AS t_name, p_brand AS t_brand FROM part GROUP BY p_name, p_brand)"
SEMANTIC = "f AS (SELECT p_partkey AS s_ord, t_ord, group_code, CASE WHEN p_brand = t_brand THEN round(greatest(0, least(1, similarity)) * 100, 4) ELSE 0.0 END AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY s_ord ORDER BY score DESC, t_ord) AS rank FROM f) SELECT s_ord, CASE WHEN score >= 60 THEN 'MATCHED' WHEN score > 0 THEN 'REVIEW' ELSE 'UNMATCHED' END AS status, score AS top1_score, group_code AS top1_group_code FROM r WHERE rank = 1"


def semantic_config():
    from kinlink.config import Decision, MatchConfig, Retrieval, Rule, Side

    name, brand = Side(columns=("p_name",)), Side(columns=("p_brand",))
    return MatchConfig(rules=(Rule("text", name, name, "semantic", 100), Rule("brand", brand, brand, "exact", 0, veto_threshold=50)), group_code_column="group_code", decision=Decision(success_threshold=60), retrieval=Retrieval(top_k=20, source=name, target=name))


@query("score_semantic", f"WITH {NAMES}, {CATALOG}, s AS (SELECT a.name AS a, b.name AS b, round(list_inner_product(a.v, b.v), 6) AS similarity FROM names a, names b), h AS (SELECT p_partkey, p_brand, catalog.*, similarity FROM part JOIN s ON a = p_name JOIN catalog ON t_name = b QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY similarity DESC, t_ord) <= 20), {SEMANTIC}")
def score_semantic(spark, d):
    """Parts against the catalog by retrieved neighbours of deterministic embeddings of their names; another brand vetoes."""
    from kinlink.plans import matching
    from kinlink.queries.linkage import catalog, parts

    s = parts(spark, d).select(F.col("p_partkey").alias("id"), V.deterministic_embedding(F.col("p_name")).alias("vector"))
    t = catalog(spark, d).select(F.col("row_ordinal").alias("id"), V.deterministic_embedding(F.col("p_name")).alias("vector"))
    hits = retrieval.topk(s, t, 20, 32).select(F.col("q_id").alias("s_ord"), F.col("t_id").alias("t_ord"), "similarity")
    return matching.match_with_vectors(parts(spark, d), catalog(spark, d), semantic_config(), hits, "p_partkey", "row_ordinal")[0].select("s_ord", "status", "top1_score", "top1_group_code")


@query("match_auto", f"WITH {NAMES}, {CATALOG}, w AS (SELECT name, v, {Q} AS q FROM names), s AS (SELECT a.name AS a, b.name AS b, {COARSE} AS coarse, {FINE} AS similarity FROM w a, names b), k AS (SELECT p_partkey, p_brand, catalog.*, similarity FROM part JOIN s ON a = p_name JOIN catalog ON t_name = b QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY coarse DESC, t_ord) <= 80), h AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY similarity DESC, t_ord) <= 20), {SEMANTIC}")
def match_auto(spark, d):
    """The same by the router: semantic rules take the two-stage retrieval."""
    from kinlink.plans import matching
    from kinlink.queries.linkage import catalog, parts

    return matching.match_auto(parts(spark, d), catalog(spark, d), semantic_config(), V.deterministic_embedding, 32, "p_partkey", "row_ordinal")[0].select("s_ord", "status", "top1_score", "top1_group_code")
