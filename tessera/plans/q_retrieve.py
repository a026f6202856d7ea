"""Queries of the index, retrieval and selection operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import postings as P
from tessera.operators import retrieve as R
from tessera.operators import vectors as V
from tessera.plans.registry import query
from tessera.sources import fixtures as X
from tessera.sources.fixtures import sql
from tessera.storage import new_folder

_TOK = r"[A-Za-z_][A-Za-z0-9_.-]*|[0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]"
_DOCS = f"docs AS (SELECT video_id, doc_id, evidence_type, lower(text) AS low, [lower(x) for x in regexp_extract_all(text, '{_TOK}')] AS tokens FROM evidence WHERE evidence_type <> 'frame' AND text IS NOT NULL)"


def _bm25_docs(spark, d):
    return X.evidence(spark, d).where("evidence_type <> 'frame' AND text IS NOT NULL")


_BM25 = (
    _DOCS
    + f""", post AS (SELECT video_id, doc_id, evidence_type, len(tokens) AS len, unnest(tokens) AS term FROM docs),
 tf AS (SELECT video_id, doc_id, evidence_type, len, term, count(*) AS tf FROM post GROUP BY ALL),
 df AS (SELECT video_id, term, count(*) AS df FROM tf GROUP BY ALL),
 corpus AS (SELECT video_id, count(*) AS n, avg(len(tokens)) AS avgdl FROM docs GROUP BY ALL),
 qt AS (SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(text, '{_TOK}'))) AS term FROM query_texts),
 parts AS (
  SELECT query_id, tf.video_id, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS w
  FROM tf JOIN df USING (video_id, term) JOIN corpus USING (video_id) JOIN qt USING (term) WHERE {{types}}
  UNION ALL SELECT query_id, video_id, doc_id, 0.08::DOUBLE FROM docs, qt WHERE length(term) >= 3 AND contains(low, term) AND {{types}}
  UNION ALL SELECT query_id, video_id, doc_id, 0.2::DOUBLE FROM docs, (SELECT query_id, trim(lower(text)) AS phrase FROM query_texts) q WHERE phrase <> '' AND contains(low, phrase) AND {{types}}),
 sums AS (SELECT query_id, video_id, doc_id, round(sum(w), 9) AS raw FROM parts GROUP BY ALL HAVING round(sum(w), 9) > 0),
 words AS (SELECT query_id, video_id, doc_id, raw, round(raw / max(raw) OVER (PARTITION BY query_id, video_id), 6) AS score, row_number() OVER (PARTITION BY query_id, video_id ORDER BY raw DESC, doc_id) AS rank FROM sums)"""
)


@query("g_bm25", sql("evidence query_texts", _BM25.replace("{types}", "true") + " SELECT * FROM words WHERE rank <= 5"))
def g_bm25(spark, d):
    return R.bm25(_bm25_docs(spark, d), X.query_texts(spark, d), 5)


@query("g_bm25_captions", sql("evidence query_texts", _BM25.replace("{types}", "evidence_type = 'frame_caption'") + " SELECT * FROM words WHERE rank <= 3"))
def g_bm25_captions(spark, d):
    return R.bm25(_bm25_docs(spark, d), X.query_texts(spark, d), 3, ["frame_caption"])


def _index(spark, d):
    """An index of the evidence in a folder of its own."""
    folder = new_folder(spark, "index")
    P.sync(_bm25_docs(spark, d), folder)
    return folder


@query("g_bm25_indexed", sql("evidence query_texts", _BM25.replace("{types}", "true") + " SELECT * FROM words WHERE rank <= 5"))
def g_bm25_indexed(spark, d):
    return P.search(spark, _index(spark, d), X.query_texts(spark, d), 5)


_TERMS = "tf AS (SELECT video_id, doc_id, unnest(tokens) AS term FROM docs), x AS (SELECT video_id, term, count(DISTINCT doc_id) AS df FROM tf GROUP BY 1, 2), c AS (SELECT video_id, count(*) AS n, round(avg(len(tokens)), 6) AS avgdl FROM docs GROUP BY 1) SELECT video_id, n, avgdl, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings, max(df) AS most FROM x JOIN c USING (video_id) GROUP BY 1, 2, 3"


def _index_rows(spark, folder):
    terms = spark.read.parquet(f"{folder}/frequencies").groupBy("video_id").agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.max("df").alias("most"))
    corpora = spark.read.parquet(f"{folder}/corpora").select("video_id", "n", F.round("avgdl", 6).alias("avgdl"))
    return corpora.join(terms, "video_id")


@query("f_postings", sql("evidence", _DOCS + ", " + _TERMS))
def f_postings(spark, d):
    return _index_rows(spark, _index(spark, d))


_LATER = """later AS (SELECT video_id, doc_id, evidence_type, CASE WHEN video_id = (SELECT min(video_id) FROM evidence) THEN text || ' zebra crossing' ELSE text END AS text FROM evidence WHERE video_id <> (SELECT max(video_id) FROM evidence)), """


@query("f_index_sync", sql("evidence", _LATER + _DOCS.replace("FROM evidence", "FROM later") + ", " + _TERMS))
def f_index_sync(spark, d):
    """An index brought up to date after one source has changed and one is gone."""
    docs, folder = _bm25_docs(spark, d), _index(spark, d)
    ends = X.evidence(spark, d).agg(F.min("video_id").alias("_first"), F.max("video_id").alias("_last"))
    later = docs.join(F.broadcast(ends), docs["video_id"] != F.col("_last"))
    P.sync(later.withColumn("text", F.when(F.col("video_id") == F.col("_first"), F.concat("text", F.lit(" zebra crossing"))).otherwise(F.col("text"))), folder)
    return _index_rows(spark, folder)


@query("f_term_stats", sql("evidence", _DOCS + ", tf AS (SELECT video_id, doc_id, unnest(tokens) AS term FROM docs) SELECT video_id, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tf GROUP BY 1, 2"))
def f_term_stats(spark, d):
    return R.term_stats(_bm25_docs(spark, d))[1]


@query("f_evidence_docs", sql("items", "SELECT video_id, video_id || ':' || item_ord || ':speech' AS evidence_id, 'speech' AS evidence_type, length(text) AS n FROM items WHERE trim(text) <> '' UNION ALL SELECT video_id, video_id || ':' || item_ord || ':frame_caption:f' || item_ord, 'frame_caption', length(speaker) FROM items"))
def f_evidence_docs(spark, d):
    items = X.items(spark, d).withColumn("segment_id", F.col("item_ord").cast("string"))
    captions = items.select("video_id", "segment_id", F.concat(F.lit("f"), "segment_id").alias("frame_id"), F.col("speaker").alias("caption"))
    docs = R.evidence_documents(items.withColumnRenamed("text", "transcript_text"), captions)
    return docs.select("video_id", "evidence_id", "evidence_type", F.length("text").cast("long").alias("n"))


_HASH = "words AS (SELECT {key}, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM {source}), b AS (SELECT {key}, ('0x' || substr(sha256(word), 1, 8))::BIGINT % 128 AS bucket, count(*) AS c FROM words GROUP BY ALL)"


@query("f_hash_embed", f"WITH {_HASH.format(key='doc_id', source='documents')} SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM b")
def f_hash_embed(spark, d):
    return R.hash_vectors(X.table(spark, d, "documents"), ["doc_id"]).withColumn("value", F.round("value", 6))


@query("f_tfidf", "WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), x AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS value FROM x")
def f_tfidf(spark, d):
    return R.tfidf_vectors(X.table(spark, d, "benchmark"), "item_id").withColumn("value", F.round("value", 6))


@query("f_embedding_cache", "SELECT count(*) AS misses FROM (SELECT DISTINCT md5(text) AS k FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)) x")
def f_embedding_cache(spark, d):
    docs = X.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    return R.cache_misses(docs, docs.where("doc_id % 2 = 0").select("k").distinct(), "k").agg(F.count("*").alias("misses"))


@query("f_index_diff", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'insert' WHEN doc_id % 7 = 0 THEN 'delete' WHEN doc_id % 3 = 0 THEN 'update' ELSE 'keep' END AS action FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)")
def f_index_diff(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    new = docs.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 3 == 0, F.concat("h", F.lit("x"))).otherwise(F.col("h")))
    return R.index_changes(docs.where("doc_id % 5 <> 0"), new, "doc_id", "h")


@query("f_vector_store", "SELECT count(*) AS n, min(len(embedding)) AS dims, round(avg(sqrt(list_sum([x::DOUBLE * x for x in embedding]))), 4) AS mean_norm FROM embeddings")
def f_vector_store(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return X.table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"), F.round(F.avg(norm), 4).alias("mean_norm"))


@query("f_index_stats", sql("evidence", "SELECT video_id, count(*) AS n, count(*) FILTER (WHERE evidence_type = 'speech') AS n_speech FROM evidence GROUP BY 1"))
def f_index_stats(spark, d):
    return X.evidence(spark, d).groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.col("evidence_type") == "speech").alias("n_speech"))


_VEC = (
    "ev AS (SELECT * FROM evidence WHERE evidence_type <> 'frame'), "
    + _HASH.format(key="video_id, doc_id", source="ev").replace("words", "dw").replace("b AS", "db AS")
    + ", dv AS (SELECT video_id, doc_id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY video_id, doc_id)) AS v FROM db), "
    + _HASH.format(key="query_id", source="query_texts").replace("words", "qw").replace("b AS", "qb AS")
    + ", qv AS (SELECT query_id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS q FROM qb)"
    + ", vs AS (SELECT query_id, video_id, doc_id, round(sum(v * q), 9) AS score FROM dv JOIN qv USING (bucket) GROUP BY ALL)"
    + ", vec AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, doc_id) AS rank FROM vs)"
)


@query("g_vector_topk", sql("evidence query_texts", _VEC + " SELECT query_id, video_id, doc_id, score, rank FROM vec WHERE rank <= 5"))
def g_vector_topk(spark, d):
    return R.hybrid(X.evidence(spark, d), X.query_texts(spark, d), "vector", 5)


_FUSE = """, lists AS (SELECT query_id, video_id, doc_id, rank, 0 AS place FROM vec WHERE rank <= 24 UNION ALL SELECT query_id, video_id, doc_id, rank, 1 FROM words WHERE rank <= 24),
 w AS (SELECT query_id, video_id, doc_id, round(sum(CASE doc_id % 3 WHEN 0 THEN 1.2::DOUBLE ELSE 1.0 END / (60 + rank)), 12) AS w, min(place * 1000000 + rank) AS seen FROM lists GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY w DESC, seen) AS rank, max(w) OVER (PARTITION BY query_id, video_id) AS top FROM w)
 SELECT query_id, video_id, doc_id, round(w / top, 6) AS score, rank FROM r WHERE rank <= 8"""


@query("g_hybrid", sql("evidence query_texts", _BM25.replace("{types}", "true") + ", " + _VEC + _FUSE))
def g_hybrid(spark, d):
    return R.hybrid(X.evidence(spark, d).where("evidence_type <> 'frame' AND text IS NOT NULL"), X.query_texts(spark, d))


_RRF = "va AS (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS rank FROM views), vb AS (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id % 11, vec_id DESC) AS rank FROM views WHERE vec_id % 2 = 0), l AS (SELECT *, 0 AS place FROM va UNION ALL SELECT *, 1 FROM vb), w AS (SELECT cluster_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS w, min(place * 1000000 + rank) AS seen FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, seen) AS rank, max(w) OVER (PARTITION BY cluster_id) AS top FROM w) SELECT cluster_id, vec_id, round(w / top, 6) AS score, rank FROM r WHERE rank <= 10"


@query("g_rrf", sql("views", _RRF))
def g_rrf(spark, d):
    v = X.views(spark, d)
    w = Window.partitionBy("cluster_id")
    a = v.select("cluster_id", "vec_id", F.row_number().over(w.orderBy("vec_id")).alias("rank"))
    b = v.where("vec_id % 2 = 0").select("cluster_id", "vec_id", F.row_number().over(w.orderBy(F.col("vec_id") % 11, F.desc("vec_id"))).alias("rank"))
    return R.reciprocal_rank_fusion([(a, 1.0), (b, 1.0)], ["cluster_id"], "vec_id", 10)


_NEAREST = "WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v, v q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5"


@query("g_vector_store_search", _NEAREST)
def g_vector_store_search(spark, d):
    e = X.table(spark, d, "embeddings")
    return R.dense_top_k(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query("g_vector_cells", _NEAREST)
def g_vector_cells(spark, d):
    e, folder = X.table(spark, d, "embeddings"), new_folder(spark, "cells")
    V.build(e, folder)
    return V.search(spark, folder, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query("g_boosted_cosine", sql("evidence query_texts", _VEC + ", low AS (SELECT doc_id, lower(text) AS t FROM documents), qq AS (SELECT query_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM query_texts) SELECT query_id, video_id, vec.doc_id, score + CASE WHEN len(list_filter(ws, lambda x: contains(t, x))) > 0 THEN 0.05::DOUBLE ELSE 0 END AS score FROM vec JOIN low USING (doc_id) JOIN qq USING (query_id) WHERE rank <= 5"))
def g_boosted_cosine(spark, d):
    top = R.sparse_top_k(X.evidence(spark, d), X.query_texts(spark, d), 5, ["speech", "frame_caption"]).drop("rank")
    q = X.query_texts(spark, d).select("query_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("ws"))
    rows = top.join(X.table(spark, d, "documents").select("doc_id", F.lower("text").alias("t")), "doc_id").join(q, "query_id")
    return rows.select("query_id", "video_id", "doc_id", (F.col("score") + F.when(F.exists("ws", lambda w: F.contains(F.col("t"), w)), 0.05).otherwise(0.0)).alias("score"))


def _mmr_sql(first, later, k=3):
    """Unrolled greedy choice in SQL: c holds candidates with cos to each other."""
    out = "c AS (SELECT cluster_id, vec_id, {rel} AS rel, embedding AS e FROM views)".format(rel=first)
    out += ", p1 AS (SELECT cluster_id, vec_id, e FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(rel, 9) DESC, vec_id) AS rn FROM c) x WHERE rn = 1)"
    for i in range(2, k + 1):
        before = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, i))
        out += f", g{i} AS (SELECT c.cluster_id, c.vec_id, any_value(c.e) AS e, round(any_value(c.rel) - {later} * greatest(0, max(list_cosine_similarity(c.e, s.e))), 9) AS gain FROM c JOIN ({before}) s USING (cluster_id) WHERE c.vec_id NOT IN (SELECT vec_id FROM ({before}) z) GROUP BY c.cluster_id, c.vec_id)"
        out += f", p{i} AS (SELECT cluster_id, vec_id, e FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY gain DESC, vec_id) AS rn FROM g{i}) x WHERE rn = 1)"
    return out + " " + " UNION ALL ".join(f"SELECT cluster_id, vec_id AS item, {i}::BIGINT AS place FROM p{i}" for i in range(1, k + 1))


@query("g_mmr", sql("views", _mmr_sql("1.0::DOUBLE - (vec_id % 17) / 20.0", "0.7::DOUBLE")))
def g_mmr(spark, d):
    c = X.views(spark, d).select("cluster_id", F.col("vec_id").alias("item"), (1.0 - (F.col("vec_id") % 17) / 20.0).alias("relevance"), "embedding")
    return R.mmr(c, "cluster_id", 3)


@query("g_mmr_multimodal")
def g_mmr_multimodal(spark, d):
    kind = F.element_at(F.array(F.lit("speech"), F.lit("frame_caption"), F.lit("frame")), (F.col("vec_id") % 3 + 1).cast("int"))
    c = X.views(spark, d).select("cluster_id", F.col("vec_id").alias("item"), (1.0 - (F.col("vec_id") % 17) / 20.0).alias("relevance"), "embedding", kind.alias("evidence_type"))
    return R.mmr(c, "cluster_id", 3, 0.55, True)


@query("g_multi_query_merge", sql("views", "m AS (SELECT cluster_id, vec_id, max(round((vec_id * 7 + author) % 101 / 100.0, 6)) AS score FROM views GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, vec_id) AS rank FROM m) SELECT cluster_id, vec_id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 6"))
def g_multi_query_merge(spark, d):
    v = X.views(spark, d).select("cluster_id", "vec_id", F.round((F.col("vec_id") * 7 + F.col("author")) % 101 / 100, 6).alias("score"))
    return R.multi_query_merge(v.union(v.withColumn("score", F.col("score") - 0.1)), "cluster_id", "vec_id", 6)


@query("g_coverage_sample", sql("items", "n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM items) SELECT DISTINCT video_id, item_ord FROM n, generate_series(0, 2) g(i) WHERE n <= 3 OR round_even(i * (n - 1) / 2.0, 0) = pos"))
def g_coverage_sample(spark, d):
    return R.coverage_sample(X.items(spark, d), "video_id", ["item_ord"], 3).select("video_id", "item_ord")


@query("g_coverage_merge", sql("items", "n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM items), c AS (SELECT DISTINCT video_id, item_ord, 0 AS part, pos AS o FROM n, generate_series(0, 2) g(i) WHERE n <= 3 OR round_even(i * (n - 1) / 2.0, 0) = pos), r AS (SELECT video_id, item_ord, 1 AS part, row_number() OVER (PARTITION BY video_id ORDER BY length(text) DESC, item_ord) AS o FROM items), f AS (SELECT video_id, item_ord, min(part * 1000 + o) AS o FROM (SELECT * FROM c UNION ALL SELECT * FROM r) x GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY o) AS rn FROM f) SELECT video_id, item_ord FROM p WHERE rn <= 4"))
def g_coverage_merge(spark, d):
    items = X.items(spark, d)
    w = Window.partitionBy("video_id")
    cover = R.coverage_sample(items, "video_id", ["item_ord"], 3).select("video_id", "item_ord", F.row_number().over(w.orderBy("item_ord")).alias("o"))
    found = items.select("video_id", "item_ord", (1000 + F.row_number().over(w.orderBy(F.desc(F.length("text")), "item_ord"))).alias("o"))
    first = cover.union(found).groupBy("video_id", "item_ord").agg(F.min("o").alias("o"))
    return first.withColumn("rn", F.row_number().over(w.orderBy("o"))).where("rn <= 4").select("video_id", "item_ord")


@query("g_query_answer_sets", sql("query_texts", "q AS (SELECT query_id, lower(text) AS t FROM query_texts), a AS (SELECT query_id, list_distinct(string_split(t, ' ')) AS x, list_distinct(string_split(substr(t, 20, 40), ' ')) AS y FROM q) SELECT query_id, round(len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE, 6) AS agreement FROM a"))
def g_query_answer_sets(spark, d):
    from tessera.operators.contract import overlap_coefficient

    q = X.query_texts(spark, d).select("query_id", F.lower("text").alias("t"))
    return q.select("query_id", F.round(overlap_coefficient(F.split("t", " "), F.split(F.substring("t", 20, 40), " ")), 6).alias("agreement"))


@query("s_cosine", "WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def s_cosine(spark, d):
    v = X.table(spark, d, "embeddings").select("vec_id", "embedding")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(b, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("s_has_cjk", sql("asked", "SELECT question_id, regexp_matches(question, '[\\x{4e00}-\\x{9fff}]') AS cjk FROM asked"))
def s_has_cjk(spark, d):
    return X.asked(spark, d).select("question_id", T.has_cjk(F.col("question")).alias("cjk"))


@query("s_unique", sql("stages", "SELECT video_id, string_agg(stage, ',' ORDER BY o) AS stages FROM (SELECT video_id, stage, min(printf('%020d%010d', ts_us, event_id)) AS o FROM stages GROUP BY ALL) x GROUP BY 1"))
def s_unique(spark, d):
    e = X.stages(spark, d)
    first = e.groupBy("video_id", "stage").agg(F.min(F.struct("ts_us", "event_id")).alias("o")).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("o", "stage"))).alias("x"))
    return first.select("video_id", F.array_join(F.transform("x", lambda x: x["stage"]), ",").alias("stages"))
