"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, fim, html_text, langid, licenses, media, mixing, pii, quality, simhash, snapshots, tokens
from tessera.llm.common import crc32_of, table


def op1_license_scan(spark, sf_dir):
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    base = F.expr("filter(detections, d -> d.base)")
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")
    kept = F.expr("filter(detections, d -> d.kept OR d.base)")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"), labels(base).alias("base_labels"), labels(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def op2_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op3_pii_surrogates(spark, sf_dir):
    found = pii.replace_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities.type")), ",").alias("types"))


def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_media_columns(spark, sf_dir):
    return media.read_back(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op8_token_output(spark, sf_dir):
    return tokens.tokenized(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark, sf_dir):
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def later_snapshot(docs):
    """The documents as they stand later: by the crc32 of doc_id, rows dropped, changed, given other keys, or copied."""
    turn = F.coalesce(crc32_of("doc_id") % 16, F.lit(-1))
    other = -1 - F.col("doc_id")
    keys = F.when(turn == 0, F.array().cast("array<long>")).when(turn.isin(3, 4), F.array(other)).when(turn == 5, F.array("doc_id", other)).otherwise(F.array("doc_id"))
    return docs.select(
        F.explode(keys).alias("doc_id"), F.when(turn == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(turn == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(turn == 2, F.col("lang")).when(turn != 4, F.col("source")).alias("source"),
    )


def op12_snapshot_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return snapshots.difference(docs, later_snapshot(docs), "doc_id", "text", ["text", "lang", "source"])


def op13_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_benchmark_decontamination, op3_pii_surrogates, op4_language_id, op5_html_extraction,
        op6_media_columns, op7_source_mixing, op8_token_output, op9_quality_classifier, op10_simhash_near_dedup, op11_fill_in_middle, op12_snapshot_difference,
        op13_byte_bpe, pipeline,
    )
}


#: Words as the contracts state them: A-Z lower-cased, nothing else.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
 b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0) x),
 dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= n) x),
 m AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, win)),
 hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM m) x GROUP BY rid),
 met AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY rid)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hits USING (rid) LEFT JOIN met USING (rid)""",
    "op11_fill_in_middle": """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
 u AS (SELECT doc_id, t, n, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS c2, CAST('0x' || s[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || s[25:32] AS BIGINT) % 100 AS h4 FROM h),
 c AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_snapshot_difference": """WITH e AS (SELECT doc_id AS key, text, lang, source,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
   lambda c, byte: list_reduce(list_prepend(xor(c, byte), list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 16 AS m FROM documents),
 l AS (SELECT unnest(CASE m WHEN 0 THEN [] WHEN 3 THEN [-1 - key] WHEN 4 THEN [-1 - key] WHEN 5 THEN [key, -1 - key] ELSE [key] END) AS key, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
  CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM e),
 k AS (SELECT l.key, e.key AS old_key, e.text AS t1, l.text AS t2, e.lang AS l1, l.lang AS l2, e.source AS s1, l.source AS s2, false AS moved FROM e JOIN l ON e.key = l.key),
 eo AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS i FROM e WHERE key NOT IN (SELECT key FROM l WHERE key IS NOT NULL)),
 lo AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS i FROM l WHERE key NOT IN (SELECT key FROM e WHERE key IS NOT NULL)),
 c AS (SELECT lo.key, eo.key AS old_key, eo.text AS t1, lo.text AS t2, eo.lang AS l1, lo.lang AS l2, eo.source AS s1, lo.source AS s2, true AS moved FROM eo FULL JOIN lo ON eo.text IS NOT DISTINCT FROM lo.text AND eo.i = lo.i),
 r AS (SELECT *, concat_ws(',', CASE WHEN t1 IS DISTINCT FROM t2 THEN 'text' END, CASE WHEN l1 IS DISTINCT FROM l2 THEN 'lang' END, CASE WHEN s1 IS DISTINCT FROM s2 THEN 'source' END) AS diff FROM (SELECT * FROM k UNION ALL SELECT * FROM c) x)
 SELECT coalesce(key, old_key) AS key, old_key, CASE WHEN key IS NULL THEN 'delete' WHEN old_key IS NULL THEN 'insert' WHEN moved THEN 'rekey' WHEN diff = '' THEN 'same' ELSE 'update' END AS op,
 CASE WHEN key IS NULL OR old_key IS NULL THEN '' ELSE diff END AS changed,
 CASE WHEN key IS NOT NULL THEN sha256(coalesce(t2, '~') || chr(10) || coalesce(l2, '~') || chr(10) || coalesce(s2, '~')) END AS row_sha256 FROM r""",
}
