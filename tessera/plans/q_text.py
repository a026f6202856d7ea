"""Queries of the parsers, text functions and routing rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import routing as R
from tessera.functions import text as T
from tessera.functions import timeparse as P
from tessera.plans.registry import query
from tessera.sources import adapters as A
from tessera.sources import fixtures as X
from tessera.sources import subtitles as S
from tessera.sources.fixtures import sql

_TOK = r"[A-Za-z_][A-Za-z0-9_.-]*|[0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]"
_BASE = f"[lower(x) for x in regexp_extract_all(text, '{_TOK}')]"


_CLOCK = "[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]+)?"


@query("a_parse_timestamp", f"""WITH s AS (SELECT stamp_id, 'raw' AS part, raw AS stamp FROM stamps UNION ALL SELECT stamp_id, 'clock', regexp_extract(raw, '{_CLOCK}') FROM stamps UNION ALL SELECT stamp_id, 'comma', regexp_extract(raw, '{_CLOCK}') || ',250' FROM stamps),
 p AS (SELECT *, list_transform(string_split(replace(stamp, ',', '.'), ':'), lambda x: TRY_CAST(x AS DOUBLE)) AS n FROM s)
 SELECT stamp_id, part, stamp, coalesce(CASE len(n) WHEN 3 THEN n[1] * 3600 + n[2] * 60 + n[3] WHEN 2 THEN n[1] * 60 + n[2] END, 0)::DOUBLE AS seconds FROM p""")
def a_parse_timestamp(spark, d):
    """Times as text: as they are, their clock part, and that with milliseconds after a comma."""
    rows = X.table(spark, d, "stamps").select("stamp_id", "raw", F.regexp_extract("raw", f"({_CLOCK})", 1).alias("clock"))
    parts = rows.select("stamp_id", F.expr("stack(3, 'raw', raw, 'clock', clock, 'comma', concat(clock, ',250')) AS (part, stamp)"))
    return parts.withColumn("seconds", P.subtitle_seconds(F.col("stamp")))


def _clock(ms, mark):
    h, m, s = F.floor(ms / 3600000), F.floor(F.pmod(ms, F.lit(3600000)) / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h.cast("long"), m.cast("long"), s.cast("long"), F.pmod(ms, F.lit(1000)).cast("long"))


def _subtitle_files(spark, d, mark):
    """Subtitle files made from transcript items, one a source."""
    block = F.concat(F.col("item_ord").cast("string"), F.lit("\n"), _clock(F.col("start_ms"), mark), F.lit(" --> "), _clock(F.col("end_ms"), mark), F.lit("\n<i>"), T.collapse(F.col("text")), F.lit("</i>"))
    rows = X.items(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("item_ord", block.alias("b")))).alias("x"))
    return rows.select("video_id", F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias("content"))


_PARSED = sql("items", r"SELECT video_id, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM items WHERE trim(text) <> ''")


@query("a_parse_vtt", _PARSED)
def a_parse_vtt(spark, d):
    return S.parse_blocks(_subtitle_files(spark, d, ".")).select("video_id", F.round("start", 3).alias("start_s"), F.round("end", 3).alias("end_s"), "text")


@query("a_parse_srt", _PARSED)
def a_parse_srt(spark, d):
    return S.parse_blocks(_subtitle_files(spark, d, ",")).select("video_id", F.round("start", 3).alias("start_s"), F.round("end", 3).alias("end_s"), "text")


@query("a_parse_json3", sql("items", r"SELECT video_id, start_ms / 1000.0::DOUBLE AS start_s, start_ms / 1000.0::DOUBLE + (end_ms - start_ms) / 1000.0::DOUBLE AS end_s, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM items WHERE trim(text) <> ''"))
def a_parse_json3(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    segs = F.array(F.struct(F.substring(F.col("text"), F.lit(1), half).alias("utf8")), F.struct(F.substring(F.col("text"), half + 1, F.length("text")).alias("utf8")))
    event = F.struct("item_ord", F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"), segs.alias("segs"))
    files = X.items(spark, d).groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(event)).alias("events"))).alias("content"))
    return S.parse_json3(files).select("video_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text")


@query("a_subtitle_dispatch", "SELECT page_id, path, CASE lower(regexp_extract(path, '\\.[A-Za-z0-9]+$')) WHEN '.json3' THEN 'json3' WHEN '.vtt' THEN 'vtt' WHEN '.srt' THEN 'srt' END AS kind FROM (SELECT page_id, url || ['', '.json3', '.VTT', '.en.srt', '.ass', '.vtt?x'][1 + page_id % 6] AS path FROM pages) p")
def a_subtitle_dispatch(spark, d):
    """Addresses as paths, with the suffixes that files come with, and without."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", ".json3", ".VTT", ".en.srt", ".ass", ".vtt?x")]), (F.col("page_id") % 6 + 1).cast("int"))
    return X.table(spark, d, "pages").select("page_id", F.concat("url", suffix).alias("path")).withColumn("kind", S.subtitle_kind(F.col("path")))


@query("a_clean_markup", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def a_clean_markup(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text"))


@query("a_url_video_id", "SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{6,})', 1), ''), nullif(regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]{6,})', 1), ''), nullif(regexp_extract(url, '/(?:shorts|embed)/([A-Za-z0-9_-]{6,})', 1), ''), substr(sha1(url), 1, 12)) AS video_id FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://v.example.com/watch?v=abc_' || page_id || 'xyz' ELSE 'https://v.example.com/shorts/id' || page_id || '-9999' END AS url FROM pages) x")
def a_url_video_id(spark, d):
    page = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://v.example.com/watch?v=abc_"), page, F.lit("xyz"))).otherwise(F.concat(F.lit("https://v.example.com/shorts/id"), page, F.lit("-9999")))
    return X.table(spark, d, "pages").select("page_id", A.url_video_id(url).alias("video_id"))


@query("a_url_safety", "SELECT page_id, page_id % 4 = 0 AS safe FROM pages")
def a_url_safety(spark, d):
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, "http://user:pw@example.com/x").when(k == 2, "http://127.0.0.1:80/").otherwise("ftp://example.com/y")
    return X.table(spark, d, "pages").select("page_id", A.url_safe(url).alias("safe"))


@query("a_content_hash", "SELECT doc_id, 'local_' || substr(sha1(text), 1, 12) AS content_id FROM documents")
def a_content_hash(spark, d):
    return X.table(spark, d, "documents").select("doc_id", A.content_hash_id(F.col("text")).alias("content_id"))


@query("a_eval_case_aliases", "SELECT CAST(item_id AS VARCHAR) AS case_id, 'v' || (item_id % 5) AS video_id, text AS question, lower(text) AS answers, 'e' || item_id || '|f' AS evidence_ids FROM benchmark")
def a_eval_case_aliases(spark, d):
    b = X.table(spark, d, "benchmark")
    q, a, ids = F.col("text"), F.lower("text"), F.array(F.concat(F.lit("e"), F.col("item_id").cast("string")), F.lit("f"))
    video = F.concat(F.lit("v"), (F.col("item_id") % 5).cast("string"))
    one = F.to_json(F.struct(F.col("item_id").cast("string").alias("case_id"), video.alias("video_id"), q.alias("question"), a.alias("answer"), ids.alias("evidence_ids")))
    two = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), video.alias("video"), q.alias("query"), F.array(a).alias("gold_answer"), ids.alias("segment_ids")))
    cases = A.eval_cases(b.select(F.when(F.col("item_id") % 2 == 0, one).otherwise(two).alias("value")))
    return cases.select("case_id", "video_id", "question", F.array_join("answers", "|").alias("answers"), F.array_join("evidence_ids", "|").alias("evidence_ids"))


@query("a_error_classify", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'cookie|sign in|login|bot') THEN 'auth' WHEN regexp_matches(lower(text), 'timeout|timed out|temporarily|connection') THEN 'network' WHEN regexp_matches(lower(text), '404|unavailable|private|removed') THEN 'unavailable' ELSE 'unknown' END AS class FROM (SELECT conv_id, turn, text || ['', ' Sign in', ' timed out', ' 404'][1 + turn % 4] AS text FROM conversations) c")
def a_error_classify(spark, d):
    """Turns of conversations as messages of a downloader, some with its words at their end."""
    ends = F.element_at(F.array(*[F.lit(x) for x in ("", " Sign in", " timed out", " 404")]), (F.col("turn") % 4 + 1).cast("int"))
    return X.table(spark, d, "conversations").select("conv_id", "turn", A.error_class(F.concat("text", ends)).alias("class"))


@query("a_frames_from_sequence", sql("frames", "SELECT video_id, frame_id, CAST(round(5.0 + (row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1) / 2.0, 6) AS DOUBLE) AS ts, printf('f_%010d', 5000 + (row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1) * 500) AS frame_name FROM frames"))
def a_frames_from_sequence(spark, d):
    return A.frames_from_sequence(X.frames(spark, d).select("video_id", "frame_id"), "video_id", "frame_id", 2.0, 5.0).select("video_id", "frame_id", F.round("timestamp", 6).alias("ts"), "frame_name")


@query("a_upsert", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1")
def a_upsert(spark, d):
    e = X.table(spark, d, "events").select("user_id", "event_type", "event_id")
    return A.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("a_notes", sql("items", "SELECT video_id, string_agg('- ' || speaker || ': ' || substr(text, 1, 30), chr(10) ORDER BY item_ord) AS note FROM items GROUP BY video_id"))
def a_notes(spark, d):
    return A.notes(X.items(spark, d), "video_id", "item_ord", F.concat(F.lit("- "), F.col("speaker"), F.lit(": "), F.substring("text", 1, 30)))


@query("a_file_name", "SELECT page_id, substr(trim(regexp_replace(url, '[\\\\/:*?\"<>|\\r\\n]+', '_', 'g')), 1, 80) AS name FROM pages")
def a_file_name(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


@query("a_raw_counts", "SELECT 'conversations' AS name, count(*) AS n FROM conversations UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def a_raw_counts(spark, d):
    parts = [X.table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("conversations", "documents", "events", "pages")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("a_trace", sql("items", "SELECT video_id, CAST(count(*) AS BIGINT) AS n, string_agg(substr(text, 1, 50), '|' ORDER BY item_ord) FILTER (WHERE rn <= 5) AS head FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) AS rn FROM items) x GROUP BY video_id"))
def a_trace(spark, d):
    rows = X.items(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("item_ord", F.substring("text", 1, 50).alias("t")))).alias("x"))
    return rows.select("video_id", F.size("x").cast("long").alias("n"), F.array_join(F.transform(F.slice("x", 1, 5), lambda e: e["t"]), "|").alias("head"))


@query("b_tokenize", f"WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -question_id, question FROM ({X.SQL['questions']}) q), b AS (SELECT id, {_BASE} AS base FROM t), c AS (SELECT id, base, [x for x in base if regexp_full_match(x, '[\\x{{4e00}}-\\x{{9fff}}]')] AS cjk FROM b) SELECT id, array_to_string(list_concat(base, [cjk[i] || cjk[i + 1] for i in generate_series(1, len(cjk) - 1)]), ' ') AS tokens FROM c")
def b_tokenize(spark, d):
    rows = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").union(X.questions(spark).select(-F.col("question_id"), "question"))
    return rows.select("id", F.array_join(T.tokenize("text"), " ").alias("tokens"))


@query("b_normalize_text", r"SELECT doc_id, trim(regexp_replace(replace(replace(text || ' 复火 晴天珠', '晴天珠', '擎天柱'), '复火', '复活'), '\s+', ' ', 'g')) AS text FROM documents")
def b_normalize_text(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.normalize_asr(F.concat(F.col("text"), F.lit(" 复火 晴天珠"))).alias("text"))


@query("b_keywords", "WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}|[\\x{4e00}-\\x{9fff}]{2,}'))) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ('这个', '我们', '一个', '以及', '然后', '所以', 'the', 'and', 'that', 'with', 'for') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rn FROM c) SELECT doc_id, string_agg(word, ' ' ORDER BY rn) AS keywords FROM r WHERE rn <= 8 GROUP BY doc_id")
def b_keywords(spark, d):
    return T.keywords(X.table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", F.array_join("keywords", " ").alias("keywords"))


@query("b_entities")
def b_entities(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.array_join(T.entities("text"), "|").alias("entities"))


_MARK = " OR ".join(f"contains(lower(text), '{m}')" for m in T.TOPIC_MARKERS)


@query("b_topic_marker", sql("items", f"SELECT video_id, item_ord, {_MARK} AS marker FROM items"))
def b_topic_marker(spark, d):
    return X.items(spark, d).select("video_id", "item_ord", T.has_topic_marker(F.col("text")).alias("marker"))


@query("b_alias_replace", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '([^A-Za-z0-9])', ' \\1 ', 'g'), '(?i)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])', '\\1DEF\\2', 'g'), ' ([^A-Za-z0-9]) ', '\\1', 'g')) AS text, CAST(len(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9])', ' \\1 ', 'g'), '(?i)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])')) AS BIGINT) AS n FROM documents")
def b_alias_replace(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.trim(T.replace_alias(F.col("text"), "the", "DEF")).alias("text"), T.count_alias(F.col("text"), "the").cast("long").alias("n"))


@query("b_entity_merge", "WITH e AS (SELECT lower(event_type) AS key, event_type || (user_id % 3) AS alias, event_type, value FROM events) SELECT key, max(value) AS confidence, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM e GROUP BY key")
def b_entity_merge(spark, d):
    from tessera.operators.entities import merge_entities

    e = X.table(spark, d, "events").select(F.col("event_type").alias("canonical"), F.array(F.concat("event_type", (F.col("user_id") % 3).cast("string"))).alias("aliases"), F.col("value").alias("confidence"))
    return merge_entities(e).select("key", "confidence", F.array_join("aliases", ",").alias("aliases"))


#: Aliases that occur in the texts: of a confident entity, one that needs review, one that is its name in another case, one that is not Latin.
ENTITIES = [("Theseus", ["the", "thst", "the a"], 0.96), ("Queen", ["que"], 0.88), ("Error", ["erer"], 0.6), ("Der", ["DER"], 0.99), ("Ügen", ["ü"], 0.85)]
_APART = r"regexp_replace(text, '([^A-Za-z0-9])', ' \1 ', 'g')"


def _replaced(said: str, alias: str, canonical: str) -> str:
    """SQL for the replacement of a whole Latin token in a text whose separators stand apart."""
    spaced = alias.replace(" ", "   ")
    return f"regexp_replace({said}, '(?i)(^|[^A-Za-z0-9]){spaced}($|[^A-Za-z0-9])', '\\1{canonical}\\2', 'g')"


def _met(said: str, alias: str) -> str:
    return f"regexp_matches({said}, '(?i)(^|[^A-Za-z0-9]){alias.replace(' ', '   ')}($|[^A-Za-z0-9])')"


_ENTITY_STEPS = [("thst", "Theseus", "0.96"), ("the a", "Theseus", "0.96"), ("the", "Theseus", "0.96"), ("que", "Queen", "0.88")]


def _entity_sql() -> str:
    out, before = f"t0 AS (SELECT doc_id, text AS raw, {_APART} AS said, '' AS found FROM documents)", "t0"
    order = sorted(_ENTITY_STEPS[:3], key=lambda s: (-len(s[0]), s[0])) + _ENTITY_STEPS[3:]
    for i, (alias, canonical, _) in enumerate(order, 1):
        out += f", t{i} AS (SELECT doc_id, raw, {_replaced('said', alias, canonical)} AS said, found || CASE WHEN {_met('said', alias)} THEN '{alias}>{canonical};' ELSE '' END AS found FROM {before})"
        before = f"t{i}"
    joined = "regexp_replace(said, ' ([^A-Za-z0-9]) ', '\\1', 'g')"
    return f"WITH {out}, u AS (SELECT doc_id, raw, {joined} AS text, found FROM {before}) SELECT doc_id, regexp_replace(text, '(?i)ü', 'Ügen', 'g') AS text, found || CASE WHEN regexp_matches(text, '(?i)ü') THEN 'ü>Ügen;' ELSE '' END AS found, coalesce(regexp_replace(text, '(?i)ü', 'Ügen', 'g') <> raw, false) AS applied FROM u"


@query("b_entity_normalize", _entity_sql())
def b_entity_normalize(spark, d):
    from tessera.operators.entities import normalize_entities

    rows = normalize_entities(X.table(spark, d, "documents").select("doc_id", "text"), ENTITIES)
    found = F.array_join(F.transform("replacements", lambda x: F.concat(x["raw"], F.lit(">"), x["canonical"], F.lit(";"))), "")
    return rows.select("doc_id", "text", F.when(F.col("raw").isNotNull(), found).alias("found"), "applied")


def _titles(spark, d):
    """Titles are the first words of every fiftieth document of a source."""
    docs = X.table(spark, d, "documents")
    return docs.where("doc_id % 50 = 0 AND text IS NOT NULL").select(F.col("source").alias("video_id"), F.regexp_extract("text", "([A-Za-z]{4,}(?: [A-Za-z]{4,})?)", 1).alias("title")).where("title <> ''").distinct()


@query("b_fuzzy_alias")
def b_fuzzy_alias(spark, d):
    from tessera.operators.entities import infer_aliases

    return infer_aliases(_titles(spark, d), X.table(spark, d, "documents").select(F.col("source").alias("video_id"), "text"))


@query("b_source_normalize")
def b_source_normalize(spark, d):
    """Every document by the names of its source's titles, whose aliases are the names most like them."""
    from tessera.operators.entities import infer_aliases, normalize_by_source

    docs = X.table(spark, d, "documents").select(F.col("source").alias("video_id"), "doc_id", "text")
    near = infer_aliases(_titles(spark, d), docs, 0.85)
    entities = near.groupBy("video_id", "canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.max("ratio").alias("confidence")).withColumn("pos", F.col("canonical"))
    return normalize_by_source(docs, entities).select("video_id", "doc_id", "text", "applied", F.transform("replacements", lambda r: F.concat(r["raw"], F.lit(">"), r["canonical"])).alias("replacements"))


@query("b_format_timestamp", sql("items", "SELECT video_id, item_ord, printf('[%02d:%02d:%02d]', s // 3600, s % 3600 // 60, s % 60) AS stamp FROM (SELECT video_id, item_ord, start_ms // 1000 AS s FROM items) x"))
def b_format_timestamp(spark, d):
    return X.items(spark, d).select("video_id", "item_ord", T.format_timestamp(F.col("start_ms") / 1000).alias("stamp"))


@query("b_shorten", r"SELECT doc_id, CASE WHEN length(p) <= 60 THEN p ELSE rtrim(substr(p, 1, 59)) || '...' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM documents) x")
def b_shorten(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.shorten(F.col("text"), 60).alias("short"))


@query("b_escape_html", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM pages")
def b_escape_html(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("html"))


#: Seconds of a clock in SQL, and the grammars without look-ahead: what may not follow is matched on a text whose other characters stand twice.
_SECONDS = "list_reduce([x::DOUBLE for x in regexp_split_to_array({c}, '[:：]')], lambda a, b: a * 60 + b)"
_RANGE_SQL = P.RANGE.replace("(?i)", "")
_TWICE = "regexp_replace(rest, '([^0-9:：])', '\\1\\1', 'g')"
TIMES_SQL = f"""q0 AS (SELECT question_id, question, regexp_replace(question, '(?i){_RANGE_SQL}', ' ', 'g') AS rest, regexp_extract_all(question, '(?i){_RANGE_SQL}', 1) AS ra, regexp_extract_all(question, '(?i){_RANGE_SQL}', 2) AS rb FROM asked),
 q1 AS (SELECT *, regexp_extract_all({_TWICE}, '(?:^|[^0-9])((?:[0-9]{{1,2}}[:：])?[0-9]{{1,2}}[:：][0-9]{{2}})(?:[^0-9]|$)', 1) AS clocks, regexp_extract_all(rest, '{P.UNIT}', 1) AS nums, regexp_extract_all(rest, '{P.UNIT}', 2) AS units FROM q0),
 times AS (SELECT question_id, question, list_concat([{_SECONDS.format(c="c")} for c in clocks], [nums[i]::DOUBLE * CASE WHEN regexp_matches(units[i], '(?i)^(分钟|minute)') THEN 60 ELSE 1 END for i in generate_series(1, len(nums))]) AS points,
  list_filter([{{'a': {_SECONDS.format(c="ra[i]")}, 'b': {_SECONDS.format(c="rb[i]")}}} for i in generate_series(1, len(ra))], lambda p: p.b >= p.a) AS spans FROM q1)"""


def _first_seen(values: str) -> str:
    """SQL for a list's distinct values in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


@query("b_question_times", sql("asked", TIMES_SQL + f" SELECT question_id, array_to_string([round(x, 3)::VARCHAR for x in {_first_seen('points')}], '|') AS seconds FROM times"))
def b_question_times(spark, d):
    return X.asked(spark, d).select("question_id", F.array_join(F.transform(P.point_times(F.col("question")), lambda x: F.round(x, 3).cast("string")), "|").alias("seconds"))


@query("b_question_intervals", sql("asked", TIMES_SQL + " SELECT DISTINCT question_id, s.a AS start_s, s.b AS end_s FROM (SELECT question_id, unnest(spans) AS s FROM times) x"))
def b_question_intervals(spark, d):
    return X.asked(spark, d).select("question_id", F.explode(P.intervals(F.col("question"))).alias("i")).select("question_id", F.col("i.start").alias("start_s"), F.col("i.end").alias("end_s"))


_CN = "CASE WHEN t = '十' THEN 10 WHEN starts_with(t, '十') THEN 10 + {r} WHEN contains(t, '十') THEN {l} * 10 + {r} WHEN length(t) = 1 THEN {w} END"
_CN_DIGIT = "coalesce(list_position(['一', '二', '三', '四', '五', '六', '七', '八', '九'], replace({x}, '两', '二')), 0)"
_CN_SQL = _CN.format(r=_CN_DIGIT.format(x="split_part(t, '十', -1)"), l=_CN_DIGIT.format(x="split_part(t, '十', 1)"), w=_CN_DIGIT.format(x="t"))
ANCHORS_SQL = f"""n AS (SELECT question_id, question, list_concat([{_SECONDS.format(c="c")} for c in regexp_extract_all(question, '{P.ANCHOR}', 1)], [x::DOUBLE * 60 for x in regexp_extract_all(question, '([0-9]+(?:\\.[0-9]+)?)\\s*分钟', 1)],
  [60.0::DOUBLE * {_CN_SQL} for t in regexp_extract_all(question, '{P.CHINESE_MINUTES}', 1) if ({_CN_SQL}) > 0],
  [x::DOUBLE for x in regexp_extract_all(question, '([0-9]+(?:\\.[0-9]+)?)\\s*秒', 1)], CASE WHEN contains(question, '开头') THEN [0.0::DOUBLE] ELSE [] END, CASE WHEN contains(question, '结尾') THEN [240.0::DOUBLE] ELSE [] END) AS found FROM asked),
 r AS (SELECT question_id, found, [round_even(x, 0) for x in found] AS near FROM n)"""


@query("b_time_anchors", sql("asked", ANCHORS_SQL + """ SELECT question_id, array_to_string([x::VARCHAR for x in list_filter(found, lambda x, i: list_position(near, near[i]) = i)], '|') AS anchors FROM r WHERE len(found) > 0"""))
def b_time_anchors(spark, d):
    return X.asked(spark, d).select("question_id", F.array_join(F.transform(P.time_anchors(F.col("question"), F.lit(300.0)), lambda x: x.cast("string")), "|").alias("anchors")).where("anchors <> ''")


@query("b_choices", sql("asked", f"SELECT question_id, array_to_string([x.k || '. ' || x.v for x in c], '|') AS choices FROM (SELECT question_id, CHOICES AS c FROM asked) x WHERE len(c) > 0".replace("CHOICES", r"list_filter(list_transform(string_split(question, chr(10)), lambda l: regexp_extract(l, '^\s*([A-H])\s*[.、):：]\s*(.+?)\s*$', ['k', 'v'])), lambda x: x.k <> '')")))
def b_choices(spark, d):
    return X.asked(spark, d).select("question_id", F.array_join(P.choices(F.col("question")), "|").alias("choices")).where("choices <> ''")


@query("b_stable_id", "SELECT doc_id, substr(sha256(concat_ws(chr(31), source, text)), 1, 24) AS id FROM documents")
def b_stable_id(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.stable_id(F.col("source"), F.col("text")).alias("id"))


@query("b_label_normalize", r"SELECT doc_id, trim(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' .,;:。；，') AS label FROM documents")
def b_label_normalize(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.normalize_label(F.col("text")).alias("label"))


@query("b_json_salvage", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN '{\"a\":' || event_id || '}' END AS found FROM events")
def b_json_salvage(spark, d):
    obj = F.concat(F.lit('{"a":'), F.col("event_id").cast("string"), F.lit("}"))
    reply = F.when(F.col("event_id") % 3 == 0, obj).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), obj, F.lit("\n```"))).otherwise("no object here")
    return X.table(spark, d, "events").select("event_id", T.salvage_json(reply).alias("found"))


@query("b_parse_choice", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' END AS choice FROM events")
def b_parse_choice(spark, d):
    k = F.col("event_id") % 4
    return X.table(spark, d, "events").select("event_id", T.parse_choice(F.when(k == 0, "Answer: B.").when(k == 1, "(c)").when(k == 2, "A or B").otherwise("none")).alias("choice"))


@query("b_parse_scores", "SELECT event_id, CAST(event_id % 10 AS DOUBLE) / 10 + 0.5 AS total FROM events")
def b_parse_scores(spark, d):
    said = F.concat(F.lit("置信度：0."), (F.col("event_id") % 10).cast("string"), F.lit("\n理由\n置信度: 0.5"))
    return X.table(spark, d, "events").select("event_id", F.aggregate(T.parse_scores(said), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("b_segment_text", sql("items", "SELECT video_id, item_ord, CASE WHEN trim(text) <> '' THEN text || chr(10) ELSE '' END || 'caption ' || item_ord AS text FROM items"))
def b_segment_text(spark, d):
    parts = F.filter(F.array(F.col("text"), F.lit("  "), F.concat(F.lit("caption "), F.col("item_ord").cast("string"))), lambda x: F.trim(x) != "")
    return X.items(spark, d).select("video_id", "item_ord", F.array_join(parts, "\n").alias("text"))


@query("b_query_expand", sql("query_texts", "q AS (SELECT query_id, text, 0 AS n FROM query_texts UNION SELECT query_id, regexp_replace(text, '(?i)the', 'THE_ENTITY', 'g'), 1 FROM query_texts WHERE contains(lower(text), 'the')) SELECT query_id, text FROM q"))
def b_query_expand(spark, d):
    q = X.query_texts(spark, d)
    return q.union(q.where(F.contains(F.lower("text"), F.lit("the"))).select("query_id", F.regexp_replace("text", "(?i)the", "THE_ENTITY")))


def _any(said: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({said}), '{w.lower()}')" for w in words) + ")"


def _holds(said: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({said}, '{w}')" for w in words) + ")"


LOOKS_SQL = f"(CASE WHEN {_holds('question', R.ACTION_ADVICE)} AND NOT {_holds('question', R.ADVICE_VISUALS)} THEN false ELSE {_any('question', R.QUESTION_VISUAL_HINTS)} END)"


@query("e_route_question", sql("asked", f"""q AS (SELECT question_id, trim(question) AS q FROM asked), r AS (SELECT question_id, CASE WHEN q = '' OR regexp_matches(q, '{R.CROSS_VIDEO}') THEN 1 WHEN regexp_matches(q, '{R.COMPLEX}') OR regexp_matches(q, '{R.UI_DETAIL}') THEN 2 WHEN regexp_matches(q, '{R.ENTITY_FACT}') THEN 3 ELSE 4 END AS k FROM q)
 SELECT question_id, CASE k WHEN 3 THEN 'fast' ELSE 'full' END AS mode, CASE k WHEN 1 THEN 'empty_or_cross_video_scope' WHEN 2 THEN 'temporal_explanation_comparison_or_explicit_visual_detail' WHEN 3 THEN 'simple_current_video_entity_fact' ELSE 'not_high_confidence_simple_fact' END AS reason FROM r"""))
def e_route_question(spark, d):
    return X.asked(spark, d).select("question_id", R.route_question(F.col("question")).alias("r")).select("question_id", "r.mode", "r.reason")


@query("e_needs_visual", sql("asked", f"SELECT question_id, {LOOKS_SQL} AS visual FROM asked"))
def e_needs_visual(spark, d):
    return X.asked(spark, d).select("question_id", R.needs_visual(F.col("question")).alias("visual"))


@query("e_modality_weight", sql("items questions", f"""x AS (SELECT video_id, item_ord, trim(text) AS said, CASE item_ord % 3 WHEN 0 THEN '' WHEN 1 THEN speaker || ' shows a demo' ELSE trim(text) END AS seen, item_ord % 2 = 0 AS frames, (video_id + item_ord) % 21 AS question_id FROM items),
 y AS (SELECT x.*, coalesce({LOOKS_SQL}, false) AS looks FROM x LEFT JOIN questions USING (question_id)),
 z AS (SELECT *, least(1.0, length(said) / 220.0::DOUBLE) AS t, greatest(CASE WHEN frames THEN 0.15 ELSE 0 END, least(0.8, length(seen) / 180.0::DOUBLE), CASE WHEN {_any("said || ' ' || seen", R.VISUAL_HINTS)} THEN 0.35 ELSE 0 END, CASE WHEN looks THEN 0.45 ELSE 0 END)::DOUBLE AS v FROM y)
 SELECT video_id, item_ord, CASE WHEN t + v > 0 THEN round(t / (t + v), 3) ELSE 0 END::DOUBLE AS text_share, CASE WHEN t + v > 0 THEN round(v / (t + v), 3) ELSE 0 END::DOUBLE AS vision_share FROM z"""))
def e_modality_weight(spark, d):
    caption = F.when(F.col("item_ord") % 3 == 0, "").when(F.col("item_ord") % 3 == 1, F.concat("speaker", F.lit(" shows a demo"))).otherwise(F.col("text"))
    rows = X.items(spark, d).withColumn("question_id", (F.col("video_id") + F.col("item_ord")) % 21).join(X.questions(spark), "question_id", "left")
    w = R.modality_weight(F.col("text"), caption, F.col("item_ord") % 2 == 0, F.col("question"))
    return rows.select("video_id", "item_ord", w.alias("w")).select("video_id", "item_ord", F.col("w.text").alias("text_share"), F.col("w.vision").alias("vision_share"))


_TITLE = "CASE video_id % 4 WHEN 0 THEN 'A Slide deck' WHEN 1 THEN '教程 one' ELSE 'a title' END"


@query("e_route_modality", sql("items", f"""v AS (SELECT video_id, {_TITLE} AS title, CASE WHEN video_id % 5 = 0 THEN 0 ELSE 300 + video_id END::DOUBLE AS duration, sum(greatest(0, (end_ms - start_ms) / 1000.0::DOUBLE)) AS spoken, bool_or({_any("text", R.VISUAL_HINTS)}) AS hinted FROM items GROUP BY video_id),
 w AS (SELECT *, hinted OR {_any("title", R.VISUAL_HINTS)} AS h FROM v) SELECT video_id, CASE WHEN h THEN 'vision_supportive' ELSE 'text_dominant' END AS mode, CAST(round(spoken / coalesce(nullif(duration, 0), nullif(spoken, 0), 1), 3) AS DOUBLE) AS speech_density, CASE WHEN h THEN 0.65::DOUBLE ELSE 0.15 END AS visual_score FROM w"""))
def e_route_modality(spark, d):
    items = X.items(spark, d).select("video_id", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text")
    videos = items.select("video_id").distinct().select("video_id", F.expr(_TITLE).alias("title"), F.when(F.col("video_id") % 5 == 0, 0.0).otherwise(300.0 + F.col("video_id")).alias("duration"))
    return R.route_modality(videos, items)


#: In SQL: the relation of a question, and whether it lists choices.
RELATION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(question, '{p}') THEN '{n}'" for n, p in R.RELATIONS) + " ELSE 'none' END"
CHOICES_SQL = r"list_filter(list_transform(string_split(question, chr(10)), lambda l: regexp_extract(l, '^\s*([A-H])\s*[.、):：]\s*(.+?)\s*$', ['k', 'v'])), lambda x: x.k <> '')"


@query("e_question_context", sql("asked", f"SELECT question_id, regexp_matches(question, '{R.WHOLE_VIDEO}') AS whole_video, regexp_matches(question, '{R.EXPLICIT_VISUAL}') AS visual_hint, regexp_matches(question, '{R.EXPLICIT_SPEECH}') AS speech_hint, {RELATION_SQL} AS relation, len({CHOICES_SQL}) > 0 AS choice_based FROM asked"))
def e_question_context(spark, d):
    q = F.col("question")
    return X.asked(spark, d).select(
        "question_id", R.matches(q, R.WHOLE_VIDEO).alias("whole_video"), R.matches(q, R.EXPLICIT_VISUAL).alias("visual_hint"), R.matches(q, R.EXPLICIT_SPEECH).alias("speech_hint"),
        R.temporal_relation(q).alias("relation"), (F.size(P.choices(q)) > 0).alias("choice_based"),
    )
