"""Text expressions: tokens, clean-up, keywords, names, labels, salvage. All are JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import spread

#: Token grammar (fixed values): identifiers, numbers, single CJK characters.
TOKEN = r"[A-Za-z_][A-Za-z0-9_.-]*|[0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]"
METRIC_TOKEN = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"
KEYWORD = r"[A-Za-z][A-Za-z0-9_-]{2,}|[\x{4e00}-\x{9fff}]{2,}"
ENTITY = r"\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*){0,3}\b"
STOP_WORDS = ["这个", "我们", "一个", "以及", "然后", "所以", "the", "and", "that", "with", "for"]
TOPIC_MARKERS = ["接下来", "第二点", "第三点", "总结一下", "但是", "另一个问题", "another point", "next", "in summary", "however"]
#: Phrases that speech recognition gets wrong, in order (fixed values).
ASR_PHRASES = [
    ("晴天珠", "擎天柱"), ("晴天柱", "擎天柱"), ("买个床", "威震天"), ("卖个床", "威震天"), ("麦个床", "威震天"), ("居住反派", "霸天虎反派"),
    ("便衣中", "变一中"), ("服衣中", "变一中"), ("复火", "复活"), ("火众员", "火种源"), ("做了情章", "堕落金刚"), ("情章", "金刚"),
]


def _all(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text if isinstance(text, Column) else F.col(text), F.lit(pattern), F.lit(group))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(text), w))


def _lowered(tokens: Column) -> Column:
    """Lower-cased elements, without a function call for each."""
    return F.array_remove(F.split(F.lower(F.array_join(tokens, " ")), " "), "")


def base_tokens(text) -> Column:
    return _lowered(_all(text, TOKEN))


def tokenize(text) -> Column:
    """Lower-cased tokens, then the bigrams of the single CJK characters among them; only texts with CJK look for these."""
    base = base_tokens(text)
    cjk = F.filter(base, lambda t: t.rlike(r"^[\x{4e00}-\x{9fff}]$"))
    n = F.greatest(F.size(cjk) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(cjk, F.lit(1), n), F.slice(cjk, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.when(has_cjk(text if isinstance(text, Column) else F.col(text)), F.concat(base, pairs)).otherwise(base)


_PLAIN_TOKEN = re.compile(TOKEN.replace(r"\x{4e00}", "\u4e00").replace(r"\x{9fff}", "\u9fff"))


def plain_tokens(text: str) -> list[str]:
    """The tokens of ``tokenize`` in Python, for steps that run there."""
    tokens = _PLAIN_TOKEN.findall(text)
    cjk = [t for t in tokens if "\u4e00" <= t <= "\u9fff"]
    return [t.lower() for t in tokens] + [a + b for a, b in zip(cjk, cjk[1:])]


def metric_tokens(text) -> Column:
    return _lowered(_all(text, METRIC_TOKEN))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_asr(text: Column) -> Column:
    for source, target in ASR_PHRASES:
        text = F.replace(text, F.lit(source), F.lit(target))
    return collapse(text)


def clean_markup(text: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\{\\.*?\}", ""))


def entities(text, limit: int = 8) -> Column:
    return F.slice(F.array_distinct(_all(text, ENTITY)), 1, limit)


def has_topic_marker(text: Column) -> Column:
    return contains_any(text, TOPIC_MARKERS)


def keywords(rows: DataFrame, key: list[str], text: str, limit: int = 8) -> DataFrame:
    """(key, keywords): a text's most frequent words, then by spelling."""
    words = spread(rows.select(*key, text)).select(*key, F.explode(_lowered(_all(text, KEYWORD))).alias("word")).where(~F.col("word").isin(STOP_WORDS))
    counts = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rn", rank).where(F.col("rn") <= limit)
    return top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda x: x["word"]).alias("keywords"))


def keyword_list(text: Column, limit: int = 8) -> Column:
    """A text's keywords by array functions alone, for texts too short to be worth a shuffle."""
    words = F.filter(_lowered(_all(text, KEYWORD)), lambda t: ~t.isin(STOP_WORDS))
    counted = F.transform(F.array_distinct(words), lambda w: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(counted), lambda x: x["w"]), 1, limit)


def replace_alias(text: Column, alias: str, canonical: str) -> Column:
    """Case-insensitive replacement of whole tokens; aliases that are not Latin match anywhere."""
    quoted = re.escape(alias)
    latin = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9 _.-]*", alias)
    return F.regexp_replace(text, f"(?iu)(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])" if latin else f"(?iu){quoted}", canonical.replace("\\", "\\\\").replace("$", "\\$"))


def count_alias(text: Column, alias: str) -> Column:
    quoted = re.escape(alias)
    latin = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9 _.-]*", alias)
    return F.size(_all(text, f"(?iu)(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])" if latin else f"(?iu){quoted}"))


def format_timestamp(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("[%02d:%02d:%02d]", F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60)))


def shorten(text: Column, limit: int, mark: str = "...") -> Column:
    plain = collapse(text)
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, limit - 1)), F.lit(mark)))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def normalize_label(text: Column) -> Column:
    return F.btrim(collapse(F.lower(text)), F.lit(" .,;:。；，"))


def salvage_json(text: Column) -> Column:
    """The first JSON object of a reply that may wrap it in prose or fences, as text; null if there is none."""
    whole = F.trim(text)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t)
    return F.coalesce(ok(whole), ok(inner))


def parse_choice(text: Column) -> Column:
    """The letter of a reply that names exactly one choice."""
    letters = F.array_distinct(F.transform(_all(text, r"(?i)(?:^|[^A-Za-z])([A-H])(?![A-Za-z])", 1), lambda x: F.upper(x)))
    return F.when(F.size(letters) == 1, F.get(letters, F.lit(0)))


def parse_scores(text: Column) -> Column:
    return F.transform(_all(text, r"置信度\s*[：:]\s*([0-9]*\.?[0-9]+)", 1), lambda x: x.cast("double"))


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}]")


def file_name(text: Column, limit: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[\\/:*?\"<>|\r\n]+", "_")), 1, limit)
