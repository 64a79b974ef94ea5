"""Text rules over documents and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.plans.views import table, union_sql

#: Documents with some words of other scripts in front.
MIXED = """SELECT doc_id, concat(CASE doc_id % 7 WHEN 0 THEN 'こんにちは' WHEN 1 THEN '안녕 ' WHEN 2 THEN '你好，' WHEN 3 THEN '。' WHEN 4 THEN '原作：' WHEN 5 THEN '第12話 ' ELSE '' END,
 substring(coalesce(text, ''), 1, CAST(doc_id % 40 AS INT))) AS text FROM documents"""
KEYS = "SELECT doc_id, concat(' ', substring(md5(coalesce(text, '')), 1, CAST(doc_id % 20 AS INT)), ' ') AS k FROM documents"
CLOCKS = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'noon' WHEN doc_id % 7 = 1 THEN '1:2:3' ELSE concat(' ', CAST(doc_id % 24 AS STRING), ':', CAST(doc_id % 60 AS STRING)) END AS v FROM documents"
NAMES = "SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'page-' ELSE 'Page-' END AS front, CAST(p_partkey % 1000 AS INT) AS n FROM part"
REPLIES = """SELECT doc_id, concat('Here:', chr(10), '1. ', substring(m, 1, 4), chr(10), ' 2) ', substring(m, 5, 4), chr(10), '2: "', substring(m, 9, 4), '" ', chr(10), '9. x', chr(10), '4、“', substring(m, 13, 4), '”') AS reply, m
 FROM (SELECT doc_id, md5(coalesce(text, '')) AS m FROM documents) d"""


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _of(spark, d, sql, name="documents"):
    return table(spark, d, name, sql)


def script_detect(spark, d):
    rows = _of(spark, d, MIXED)
    return rows.select("doc_id", T.script(F.col("text")).alias("lang"), T.count_class(F.col("text"), T.KANA).alias("kana"))


def page_language(spark, d):
    rows = _of(spark, d, MIXED)
    return rows.select("doc_id", T.has_cjk_or_hangul(F.col("text")).alias("cjk"), T.has_cjk(F.col("text")).alias("no_hangul"))


def ascii_share(spark, d):
    return _of(spark, d, MIXED).select("doc_id", F.round(T.ascii_share(F.col("text")), 6).alias("share"))


def redact(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"))


def mask_key(spark, d):
    return _of(spark, d, KEYS).select("doc_id", T.mask_key(F.col("k")).alias("masked"), T.is_masked(F.col("k")).alias("keeps"))


def hhmm_minutes(spark, d):
    return _of(spark, d, CLOCKS).select("doc_id", T.minutes(F.col("v")).alias("minutes"))


def natural_sort(spark, d):
    rows = _of(spark, d, NAMES, "part").withColumn("name", F.concat("front", F.col("n").cast("string"), F.lit(".jpg")))
    order = Window.partitionBy("p_brand").orderBy(T.natural_key(F.col("name")), "p_partkey")
    return rows.select("p_partkey", F.row_number().over(order).alias("place"))


def numbered_parse(spark, d):
    said = _of(spark, d, REPLIES).select("doc_id", F.posexplode(T.numbered_reply(F.col("reply"), F.lit(4))))
    return said.select("doc_id", (F.col("pos") + 1).alias("n"), F.col("col").alias("said"))


def exact_duplicate_groups(spark, d):
    key = F.lower(F.trim(F.regexp_replace("text", "[ \t\n]+", " ")))
    groups = _docs(spark, d).groupBy(F.md5(key).alias("digest"))
    return groups.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def punctuation_only_filter(spark, d):
    return _of(spark, d, MIXED).where(~T.punctuation_only(F.col("text"))).select("doc_id")


def chapter_heading(spark, d):
    return _of(spark, d, MIXED).select((F.col("doc_id") % 50).alias("page"), T.is_chapter_heading(F.col("text")).alias("h")).groupBy("page").agg(F.bool_or("h").alias("heading"))


def credit_marker_filter(spark, d):
    return _of(spark, d, MIXED).where(~T.has_credit(F.col("text"))).select("doc_id")


def norm_utterance(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.utterance(F.col("text"))).alias("digest"))


def width_glyphs(spark, d):
    return _docs(spark, d).select("doc_id", T.width_glyphs(F.col("text")).alias("glyphs"))


def recoverable_text(spark, d):
    return _of(spark, d, MIXED).select("doc_id", T.recoverable(F.col("text")).alias("keep"))


def normalize_ascii(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.ascii_form(F.col("text"))).alias("digest"))


def clean_translation(spark, d):
    rows = _of(spark, d, MIXED)
    return rows.select("doc_id", T.clean_reply(F.col("text")).alias("text"), T.echoes(F.col("text")).alias("echo"))


def archive_ext(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet")
    mode = F.element_at(F.array(*map(F.lit, ("folder", "cbz", "mirror"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    source = F.element_at(F.array(*map(F.lit, ("folder", "cbz", "zip", "images"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return rows.select("o_orderkey", T.archive_kind(mode, source).alias("packed"), T.download_kind(mode, source).alias("ext"))


QUERIES = {f.__name__: f for f in (
    script_detect, page_language, ascii_share, redact, mask_key, hhmm_minutes, natural_sort, numbered_parse,
    exact_duplicate_groups, punctuation_only_filter, chapter_heading, credit_marker_filter, norm_utterance, width_glyphs,
    recoverable_text, normalize_ascii, clean_translation, archive_ext)}


def _redacted() -> str:
    out = "text"
    for pattern in T.CREDENTIALS:
        kept, plain = (r"\1", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        space = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
        plain = plain.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace("'", "''")
        out = f"regexp_replace({out}, '{plain}', '{kept}{T.REDACTED}', '{'gi' if kept else 'g'}')"
    return out


def _class(marks: str) -> str:
    return "".join("\\" + m if m in "\\.?()[]{}!,-^" else m for m in marks).replace("'", "''")


_HAS = lambda c, f="text": f"regexp_matches({f}, '[{c}]')"
_KANA, _HANGUL, _HANZI = r"\x{3040}-\x{30FF}", r"\x{AC00}-\x{D7AF}", r"\x{4E00}-\x{9FFF}"
_KANJI = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
_WHITE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CREDIT = " OR ".join(f"contains(lower(text), '{m.lower()}')" if m.isascii() else f"contains(text, '{m}')" for m in T.CREDITS)
_STRIPPED = f"regexp_replace(text, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"

ORACLE = {
    "script_detect": union_sql("m", MIXED, f"SELECT doc_id, CASE WHEN {_HAS(_KANA)} THEN 'ja' WHEN {_HAS(_HANGUL)} THEN 'ko' WHEN {_HAS(_HANZI)} THEN 'zh' ELSE 'en' END AS lang, CAST(length(regexp_replace(text, '[^{_KANA}]', '', 'g')) AS INT) AS kana FROM m"),
    "page_language": union_sql("m", MIXED, rf"SELECT doc_id, {_HAS(_KANA + _HANGUL + _HANZI)} OR {_HAS(chr(92) + 'x{3000}-' + chr(92) + 'x{303F}')} AS cjk, {_HAS(_KANA + _HANZI)} OR {_HAS(chr(92) + 'x{3000}-' + chr(92) + 'x{303F}')} AS no_hangul FROM m"),
    "ascii_share": union_sql("m", MIXED, r"SELECT doc_id, round(coalesce(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')), 0), 0.0), 6) AS share FROM m"),
    "redact": f"SELECT doc_id, md5({_redacted()}) AS digest FROM documents",
    "mask_key": union_sql("m", KEYS, "SELECT doc_id, CASE WHEN length(t) = 0 THEN '' WHEN length(t) <= 8 THEN repeat('•', length(t)) ELSE left(t, 6) || '…' || right(t, 4) END AS masked, t = '' AS keeps FROM (SELECT doc_id, trim(k) AS t FROM m)"),
    "hhmm_minutes": union_sql("m", CLOCKS, "SELECT doc_id, CASE WHEN doc_id % 7 > 1 THEN CAST((doc_id % 24) * 60 + doc_id % 60 AS INT) END AS minutes FROM m"),
    "natural_sort": union_sql("m", NAMES, "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY lower(front), n, p_partkey) AS INT) AS place FROM m"),
    "numbered_parse": union_sql("m", REPLIES, "SELECT doc_id, 1 AS n, substring(m, 1, 4) AS said FROM m UNION ALL SELECT doc_id, 2, substring(m, 9, 4) FROM m UNION ALL SELECT doc_id, 3, '' FROM m UNION ALL SELECT doc_id, 4, substring(m, 13, 4) FROM m"),
    "exact_duplicate_groups": "SELECT md5(lower(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')))) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "punctuation_only_filter": union_sql("m", MIXED, r"SELECT doc_id FROM m WHERE regexp_matches(text, '[\p{L}\p{N}]')"),
    "chapter_heading": union_sql("m", MIXED, f"SELECT doc_id % 50 AS page, bool_or(regexp_matches(text, '{T.CHAPTER}')) AS heading FROM m GROUP BY 1"),
    "credit_marker_filter": union_sql("m", MIXED, f"SELECT doc_id FROM m WHERE NOT ({_CREDIT})"),
    "norm_utterance": f"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[{_WHITE}{_class(T.NO_UTTERANCE)}]', '', 'g')) AS digest FROM documents",
    "width_glyphs": f"SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '[{_class(T.WIDTHLESS)}]', '', 'g')) AS INT) AS glyphs FROM documents",
    "recoverable_text": union_sql("m", MIXED, rf"SELECT doc_id, regexp_matches(t, '[{_KANJI}]') OR length(t) >= 2 AND regexp_matches(t, '[\x{{3041}}-\x{{309F}}\x{{30A0}}-\x{{30FF}}]') AS keep FROM (SELECT doc_id, {_STRIPPED} AS t FROM m)"),
    "archive_ext": "WITH o AS (SELECT o_orderkey, ['folder', 'cbz', 'mirror'][o_orderkey % 3 + 1] AS m, ['folder', 'cbz', 'zip', 'images'][o_orderkey % 4 + 1] AS s FROM orders), p AS (SELECT *, CASE WHEN m = 'cbz' THEN 'cbz' WHEN m = 'mirror' AND s IN ('cbz', 'zip') THEN s END AS packed FROM o) SELECT o_orderkey, packed, CASE WHEN packed IS NOT NULL THEN packed WHEN s IN ('cbz', 'zip') THEN s ELSE 'cbz' END AS ext FROM p",
}
