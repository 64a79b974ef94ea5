"""Text rules as Catalyst expressions; Python sees a text only to decompose accents, which no expression does."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges of scripts, and the mask put in place of a credential.
KANA = r"\x{3040}-\x{30FF}"
HANGUL = r"\x{AC00}-\x{D7AF}"
HANZI = r"\x{4E00}-\x{9FFF}"
CJK_MARKS = r"\x{3000}-\x{303F}"
BULLET, ELLIPSIS = "•", "…"
REDACTED = "***REDACTED***"
#: Credentials to mask, in this order; what precedes them in a first group stays.
CREDENTIALS = (
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"(?i)(Bearer\s+)[A-Za-z0-9._\-]{8,}",
    r"""(?i)((?:api[_-]?key|apikey|token|secret|password|passwd|auth[_-]?key)\s*[=:]\s*)[^\s,;"')]{6,}""",
    r"""(?i)("(?:api_?key|token|secret|password)"\s*:\s*")[^"]{6,}""",
    r"\b[A-Za-z0-9_\-]{32,}\b",
)
#: White space as Python knows it.
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def count_class(text: Column, ranges: str) -> Column:
    """Code points of text in a character class."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{ranges}]", ""))


def script(text: Column) -> Column:
    """ja, ko, zh or en: kana before hangul before hanzi."""
    has = lambda r: F.coalesce(text, F.lit("")).rlike(f"[{r}]")
    return F.when(has(KANA), "ja").when(has(HANGUL), "ko").when(has(HANZI), "zh").otherwise("en")


def has_cjk_or_hangul(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{KANA}{HANGUL}{HANZI}{CJK_MARKS}]")


def ascii_share(text: Column) -> Column:
    """Share of letters and digits that are ASCII; 0 where there are none."""
    some = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[A-Za-z0-9]")), some), F.lit(0.0))


def mask_key(key: Column) -> Column:
    """Empty stays empty; up to 8 characters become bullets; else the first 6, an ellipsis and the last 4."""
    k = strip(F.coalesce(key, F.lit("")))
    n = F.char_length(k)
    masked = F.concat(F.left(k, F.lit(6)), F.lit(ELLIPSIS), F.right(k, F.lit(4)))
    return F.when(n == 0, "").when(n <= 8, F.rpad(F.lit(""), n, BULLET)).otherwise(masked)


def is_masked(key: Column) -> Column:
    k = strip(F.coalesce(key, F.lit("")))
    return (k == "") | k.rlike(f"[{ELLIPSIS}{BULLET}]")


def minutes(clock: Column) -> Column:
    """Minutes since midnight of 'HH:MM'; null where it has another shape."""
    parts = F.split(strip(clock), ":")
    number = lambda i: strip(F.get(parts, F.lit(i))).try_cast("int")
    return F.when(F.size(parts) == 2, number(0) * 60 + number(1))


def redact(text: Column) -> Column:
    """Masks what looks like a credential: prefixed keys, bearer tokens, assignments, JSON fields, long opaque runs."""
    for pattern in CREDENTIALS:
        kept = "$1" if pattern.startswith("(?i)(") else ""
        text = F.regexp_replace(text, pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]"), kept + REDACTED)
    return text


def natural_key(name: Column) -> Column:
    """Sorts 'page-2' before 'page-10' and '10' before 'a': text without case, then a number, in turns."""
    runs = r"([^0-9]*)([0-9]+|$)"
    texts, numbers = (F.regexp_extract_all(F.lower(name), F.lit(runs), F.lit(i)) for i in (1, 2))

    def token(text: Column, number: Column) -> Column:
        digits = F.regexp_replace(number, "^0+(?=.)", "")
        return F.struct(text.alias("t"), F.nullif(F.char_length(digits), F.lit(0)).alias("n"), digits.alias("d"))

    return F.zip_with(texts, numbers, token)


def numbered_reply(reply: Column, n: Column) -> Column:
    """Texts 1 to n of a reply of numbered lines; the last of a number wins, a missing one is empty."""
    line = r"(?mUd)^\s*(\d+)\s*[.)、:：]\s*(.+?)\s*$"
    number, said = (F.regexp_extract_all(reply, F.lit(line), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(number.alias("k"), said.alias("v"))

    def pick(i: Column) -> Column:
        own = F.transform(F.filter(pairs, lambda p: p["k"].try_cast("int") == i), lambda p: p["v"])
        return F.regexp_replace(strip(F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit(""))), "^[\"'“”]+|[\"'“”]+$", "")

    return F.transform(F.sequence(F.lit(1), n), pick)


#: Punctuation that is no glyph of a reading, beside white space.
NO_GLYPH = "、。．，,.！？!?…‥ー〜～「」『』（）()[]【】"


def glyph_count(c: Column) -> Column:
    """Characters but white space and punctuation; null counts none."""
    marks = "".join("\\" + m if m in ".?()[]!," else m for m in NO_GLYPH)
    return F.char_length(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[\s\p{{Z}}\x0B\x1C-\x1F\x85{marks}]", ""))


#: Punctuation that does not tell utterances apart, beside that which is no glyph.
NO_UTTERANCE = NO_GLYPH + "・:;'\"-"
#: Characters without a width of their own.
WIDTHLESS = " \t\n\u3000【】「」『』（）()[]{}〈〉《》、。，．・…‥!?！？:：;；-–—_'\"”’"
#: Wording of publishers and authors.
CREDITS = "発行 出版社 株式会社 レーベル 定価 印刷 著者 原作 漫画 キャラクター原案 翻訳 編集 デザイン 協力 © (c) copyright ISBN ● ◆ ★ ※".split()
#: What models say instead of a translation.
REFUSALS = (
    "[text untranslatable]", "[untranslatable]", "[untranslated]", "untranslatable", "[no translation]",
    "[unable to translate]", "[cannot be translated]", "unable to translate", "cannot translate", "garbled text",
    "unintelligible", "illegible", "gibberish", "ocr corruption",
)
#: What typographic marks are written as.
PLAIN = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "―": "-",
    "−": "-", "…": "...", "•": "-", "·": "-", "\u00a0": " ", "\u2009": " ", "\u200a": " ", "\u3000": " ",
}
CHAPTER = "第[〇一二三四五六七八九十百千零0-9]+[話章回編節]"
KANA_LETTER, KANJI = r"[\x{3041}-\x{309F}\x{30A0}-\x{30FF}]", r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def _class(marks: str) -> str:
    return "".join("\\" + m if m in "\\.?()[]{}!,-^&" else m for m in marks)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def punctuation_only(c: Column) -> Column:
    """Whether a reading has no letter or digit."""
    return ~_text(c).rlike(r"[\p{L}\p{N}]")


def is_chapter_heading(c: Column) -> Column:
    return _text(c).rlike(CHAPTER)


def utterance(c: Column) -> Column:
    """A reading without white space and punctuation."""
    return F.regexp_replace(_text(c), rf"[{SPACE}{_class(NO_UTTERANCE)}]", "")


def truncates(long: Column, short: Column) -> Column:
    """Whether the second reading is a part, of two characters or more, of the first."""
    a, b = utterance(long), utterance(short)
    return (F.char_length(b) >= 2) & (F.char_length(b) < F.char_length(a)) & F.contains(a, b)


def recoverable(c: Column) -> Column:
    """A lone kanji, or two characters and more with kana or kanji."""
    t = strip(_text(c))
    return t.rlike(KANJI) | (F.char_length(t) >= 2) & t.rlike(KANA_LETTER)


def ink_matches(ink: Column, c: Column, per_glyph: float = 0.05) -> Column:
    """Whether a share of ink is enough for the glyphs read; one or two always are."""
    n = glyph_count(c)
    return (n <= 2) | (ink >= per_glyph * n)


def has_cjk(c: Column) -> Column:
    """Kana, hanzi or their punctuation; hangul does not count."""
    return _text(c).rlike(f"[{KANA}{HANZI}{CJK_MARKS}]")


def _any_of(marks: tuple[str, ...] | list[str]) -> str:
    """A pattern that finds any of some wordings, ASCII letters in either case."""
    return "|".join(f"(?i:{re.escape(m)})" if m.isascii() else m for m in marks)


def has_credit(c: Column) -> Column:
    """Whether a reading carries wording of publishers or authors; ASCII wording in either case."""
    return _text(c).rlike(_any_of(CREDITS))


def width_glyphs(c: Column) -> Column:
    """Characters that take up width."""
    return F.char_length(F.regexp_replace(_text(c), f"[{_class(WIDTHLESS)}]", ""))


def ascii_form(c: Column) -> Column:
    """Plain ASCII: accents off, typographic marks as ASCII, three dots at most, the rest dropped.

    Accents come off by decomposition, which no built-in function does; texts that are ASCII already stay in the JVM.
    """
    @F.arrow_udf("string")
    def decomposed(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in column:
            split = [None if t is None else unicodedata.normalize("NFKD", t) for t in part.to_pylist()]
            yield pa.array([None if t is None else "".join(c for c in t if not unicodedata.combining(c)) for t in split], pa.string())

    other = decomposed(F.when(c.rlike(r"[^\x00-\x7F]"), c))
    for mark, plain in PLAIN.items():
        other = F.replace(other, F.lit(mark), F.lit(plain))
    t = F.regexp_replace(F.coalesce(other, _text(c)), r"\.{3,}", "...")
    return strip(F.regexp_replace(t, r"[^\x00-\x7F]", ""))


def is_refusal(c: Column) -> Column:
    return _text(c).rlike(_any_of(REFUSALS))


def clean_reply(c: Column) -> Column:
    """A reply as ASCII; empty where it is a refusal."""
    return F.when(is_refusal(c), "").otherwise(ascii_form(strip(_text(c))))


@cache
def _letterable() -> str:
    """A class of the characters whose ASCII form is more than white space, ASCII ones first."""
    plain = lambda c: PLAIN.get(c, "".join(PLAIN.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)))
    seen = [i for i in range(128, 0x110000) if any(x < "\x80" and not re.match(f"[{SPACE}]", x) for x in plain(chr(i)))]
    first = [i for i, before in zip(seen, [0, *seen], strict=False) if i != before + 1]
    last = [i for i, after in zip(seen, [*seen[1:], 0], strict=True) if i + 1 != after]
    return r"\x00-\x08\x0E-\x1B!-\x7F" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(first, last, strict=True))


def is_unusable(c: Column) -> Column:
    """clean_reply(c) == "", without a decomposition: whether a reply is a refusal or nothing of it is left in ASCII."""
    return is_refusal(c) | ~_text(c).rlike(f"[{_letterable()}]")


def echoes(c: Column) -> Column:
    """Whether a reply hands the source back: it has other than ASCII, and no ASCII letter in its ASCII form."""
    return _text(c).rlike(r"[^\x00-\x7F]") & ~ascii_form(c).rlike("[A-Za-z]")


def json_object(c: Column) -> Column:
    """The JSON object of a reply that may wrap it in a fence or in prose; null if there is none."""
    t = F.regexp_replace(F.regexp_replace(strip(_text(c)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    known = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.rlike(r"(?s)^\s*\{.*\}\s*$"), x)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.coalesce(known(t), known(inner))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def number_or(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def archive_kind(mode: Column, source: Column) -> Column:
    """What a job's output is packed as (null: not at all): cbz on demand, or mirrored after the upload."""
    return F.when(mode == "cbz", "cbz").when((mode == "mirror") & source.isin("cbz", "zip"), source)


def download_kind(mode: Column, source: Column) -> Column:
    """The extension of a download: as packed, else as uploaded, else cbz."""
    return F.coalesce(archive_kind(mode, source), F.when(source.isin("cbz", "zip"), source), F.lit("cbz"))


def page_stem(path: Column) -> Column:
    """Name of a page's bundle: its file name without the last extension, after the job's number if the path names one."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    job = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"/jobs/([0-9]+)/", 1)
    return F.when(job != "", F.concat(F.lit("j"), job, F.lit("_"), stem)).otherwise(stem)


def caption_verdict(kind: Column, reading: Column, reply: Column, capacity: Column) -> Column:
    """Why a caption's reading is not taken, empty if it is; the first reason counts."""
    read, n = strip(_text(reading)), width_glyphs(strip(_text(reading)))
    return (
        F.when(F.upper(_text(kind)) != "CAPTION", "kind").when(~_text(reading).rlike(f"[^{SPACE}]"), "empty reading").when(~has_cjk(read), "not japanese")
        .when(has_credit(reading), "credit marker").when(n > capacity, F.concat(F.lit("implausible length "), n, F.lit(">"), capacity))
        .when(is_unusable(reply), "unusable translation").otherwise("")
    )
