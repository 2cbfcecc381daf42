"""Column functions over texts: cleaning, counting, quality, spam and personal data. All but NFC run in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAX_REPETITION, MAX_SPAM_DENSITY, MAX_SYMBOL_RATIO, MIN_AVG_WORD_LEN, MIN_WORDS

# fixed values: spam phrases, personal data patterns and quality symbols
SPAM_PHRASES = ("click here", "subscribe now", "buy now", "limited time offer", "100% free", "make money", "work from home", "congratulations you", "you have been selected")
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(\+\d{1,3}[\s-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
SYMBOLS = "#|<>{}[]\\"
#: Ends of lines besides the line feed.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: Unicode white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


@cache
def _may_change() -> str:
    """Pattern of the characters that form C may change or move: those with a combining class, a canonical decomposition that it keeps, or a place after another in a composition."""
    points = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # the followers of Hangul, which compose by rule
    for p in range(0x300, sys.maxunicode + 1):
        if 0xAC00 <= p < 0xD7A4:
            continue
        parts = unicodedata.decomposition(c := chr(p)).split()
        if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c:
            points.add(p)
        if len(parts) == 2 and not parts[0].startswith("<"):
            points.add(int(parts[1], 16))
    ends = sorted(p for p in points if p - 1 not in points), sorted(p for p in points if p + 1 not in points)
    ranges = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(*ends, strict=True))
    return rf"[\x{{300}}-\x{{10ffff}}&&[{ranges}]]"  # most characters fail the first test


def nfc(c: Column) -> Column:
    """Unicode normal form C, for which Spark has no function; texts of characters that it leaves alone stay in the JVM."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(run(F.when(c.rlike(_may_change()), c)), c)


#: What single bytes of the Windows code page stand for beyond Latin-1, by byte.
WINDOWS = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}  # fixed values


def unmojibake(c: Column, times: int = 2) -> Column:
    """Texts whose UTF-8 bytes were read as Latin-1 or Windows-1252 turned back, up to `times` layers; others stay as they are.

    A text is turned back if all of it could be such bytes and they are valid UTF-8 with at least one longer sequence: by chance,
    accented letters hardly ever follow each other like that.
    """
    for _ in range(times):
        single = F.translate(c, "".join(WINDOWS.values()), "".join(map(chr, WINDOWS)))
        # a lead byte and its followers, as letters; nothing beyond one byte
        odd = single.rlike("[\u00c2-\u00f4][\u0080-\u00bf]") & ~single.rlike("[^\u0000-\u00ff]")
        raw = F.encode(F.when(odd, single), "ISO-8859-1").cast("string")
        c = F.when(odd & F.is_valid_utf8(raw), raw).otherwise(c)
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " ")


def clean_text(c: Column, normalise: bool = True) -> Column:
    """Tags to spaces, control characters out, NFC, at most one blank line and one space, trimmed."""
    c = strip_controls(strip_tags(c))
    return strip(collapse(nfc(c) if normalise else c))


def clean_text_legacy(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n|\r", "\n"), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{BLANKS}]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def lines(c: Column) -> Column:
    """Non-blank lines, trimmed."""
    plain = F.translate(c, LINE_ENDS, "\n" * len(LINE_ENDS))
    return F.filter(F.transform(F.split(plain, "\n"), strip), lambda x: x != "")


def measures(c: Column) -> Column:
    """Struct of n_words, word_chars, n_lines, n_distinct_lines, n_symbols, each from one pass over the text."""

    def of(x: Column) -> Column:
        return F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).alias("word_chars"),
            F.size(x["l"]).alias("n_lines"),
            F.size(F.array_distinct(x["l"])).alias("n_distinct_lines"),
            x["s"].alias("n_symbols"),
        )

    return let(F.struct(words(c).alias("w"), lines(c).alias("l"), symbol_count(c).alias("s")), of)


def repetition_of(m: Column) -> Column:
    return F.when(m["n_lines"] > 0, 1 - m["n_distinct_lines"] / m["n_lines"]).otherwise(F.lit(0.0))


def avg_word_len_of(m: Column) -> Column:
    return F.when(m["n_words"] > 0, m["word_chars"] / m["n_words"]).otherwise(F.lit(0.0))


def repetition(c: Column) -> Column:
    """Share of non-blank lines that repeat another; 0 without lines."""
    return let(measures(c), repetition_of)


def avg_word_len(c: Column) -> Column:
    return let(measures(c), avg_word_len_of)


def symbol_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[" + "".join("\\" + x for x in SYMBOLS) + "]"))


def passes_of(m: Column, min_words: int = MIN_WORDS, max_repetition: float = MAX_REPETITION, min_len: float = MIN_AVG_WORD_LEN, max_symbols: float = MAX_SYMBOL_RATIO) -> Column:
    """The quality filter over measures()."""
    n = m["n_words"]
    return (n >= min_words) & (n > 0) & (repetition_of(m) <= max_repetition) & (avg_word_len_of(m) >= min_len) & (m["n_symbols"] / F.greatest(n, F.lit(1)) <= max_symbols)


def score_of(m: Column) -> Column:
    """Mean of length, repetition and word length scores from 0 to 1 over measures(); 0 without words."""
    size = F.least(F.lit(1.0), F.log(m["n_words"] + 1) / F.log(F.lit(500.0)))
    length = F.least(F.lit(1.0), avg_word_len_of(m) / 6)
    both = F.when(m["n_lines"] > 0, (size + (1 - repetition_of(m)) + length) / 3).otherwise((size + length) / 2)
    return F.when(m["n_words"] > 0, both).otherwise(F.lit(0.0))


def quality_passes(c: Column, *limits: float, **named: float) -> Column:
    return let(measures(c), lambda m: passes_of(m, *limits, **named))


def quality_score(c: Column) -> Column:
    return let(measures(c), score_of)


def spam_hits(c: Column) -> Column:
    pattern = "(?i)(" + "|".join(SPAM_PHRASES) + ")"
    return F.regexp_count(c, F.lit(pattern))


def spam_density(c: Column) -> Column:
    return spam_hits(c) / F.greatest(count_words(c), F.lit(1))


def spam_passes(c: Column, limit: float = MAX_SPAM_DENSITY) -> Column:
    return spam_density(c) <= limit


def has_pii(c: Column) -> Column:
    return c.rlike(EMAIL) | c.rlike(PHONE) | c.rlike(SSN)
