"""Language detection by stop words, in the JVM; any model can take its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: frequent words by language
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "is", "that", "for", "with", "are", "this", "was", "by", "be", "on", "it"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "im", "dem", "nicht", "ein", "eine", "auf"),
    "fr": ("le", "la", "les", "et", "des", "du", "une", "dans", "qui", "pour", "est", "sur", "pas", "au", "avec"),
    "es": ("el", "los", "las", "que", "en", "por", "con", "se", "su", "para", "del", "una", "al", "como", "es"),
}
#: Shorter texts tell nothing.
MIN_CHARS = 20


def detect_language(c: Column) -> Column:
    """The language with most stop words, the first listed on ties; null for short texts or without any."""
    scores = lambda x: F.array(*(F.struct(F.size(F.filter(x, lambda w: w.isin(*stops))).alias("n"), F.lit(-k).alias("o"), F.lit(lang).alias("lang")) for k, (lang, stops) in enumerate(STOP_WORDS.items())))
    best = F.transform(F.array(T.words(F.lower(c))), lambda x: F.array_max(scores(x)))[0]
    return F.when((F.length(T.strip(c)) >= MIN_CHARS) & (best["n"] > 0), best["lang"])


def detect_language_or_unknown(c: Column) -> Column:
    """The legacy form: from the first 2000 characters, 'unknown' where nothing is found."""
    return F.coalesce(detect_language(F.substring(c, 1, 2000)), F.lit("unknown"))
