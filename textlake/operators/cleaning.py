"""Cleaning and filtering of documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MAX_REPETITION, MAX_SPAM_DENSITY, MIN_WORDS
from ..functions import text as T


def clean(docs: DataFrame, repair: Callable[[Column], Column] | None = None) -> DataFrame:
    """Clean text (and title, if there) and add word_count; repair: mojibake repair, done before all else, none by default."""
    repair = repair or (lambda c: c)
    out = docs.withColumn("text", F.explode(F.array(T.clean_text(repair(F.coalesce("text", F.lit("")))))))  # exploded, so computed once
    if "title" in docs.columns:
        out = out.withColumn("title", T.clean_text(repair(F.col("title"))))
    return out.withColumn("word_count", T.count_words(F.col("text")))


def verdict(c: Column, min_words: int = MIN_WORDS, max_repetition: float = MAX_REPETITION, remove_pii: bool = False) -> Column:
    """Struct of _passes (quality, spam and, if asked for, personal data filters, the cheap ones first) and quality_score; the text is measured once."""

    def of(m: Column) -> Column:
        passes = T.passes_of(m, min_words, max_repetition) & (T.spam_hits(c) / F.greatest(m["n_words"], F.lit(1)) <= MAX_SPAM_DENSITY)
        return F.struct((passes & ~T.has_pii(c) if remove_pii else passes).alias("_passes"), T.score_of(m).alias("quality_score"))

    return T.let(T.measures(c), of)


def pipeline(docs: DataFrame, languages: tuple[str, ...] = ("en",), min_words: int = MIN_WORDS, max_repetition: float = MAX_REPETITION, remove_pii: bool = False, language: str = "lang") -> DataFrame:
    """Language filter, then those of verdict(); adds quality_score.

    The generator keeps the optimizer from copying the measures into every filter and column.
    """
    marks = verdict(F.col("text"), min_words, max_repetition, remove_pii)
    return docs.drop("quality_score").where(F.col(language).isin(*languages)).select("*", F.inline(F.array(marks))).where("_passes").drop("_passes")


def compile_filter(spec: dict | None) -> Column | None:
    """Equality and {"$in": [...]} conditions joined by AND; other operators are ignored; None if nothing is left."""
    terms = []
    for name, value in (spec or {}).items():
        if not isinstance(value, dict):
            terms.append(F.col(name) == value)
        elif next(iter(value), None) == "$in":
            terms.append(F.col(name).isin(list(value["$in"])))
    return reduce(and_, terms) if terms else None


def intent_filter(categories: list[str] | None = None, domains: list[str] | None = None, language: str | None = None) -> dict:
    """One value: equality; several: $in."""
    out: dict = {}
    for name, values in (("category", categories), ("source_domain", domains)):
        if values:
            out[name] = values[0] if len(values) == 1 else {"$in": list(values)}
    if language:
        out["language"] = language
    return out


def merge_filters(caller: dict | None, intent: dict | None) -> dict:
    """The intent's conditions win."""
    return {**(caller or {}), **(intent or {})}


def where(df: DataFrame, spec: dict | None) -> DataFrame:
    condition = compile_filter(spec)
    return df if condition is None else df.where(condition)
