"""Language detection by a model trained on labelled documents: how often each language has each character trigram of words.

A trigram of a word between two spaces weighs floor(1000 ln(count + 1)) for a language, and each one of a text costs floor(1000 ln(trigrams
of the language + distinct trigrams)): add-one smoothed log probabilities in whole numbers, so sums don't depend on their order. The model
keeps the GRAMS commonest trigrams, a fixed size that every task gets; others count as unseen. Both training and scoring take the words of a block of
texts at a time, so each distinct word of a block is counted or cut into trigrams once, and running text costs a sum a word.

Null and blank texts have no language, nor has any text where no label was given. Rows of one id and text are one row of the result. Words
of any length are read whole. Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scratch import materialise
from .inverted import _blocks, _coded

GRAMS, MAX_LANGUAGES = 50_000, 100
#: Distinct words of a block that are cut into trigrams at a time.
WORDS = 20_000
#: Longer words are cut in pieces of so many characters.
PIECE = 64


@dataclass
class LanguageModel:
    grams: DataFrame  # gram, weights: one for each language
    languages: list[str]
    costs: list[int]


def pieces(word: Column) -> Column:
    """' word ' whole, or in pieces that overlap by two characters, so that its trigrams cost time linear in its length."""
    whole = F.concat(F.lit(" "), word, F.lit(" "))
    long = T.let(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda x: F.transform(x, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(x, i + 1), 1, 2), F.lit("")))))
    return F.when(F.length(word) <= PIECE, F.array(whole)).otherwise(long)


def trigrams(df: DataFrame, parts: Column) -> DataFrame:
    """df with a row for each character trigram (`gram`) of its pieces; one of null for a row or piece without any."""
    cut = df.withColumn("_piece", F.explode_outer(parts))
    at = cut.withColumn("_at", F.explode_outer(F.when(F.length("_piece") >= 3, F.sequence(F.lit(1), F.length("_piece") - 2))))
    return at.withColumn("gram", F.substring("_piece", F.col("_at"), 3)).drop("_piece", "_at")


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n) of each block."""
    for part in parts:
        for block in _blocks(part):
            (row, word), lang = _coded(block.column(1)), block.column(0).dictionary_encode()
            both, n = np.unique(lang.indices.to_numpy().astype(np.int64)[row] * max(1, len(word.dictionary)) + word.indices.to_numpy(), return_counts=True)
            of = divmod(both, max(1, len(word.dictionary)))
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of[0])), word.dictionary.take(pa.array(of[1])), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


def _places(s: str) -> np.ndarray:
    """A number for each three characters that follow each other in s."""
    p = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return p[:-2] << 42 | p[1:-1] << 21 | p[2:]


def _word_sums(words: pa.Array, known: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of trigrams of each word, and what they weigh for each language; known: sorted places, whose weights end with a row of nulls."""
    n, out = pc.utf8_length(words).to_numpy().astype(np.int64), np.zeros((weights.shape[1], len(words)), np.int64)
    for i in range(0, len(words), step := max(1, WORDS)):
        some, size = words.slice(i, step).to_pylist(), n[i : i + step]
        ends = np.cumsum(size + 2)
        inside = np.ones(ends[-1], bool)
        inside[ends - 1] = inside[ends - 2] = False  # trigrams that would reach into the next word
        at = _places(f" {'  '.join(some)} ")[inside[:-2]]
        found = np.searchsorted(known, at)
        found[known[np.minimum(found, len(known) - 1)] != at if len(known) else slice(None)] = len(known)
        starts = np.cumsum(size) - size
        for k in range(len(out)):
            out[k, i : i + step] = np.add.reduceat(weights[found, k], starts)
    return n, out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", grams: int = GRAMS) -> LanguageModel:
    """The model of all rows with a label."""
    labelled = docs.where((F.col(lang) != "") & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.lower(text).alias("text"))
    counted = materialise(labelled.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    counts = materialise(trigrams(counted, pieces(F.col("word"))).where("gram IS NOT NULL").groupBy("lang", "gram").agg(F.sum("n").alias("c")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("c").alias("c")).orderBy("lang").limit(MAX_LANGUAGES + 1)
    distinct = counts.agg(F.countDistinct("gram").alias("n"))
    rows = totals.crossJoin(distinct).select("lang", F.floor(1000 * F.log(F.col("c") + F.col("n"))).alias("cost")).orderBy("lang").collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    of = lambda r: F.coalesce(F.sum(F.when(F.col("lang") == r.lang, F.col("c"))), F.lit(0))
    weights = F.array(*(F.floor(1000 * F.log(of(r) + 1)) for r in rows)) if rows else F.array().cast("array<bigint>")
    top = counts.groupBy("gram").agg(F.sum("c").alias("total"), weights.alias("weights")).orderBy(F.desc("total"), "gram").limit(grams)
    kept = materialise(top.select("gram", "weights"), "trigrams")
    return LanguageModel(kept, [r.lang for r in rows], [r.cost for r in rows])


def _sums(weights: Column, n: int) -> Column:
    return F.array(*(F.coalesce(F.sum(weights[k]), F.lit(0)) for k in range(n))) if n else F.array().cast("array<bigint>")


def detect(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_grams, language, margin) of every text; margin: how far the language leads the next, in thousandths of a nat."""
    n = len(model.languages)
    held = sorted((_places(r.gram)[0], r.weights) for r in model.grams.collect())  # GRAMS rows
    known, weights = np.array([g for g, _ in held], np.int64), np.array([w for _, w in held] + [[0] * n], np.int64).reshape(-1 if n else len(held) + 1, n)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in _blocks(part):
                row, word = _coded(block.column(1))
                of, size = word.indices.to_numpy(), len(block)
                n_grams, sums = _word_sums(word.dictionary, known, weights)
                total = lambda x: np.bincount(row, x[of], size).astype(np.int64)  # noqa: E731, B023
                lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * n, pa.int32()), pa.array(np.array([total(x) for x in sums], np.int64).reshape(n, size).T.ravel()))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(total(n_grams)), lists], ["key", "_text", "n_grams", "sums"])

    given = docs.select(F.col(key).alias("key"), F.lower(text).alias("text"), F.xxhash64(text).alias("_text"))
    counted = given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, _text long, n_grams long, sums array<long>").withColumnRenamed("key", key)
    rows = counted.groupBy(key, "_text").agg(F.sum("n_grams").alias("n_grams"), _sums(F.col("sums"), n).alias("sums"))
    if not n:
        return rows.select(key, "n_grams", F.lit(None).cast("string").alias("language"), F.lit(None).cast("long").alias("margin"))
    ranked = F.sort_array(F.array(*(F.struct((F.col("sums")[k] - F.col("n_grams") * cost).alias("score"), F.lit(-k).alias("o"), F.lit(lang).alias("lang")) for k, (lang, cost) in enumerate(zip(model.languages, model.costs)))), asc=False)
    best = rows.select(key, "n_grams", F.when(F.col("n_grams") > 0, ranked).alias("r"))
    return best.select(key, "n_grams", F.col("r")[0]["lang"].alias("language"), (F.col("r")[0]["score"] - F.get("r", F.lit(1))["score"]).alias("margin"))
