"""Registered queries of the engine and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JACCARD, NUM_PERM, DatasetConfig
from ..functions import language as L
from ..functions import text as T
from ..functions import urls as U
from ..operators import near_index as near_index_table
from ..operators import ann, chunking, cleaning, crawl, datasets, dedup, fetch, inverted, jobs, language_model, ranking, retrieval, robots, storage, vectors
from ..sources import archives, article
from ..sources import documents as sources
from ..sources import registry
from ..streaming import ingest
from . import ingestion
from .scratch import shared_dir as _shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Query text and vector of the search queries.
ASKED = "the of and thing in the die der la que"
ASKED_VECTOR = [((k * 37) % 64 - 31.5) / 64 for k in range(64)]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# pieces of SQL
def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda x: x <> '')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_MEASURES = f"""
  SELECT *, len({_words('text')}) AS n, {_LINES} AS ls,
    length(regexp_replace(text, '\\s+', '', 'g')) AS chars, length(text) - length(translate(text, '#|<>{{}}[]\\', '')) AS symbols FROM documents"""
_RATES = f"""
  SELECT *, CASE WHEN len(ls) > 0 THEN 1 - len(list_distinct(ls)) / len(ls) ELSE 0 END AS rep,
    CASE WHEN n > 0 THEN chars / n ELSE 0 END AS avg_len, symbols / greatest(n, 1) AS sym FROM ({_MEASURES})"""
_PASSES = "n >= 50 AND rep <= 0.3 AND avg_len >= 3 AND sym <= 0.1"
_SCORE = "CASE WHEN n = 0 THEN 0 WHEN len(ls) > 0 THEN (least(1, ln(n + 1) / ln(500)) + (1 - rep) + least(1, avg_len / 6)) / 3 ELSE (least(1, ln(n + 1) / ln(500)) + least(1, avg_len / 6)) / 2 END"
_SPAM = "len(regexp_extract_all(text, '(?i)(" + "|".join(T.SPAM_PHRASES) + ")'))"


@query(rf"""SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(nfc_normalize(regexp_replace(regexp_replace('<p>' || text || '</p>   <b>' || chr(10) || chr(10) || chr(10) || chr(10) || chr(7) || 'end</b>', '<[^>]+>', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')")} AS text FROM documents""")
def clean_text(spark, sf_dir):
    marked = F.concat(F.lit("<p>"), "text", F.lit("</p>   <b>\n\n\n\n\x07end</b>"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(marked).alias("text"))


@query(rf"""SELECT page_id, {_strip(r"regexp_replace(regexp_replace(regexp_replace(html, '\r\n|\r', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")} AS text FROM pages""")
def legacy_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text_legacy(F.col("html")).alias("text"))


@query(f"SELECT doc_id, len({_words('text')})::BIGINT AS n_words, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_words(F.col("text")).alias("n_words"), T.approx_tokens(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, {_PASSES} AS passes, round(rep, 6)::DOUBLE AS repetition, round(avg_len, 6)::DOUBLE AS avg_word_len, symbols::BIGINT AS symbols FROM ({_RATES})")
def quality_filter(spark, sf_dir):
    of = lambda m: F.struct(T.passes_of(m).alias("passes"), F.round(T.repetition_of(m), 6).alias("repetition"), F.round(T.avg_word_len_of(m), 6).alias("avg_word_len"), m["n_symbols"].cast("long").alias("symbols"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(T.let(T.measures(F.col("text")), of))))


@query(f"SELECT doc_id, round({_SCORE}, 6)::DOUBLE AS quality_score FROM ({_RATES})")
def quality_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.quality_score(F.col("text")), 6).alias("quality_score"))


@query(f"SELECT doc_id, lang, source, round({_SCORE}, 6)::DOUBLE AS quality_score FROM ({_RATES}) WHERE lang IN ('en', 'fr') AND {_PASSES} AND {_SPAM} / greatest(n, 1) <= 0.02 AND NOT (regexp_matches(text, '{T.EMAIL}') OR regexp_matches(text, '{T.PHONE}') OR regexp_matches(text, '{T.SSN}'))")
def cleaning_pipeline(spark, sf_dir):
    kept = cleaning.pipeline(table(spark, sf_dir, "documents"), ("en", "fr"), remove_pii=True)
    return kept.select("doc_id", "lang", "source", F.round("quality_score", 6).alias("quality_score"))


@query(f"SELECT doc_id, regexp_matches(text, '{T.EMAIL}') AS email, regexp_matches(text, '{T.PHONE}') AS phone, regexp_matches(text, '{T.SSN}') AS ssn FROM documents")
def pii_flags(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", c.rlike(T.EMAIL).alias("email"), c.rlike(T.PHONE).alias("phone"), c.rlike(T.SSN).alias("ssn"))


@query(f"SELECT doc_id, len(regexp_extract_all(t, '(?i)(" + "|".join(T.SPAM_PHRASES) + f")'))::BIGINT AS hits, round(len(regexp_extract_all(t, '(?i)(" + "|".join(T.SPAM_PHRASES) + f")')) / greatest(len({_words('t')}), 1), 6)::DOUBLE AS density FROM (SELECT doc_id, replace(text, ' the ', ' Buy now ') AS t FROM documents)")
def spam_density(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace(F.col("text"), F.lit(" the "), F.lit(" Buy now ")))
    return docs.select("doc_id", T.spam_hits(F.col("text")).cast("long").alias("hits"), F.round(T.spam_density(F.col("text")), 6).alias("density"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY ALL")
def language_mix(spark, sf_dir):
    return cleaning.where(table(spark, sf_dir, "documents"), {"lang": {"$in": ["en", "de"]}, "n_chars": {"$gt": 5}}).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, sf_dir):
    return dedup.exact(table(spark, sf_dir, "documents"))


def _signature_sql(shingles: str) -> str:
    """Common table expressions sig (doc_id, k, m) and banded (doc_id, rn, bands) over s (doc_id, h): the same hashes, permutations and bands."""
    pairs = ", ".join(f"({k}, {a}::UBIGINT, {b}::UBIGINT)" for k, (a, b) in enumerate(dedup.permutations()))
    return f"""s AS ({shingles}), perms(k, a, b) AS (VALUES {pairs}),
sig AS (SELECT doc_id, k, min((h * a + b) & 4294967295) AS m FROM s, perms GROUP BY doc_id, k),
keys AS (SELECT doc_id, ('0x' || substr(md5(k // {dedup.ROWS} || ':' || string_agg(m::VARCHAR, ',' ORDER BY k)), 1, 15))::BIGINT AS band FROM sig GROUP BY doc_id, k // {dedup.ROWS}),
banded AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, list(band) AS bands FROM keys GROUP BY doc_id),
greedy AS (
  SELECT 0::BIGINT AS rn, false AS is_duplicate, []::BIGINT[] AS taken
  UNION ALL SELECT b.rn, list_has_any(g.taken, b.bands), CASE WHEN list_has_any(g.taken, b.bands) THEN g.taken ELSE list_concat(g.taken, b.bands) END FROM greedy g JOIN banded b ON b.rn = g.rn + 1)"""


def _char_shingles_sql(where: str) -> str:
    h = "p[i]"
    for k in range(1, 5):
        h = f"(({h} * {dedup.STEP} + p[i + {k}]) & 4294967295)"
    mixed = "xor(g, g >> 13)"
    first = f"((xor({h}, {h} >> 16) * 2246822507) & 4294967295)"
    return f"SELECT DISTINCT doc_id, {mixed} AS h FROM (SELECT doc_id, unnest(list_transform(range(1, len(p) - 3), lambda i: {first})) AS g FROM (SELECT doc_id, list_transform(string_split(lower(text), ''), lambda x: unicode(x)::UBIGINT) AS p FROM documents WHERE {where}))"


_GREEDY = f"WITH RECURSIVE {_signature_sql(_char_shingles_sql(f'length(text) >= {dedup.MIN_CHARS}'))} SELECT doc_id, coalesce(is_duplicate, false) AS is_duplicate FROM documents LEFT JOIN banded USING (doc_id) LEFT JOIN greedy USING (rn)"


@query(_GREEDY)
def minhash_dedup(spark, sf_dir):
    return dedup.greedy_marks(table(spark, sf_dir, "documents"))


@query(_GREEDY)
def near_index(spark, sf_dir):
    """Documents in four batches by doc_id against a stored index of bands: the marks of one run over all."""
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    index, out, edges = near_index_table.NearIndex(spark, f"{_shared(spark)}/bands-{uuid.uuid4().hex}"), None, [low + (high - low + 1) * k // 4 for k in range(5)] if low is not None else [0, 0]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        marks = index.add(docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)), k)
        out = marks if out is None else out.unionByName(marks)
    return out


@query(_GREEDY)
def minhash_rounds(spark, sf_dir):
    """The greedy pass in rounds over tables to the end, however few rows are left."""
    return dedup.greedy_marks(table(spark, sf_dir, "documents"), finish=0)


@query(f"""WITH RECURSIVE {_signature_sql(_char_shingles_sql('true'))},
full_sig AS (SELECT doc_id, k, coalesce(m, 4294967295) AS m FROM (SELECT doc_id, k FROM documents, perms) LEFT JOIN sig USING (doc_id, k)),
hits AS (SELECT q.doc_id FROM full_sig q JOIN full_sig o ON q.k = o.k AND q.m = o.m AND q.doc_id <> o.doc_id WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, o.doc_id HAVING count(*) / {NUM_PERM} >= {JACCARD})
SELECT doc_id AS query_id, doc_id IN (SELECT doc_id FROM hits) AS is_duplicate FROM documents WHERE doc_id % 100 = 0""")
def stored_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return dedup.like_any(dedup.signatures(docs.where("doc_id % 100 = 0")), dedup.signatures(docs))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, source, lang AS language, len({_words('text')})::BIGINT AS word_count FROM documents WHERE lang IN ('en', 'de')),
chosen AS (SELECT * FROM d WHERE word_count BETWEEN 50 AND 100000),
{_signature_sql(f"SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT AS h FROM (SELECT DISTINCT doc_id, unnest({_words('lower(text)')}) AS w FROM chosen)")}
SELECT c.* FROM chosen c JOIN banded USING (doc_id) JOIN greedy USING (rn) WHERE NOT is_duplicate""")
def dataset_build(spark, sf_dir):
    return datasets.build(table(spark, sf_dir, "documents"), DatasetConfig(languages=("en", "de")))


@query(f"""SELECT doc_id, i::INT AS chunk_index, array_to_string(w[i * 448 + 1 : i * 448 + 512], ' ') AS content, least(i * 448 + 512, len(w))::INT - (i * 448)::INT AS token_count, (i * 448)::INT AS start_word, least(i * 448 + 512, len(w))::INT AS end_word
FROM (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 512) / 448))::BIGINT + 1)) AS i FROM (SELECT doc_id, {_words('text')} AS w FROM documents) WHERE len(w) > 0)""")
def word_chunks(spark, sf_dir):
    return chunking.word_chunks(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, i::INT AS chunk_index, substring(text, i * 448 + 1, 512) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 448 + 1)) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"))


@query(rf"""WITH p AS (SELECT doc_id, source, list_transform(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: len({_words('p')}) > 20), lambda p: {_strip('p')})[1:10] AS ps FROM documents),
e AS (SELECT doc_id, source, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM p)
SELECT doc_id, i::INT AS sample_index, 'Summarize the following passage.' AS instruction, substring(p, 1, 500) AS input, substring(p, 1, 200) || CASE WHEN length(p) > 200 THEN '...' ELSE '' END AS output, source FROM e""")
def instruction_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return chunking.instruction_samples(docs)


def _split_sql(text: str, size: int = 512, overlap: int = 64, level: int = 0) -> str:
    """The list of chunks of a text: pieces of a level folded together while they fit, longer ones split by the next level, then the overlap."""
    names = (f"{v}{level}" for v in ("p", "s", "x", "m", "o", "i"))
    p, s, x, m, o, i = names
    mark = ("chr(10) || chr(10)", "chr(10)", "'. '", "' '", "''")[level]
    if level == 4:
        parts = f"list_transform(range(0, (length({text}) + {size - 1}) // {size}), lambda {i}: substring({text}, {i} * {size} + 1, {size}))"
    else:
        none = "{{'t': '', 'l': false}}".format()
        fits = f"CASE WHEN {s}.cur = '' THEN length({x}) <= {size} ELSE length({s}.cur) + length({mark}) + length({x}) <= {size} END"
        grown = f"CASE WHEN {s}.cur = '' THEN {x} ELSE {s}.cur || {mark} || {x} END"
        out = f"list_concat({s}.out, CASE WHEN {s}.cur = '' THEN [] ELSE [{{'t': {s}.cur, 'l': false}}] END, CASE WHEN length({x}) > {size} THEN [{{'t': {x}, 'l': true}}] ELSE [] END)"
        step = f"CASE WHEN {fits} THEN {{'cur': {grown}, 'out': {s}.out}} ELSE {{'cur': CASE WHEN length({x}) > {size} THEN '' ELSE {x} END, 'out': {out}}} END"
        fold = f"list_reduce(list_transform(string_split({text}, {mark}), lambda {p}: {{'cur': {p}, 'out': [{none}][1:0]}}), lambda {s}, {s}n: list_transform([{s}n.cur], lambda {x}: {step})[1], {{'cur': '', 'out': [{none}][1:0]}})"
        whole = f"list_transform([{fold}], lambda {m}: list_concat({m}.out, CASE WHEN {m}.cur = '' THEN [] ELSE [{{'t': {m}.cur, 'l': false}}] END))[1]"
        parts = f"flatten(list_transform({whole}, lambda {m}: CASE WHEN {m}.l THEN {_split_sql(f'{m}.t', size, overlap, level + 1)} ELSE [{m}.t] END))"
    led = f"{o}[{i} - 1][-{overlap}:] || {mark} || {o}[{i}]"
    return f"list_transform([{parts}], lambda {o}: list_transform(range(1, len({o}) + 1), lambda {i}: CASE WHEN {i} > 1 AND length({led}) <= {size + overlap} THEN {led} ELSE {o}[{i}] END))[1]"


def _chunks_sql(docs: str) -> str:
    """(doc_id, chunk_index, content, token_count) of a table of doc_id and text."""
    return f"SELECT doc_id, (i - 1)::INT AS chunk_index, c[i] AS content, greatest(1, length(c[i]) // 4)::BIGINT AS token_count FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {_split_sql('text')} AS c FROM {docs})) WHERE {_strip('c[i]')} <> ''"


@query(f"SELECT c.*, d.source AS source, d.lang AS lang, c.chunk_index::VARCHAR AS meta_index FROM ({_chunks_sql('documents')}) c JOIN documents d USING (doc_id)")
def recursive_chunks(spark, sf_dir):
    found = chunking.recursive_chunks(table(spark, sf_dir, "documents"), inherit=("source", "lang"))
    meta = lambda k: F.col("metadata")[k]
    return found.select("doc_id", "chunk_index", "content", "token_count", meta("source").alias("source"), meta("lang").alias("lang"), meta("chunk_index").alias("meta_index"))


_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in ASKED_VECTOR) + "]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_Q})"


@query(f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return vectors.top_k(table(spark, sf_dir, "embeddings"), ASKED_VECTOR).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 3, 5) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def filtered_topk(spark, sf_dir):
    return vectors.top_k(table(spark, sf_dir, "embeddings"), ASKED_VECTOR, spec={"label": {"$in": [1, 3, 5]}}).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def filter_fallback(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"), ASKED_VECTOR, spec={"label": 999}).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(1 / (60 + row_number() OVER (ORDER BY {_COS} DESC, vec_id)), 6)::DOUBLE AS rrf FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def hybrid_topk(spark, sf_dir):
    return vectors.hybrid(table(spark, sf_dir, "embeddings"), ASKED_VECTOR).select("vec_id", F.round("rrf", 6).alias("rrf"))


@query(f"""WITH d AS (SELECT vec_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings QUALIFY r <= 20),
t AS (SELECT doc_id AS vec_id, round(list_sum([0.0] || list_transform([{', '.join(repr(w) for w in ASKED.split())}], lambda q: ln(2) * len(list_filter(w, lambda y: y = q)) * 2.5 / (len(list_filter(w, lambda y: y = q)) + 1.5 * (0.25 + 0.75 * len(w) / 200.0)))), 9) AS score FROM (SELECT doc_id, {_words('lower(text)')} AS w FROM documents)),
h AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS p FROM t WHERE score > 0 QUALIFY p <= 200),
l AS (SELECT vec_id, row_number() OVER (ORDER BY p) AS r FROM h WHERE vec_id IN (SELECT vec_id FROM embeddings) QUALIFY r <= 20)
SELECT vec_id, d.r::INT AS dense_rank, l.r::INT AS lexical_rank, round(coalesce(1 / (60 + d.r), 0) + coalesce(1 / (60 + l.r), 0), 6)::DOUBLE AS rrf FROM d FULL JOIN l USING (vec_id) ORDER BY coalesce(1 / (60 + d.r), 0) + coalesce(1 / (60 + l.r), 0) DESC, vec_id LIMIT 10""")
def hybrid_search(spark, sf_dir):
    """Dense hits over embeddings and lexical ones over an inverted index of documents, which is built first."""
    path = f"{_shared(spark)}/index-{uuid.uuid4().hex}"
    inverted.add(table(spark, sf_dir, "documents"), path)
    asked = spark.createDataFrame([(0, ASKED)], "query_id long, text string")
    hits = inverted.search(spark, path, asked, k=200).select(F.col("doc_id").alias("vec_id"), "rank")
    return vectors.hybrid(table(spark, sf_dir, "embeddings"), ASKED_VECTOR, lexical=hits).select("vec_id", "dense_rank", "lexical_rank", F.round("rrf", 6).alias("rrf"))


@query("""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (
    SELECT q.vec_id AS query_id, p.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def knn_batch(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return vectors.knn(points.where("vec_id % 100 = 0"), points).withColumn("score", F.round("score", 6))


@query()
def knn_approximate(spark, sf_dir):
    """Neighbours of the query set by an index over all embeddings, which is built first; tests measure its recall against knn_batch."""
    points = table(spark, sf_dir, "embeddings")
    index = ann.VectorIndex(spark, f"{_shared(spark)}/vectors-{uuid.uuid4().hex}")
    index.fit(points)
    index.add(points)
    return index.search(points.where("vec_id % 100 = 0")).withColumn("score", F.round("score", 6))


def _bm25_sql(terms: str, average: float, idf: str) -> str:
    return f"list_sum([0.0] || list_transform({terms}, lambda q: {idf} * f(t, q) * 2.5 / (f(t, q) + 1.5 * (0.25 + 0.75 * len(t) / {average}))))".replace("f(t, q)", "len(list_filter(t, lambda y: y = q))")


_ASKED_TERMS = "[" + ", ".join(f"'{w}'" for w in ASKED.split()) + "]"
_ASKED_SET = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(ASKED.split())) + "]"
_TOKENS = f"(SELECT doc_id, {_words('lower(text)')} AS t FROM documents)"


@query(f"SELECT doc_id, round({_bm25_sql(_ASKED_TERMS, 200, 'ln(2)')}, 6)::DOUBLE AS score FROM {_TOKENS}")
def bm25_current(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(ranking.bm25(F.lit(ASKED), F.col("text")), 6).alias("score"))


@query(f"SELECT doc_id, round({_bm25_sql(_ASKED_SET, 100, '1')}, 6)::DOUBLE AS score FROM {_TOKENS}")
def bm25_legacy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(ranking.bm25_legacy(F.lit(ASKED), F.col("text")), 6).alias("score"))


def _candidates(spark, sf_dir, lexical) -> DataFrame:
    """Every vector with its document's lexical score; a query for each label."""
    points = table(spark, sf_dir, "embeddings").withColumn("vector_score", F.round(vectors.cosine(F.col("embedding"), vectors.literal(ASKED_VECTOR)), 6))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.round(lexical(F.lit(ASKED), F.col("text")), 6).alias("bm25_score"))
    return points.join(docs, "vec_id").select(F.col("label").alias("query_id"), "vec_id", F.col("vec_id").alias("pos"), "vector_score", "bm25_score")


def _rrf_sql(bm25: str, tie: str) -> str:
    return f"""WITH c AS (SELECT label AS query_id, vec_id, vec_id AS pos, round({_COS}, 6) AS v, round({bm25}, 6)::DOUBLE AS b FROM embeddings JOIN {_TOKENS} d ON d.doc_id = vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, pos) AS vr, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, pos) AS br FROM c),
s AS (SELECT *, 0.7::DOUBLE / (60 + vr) + 0.3::DOUBLE / (60 + br) AS s FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, {tie})::INT AS rank FROM s)
SELECT query_id, vec_id, round(s, 6)::DOUBLE AS score, rank FROM k WHERE rank <= 5"""


@query(_rrf_sql(_bm25_sql(_ASKED_TERMS, 200, "ln(2)"), "vr"))
def rrf_rerank(spark, sf_dir):
    return ranking.rerank(_candidates(spark, sf_dir, ranking.bm25)).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(_rrf_sql(_bm25_sql(_ASKED_SET, 100, "1"), "pos"))
def rrf_legacy(spark, sf_dir):
    return ranking.rerank_legacy(_candidates(spark, sf_dir, ranking.bm25_legacy)).select("query_id", "vec_id", F.round("final_score", 6).alias("score"), "rank")


def _intent_sql() -> str:
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, '{name}', [{', '.join(map(quote, words))}])" for k, (name, (_, words, _)) in enumerate(registry.CATEGORIES.items()))
    return f"""WITH k(ord, category, words) AS (VALUES {rows}),
h AS (SELECT conv_id, turn, ord, category, len(list_filter(words, lambda w: contains(lower(text), w))) AS n, len(words) AS m FROM conversations, k),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, ord) AS r FROM h)
SELECT conv_id, turn, CASE WHEN n > 0 THEN category ELSE 'general' END AS category, round(CASE WHEN n > 0 THEN n / m ELSE 0 END, 6)::DOUBLE AS intent_confidence FROM b WHERE r = 1"""


@query(_intent_sql())
def intent_route(spark, sf_dir):
    asked = retrieval.classify(table(spark, sf_dir, "conversations"), registry.categories(spark))
    return asked.select("conv_id", "turn", "category", F.round("intent_confidence", 6).alias("intent_confidence"))


def _answers_sql() -> str:
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, '{name}', {quote(registry.LANGUAGES[name]) if name in registry.LANGUAGES else 'NULL'}, [{', '.join(map(quote, words))}])" for k, (name, (_, words, _)) in enumerate(registry.CATEGORIES.items()))
    bm25 = _bm25_sql("q", 200, "ln(2)")
    return f"""WITH k(ord, category, speaks, words) AS (VALUES {rows}),
q AS (SELECT item_id AS query_id, text, CASE WHEN n > 0 THEN category ELSE 'general' END AS category, speaks, embedding FROM (
  SELECT item_id, text, category, speaks, len(list_filter(words, lambda w: contains(lower(text), w))) AS n, row_number() OVER (PARTITION BY item_id ORDER BY len(list_filter(words, lambda w: contains(lower(text), w))) DESC, ord) AS r FROM benchmark, k) JOIN embeddings ON vec_id = item_id WHERE r = 1),
p AS (SELECT doc_id, text AS content, lang AS language, embedding, CASE WHEN label % 2 = 0 THEN 'academic_ai' ELSE 'thai_law' END AS category FROM documents JOIN embeddings ON vec_id = doc_id),
s AS (SELECT query_id, q.category, doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS v, q.category <> 'general' AND p.category = q.category AND (speaks IS NULL OR p.language = speaks) AS own FROM q, p),
u AS (SELECT *, bool_or(own) OVER (PARTITION BY query_id) AS met FROM s),
t AS (SELECT query_id, category, doc_id, v, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, doc_id) AS vr FROM u WHERE own OR NOT met QUALIFY vr <= 10),
b AS (SELECT t.*, content, round((SELECT {bm25} FROM (SELECT {_words('lower(q.text)')} AS q, {_words('lower(p.content)')} AS t)), 9)::DOUBLE AS bm FROM t JOIN q USING (query_id) JOIN p USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm DESC, vr) AS br FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.7::DOUBLE / (60 + vr) + 0.3::DOUBLE / (60 + br) DESC, vr) AS rank FROM r)
SELECT query_id, any_value(category) AS category, max(CASE WHEN rank = 1 THEN CASE WHEN split_part(split_part(content, chr(10) || chr(10), 1), '. ', 1) = '' THEN '{retrieval.NOTHING}' ELSE split_part(split_part(content, chr(10) || chr(10), 1), '. ', 1) END END) AS answer,
  string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS cited, round(max(v), 6) AS confidence FROM f WHERE rank <= 5 GROUP BY query_id"""


@query(_answers_sql())
def rag_answers(spark, sf_dir):
    """Benchmark items as questions over documents: intent, filtered search, reranking, prompt, model and citations; vectors are those given."""
    given = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").join(given.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id").select(F.col("item_id").alias("query_id"), "text", "vector")
    topic = F.when(F.col("label") % 2 == 0, "academic_ai").otherwise("thai_law")
    held = table(spark, sf_dir, "documents").join(given, F.col("vec_id") == F.col("doc_id"))
    points = held.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("").alias("document_title"), F.lit("").alias("url"), F.col("text").alias("content"), F.col("lang").alias("language"), topic.alias("category"), F.col("embedding").alias("vector"))
    out = retrieval.answer_many(asked, points)
    return out.select("query_id", "category", "answer", F.array_join(F.transform("citations", lambda c: c["document_id"]), ",").alias("cited"), F.round("confidence", 6).alias("confidence"))


def _registry_sql() -> str:
    return ", ".join(f"({k}, '{name}', '{url}', '{lang}', {depth}, {n})" for k, (name, (_, _, own)) in enumerate(registry.CATEGORIES.items()) for url, lang, depth, n in own)


_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_DOMAIN = f"CASE WHEN regexp_replace({_HOST}, '^www\\.', '') = '' THEN 'unknown' ELSE regexp_replace({_HOST}, '^www\\.', '') END"


@query(f"""WITH s(ord, category, url, language, depth, n) AS (VALUES {_registry_sql()}),
m AS (SELECT {_DOMAIN} AS domain, min_by(category, ord) AS category FROM s GROUP BY 1),
p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.matichon.co.th/' || page_id WHEN page_id % 3 = 1 THEN 'https://arxiv.org/abs/' || page_id ELSE url END AS url FROM pages)
SELECT page_id, {_DOMAIN} AS source_domain, coalesce(m.category, 'general') AS category FROM p LEFT JOIN m ON m.domain = {_DOMAIN}""")
def category_resolve(spark, sf_dir):
    own = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.matichon.co.th/"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/"), "page_id")).otherwise(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", own.alias("url"))
    return registry.resolve_category(pages, registry.sources(spark)).select("page_id", "source_domain", "category")


@query(f"""WITH s(ord, category, url, language, depth, n) AS (VALUES {_registry_sql()}),
m AS (SELECT {_DOMAIN} AS domain, min_by(category, ord) AS category FROM s GROUP BY 1),
p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.matichon.co.th/' || page_id WHEN page_id % 3 = 1 THEN 'https://arxiv.org/abs/' || page_id ELSE url END AS url FROM pages),
c AS (SELECT coalesce(m.category, 'general') AS category, count(*) AS pages FROM p LEFT JOIN m ON m.domain = {_DOMAIN} GROUP BY 1)
SELECT category, max(depth)::INT AS crawl_depth, max(n)::INT AS crawl_pages, coalesce(any_value(pages), 0)::BIGINT AS pages, greatest(0, max(n) - coalesce(any_value(pages), 0))::BIGINT AS left_to_crawl FROM s LEFT JOIN c USING (category) GROUP BY 1""")
def crawl_limits(spark, sf_dir):
    """Limits of every topic, with how many of its pages are there and may still be crawled."""
    own = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.matichon.co.th/"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/"), "page_id")).otherwise(F.col("url"))
    held = registry.resolve_category(table(spark, sf_dir, "pages").select(own.alias("url")), registry.sources(spark)).groupBy("category").agg(F.count("*").alias("pages"))
    pages = F.coalesce("pages", F.lit(0))
    return registry.crawl_limits(spark).join(held, "category", "left").select("category", "crawl_depth", "crawl_pages", pages.alias("pages"), F.greatest(F.lit(0), F.col("crawl_pages") - pages).alias("left_to_crawl"))


@query(f"""WITH s(ord, category, url, language, depth, n) AS (VALUES {_registry_sql()}),
p AS (SELECT {_DOMAIN} AS domain, count(*) AS pages FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'https://www.arxiv.org/x' WHEN page_id % 5 = 0 THEN 'https://docs.docker.com/y' ELSE url END AS url FROM pages) GROUP BY 1)
SELECT domain, coalesce(any_value(pages), 0)::BIGINT AS pages FROM (SELECT DISTINCT {_DOMAIN} AS domain FROM s) LEFT JOIN p USING (domain) GROUP BY domain""")
def registry_domains(spark, sf_dir):
    """Every domain of the registry with the pages that it gave."""
    url = F.when(F.col("page_id") % 2 == 0, "https://www.arxiv.org/x").when(F.col("page_id") % 5 == 0, "https://docs.docker.com/y").otherwise(F.col("url"))
    held = table(spark, sf_dir, "pages").groupBy(U.domain(url).alias("domain")).agg(F.count("*").alias("pages"))
    return registry.domains(spark).join(held, "domain", "left").select("domain", F.coalesce("pages", F.lit(0)).alias("pages"))


@query(f"WITH s(ord, category, url, language, depth, n) AS (VALUES {_registry_sql()}), i AS (SELECT DISTINCT {_DOMAIN} AS d FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'https://arxiv.org/x' ELSE url END AS url FROM pages)) SELECT DISTINCT category FROM s WHERE category NOT IN (SELECT category FROM s JOIN i ON i.d = {_DOMAIN})")
def auto_crawl(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(U.domain(F.when(F.col("page_id") % 2 == 0, F.lit("https://arxiv.org/x")).otherwise(F.col("url"))).alias("domain")).distinct()
    return registry.should_auto_crawl(spark, pages)


@query(f"SELECT page_id, {_DOMAIN} AS domain, regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages")
def domain_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("domain"), U.is_valid_url(F.col("url")).alias("valid"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS head, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' END AS url FROM pages))
SELECT page_id, head || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&') END AS url FROM p""")
def url_normalize(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.when(F.col("page_id") % 2 == 0, F.lit("")).otherwise(F.lit("/"))))
    return pages.select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query("""SELECT page_id, pos::INT AS pos, links[pos + 1] AS link FROM (SELECT page_id, links, unnest(range(0, len(links))) AS pos FROM (
  SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS links FROM (SELECT page_id, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|mailto:|tel:|javascript:)')) AS l FROM pages)))""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(U.links(F.col("html"))).alias("pos", "link"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CASE WHEN regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) = '' THEN 'en' ELSE regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) END AS lang FROM pages""")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.title(F.col("html")).alias("title"), U.html_lang(F.col("html")).alias("lang"))


def _drop_sql() -> str:
    html = "html"
    for tag in ("script", "style", "nav", "footer", "header", "aside", "noscript"):
        html = rf"regexp_replace({html}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return html


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({_drop_sql()}, '(?s)<!--.*?-->|<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.rough_text(F.col("html")).alias("text"))


@query()
def page_parse(spark, sf_dir):
    return sources.parse_pages(table(spark, sf_dir, "pages")).select("page_id", "title", "text")


@query("""WITH RECURSIVE e AS (SELECT page_id AS src, unnest([2 * page_id + 1, 2 * page_id + 2]) AS dst FROM pages), r AS (
  SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 5 AND dst IN (SELECT page_id FROM pages))
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def bfs_crawl(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    edges = pages.select(F.col("page_id").alias("src"), F.explode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("dst"))
    edges = edges.join(pages.select(F.col("page_id").alias("dst")), "dst", "left_semi")
    return crawl.bfs(edges, spark.createDataFrame([(0,)], "node long"), 5)


_CONTEXT = "FROM (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 5"


def _ranked(spark, sf_dir) -> DataFrame:
    place = F.expr("row_number() over (partition by source order by n_chars desc, doc_id)")
    docs = table(spark, sf_dir, "documents").withColumn("rank", place).where("rank <= 5")
    url = F.when(F.col("lang") == "en", F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string")))
    return docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("document_id"), F.when(F.col("lang") != "de", F.col("lang")).alias("document_title"), url.alias("url"), F.col("text").alias("content"), "rank", F.lit(1.0).alias("score"))


@query(f"SELECT source AS query_id, string_agg('[' || rank || '] **' || CASE WHEN lang <> 'de' THEN lang ELSE doc_id::VARCHAR END || '**' || CASE WHEN lang = 'en' THEN ' — https://x.org/' || doc_id ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context {_CONTEXT} GROUP BY source")
def prompt_context(spark, sf_dir):
    return retrieval.context(_ranked(spark, sf_dir))


@query(f"SELECT source AS query_id, rank AS \"index\", doc_id AS document_id, CASE WHEN lang <> 'de' THEN lang END AS title, CASE WHEN lang = 'en' THEN 'https://x.org/' || doc_id END AS url, substring(text, 1, 300) AS excerpt, 1.0::DOUBLE AS score {_CONTEXT}")
def citations(spark, sf_dir):
    return retrieval.citations(_ranked(spark, sf_dir))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def list_documents(spark, sf_dir):
    return storage.page(table(spark, sf_dir, "documents"), 10, 10, "n_chars", lang="en").select("doc_id", "lang", "source", "n_chars")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def count_by_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM events GROUP BY 1")
def job_latest(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "event_id", "ts")
    return jobs.latest(log).select("job_id", "status", "event_id", "n_events")


@query("SELECT user_id AS job_id, CASE WHEN count(*) > 0 THEN least(99, floor(count(*) FILTER (event_type = 'click') / count(*) * 100))::INT ELSE 0 END AS progress FROM events GROUP BY 1")
def job_progress(spark, sf_dir):
    done = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.count_if(F.col("event_type") == "click").alias("processed"), F.count("*").alias("total"))
    return done.select("job_id", jobs.progress().alias("progress"))


def _logs(spark, sf_dir) -> DataFrame:
    """First user turns as queries, assistant turns as passages, a score from the conversation's number."""
    said = table(spark, sf_dir, "conversations")
    asked = said.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query_text"))
    passages = said.where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("text").alias("content"), F.lit(1.0).alias("score")).alias("c")))).alias("c"))
    score = F.when(F.col("conv_id") % 7 != 0, F.col("conv_id") % 5 + 1)
    return asked.join(passages, "conv_id", "left").select(F.col("conv_id").alias("id"), "query_text", F.transform("c", lambda x: x["c"]).alias("retrieved_chunks"), score.alias("feedback_score"))


_LOGS = "logs AS (SELECT u.conv_id AS id, u.q AS query_text, a.c AS chunks, CASE WHEN u.conv_id % 7 <> 0 THEN u.conv_id % 5 + 1 END AS score FROM (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY 1) u LEFT JOIN (SELECT conv_id, list(text ORDER BY turn) AS c FROM conversations WHERE role = 'assistant' GROUP BY 1) a USING (conv_id))"


@query(f"""WITH {_LOGS}, n AS (SELECT count(*) AS t, count(score) AS l, count(*) FILTER (score >= 4 AND chunks IS NOT NULL) AS p, count(*) FILTER (score <= 2 AND chunks IS NOT NULL) AS m FROM logs)
SELECT t AS total_logs, l AS labelled_logs, p * 3 AS positive_pairs, m AS negative_pairs, t - l AS unlabelled_logs, p * 3 >= 50 AS ready_to_train, CASE WHEN p * 3 < 50 THEN p * 3 || ' of the 50 positive pairs needed, estimated from ' || p || ' well-rated queries' END AS reason FROM n""")
def feedback_stats(spark, sf_dir):
    return jobs.feedback_stats(_logs(spark, sf_dir))


@query(rf"WITH {_LOGS} SELECT {_strip('query_text')} AS query, {_strip('c')} AS chunk, true AS is_positive FROM (SELECT query_text, unnest(chunks) AS c FROM logs WHERE score >= 4) WHERE {_strip('c')} <> '' AND {_strip('query_text')} <> ''")
def training_pairs(spark, sf_dir):
    return jobs.training_pairs(_logs(spark, sf_dir))


_SAMPLES = f"SELECT doc_id, text, source, lang AS language, len({_words('text')})::BIGINT AS word_count FROM documents WHERE lang IN ('en', 'es') AND len({_words('text')}) BETWEEN 50 AND 100000"


@query(_SAMPLES)
def dataset_samples(spark, sf_dir):
    return datasets.samples(table(spark, sf_dir, "documents"), DatasetConfig(languages=("en", "es")))


@query(f"SELECT fmt, text, source, language, word_count::INT AS word_count FROM ({_SAMPLES}), (VALUES ('jsonl'), ('parquet'), ('huggingface')) f(fmt)")
def dataset_writers(spark, sf_dir):
    rows = datasets.samples(table(spark, sf_dir, "documents"), DatasetConfig(languages=("en", "es")))
    out = None
    for fmt in datasets.FORMATS:
        path = f"{_shared(spark)}/dataset-{fmt}-{uuid.uuid4().hex}"
        datasets.write_dataset(rows, path, fmt)
        back = datasets.read_dataset(spark, path, fmt).select(F.lit(fmt).alias("fmt"), "text", "source", "language", "word_count")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT vec_id, label + CASE WHEN vec_id % 5 = 0 THEN 100 ELSE 0 END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 7 FROM embeddings WHERE vec_id % 7 = 0")
def vector_upsert(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    new = points.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1000000).withColumn("label", F.lit(7))
    batch = points.where("vec_id % 5 = 0").withColumn("label", F.col("label") + 100).unionByName(new)
    return storage.upsert(points, batch).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def vector_delete(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return storage.delete(points, points.where("label = 3")).select("vec_id", "label")


@query("SELECT d.doc_id, d.text, sha256(d.text) AS content_hash FROM documents d WHERE d.doc_id = (SELECT min(doc_id) FROM documents x WHERE x.text = d.text) AND d.text NOT IN (SELECT text FROM documents WHERE source = 'src1')")
def ingest_new(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    stored = docs.where("source = 'src1'").select(F.sha2("text", 256).alias("content_hash"))
    return dedup.new_only(docs.select("doc_id", "text"), stored).select("doc_id", "text", "content_hash")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    counted = ingest.event_counts(table(spark, sf_dir, "events"))
    return counted.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(f"SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM ({_RATES}) WHERE lang IN ('en', 'fr') AND {_PASSES} AND {_SPAM} / greatest(n, 1) <= 0.02 GROUP BY text")
def stream_ingest(spark, sf_dir):
    """The document table as a file stream into a table by hash buckets, each text that passes once; the same as the batch."""
    path = f"{sf_dir}/documents.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    one_file = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    stream = reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir) if one_file else reader.parquet(path)
    out = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    ingest.ingest(stream, f"{out}/table", f"{out}/mark", languages=("en", "fr")).awaitTermination()
    return spark.read.parquet(f"{out}/table").select("doc_id", "content_hash")


def _language_sql(text: str) -> str:
    hits = ", ".join("len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in stops) + ")))" for stops in L.STOP_WORDS.values())
    names = "[" + ", ".join(f"'{n}'" for n in L.STOP_WORDS) + "]"
    return f"SELECT doc_id, CASE WHEN length({_strip('t')}) >= 20 AND list_max(h) > 0 THEN {names}[list_position(h, list_max(h))] END AS language FROM (SELECT doc_id, t, [{hits}] AS h FROM (SELECT doc_id, {text} AS t, {_words(f'lower({text})')} AS w FROM documents))"


@query(_language_sql("text"))
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.detect_language(F.col("text")).alias("language"))


@query(f"SELECT doc_id, coalesce(language, 'unknown') AS language FROM ({_language_sql('substring(text, 1, 2000)')})")
def language_legacy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.detect_language_or_unknown(F.col("text")).alias("language"))


_TRIGRAMS = "unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)))"


@query(f"""WITH w AS (SELECT doc_id, lang, unnest({_words('lower(text)')}) AS w FROM documents),
c AS (SELECT lang, gram, sum(n) AS c FROM (SELECT lang, n, {_TRIGRAMS} AS gram FROM (SELECT lang, w, count(*) AS n FROM w WHERE lang <> '' GROUP BY ALL)) GROUP BY ALL),
t AS (SELECT lang, floor(1000 * ln(sum(c) + (SELECT count(DISTINCT gram) FROM c)))::BIGINT AS cost FROM c GROUP BY lang),
g AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(c) DESC, gram LIMIT {language_model.GRAMS}),
m AS (SELECT gram, lang, floor(1000 * ln(c + 1))::BIGINT AS weight FROM c JOIN g USING (gram)),
dg AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, {_TRIGRAMS} AS gram FROM w) GROUP BY ALL),
s AS (SELECT doc_id, t.lang, sum(n) AS n, (sum(n * coalesce(weight, 0)) - sum(n) * any_value(cost))::BIGINT AS score FROM dg CROSS JOIN t LEFT JOIN m ON m.gram = dg.gram AND m.lang = t.lang GROUP BY ALL),
r AS (SELECT doc_id, n, lang, score - lead(score) OVER o AS margin, row_number() OVER o AS r FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, lang))
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_grams, lang AS language, margin::BIGINT AS margin FROM (SELECT DISTINCT doc_id, text FROM documents) d LEFT JOIN (SELECT * FROM r WHERE r = 1) b ON b.doc_id = d.doc_id""")
def language_model_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_model.detect(docs, language_model.fit(docs))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, NOT (host LIKE '%.com' AND starts_with(path, '/en') AND NOT starts_with(path, '/en/1')) AS allowed FROM p""")
def robots_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    files = pages.select(F.lower(U.authority(F.col("url"))).alias("origin")).distinct().select("origin", F.when(F.col("origin").endswith(".com"), 200).otherwise(404).alias("status"), F.lit("User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /en # all\nAllow: /en/1").alias("body"))
    return robots.allowed(pages, robots.parse_rules(files)).select("page_id", "allowed")


@query()
def article_scrape(spark, sf_dir):
    return article.articles(table(spark, sf_dir, "pages")).select("page_id", "title", "content", "author", "published_at", "tags", "language")


@query(f"""WITH s(ord, category, url, language, depth, n) AS (VALUES {_registry_sql()}), m AS (SELECT {_DOMAIN} AS domain, min_by(category, ord) AS category FROM s GROUP BY 1),
p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://www.set.or.th/' || page_id WHEN page_id % 4 = 1 THEN NULL ELSE url END AS url, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) END AS l FROM pages)
SELECT page_id, coalesce({_DOMAIN}, 'unknown') AS source_domain, coalesce(m.category, 'general') AS category, CASE WHEN trim(l) = '' THEN 'unknown' ELSE l END AS language, CASE WHEN url IS NULL THEN 'upload' ELSE 'web' END AS source_type FROM p LEFT JOIN m ON m.domain = {_DOMAIN}""")
def payload_enrich(spark, sf_dir):
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.set.or.th/"), "page_id")).when(F.col("page_id") % 4 != 1, F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.when(F.col("page_id") % 3 == 0, F.lit(" ")).otherwise(U.html_lang(F.col("html"))).alias("language"))
    return ingestion.enrich(pages, registry.sources(spark)).select("page_id", "source_domain", "category", "language", "source_type")


_CLEANED = _strip("regexp_replace(text, ' {2,}', ' ', 'g')")


_PASSED = f"""WITH RECURSIVE c AS (SELECT doc_id, lang, {_CLEANED} AS text FROM documents),
k AS (SELECT doc_id, text FROM ({_RATES.replace('FROM documents', 'FROM c')}) WHERE lang IN ('en', 'de', 'fr', 'es') AND {_PASSES} AND {_SPAM} / greatest(n, 1) <= 0.02),
{_signature_sql(_char_shingles_sql(f'length(text) >= {dedup.MIN_CHARS}').replace('FROM documents', 'FROM k'))},
u AS (SELECT k.doc_id, text, coalesce(is_duplicate, false) AS near FROM k LEFT JOIN banded USING (doc_id) LEFT JOIN greedy USING (rn)),
f AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM u WHERE NOT near)"""


def _outcomes(spark, sf_dir) -> DataFrame:
    return ingestion.outcomes(table(spark, sf_dir, "documents"), languages=("en", "de", "fr", "es"), near="drop")


@query(f"{_PASSED} SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) - (SELECT count(*) FROM k) AS rejected, (SELECT count(*) FROM u WHERE near) AS near_dup, (SELECT count(*) FROM f WHERE r > 1) AS exact_dup, (SELECT count(*) FROM f WHERE r = 1) AS indexed")
def ingest_stats(spark, sf_dir):
    return ingestion.stats(_outcomes(spark, sf_dir))


@query(f"{_PASSED} SELECT sha256(doc_id || ':' || chunk_index) AS id, doc_id, chunk_index, token_count, 384::INT AS dim FROM ({_chunks_sql('(SELECT * FROM f WHERE r = 1)')})")
def ingest_points(spark, sf_dir):
    """Embedded chunks of all documents that pass, near-duplicates left out."""
    return ingestion.points(_outcomes(spark, sf_dir)).select("id", "doc_id", "chunk_index", "token_count", F.size("vector").alias("dim"))


class _ByLength:
    """A network whose answers follow from the length of a url."""

    def __init__(self):
        self.asked: dict[str, int] = {}

    def get(self, url: str) -> fetch.Response:
        n, k = len(url), self.asked.get(url, 0)
        self.asked[url] = k + 1
        if n % 8 == 0 or n % 4 == 0 and k < 2:
            raise ConnectionError(url)
        return fetch.Response(404 if n % 4 == 1 else 200, "image/png" if n % 4 == 2 else "text/html; charset=utf-8", f"<p>{n}</p>")


@query("""SELECT DISTINCT url, CASE WHEN length(url) % 8 = 0 THEN 'network_error' WHEN length(url) % 4 = 1 THEN 'http_error' WHEN length(url) % 4 = 2 THEN 'not_html' ELSE 'ok' END AS outcome,
CASE WHEN length(url) % 8 = 0 THEN 4 WHEN length(url) % 4 = 0 THEN 3 ELSE 1 END::INT AS tries, CASE WHEN length(url) % 8 = 0 THEN 0 WHEN length(url) % 4 = 1 THEN 404 ELSE 200 END::INT AS status,
CASE WHEN length(url) % 8 <> 0 AND length(url) % 4 IN (0, 3) THEN '<p>' || length(url) || '</p>' END AS html FROM pages""")
def fetch_pages(spark, sf_dir):
    return fetch.fetch(table(spark, sf_dir, "pages"), _ByLength(), wait=0.0, pause=0.0).select("url", "outcome", "tries", F.coalesce("status", F.lit(0)).alias("status"), "html")


@query("""SELECT url AS feed_url, 'P' || page_id AS title, url, CASE WHEN page_id % 2 = 0 THEN 'sum & mary' ELSE 's' END AS summary, 'W' || page_id AS author, make_timestamp(2024, 5, page_id % 9 + 1, 7, 8, 9) AS published_at FROM pages
UNION ALL SELECT url, NULL, 'id' || page_id, '', NULL, NULL FROM pages""")
def feed_scrape(spark, sf_dir):
    """A feed for every page, RSS or Atom in turn: its own entry, one without a date, and one without a link, which is left out."""
    k, url = F.col("page_id").cast("string"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    day = (F.col("page_id") % 9 + 1).cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    rss = text('<?xml version="1.0"?><rss xmlns:dc="http://d"><channel><item><title><![CDATA[P', k, "]]></title><link>", url, "</link><pubDate>Wed, 0", day, ' May 2024 07:08:09 GMT</pubDate><description><![CDATA[<b>sum</b> &]]> mary</description><dc:creator> W', k, ' </dc:creator></item><item><guid isPermaLink="false">id', k, "</guid></item><item><title>none</title></item></channel></rss>")
    atom = text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">P', k, '</title><link rel="self" href="http://no"/><link href="', url, '"/><updated>2024-05-0', day, "T07:08:09Z</updated><author><name>W", k, "</name></author><summary>s</summary></entry><entry><id>id", k, "</id></entry><entry><title>none</title></entry></feed>")
    feeds = table(spark, sf_dir, "pages").select(F.col("url").alias("feed_url"), F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return sources.feed_items(feeds).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


@query(rf"SELECT url, sha256(html) AS content_hash, (strlen(html) + {len(_HTTP)})::BIGINT AS length, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def common_crawl(spark, sf_dir):
    """Pages as archives, a gzip member each, read back in ranges of members."""
    path = f"{_shared(spark)}/archives-{uuid.uuid4().hex}"
    archives.register(spark)
    pages = table(spark, sf_dir, "pages").select("url", F.encode(F.concat(F.lit(_HTTP), "html"), "UTF-8").alias("http"))
    pages.write.format("textlake_warc").mode("append").save(path)
    found = spark.read.format("textlake_warc").options(path=path, kind="response", html="true", range_bytes=1 << 20).load()
    html = F.substring(F.col("http").cast("string"), len(_HTTP) + 1, 1 << 30)
    return found.select("url", F.sha2(html, 256).alias("content_hash"), "length", U.title(html).alias("title"))


@query("SELECT DISTINCT url FROM pages")
def sitemap_discovery(spark, sf_dir):
    """An index of a sitemap for every host, and in each the host's pages."""
    pages = table(spark, sf_dir, "pages").select("url", U.authority(F.col("url")).alias("host"))
    loc = lambda c: F.concat(F.lit("<loc> "), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit(" </loc>"))
    of_host = F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))
    sets = pages.groupBy("host").agg(F.array_join(F.collect_list(F.concat(F.lit("<url>"), loc(F.col("url")), F.lit("</url>"))), "").alias("x")).select(of_host.alias("url"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("xml"))
    index = pages.select("host").distinct().agg(F.array_join(F.collect_list(F.concat(F.lit("<sitemap>"), loc(of_host), F.lit("</sitemap>"))), "").alias("x")).select(F.lit("https://root/sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>")).alias("xml"))
    return crawl.discover_sitemaps(sets.unionByName(index), spark.createDataFrame([("https://root/sitemap.xml",)], "url string"))


@query(f"SELECT vec_id::VARCHAR AS id, round({_COS}, 6) AS score, '' AS document_id, '' AS document_title, 'label ' || label AS content, label::VARCHAR AS label, 'label,url' AS fields FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def result_mapping(spark, sf_dir):
    hits = vectors.top_k(table(spark, sf_dir, "embeddings"), ASKED_VECTOR).withColumn("content", F.concat(F.lit("label "), "label")).withColumn("url", F.lit("x")).withColumn("none", F.lit(None).cast("string"))
    found = vectors.as_results(hits, "vec_id")
    return found.select("id", F.round("score", 6).alias("score"), "document_id", "document_title", "content", F.col("metadata")["label"].alias("label"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("fields"))


@query(f"SELECT source AS query_id, 'asked of ' || source AS query_text, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS retrieved_doc_ids, 7 AS latency_ms {_CONTEXT} GROUP BY source")
def query_log(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    asked = ranked.select("query_id").distinct().select("query_id", F.concat(F.lit("asked of "), "query_id").alias("query_text"), F.lit("").alias("answer"), F.lit(7).alias("latency_ms"))
    return jobs.query_logs(asked, retrieval.citations(ranked)).select("query_id", "query_text", F.array_join("retrieved_doc_ids", ",").alias("retrieved_doc_ids"), "latency_ms")


_LEGACY = _strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")


@query(rf"""WITH documents AS (SELECT doc_id, {_LEGACY} AS text FROM documents), l AS ({_language_sql('substring(text, 1, 2000)')})
SELECT doc_id, sha256(text) AS content_hash, coalesce(language, 'unknown') AS language, i::INT AS chunk_index, array_to_string(w[i * 448 + 1 : i * 448 + 512], ' ') AS content, least(i * 448 + 512, len(w))::INT - (i * 448)::INT AS token_count
FROM (SELECT doc_id, text, w, unnest(range(0, greatest(0, ceil((len(w) - 512) / 448))::BIGINT + 1)) AS i FROM (SELECT doc_id, text, {_words('text')} AS w FROM documents) WHERE len(w) > 0) JOIN l USING (doc_id)""")
def process_legacy(spark, sf_dir):
    return ingestion.process_legacy(table(spark, sf_dir, "documents")).select("doc_id", "content_hash", "language", "chunk_index", "content", "token_count")


@query(f"""WITH n AS (SELECT doc_id, count(*)::INT AS n FROM ({_chunks_sql('documents')}) GROUP BY doc_id), l AS (SELECT DISTINCT doc_id FROM labels)
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN n > 0 THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN l.doc_id IS NULL THEN 0 ELSE coalesce(n, 0) END::INT AS chunk_count FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)""")
def embed_stored(spark, sf_dir):
    """Stored documents that have a label are embedded; the others stay pending."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), "text", F.lit("pending").alias("status"))
    done, _, _ = ingestion.embed_documents(docs, table(spark, sf_dir, "labels").join(docs, "doc_id", "left_semi"))
    return done.select("doc_id", "status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


@query("SELECT doc_id, text FROM documents")
def mojibake(spark, sf_dir):
    """Documents whose bytes are read with the wrong code page, some twice, and turned back; every third is left alone."""
    wrong = lambda c: F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), "".join(map(chr, T.WINDOWS)), "".join(T.WINDOWS.values()))
    text, k = F.col("text"), F.col("doc_id") % 3
    broken = F.when(k == 0, text).when(k == 1, wrong(text)).otherwise(wrong(wrong(text)))
    return table(spark, sf_dir, "documents").select("doc_id", T.unmojibake(broken).alias("text"))


@query(rf"SELECT doc_id, {_strip(r'regexp_replace(text, ' + chr(39) + r'\s+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS line, list_filter(list_transform(string_split(replace(text, ' ', ' , '), ','), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS first_item FROM documents")
def one_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"), F.get(T.csv_list(F.replace("text", F.lit(" "), F.lit(" , "))), 0).alias("first_item"))


def _marked_page() -> F.Column:
    """The page's own html with metadata in its head that follows from page_id, and JSON-LD of four shapes: object, list, graph, and none that parses."""
    k = F.col("page_id").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    date = text('"datePublished": "2024-01-0', (F.col("page_id") % 9 + 1).cast("string"), 'T00:00:00Z"')
    shape = F.col("page_id") % 4
    json = F.when(shape == 0, text('{"author": {"name": "J', k, '"}, ', date, ', "keywords": ["k", "b', k, '"]}'))
    json = json.when(shape == 1, text('[1, {"author": [{"name": "J', k, '"}, "x"], ', date, '}, {"keywords": "k, b', k, '"}]'))
    json = json.when(shape == 2, text('{"@graph": [{"@type": "Site"}, {"author": "J', k, '", ', date, ', "keywords": []}]}')).otherwise(text('{"author": "J', k, '", ', date))
    head = text('<head><meta property="og:title" content="T', k, '"><meta name="description" content="D', k, '"><meta name="keywords" content="b', k, ', a', k, '"><link rel="canonical" href="https://c.org/', k, '"><meta name="author" content=" A', k, ' "><meta name="date" content="2023-02-03"><script type="application/ld+json">', json, '</script><img src="/i', k, '.png"><img src="https://x.org/y.png"><a rel="tag" href="/t"> z </a>')
    return F.replace(F.col("html"), F.lit("<head>"), head)


@query("""SELECT page_id, 'T' || page_id AS og_title, 'D' || page_id AS description, 'https://c.org/' || page_id AS canonical, CASE WHEN page_id % 4 = 3 THEN 'A' ELSE 'J' END || page_id AS author,
CASE WHEN page_id % 4 = 3 THEN make_timestamp(2023, 2, 3, 0, 0, 0) ELSE make_timestamp(2024, 1, page_id % 9 + 1, 0, 0, 0) END AS published_at,
array_to_string(list_sort(list_concat(['a' || page_id, 'b' || page_id, 'z'], CASE WHEN page_id % 4 < 2 THEN ['k'] ELSE [] END)), ',') AS tags, 'https://h.org/i' || page_id || '.png,https://x.org/y.png' AS images, ([1, 2, 2, 0])[page_id % 4 + 1]::INT AS json_objects FROM pages""")
def page_metadata(spark, sf_dir):
    html = F.col("html")
    rows = table(spark, sf_dir, "pages").select("page_id", _marked_page().alias("html"))
    return rows.select("page_id", U.meta(html, "og:title").alias("og_title"), U.meta(html, "description").alias("description"), U.canonical(html).alias("canonical"), U.author(html).alias("author"), U.published_at(html).cast("timestamp_ntz").alias("published_at"), F.array_join(U.tags(html), ",").alias("tags"), F.array_join(U.images(html, F.lit("https://h.org/p")), ",").alias("images"), F.size(U.json_ld(html)).alias("json_objects"))


@query("SELECT page_id, page_id % 3 <> 1 AS same, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages")
def same_domain(spark, sf_dir):
    """Every page's url against one of its host in capitals, one of a subdomain, and one of another scheme."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(U.authority(F.col("url"))).alias("host"), "url")
    other = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("HTTP://"), F.upper("host"), F.lit("/other"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("http://sub."), "host")).otherwise(F.concat(F.lit("ftp://"), "host", F.lit("?q#f")))
    return pages.select("page_id", U.is_same_domain(F.col("url"), other).alias("same"), "host")


@query("SELECT user_id AS job_id, event_id, ts, event_type AS job_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, user_id, event_id LIMIT 50")
def recent_jobs(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.struct("user_id", "event_id").alias("job_id"), "ts", F.col("event_type").alias("job_type"))
    return jobs.recent(log, "click").select(F.col("job_id.user_id").alias("job_id"), F.col("job_id.event_id").alias("event_id"), "ts", "job_type")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def get_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return storage.get(docs, "doc_id", docs.agg(F.min("doc_id")).first()[0])


@query("SELECT doc_id, list_transform(range(0, (length(text) - 1) // 448 + 1), lambda i: i::INT) AS indexes, array_to_string(list_transform(range(0, (length(text) - 1) // 448 + 1), lambda i: substring(text, i * 448 + 1, 512)), '|') AS content FROM documents WHERE length(text) > 0")
def document_with_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    found = storage.with_chunks(docs.select("doc_id"), chunking.fixed_chunks(docs))
    return found.select("doc_id", F.transform("chunks", lambda c: c["chunk_index"]).alias("indexes"), F.array_join(F.transform("chunks", lambda c: c["content"]), "|").alias("content"))


@query("""SELECT kind, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT 'documents' AS kind, doc_id FROM documents UNION ALL SELECT 'chunks', doc_id FROM (SELECT doc_id, unnest(range(0, (length(text) - 1) // 448 + 1)) FROM documents WHERE length(text) > 0) UNION ALL SELECT 'points', vec_id FROM embeddings)
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY kind""")
def delete_documents(spark, sf_dir):
    """Toxic documents with their chunks and points."""
    docs, points = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    left = storage.delete_document(docs, chunking.fixed_chunks(docs), points, gone)
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return one(left[0], "documents").unionByName(one(left[1], "chunks")).unionByName(one(left[2], "points"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source = 'src2'")
def intent_filters(spark, sf_dir):
    """The intent's languages win over the caller's."""
    intent = cleaning.intent_filter(["de", "fr"])
    spec = cleaning.merge_filters({"lang": "en", "source": "src2"}, {"lang": intent["category"]})
    return cleaning.where(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), spec)


@query("SELECT doc_id, lang AS lang_meta, source AS source_meta, 2::INT AS n FROM documents")
def scalar_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.array("lang").alias("many"))
    meta = sources.scalar_metadata(rows, ("doc_id",))
    return rows.select("doc_id", meta["lang"].alias("lang_meta"), meta["source"].alias("source_meta"), F.size(F.map_keys(meta)).alias("n"))
