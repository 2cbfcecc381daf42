"""Quality rules: base counts, then a calibrated logistic regression over hashed word and character n-grams.

The model is fitted on at most SAMPLE labelled documents (those whose ids hash lowest), a quarter of them held out
to calibrate its probability, and scores whole texts in Arrow batches against fixed thresholds.

Defined results: a null or blank text has no words and fails the base rules. Labels with a null id or quality are
ignored; for an id that is labelled twice the lower quality counts. Without labels of both kinds the model
keeps everything that passes the base rules. Every row gets a row, repeated or null ids included; extra columns pass through
keep() and are ignored by assess(). Bytes that are no UTF-8 count as U+FFFD, each text on its own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import filter_rows, limit_batches, materialise
from .words import chunks, grams, hashed

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4000
WORD_BINS = CHAR_BINS = 4096
BINS = WORD_BINS + CHAR_BINS
#: Base rules: words at least, and words in repeated 3-word windows at most, in percent.
MIN_WORDS, MAX_REPEAT = 50, 50
#: A document is kept from this probability of being good.
KEEP_FROM = 0.5

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Model:
    """Weights over BINS, a bias, and the calibration slope and offset; weights None: keep all."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, x: np.ndarray) -> float:
        if self.weights is None:
            return 1.0
        z = self.slope * (float(x @ self.weights) + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _repeated(windows: np.ndarray, n_words: int) -> int:
    """Words that lie in a window found twice or more."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n_words, bool)
    for k in range(n_words - len(windows) + 1):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def examine(texts: list[bytes], features: bool = True) -> Iterator[tuple[tuple[int, ...], np.ndarray | None]]:
    """For each text (of valid UTF-8), the COUNTS and the normalised feature vector."""
    for i, j in chunks(texts):
        part = texts[i:j]
        buf, starts, ends, value, first = hashed(part)
        at = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in part], out=at[1:])
        lead = (buf & 0xC0) != 0x80
        in_word = (buf != 32) & ((buf < 9) | (buf > 13))
        chars = np.concatenate([[0], np.cumsum(lead & in_word)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
        three, two = grams(value, 3), grams(value, 2)
        if features:
            points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
            begin = np.concatenate([[0], np.cumsum(lead)])[at]
            tri = ((points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(20)
            one = (points * np.uint32(0x165667B1)) >> np.uint32(20)
            one_word, two_words = (value >> np.uint64(52)).astype(np.int64), (two >> np.uint64(52)).astype(np.int64)
        for k, text in enumerate(part):
            a, b = int(first[k]), int(first[k + 1])
            lines = [x for x in text.split(b"\n") if x.strip()]
            counts = (b - a, int(chars[at[k + 1]] - chars[at[k]]), int(symbols[at[k + 1]] - symbols[at[k]]), len(lines) - len(set(lines)), _repeated(three[a : max(a, b - 2)], b - a))
            x = None
            if features:
                x = np.zeros(BINS, np.float32)
                x[:WORD_BINS] = np.bincount(one_word[a:b], minlength=WORD_BINS) + np.bincount(two_words[a : max(a, b - 1)], minlength=WORD_BINS)
                c, d = int(begin[k]), int(begin[k + 1]) - 1  # without the separator
                x[WORD_BINS:] = np.bincount(one[c:d], minlength=CHAR_BINS) + np.bincount(tri[c : max(c, d - 2)], minlength=CHAR_BINS)
                np.log1p(x, out=x)
                for half in (x[:WORD_BINS], x[WORD_BINS:]):
                    half /= max(float(np.sqrt(half @ half)), 1e-9)
            yield counts, x


def valid(text: bytes) -> bytes:
    """The text, with U+FFFD for what is no UTF-8."""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def _utf8(column: pa.Array) -> list[bytes]:
    return [valid(x or b"") for x in column.cast(pa.binary()).to_pylist()]


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [x.astype(np.float16).tobytes() for _, x in examine(_utf8(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), batch.column(2)], ["doc_id", "x", "quality"])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Accelerated full-batch gradient descent; both kinds weigh the same."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    w, b, step = np.zeros(x.shape[1], np.float32), 0.0, 1.5
    look_w, look_b = w, b
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ look_w + look_b)))
        miss = weight * (p - y)
        new_w, new_b = look_w - step * (x.T @ miss + l2 * look_w), look_b - step * float(miss.sum())
        pull = (t - 1) / (t + 2)
        look_w, look_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    return w, b


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset by Newton steps on smoothed targets."""
    good = y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    v = np.array([1.0, 0.0])
    m = np.stack([z, np.ones_like(z)], axis=1).astype(np.float64)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ v, -30, 30)))
        grad = m.T @ (p - target) + np.array([1e-3 * v[0], 0])
        hess = (m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2)
        v = v - np.linalg.solve(hess, grad)
    return float(v[0]), float(v[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents whose ids hash lowest, `sample` at most."""
    spark = docs.sparkSession
    limit_batches(spark)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if len({r.quality > 0 for r in chosen}) < 2:
        return Model()
    # every fourth of each kind is held out and goes to the end
    chosen.sort(key=lambda r: (r.quality, r.doc_id))
    train = [r for k, r in enumerate(chosen) if k % 4]
    order = train + [r for k, r in enumerate(chosen) if k % 4 == 0]
    few = F.broadcast(spark.createDataFrame([(r.doc_id, r.quality) for r in chosen], "doc_id long, quality int"))  # `sample` rows at most
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").mapInArrow(_featurise, "doc_id long, x binary, quality int")
    # one array, filled partition by partition; of rows that repeat an id the greatest counts
    at, seen = {r.doc_id: k for k, r in enumerate(order)}, {}
    x = np.zeros((len(order), BINS), np.float32)
    for r in materialise(found, "features").coalesce(8).toLocalIterator():
        mark = hashlib.blake2b(r.x, digest_size=8).digest()
        if mark >= seen.get(r.doc_id, b""):
            seen[r.doc_id] = mark
            x[at[r.doc_id]] = np.frombuffer(r.x, np.float16)
    there = [k for k, r in enumerate(order) if r.doc_id in seen]
    for new, old in enumerate(there):
        if new != old:
            x[new] = x[old]
    y = np.array([order[k].quality > 0 for k in there], np.float32)
    x, m = x[: len(there)], sum(k < len(train) for k in there)
    if len(set(y.tolist())) < 2:
        return Model()
    if len(set(y[:m].tolist())) < 2 or m == len(y):
        return Model(*_logistic(x, y))
    w, b = _logistic(x[:m], y[:m])
    return Model(w, b, *_calibrate(x[m:] @ w + b, y[m:]))


def _assessor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for counts, x in examine(_utf8(batch.column(1)), model.weights is not None):
                failed, p = base_failed(counts), model.probability(x)
                out.append((*counts, failed, not failed and p >= KEEP_FROM, p))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *COUNTS, "base_failed", "kept", "p_good"])

    return run


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the COUNTS, base_failed, kept and the calibrated probability, for every row of docs."""
    limit_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_assessor(model), f"doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, p_good double")


def _keeper(model: Model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _utf8(batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array([not base_failed(c) and model.probability(x) >= KEEP_FROM for c, x in examine(texts, model.weights is not None)], pa.bool_()))

    return run


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    limit_batches(docs.sparkSession)
    return filter_rows(docs, lambda text: _keeper(model, text))
