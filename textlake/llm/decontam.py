"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows of words.

Texts and items are word sequences (A-Z lower-cased). An item leaks into a document if some stretch of it is within
floor(edit_share * words) word edits of the item. For windows of an item's length at every word that may lie in such a stretch, the CGK random walk
(a symbol is put out again or the walk moves on, as a random function of step and symbol says) turns edit
distance into Hamming distance; in each of WALKS walks, TABLES tables sample BITS positions, and a window that agrees with an item in one
is a candidate. Candidates are confirmed by exact edit distance of the item to the best stretch around the window. Walks drift
apart over long items, so positions are sampled from their first SPAN steps, and where they show no unedited copy, the exact distance is
taken over all windows that are left: no leak is missed. Of stretches with equally few edits, the first is reported.

Windows that cannot match are set aside before they are embedded, without loss: k edits leave at least n - 1 - 2k of an item's
word pairs whole, so places with fewer of the items' pairs nearby hold no leak. Items of two words or fewer, and those for which
that bound is 0 or less, only match exactly.

Items are a stated query set: they go to the tasks in blocks of BLOCK items and BLOCK_BYTES bytes or so, one on the driver at a time, and
every block meets all documents; nothing is shuffled but the leaks found. What a task holds of a block is linear in its words; windows
are embedded in arrays of CELLS words, whatever the lengths of items.

Defined results: null or blank texts and items match nothing; repeated items or rows are reported for each; null ids are
carried along. Extra columns are ignored by leaks() and kept by drop_leaks(). An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import filter_rows, limit_batches, materialise, release
from .words import chunks, grams, hashed, mix

#: Word edits for each word of an item, at most: similarity 0.8 or more.
EDIT_SHARE = 0.2
#: Walks, tables sampled from each, and positions that a table samples.
WALKS, TABLES, BITS = 10, 4, 4
#: Steps of a walk that positions are sampled from, at most.
SPAN = 512
#: Items, and bytes of their texts, that a task holds at a time.
BLOCK, BLOCK_BYTES = 5_000, 4 << 20
#: Words of the windows that are embedded at a time, (pair, item) hits that are looked at together, and bytes of masks that are kept.
CELLS, HITS, MASK_BYTES = 2_000_000, 2_000_000, 16 << 20
SEED = 7


def item_words(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for i, j in chunks(texts):
        _, _, _, value, first = hashed(texts[i:j], lower=True)
        out += [value[first[k] : first[k + 1]] for k in range(j - i)]
    return out


_STEP = np.random.default_rng(SEED + 1).integers(0, 1 << 64, (64, 4096), dtype=np.uint64)  # random bits of (walk, step), repeated beyond


def embed(windows: np.ndarray, n: np.ndarray, walk: np.ndarray, steps: int) -> np.ndarray:
    """CGK walks over the rows of windows, row r with n[r] words and its own walk: array of (row, step); 0 past a row's end."""
    rows, width = windows.shape
    place = np.zeros(rows, np.int64)
    out = np.zeros((rows, steps), np.uint64)
    flat, at = windows.ravel(), np.arange(rows) * width
    for s in range(steps):
        symbol = flat[at + np.minimum(place, width - 1)]
        symbol[place >= n] = 0
        out[:, s] = symbol
        place += (((symbol ^ _STEP[walk % 64, s % 4096]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
    return out


class _Masks(dict):
    """word -> bit mask of its places in an item; masks of long items are made as they are needed."""

    def __init__(self, words: np.ndarray):
        self.where: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(words.tolist()):
            self.where[x].append(k)
        self.most = max(1, MASK_BYTES // (len(words) // 8 + 64))

    def __missing__(self, x: int) -> int:
        if len(self) >= self.most:
            self.clear()
        mask = 0
        for k in self.where[x]:
            mask |= 1 << k
        self[x] = mask
        return mask


class Tables:
    """What a task needs of a block of items: their word pairs, and their keys in the LSH tables."""

    def __init__(self, items: list[tuple[int, np.ndarray]], edit_share: float = EDIT_SHARE, walks: int = WALKS, tables: int = TABLES, bits: int = BITS):
        self.items = [(i, w) for i, w in items if len(w)]
        self.length = np.array([len(w) for _, w in self.items], np.int64)
        edits = (edit_share * self.length).astype(np.int64)
        self.edits = np.where(self.length - 1 - 2 * edits > 0, edits, 0)
        self.least = self.length - 1 - 2 * self.edits
        self.single: dict[int, list[int]] = defaultdict(list)  # one-word items by word
        for k, (_, w) in enumerate(self.items):
            if len(w) == 1:
                self.single[int(w[0])].append(k)
        self.masks: dict[int, _Masks] = {}  # of items that were compared lately
        # the items of every pair: a row of (pair, items) in compressed form
        two = [np.unique(grams(w, 2)) for _, w in self.items]
        flat = np.concatenate([*two, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(two)), [len(x) for x in two])
        order = np.argsort(flat, kind="stable")
        self.pairs, begin = np.unique(flat[order], return_index=True)
        self.owners, self.begin = owner[order], np.append(begin, len(flat))
        # a bitmap over hashes tells most pairs apart before the exact lookup
        self.map_bits = max(16, int(len(self.pairs) * 16).bit_length())
        self.bitmap = np.zeros(1 << self.map_bits, bool)
        self.bitmap[(self.pairs >> np.uint64(64 - self.map_bits)).astype(np.int64)] = True
        # for every length, walk and table, the positions sampled, and every item's keys;
        # the walk passes a symbol in two steps on average, so the first 2n steps are inside the window
        rng = np.random.default_rng(SEED)
        self.walks = walks
        lengths, self.kind = np.unique(self.length, return_inverse=True)
        self.sampled_at = np.zeros((len(lengths), walks, tables, bits), np.int64)
        for k, n in enumerate(lengths.tolist()):
            self.sampled_at[k] = rng.integers(0, min(2 * n, SPAN), (walks, tables, bits))
        self.shown = np.minimum(self.length, SPAN)  # words of a window that a walk can reach
        self.item_keys = np.zeros((len(self.items), walks, tables), np.uint64)
        for part in self.even(np.arange(len(self.items))):
            rows = np.zeros((len(part), int(self.shown[part].max())), np.uint64)
            for r, k in enumerate(part.tolist()):
                rows[r, : self.shown[k]] = self.items[k][1][: self.shown[k]]
            for walk in range(walks):
                self.item_keys[part, walk] = self.keys(rows, part, np.full(len(part), walk))

    def even(self, item: np.ndarray) -> Iterator[np.ndarray]:
        """Places of item in groups of like length, of CELLS words or so each; in order within a length."""
        order = np.argsort(self.shown[item], kind="stable")
        at = 0
        while at < len(order):
            n = int(self.shown[item[order[at]]])
            to = at + max(1, CELLS // (2 * n))  # lengths grow to twice the first at most
            to = min(to, at + max(1, int(np.searchsorted(self.shown[item[order[at:to]]], 2 * n, side="right"))))
            yield order[at:to]
            at = to

    def keys(self, windows: np.ndarray, item: np.ndarray, walk: np.ndarray) -> np.ndarray:
        """For every window (of its item's length) and table of its walk, a hash of the sampled positions."""
        n, at = self.length[item], self.sampled_at[self.kind[item], walk]
        shown = embed(windows, self.shown[item], walk, min(2 * int(n.max(initial=0)), SPAN))
        key = np.broadcast_to(n.astype(np.uint64)[:, None], at.shape[:2])
        for b in range(at.shape[2]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(shown, at[:, :, b], axis=1))
        return key

    def distance(self, k: int, text: list[int]) -> tuple[int, int]:
        """Least edit distance of item k to a stretch of text, and the stretch's end (Myers' bit vectors, free ends)."""
        m = len(self.items[k][1])
        mask = self.masks.get(k)
        if mask is None:
            if len(self.masks) >= 64 or m > 1000:  # whose masks take the square of their length
                self.masks.clear()
            mask = self.masks[k] = _Masks(self.items[k][1])
        where = mask.where
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best, end = full, 0, m, m, 0
        for j, x in enumerate(text):
            eq = mask[x] if x in where else 0
            d = (((eq & up) + up) ^ up) | eq | down
            rise, fall = down | (full & ~(d | up)), up & d
            score += bool(rise & top) - bool(fall & top)
            if score < best:
                best, end = score, j + 1
            rise, fall = rise << 1 & full, fall << 1 & full
            up, down = (fall | (full & ~(d | rise))) & full, rise & d
        return best, end

    def places(self, value: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, window starts) wherever enough of an item's pairs are close together in a chunk."""
        two = grams(value, 2)
        at = np.flatnonzero(self.bitmap[(two >> np.uint64(64 - self.map_bits)).astype(np.int64)])
        pair = np.minimum(np.searchsorted(self.pairs, two[at]), len(self.pairs) - 1)
        same = self.pairs[pair] == two[at]
        at, pair = at[same], pair[same]
        text = np.searchsorted(first, at, side="right") - 1
        inside = at + 1 < first[text + 1]
        at, pair, text = at[inside], pair[inside], text[inside]
        total = int((self.begin[pair + 1] - self.begin[pair]).sum())
        if total <= HITS:
            yield from self.dense(at, pair, text, first, self.begin, self.owners)
            return
        for part in np.array_split(np.arange(len(self.items)), -(-total // HITS)):  # pairs that many items share
            if len(part):
                own = (self.owners >= part[0]) & (self.owners <= part[-1])
                yield from self.dense(at, pair, text, first, np.append(0, np.cumsum(own))[self.begin], self.owners[own])

    def dense(self, at: np.ndarray, pair: np.ndarray, text: np.ndarray, first: np.ndarray, begin: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        many = begin[pair + 1] - begin[pair]
        hit = np.repeat(np.arange(len(at)), many)
        item = owners[np.repeat(begin[pair] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(len(hit))]
        group = text[hit] * len(self.items) + item
        order = np.argsort(group, kind="stable")
        group, item, at, text = group[order], item[order], at[hit[order]], text[hit[order]]
        ahead = np.arange(len(group)) + self.least[item] - 1
        known = ahead < len(group)
        ahead[~known] = 0
        near = known & (group[ahead] == group) & (at[ahead] - at <= self.length[item] + self.edits[item] - 2)  # within the longest stretch, so that none of the marks below is void
        keep = np.flatnonzero(near)
        for part in np.split(keep, np.flatnonzero(np.diff(group[keep])) + 1) if len(keep) else []:
            k, t = int(item[part[0]]), int(text[part[0]])
            n, e = int(self.length[k]), int(self.edits[k])
            a, b = int(first[t]), int(first[t + 1])
            # a stretch that holds the pairs from part to ahead[part] starts at the first or before, and reaches the last
            marks = np.zeros(b - a + 2, np.int64)
            np.add.at(marks, np.clip(at[ahead[part]] + 2 - a - n - e, 0, b - a), 1)
            np.add.at(marks, at[part] - a + 1, -1)
            yield t, k, np.flatnonzero(np.cumsum(marks)[: b - a] > 0)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For every text, (item, start, end, distance) of its leaks."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        rows: list[tuple[int, int, np.ndarray]] = []
        held: dict[int, np.ndarray] = {}
        for i, j in chunks(texts) if len(self.items) else ():
            _, _, _, value, first = hashed(texts[i:j], lower=True)
            if len(self.pairs) and len(value) > 1:
                for t, k, starts in self.places(value, first):
                    held.setdefault(i + t, value[first[t] : first[t + 1]].copy())
                    rows.append((i + t, k, starts))
            for x, same in self.single.items():
                for w in np.flatnonzero(value == np.uint64(x)):
                    t = int(np.searchsorted(first, w, side="right")) - 1
                    for k in same:
                        best.setdefault((i + t, k), (int(w - first[t]), int(w - first[t]) + 1, 0))
        if rows:
            text, item = (np.concatenate([np.full(len(g[2]), g[c]) for g in rows]) for c in (0, 1))
            start = np.concatenate([g[2] for g in rows])
            for part in self.even(item):
                self.match(text[part], item[part], start[part], held, best)
            for t, k, starts in rows:
                self.settle(t, k, starts, held[t], best)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for (t, k), v in sorted(best.items()):
            out[t].append((k, *v))
        return out

    def match(self, text: np.ndarray, item: np.ndarray, start: np.ndarray, held: dict[int, np.ndarray], best: dict) -> None:
        """Embed the windows (text, start), look them up in their item's keys, and confirm those that agree.

        Most leaks are exact and show in the first walk; the windows of what it leaves open go through all others at once.
        """
        windows = np.zeros((len(text), int(self.shown[item].max())), np.uint64)
        for r, (t, s, m) in enumerate(zip(text.tolist(), start.tolist(), self.shown[item].tolist(), strict=True)):
            part = held[t][s : s + m]
            windows[r, : len(part)] = part
        mark = windows[:, 0] + item.astype(np.uint64)
        for k in range(1, windows.shape[1]):
            mark = (mark * np.uint64(0x9FB21C651E98DF25)) ^ windows[:, k] ^ (mark >> np.uint64(29))
        _, one, back = np.unique(mark, return_index=True, return_inverse=True)  # a passage that many texts share is embedded once
        pair = text * len(self.items) + item
        seen = np.zeros(len(text), bool)
        for walks in (np.arange(1), np.arange(1, self.walks)):
            solved = np.array([t * len(self.items) + k for (t, k), v in best.items() if v[2] == 0], np.int64)
            open_ = ~seen & ~np.isin(pair, solved)
            need = np.unique(back[open_])
            agree = np.zeros(len(one), bool)
            step = max(1, CELLS // (2 * windows.shape[1] * len(walks)))
            for low in range(0, len(need), step):
                part = need[low : low + step]
                rows, walk = np.repeat(one[part], len(walks)), np.tile(walks, len(part))
                same = (self.keys(windows[rows], item[rows], walk) == self.item_keys[item[rows], walk]).any(axis=1)
                agree[part] = same.reshape(len(part), len(walks)).any(axis=1)
            for r in np.flatnonzero(agree[back] & open_).tolist():
                t, k, s = int(text[r]), int(item[r]), int(start[r])
                seen[r] = True
                if (t, k) not in best or best[t, k][2]:
                    limit = int(self.edits[k])
                    self.compare(t, k, max(0, s - limit), s + int(self.length[k]) + limit, held[t], best)

    def compare(self, t: int, k: int, low: int, high: int, text: np.ndarray, best: dict) -> None:
        """Keep the item's best stretch of text[low:high] if it is better than what is known."""
        n = int(self.length[k])
        cost, end = self.distance(k, text[low:high].tolist())
        if cost <= self.edits[k]:
            now = (max(low, low + end - n), low + end, cost)
            had = best.get((t, k))
            if had is None or (cost, now[0]) < (had[2], had[0]):
                best[t, k] = now

    def settle(self, t: int, k: int, starts: np.ndarray, text: np.ndarray, best: dict) -> None:
        """The exact distance of item k to the text at all its windows, unless an unedited copy is known."""
        n, limit = int(self.length[k]), int(self.edits[k])
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > n + limit) + 1):
            if (t, k) in best and best[t, k][2] == 0:
                return
            self.compare(t, k, int(run[0]), int(run[-1]) + n + limit, text, best)


def _items(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[int, bytes]]]]:
    """The number of blocks, and the items in blocks by hash; each block is read on its own."""
    rows = benchmark.where("text is not null").select("item_id", F.encode("text", "UTF-8").alias("text"))
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-held // BLOCK_BYTES))

    def read() -> Iterator[list[tuple[int, bytes]]]:
        for b in range(blocks):
            part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
            block = [(r.item_id, bytes(r.text)) for r in part.collect()]
            if block:
                yield block

    return blocks, read()


def _scanner(block: list[tuple[int, bytes]], edit_share: float):
    made: list[Tables] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            ids = [i for i, _ in block]
            made.append(Tables(list(zip(ids, item_words([t for _, t in block]), strict=True)), edit_share))
        tables = made[0]
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            out = [(row, tables.items[k][0], *rest) for row, found in enumerate(tables.scan(texts)) for k, *rest in found]
            if out:
                row, item, start, end, cost = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, end, cost))], ["doc_id", "item_id", "start_word", "end_word", "edits"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits): the best stretch of every item that leaks into a document."""
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, start_word long, end_word long, edits long"
    blocks, items = _items(benchmark)
    found = []
    for block in items:
        now = rows.mapInArrow(_scanner(block, edit_share), schema)
        found.append(now if blocks == 1 else materialise(now, "leaks"))  # of several blocks, none stays on the driver
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _dropper(block: list[tuple[int, bytes]], edit_share: float, text: str):
    made: list[Tables] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Tables(list(zip([i for i, _ in block], item_words([t for _, t in block]), strict=True)), edit_share))
        for batch in batches:
            texts = [x or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([not found for found in made[0].scan(texts)], pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns."""
    limit_batches(docs.sparkSession)
    blocks, items = _items(benchmark)
    for block in items:
        was, docs = docs, filter_rows(docs, lambda text, block=block: _dropper(block, edit_share, text))
        if blocks > 1:
            docs = materialise(docs, "clean")
            release(was)
    return docs
