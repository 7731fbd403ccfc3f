"""Evaluation items that stand, wholly or partly, in corpus documents.

The corpus is read in shards; each gets a suffix array over its normalised
words.  Every suffix of every item is binary-searched in every shard, which
gives all places that share a stretch of words with it and, joined along
diagonals, the longest verbatim matches.  Matches of one item that follow each other in one place of a
document are chained, and the chain tells how much of the item stands there, altered words included.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: Words (for zh and ja characters) that a stretch must share verbatim.
SEED_WORDS, SEED_CHARS = 4, 8
#: Share of an item that a document must hold, and of that stretch the share that must be verbatim.
SHARE, VERBATIM = 0.5, 0.6
#: Words of a shard; longer documents make a longer shard.
SHARD = 1_000_000
#: Characters of items that are broadcast at once; more are searched in parts.
MAX_ITEM_CHARS = 50_000_000
#: Places of shared stretches that are held at once; a shard with more (a stock phrase of many items and documents) is searched in halves.
MOST_PLACES = 4_000_000
#: Two verbatim stretches belong to one passage if at most so many words of the item or of the document lie between them; so many altered words in a row may end a passage.
GAP_ITEM, GAP_DOC, ALTERED = 30, 40, 3

_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{N}\p{M}--[\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)
_CHARS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, marks and compatibility forms; Han and kana singly."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text).casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _TOKEN.findall(text)


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``x`` in order of their first ``depth`` numbers, by prefix doubling."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(x)
    order = np.argsort(rank, kind="stable")
    while k < depth and n > 1:
        follow = np.zeros(n, np.int64)
        follow[:-k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        new = np.cumsum(step)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


def _narrow(x: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search, for all patterns at once, of the part of [lo, hi) whose number at ``depth`` is ``token``."""

    def bound(left: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            at = np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(x) - 1)
            less = x[at] < token if left else x[at] <= token
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)

    return bound(True), bound(False)


class Items:
    """The evaluation items, as numbers of a vocabulary of their own words (0: any other word)."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        self.ids, self.tokens, self.seed = [], [], []
        self.vocabulary: dict[str, int] = {}
        for item_id, lang, text in rows:
            w = words(text)
            if not w:
                continue
            chars = sum(bool(_CHARS.match(t)) for t in w) > len(w) / 2
            self.ids.append(item_id)
            self.seed.append(SEED_CHARS if chars else SEED_WORDS)
            self.tokens.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in w], np.int64))
        self.longest = max(map(len, self.tokens), default=0)
        starts, of, seeds = [], [], []
        at = 0
        for k, t in enumerate(self.tokens):
            last = len(t) - min(self.seed[k], len(t)) + 1
            starts += range(at, at + last)
            of += [k] * last
            seeds += [min(self.seed[k], len(t))] * last
            at += len(t)
        self.flat = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.int64)
        self.offset = np.cumsum([0, *map(len, self.tokens)])
        self.start, self.of, self.need = (np.array(z, np.int64) for z in (starts, of, seeds))


def seeds(items: Items, x: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Item, place in the item and place in ``x`` of every stretch of seed length shared by both; None if they are more than ``most``."""
    sa = suffix_array(x, int(items.need.max()))
    lo, hi = np.zeros(len(items.start), np.int64), np.full(len(items.start), len(x), np.int64)
    active = np.arange(len(items.start))
    for depth in range(int(items.need.max())):
        active = active[(items.need[active] > depth) & (lo[active] < hi[active])]
        if not len(active):
            break
        lo[active], hi[active] = _narrow(x, sa, lo[active], hi[active], depth, items.flat[items.start[active] + depth])
    many = np.maximum(hi - lo, 0)
    if most is not None and many.sum() > most:
        return None
    which = np.repeat(np.arange(len(many)), many)
    within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return items.of[which], items.start[which] - items.offset[items.of[which]], sa[lo[which] + within]


def _held(runs: list[tuple[int, int, int]], item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int]:
    """The longest stretch of ``item`` that stands in one place of ``doc``: its first word and the one after its last, in the item and in the document.

    ``runs`` are verbatim matches (place in item, place in doc, length).  A run may
    follow another if it lies behind it in both, at nearly the same distance.
    The stretch goes from the first to the last word matched; it is empty if too little of it is verbatim.
    """
    runs.sort()
    n = len(item)
    best = (0, 0, 0, 0)
    states: list[tuple[float, int, int, int]] = []  # score, index of the first run, verbatim, index
    for i, (a, d, length) in enumerate(runs):
        top = (float(length), i, length)
        for score, start, same, j in states:
            a0, d0, l0 = runs[j]
            overlap = max(0, a0 + l0 - a, d0 + l0 - d)
            if a <= a0 or d <= d0 or overlap >= length:
                continue
            gap_a, gap_d = a + overlap - a0 - l0, d + overlap - d0 - l0
            skew = abs(gap_a - gap_d)
            if gap_a > GAP_ITEM or gap_d > GAP_DOC or skew > 3 + 0.4 * max(gap_a, gap_d):
                continue
            new = score + length - overlap - 0.5 * skew - 0.15 * min(gap_a, gap_d)
            if new > top[0]:
                top = (new, start, same + length - overlap)
        states.append((*top, i))
        begin, end = runs[top[1]][0], a + length
        if (end - begin) < SHARE * n - 2 * ALTERED or best[1] - best[0] >= end - begin:
            continue
        reach = _reach(top[2], runs[top[1]], runs[i], item, doc)
        if reach[1] - reach[0] > best[1] - best[0]:
            best = reach
    return best


def _reach(verbatim: int, first: tuple[int, int, int], last: tuple[int, int, int], item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int]:
    """The stretch from one run to another, lengthened at its ends over single altered words; empty if too little is verbatim."""
    ends = []
    for way, i, j in ((1, last[0] + last[2], last[1] + last[2]), (-1, first[0] - 1, first[1] - 1)):
        end, miss = (i, j) if way > 0 else (i + 1, j + 1), 0
        inside = lambda p, q: 0 <= p < len(item) and 0 <= q < len(doc)
        while inside(i, j) and miss < ALTERED:
            for di, dj in ((0, 0), (1, 1), (0, 1), (1, 0), (2, 2)):
                p, q = i + way * di, j + way * dj
                if inside(p, q) and item[p] == doc[q]:
                    verbatim, miss = verbatim + 1, miss + bool(di or dj)
                    end = (p + 1, q + 1) if way > 0 else (p, q)
                    i, j = p + way, q + way
                    break
            else:
                break
        ends.append(end)
    (stop_a, stop_d), (start_a, start_d) = ends
    return (start_a, stop_a, start_d, stop_d) if verbatim >= VERBATIM * (stop_a - start_a) else (0, 0, 0, 0)


def search(items: Items, keys: list, texts: list[list[int]]) -> list[tuple]:
    """(key, item id, share held, first word in the item, the one after the last, and both in the document) for the documents of one shard, whose words are numbers of the items' vocabulary."""
    if not items.ids or not texts:
        return []
    lengths = np.array([len(t) + 1 for t in texts])
    x = np.empty(lengths.sum(), np.int64)
    begins = np.cumsum(lengths) - lengths
    for t, b in zip(texts, begins):
        x[b : b + len(t)] = t
        x[b + len(t)] = 0  # a word of no item, so nothing runs over the end of a document
    found = seeds(items, x, MOST_PLACES if len(texts) > 1 else None)
    if found is None:
        half = len(texts) // 2
        return search(items, keys[:half], texts[:half]) + search(items, keys[half:], texts[half:])
    item, at, place = found
    if not len(item):
        return []
    doc = np.searchsorted(begins, place, side="right") - 1
    order = np.lexsort((at, place - at, doc, item))
    item, at, place, doc = item[order], at[order], place[order], doc[order]
    diagonal = place - at
    new_pair = np.ones(len(item), bool)
    new_pair[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])
    size = np.array(items.seed)
    new_run = new_pair.copy()
    new_run[1:] |= (diagonal[1:] != diagonal[:-1]) | (at[1:] > at[:-1] + 1)
    run = np.flatnonzero(new_run)
    run_end = np.append(run[1:], len(item)) - 1
    run_item, run_doc = item[run], doc[run]
    run_len = at[run_end] - at[run] + np.minimum(size[run_item], np.diff(items.offset)[run_item])
    pair = np.cumsum(new_pair)[run] - 1
    covered = np.bincount(pair, run_len)
    pair_first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    pair_stop = np.append(pair_first[1:], len(run))
    n_words = np.diff(items.offset)[run_item[pair_first]]
    out = []
    # A stretch that is VERBATIM in seeds has at least this much in runs; short runs between altered words need not count.
    for p in np.flatnonzero(covered >= 0.5 * SHARE * VERBATIM * n_words):
        s = slice(pair_first[p], pair_stop[p])
        k, d = int(run_item[s.start]), int(run_doc[s.start])
        base = int(begins[d])
        runs = [(int(a), int(b) - base, int(n)) for a, b, n in zip(at[run[s]], place[run[s]], run_len[s])]
        stretch = _held(runs, items.tokens[k], x[base : base + lengths[d] - 1])
        share = (stretch[1] - stretch[0]) / len(items.tokens[k])
        if share >= SHARE:
            out.append((keys[d], items.ids[k], share, *stretch))
    return out


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, ``item_key``, ``share``, and where it stands, of every document that holds half or more of an item in one place and in order.

    item_from and item_to are the first word of the item that the document holds and the one after the last, doc_from and doc_to
    the same in the document; words are those of :func:`words`, counted from 0.
    The documents are read once and not shuffled.  The items, a fixed test set, are indexed once and
    broadcast; more than MAX_ITEM_CHARS characters of them are searched in parts, each a pass over the documents.
    Null, empty and blank texts hold nothing and items without words are held by nothing.  Very long
    documents are searched whole; repeated documents are reported each.
    Documents with a null key are reported with a null key.
    """
    chars = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    parts = max(1, -(-chars // MAX_ITEM_CHARS))
    placed = items.withColumn("_part", F.pmod(F.xxhash64(item_key, item_text), F.lit(parts)))
    found = [_leaked(documents, key, text, placed.where(F.col("_part") == p), item_key, item_text, lang) for p in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _leaked(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, lang: str) -> DataFrame:
    rows = [tuple(r) for r in items.select(item_key, lang, item_text).orderBy(item_key).collect()]  # about MAX_ITEM_CHARS at most
    shared = documents.sparkSession.sparkContext.broadcast(Items(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        known = tests.vocabulary.get
        keys: list = []
        texts: list[list[int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = search(tests, keys, texts)
            kinds = [key_type, pa.int64(), pa.float64(), *[pa.int32()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names=names)

        key_type, names = pa.int64(), [key, item_key, "share", "item_from", "item_to", "doc_from", "doc_to"]
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = [known(z, 0) for z in words(t)]
                if not w:
                    continue
                keys.append(k)
                texts.append(w)
                size += len(w)
                if size >= SHARD:
                    yield flush()
                    keys, texts, size = [], [], 0
        if keys:
            yield flush()

    docs = documents.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, `{item_key}` bigint, share double, item_from int, item_to int, doc_from int, doc_to int")


def without_leaked(documents: DataFrame, key: str, text: str, items: DataFrame, **names: str) -> DataFrame:
    """``documents`` less those that hold an item; every row of a key that holds one goes. Rows with a null key stay unless any such row holds one."""
    found = leaked_items(documents, key, text, items, **names).select(F.col(key).alias("_held")).distinct()
    return documents.join(found, documents[key].eqNullSafe(F.col("_held")), "left_anti")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold an evaluation item."""
    found = leaked_items(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "evalitems"))
    return found.select("doc_id", "item_id").distinct()


def p9_kept(spark: SparkSession, root: str) -> DataFrame:
    """Number of documents, by source, that are left when those that hold an evaluation item are removed."""
    kept = without_leaked(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "evalitems"))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_kept": p9_kept}

SQL: dict[str, str] = {}
