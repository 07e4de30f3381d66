"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass counts how often the benchmark's words occur in the corpus. An n-gram of a test item is a rare seed if
   independent words would make it by chance in at most ``CHANCE`` of the documents; leaked copies can't make a seed
   common. Every item keeps at least its rarest quarter of n-grams, so each item can be found.
2. One pass over the documents looks the seeds up. Hits of one item close to one diagonal make a candidate passage, and
   local alignment over words (match 2, other word -1, gap -1) scores it, all candidates of a batch together. A document
   is contaminated by an item if the score is ``MIN_SCORE`` of a full match's or more.

The benchmark is the small side: its index is sent to all tasks in shards of at most ``SHARD_WORDS`` words. A larger
benchmark means more shards, searched one after the other, so that a task holds one at a time; words are counted for ``TOGETHER``
shards in one pass. Documents are not shuffled by the search.

Words are runs of other than white space and ASCII punctuation, with A-Z lower-cased. Defined cases: null or empty
texts and items never match; items of under ``NGRAM`` words use shorter seeds; an item that occurs twice in a text
gives its best passage; ties go to the first passage; repeated rows are searched one by one; empty tables give no row.
"""

from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import stored

from .common import BROADCAST_ROWS, small_batches, text_or_empty
from .rolling import Batch, slices, window_hashes

NGRAM, CHANCE, MIN_SCORE, SHARD_WORDS, TOGETHER = 3, 1e-4, 0.6, 1_000_000, 4
MATCH, OTHER, GAP = 2, -1, -1
_PUNCTUATION = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(b for b in range(33, 127) if not chr(b).isalnum()), b"abcdefghijklmnopqrstuvwxyz" + b" " * sum(not chr(b).isalnum() for b in range(33, 127)))
#: Hash bits of the table that screens n-grams before the exact lookup.
_SCREEN = 22


def normal(text: str | bytes | None) -> bytes:
    if text is None:
        return b""
    return (text.encode() if isinstance(text, str) else text).translate(_PUNCTUATION)


class Items:
    """Test items of one shard, by word hashes."""

    def __init__(self, ids: list[int], texts: list[str]):
        keep = [(i, b) for i, t in zip(ids, texts, strict=True) if (b := normal(t)).split()]
        self.ids = [i for i, _ in keep]
        words = Batch([b for _, b in keep])
        self.words = [words.hashes[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
        self.vocabulary = np.unique(words.hashes)

    def index(self, counts: np.ndarray, total: int, n: int, chance: float, docs: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each seed length: sorted hashes, and the item and position of each."""
        rarity = np.log(np.maximum(counts, 0.5) / max(total, 1))
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, words in enumerate(self.words):
            size = min(n, len(words))
            grams = window_hashes(words, size)
            own = rarity[np.searchsorted(self.vocabulary, words)]
            expected = np.exp(np.convolve(own, np.ones(size), "valid")) * total
            bar = max(chance * docs, np.partition(expected, (len(expected) - 1) // 4)[(len(expected) - 1) // 4])
            at = np.flatnonzero(expected <= bar)
            found.setdefault(size, []).append((grams[at], np.full(len(at), k), at))
        out = []
        for size, parts in sorted(found.items()):
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            out.append((size, h[order], item[order], at[order]))
        return out


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and the passage word at which it first ends."""
    rows, width = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), rows), dtype=np.uint64), np.zeros((len(items), width), dtype=np.uint64)
    inside = np.zeros((len(items), width), dtype=bool)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)], b[k, : len(y)], inside[k, : len(y)] = x, y, True
    lengths = np.array([len(x) for x in items])
    ramp = np.arange(width, dtype=np.int32) * -GAP
    h = np.zeros((len(items), width + 1), dtype=np.int32)
    best, end = np.zeros(len(items), dtype=np.int32), np.zeros(len(items), dtype=np.int64)
    for i in range(rows):
        score = np.where((a[:, i : i + 1] == b) & inside, MATCH, OTHER).astype(np.int32)
        up = np.maximum(np.maximum(h[:, :-1] + score, h[:, 1:] + GAP), 0)
        up = np.maximum.accumulate(up + ramp, axis=1) - ramp
        up[i >= lengths] = 0
        up[~inside] = 0
        h[:, 1:] = up
        top = up.argmax(axis=1)
        now = up[np.arange(len(items)), top]
        more = now > best
        best[more], end[more] = now[more], top[more]
    return best, end


def _align_all(jobs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = [(0, 0)] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda k: len(jobs[k][1]))
    lo = 0
    while lo < len(order):  # of like length together, about 4 million cells a row at most
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(jobs[order[hi]][1]) <= 1 << 18:
            hi += 1
        part = order[lo:hi]
        best, end = align([jobs[k][0] for k in part], [jobs[k][1] for k in part])
        for k, s, e in zip(part, best.tolist(), end.tolist(), strict=True):
            out[k] = (s, e)
        lo = hi
    return out


class Finder:
    def __init__(self, items: Items, index, min_score: float):
        self.items, self.index, self.min_score = items, index, min_score
        self.screens = []
        for _, hashes, _, _ in index:
            screen = np.zeros(1 << _SCREEN, dtype=bool)
            screen[(hashes >> np.uint64(64 - _SCREEN)).astype(np.int64)] = True
            self.screens.append(screen)

    def _hits(self, words: Batch):
        """(text, item, diagonal) of all seed hits."""
        for (size, hashes, item, at), screen in zip(self.index, self.screens, strict=True):
            grams = window_hashes(words.hashes, size)
            pos = np.flatnonzero(screen[(grams >> np.uint64(64 - _SCREEN)).astype(np.int64)] & words.inside(size)) if len(grams) else np.empty(0, dtype=np.int64)
            lo, hi = np.searchsorted(hashes, grams[pos]), np.searchsorted(hashes, grams[pos], side="right")
            n = hi - lo
            which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else n
            where = np.repeat(pos, n)
            yield words.owner[where], item[which], where - at[which]

    def find(self, texts: list[bytes]) -> list[list[tuple[int, float, int, int]]]:
        """(item, score, first word, end word) of each text's contaminating items."""
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        for lo, hi in slices(texts):
            words = Batch(texts[lo:hi])
            hits = [np.concatenate(x) for x in zip(*self._hits(words), strict=True)] if self.index else []
            if not hits or not len(hits[0]):
                continue
            order = np.lexsort((hits[2], hits[1], hits[0]))
            owner, item, diagonal = (x[order] for x in hits)
            lengths = np.array([len(w) for w in self.items.words])
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > lengths[item[1:]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(owner)) - 1
            jobs, place = [], []
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                k, size = int(item[a]), int(lengths[item[a]])
                slack = size // 2 + 2
                at = max(int(words.first[owner[a]]), int(diagonal[a]) - slack)
                to = min(int(words.first[owner[a] + 1]), int(diagonal[b]) + size + slack)
                jobs.append((self.items.words[k], words.hashes[at:to]))
                place.append((int(owner[a]), k, at))
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for (text, k, at), (score, end) in zip(place, _align_all(jobs), strict=True):
                if score >= self.min_score * MATCH * lengths[k] and score > best.get((text, k), (0, 0, 0))[0]:
                    best[text, k] = (score, at, at + end + 1)
            back = list(best.items())
            starts = _align_all([(self.items.words[k][::-1], words.hashes[at:end][::-1]) for (_, k), (_, at, end) in back])
            for ((text, k), (score, _, end)), (_, first_word) in zip(back, starts, strict=True):
                base = int(words.first[text])
                out[lo + text].append((self.items.ids[k], score / (MATCH * int(lengths[k])), end - 1 - first_word - base, end - base))
        return [sorted(x) for x in out]


def _word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Corpus counts of the benchmark's words, all words and all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        counts = np.zeros(len(known) + 2, dtype=np.int64)
        for batch in batches:
            texts = [normal(t) for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            counts[-1] += len(texts)
            for lo, hi in slices(texts):
                h = Batch(texts[lo:hi]).hashes
                counts[-2] += len(h)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    counts[: len(known)] += np.bincount(at[known[at] == h], minlength=len(known))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["word", "n"])

    out = np.zeros(len(vocabulary) + 2, dtype=np.int64)
    for r in docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["word"]] = r["n"]
    shared.destroy()
    return out[:-2], int(out[-2]), int(out[-1])


def _shards(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    ids, texts, words = [], [], 0
    for r in benchmark.select(benchmark[item_col].alias("i"), benchmark[text_col].cast("string").alias("t")).toLocalIterator():
        if r["i"] is None or not r["t"]:
            continue
        if ids and words + len(r["t"]) // 4 > limit:
            yield Items(ids, texts)
            ids, texts, words = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        words += len(r["t"]) // 4
    if ids:
        yield Items(ids, texts)


_FOUND = "array<struct<item_id: bigint, score: double, start: bigint, end: bigint>>"
_FIELDS = (("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()))


def _search(shared):
    """The column function of one shard; the index is set up once for all batches of a task."""

    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Finder(*shared.value)
        for column in columns:
            rows = held.find([normal(t) for t in column.cast(pa.large_binary()).to_pylist()])
            yield pa.array([[dict(zip(dict(_FIELDS), x, strict=True)) for x in r] for r in rows], pa.list_(pa.struct(_FIELDS)))

    return F.arrow_udf(find, _FOUND)


def _searches(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, ngram: int, chance: float, min_score: float, shard_words: int):
    """One shard after the other, as its column function, text -> array of (item_id, score, start, end), words from start to before end, and what it has sent out."""
    texts, sc = small_batches(docs).select(docs[text_col].cast("string").alias("text")), docs.sparkSession.sparkContext
    for shards in batched(_shards(benchmark, item_col, item_text_col, shard_words), TOGETHER):
        vocabulary = np.unique(np.concatenate([items.vocabulary for items in shards]))
        counts, total, n = _word_counts(texts, vocabulary)
        for items in shards:
            own = counts[np.searchsorted(vocabulary, items.vocabulary)]
            shared = sc.broadcast((items, items.index(own, total, ngram, chance, n), min_score))
            yield _search(shared), shared


def _each(docs: DataFrame, searches, row) -> DataFrame:
    """The rows that ``row`` makes of each search. One shard's stay lazy; of several, each shard's are written, and the shard freed, before the next is built."""

    def written(search) -> DataFrame:
        find, shared = search
        rows = stored(row(find))
        shared.destroy()
        return rows

    first = next(searches, None)
    if first is None:
        return row(lambda text: F.array().cast(_FOUND))
    second = next(searches, None)
    if second is None:
        return row(first[0])
    out = written(first).unionByName(written(second))
    for search in searches:
        out = out.unionByName(written(search))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, chance: float = CHANCE, min_score: float = MIN_SCORE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per contaminated document and item: id, item_id, score, start, end."""
    searches = _searches(docs, benchmark, text_col, item_col, item_text_col, ngram, chance, min_score, shard_words)
    return _each(docs, searches, lambda search: docs.select(docs[id_col].alias("__id"), F.explode(search(docs[text_col].cast("string"))).alias("x")).select(F.col("__id").alias(id_col), "x.*"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, chance: float = CHANCE, min_score: float = MIN_SCORE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, all columns."""
    searches = _searches(docs, benchmark, text_col, item_col, item_text_col, ngram, chance, min_score, shard_words)
    text = docs[text_col].cast("string")
    first = next(searches, None)
    if first is None:
        return docs
    second = next(searches, None)
    if second is None:
        return docs.where(F.size(first[0](text)) == 0)
    digest = F.sha2(text_or_empty(docs[text_col]), 256)
    hit = lambda search: docs.where(F.size(search(text)) > 0).select(digest.alias("__digest"))
    found = _each(docs, chain((first, second), searches), hit).distinct()
    small = found.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(found) if small else found, digest == F.col("__digest"), "left_anti")
