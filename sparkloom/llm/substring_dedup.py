"""Substring dedup: remove words covered by a window that an earlier document also has.

A window is ``WINDOW`` consecutive words of one document. A word goes if some window over it also starts in a
document with a smaller id. Windows are judged on the input.

1. *Prefilter.* A window's name is the smallest hash of its ``NGRAM``-word parts, so equal windows have equal names, and
   neighbours mostly share one: about a name for fourteen words. Each document's distinct names are written once, narrow.
   Tasks sketch their names, and the sketches are merged into one count-min sketch: a document with a window of some name
   adds one to the name's cell in both rows of the name's block, so no window is ever counted too low. The number of blocks follows the
   number of names, ``NAMES`` to a block at most on average: a name that occurs once passes by chance at under 2 %, at any size.
   A sketch of up to ``SENT`` blocks (128 KB each) goes to all tasks. A larger one stays where it was merged: the
   names meet their block there, and those that pass come back to their documents by key.
2. *Exact pass.* Windows whose name is estimated at two documents or more are grouped by 128 bits, two independent keyed
   hashes over exact word identities (see ``rolling``); keys are drawn anew for each run and the result does not
   depend on them. A task first groups its own: it passes on, for each window, only the smallest id that it has, and
   reports the others as found already. So a window in a third of all documents is as many rows as there are
   tasks, and no group is gathered anywhere; the shuffled rows stream in order of (window, id).
3. *Removal.* Found windows meet their document by id and a digest of its text, as places in that text.

Defined cases: null text has no words; null ids count as one id above all others; rows that share an id are
one document for comparison and are each judged whole; documents of under ``WINDOW`` words lose nothing.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import cut, stored

from .common import pick, small_batches, with_small
from .rolling import SECOND_BASE, Batch, mix, slices, window_hashes

WINDOW, NGRAM = 50, 25
#: Cells of a sketch block's row, as a power of two; rows; and names that a block takes, which is an eighth of a row's cells.
CELL_BITS, ROWS, NAMES = 19, 2, 1 << 16
#: Blocks that are sent to all tasks, 64 MB together; larger sketches are joined by block.
SENT = 512
#: Rows of a block that one task takes in that join.
HEAVY = 2_000_000
_SALTS = (0x8F14E45FCEEA167A, 0x1B873593CC9E2D51)
#: Names, and candidate windows, that a task holds before it passes them on.
HELD = 500_000
NULL_ID = (1 << 63) - 1

_CANDIDATES = "h1 long, h2 long, known boolean, doc long, tag long, at long, n int"


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def _longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _names(batch: Batch, window: int, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of the window at each word, and whether that window lies in one text."""
    grams = window_hashes(batch.hashes, ngram)
    n = len(batch.hashes) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    least, width = grams, 1  # the minimum of `width` parts from each on
    while width < window - ngram + 1:
        step = min(width, window - ngram + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least[:n], batch.inside(window)


def document_names(docs: DataFrame, window: int, ngram: int, keys: tuple[int, int, int]) -> DataFrame:
    """(doc, tag, name): the distinct window names of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc, tag = _texts(batch, "text"), _longs(batch, "doc"), _longs(batch, "tag")
            for lo, hi in slices(texts):
                words = Batch(texts[lo:hi], keys)
                names, good = _names(words, window, ngram)
                owner, names = words.owner[: len(names)][good], names[good]
                new = np.ones(len(names), dtype=bool)
                new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
                owner, names = owner[new], names[new]
                order = np.lexsort((names, owner))
                owner, names = owner[order], names[order]
                once = np.ones(len(names), dtype=bool)
                once[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
                owner, names = owner[once], names[once]
                yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][owner]), pa.array(tag[lo:hi][owner]), pa.array(names.view(np.int64))], ["doc", "tag", "name"])

    return docs.select("doc", "tag", "text").mapInArrow(run, "doc long, tag long, name long")


def block_of(names: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(names) % np.uint64(blocks)).astype(np.int64)


def cells_of(names: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(names ^ np.uint64(_SALTS[row])) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(names: DataFrame, blocks: int, bits: int) -> DataFrame:
    """(block, cells): the merged count-min sketch, a bit a cell in both rows: counted in two documents or more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            name = np.concatenate(held)
            held.clear()
            block, out = block_of(name, blocks), ([], [])
            order = np.argsort(block, kind="stable")
            name, block = name[order], block[order]
            edges = [*np.flatnonzero(np.diff(block, prepend=-1)), len(name)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                for row in range(ROWS):
                    # A cell's place, row included, times two, plus one if this task alone counted it twice or more.
                    cell, n = np.unique(cells_of(name[lo:hi], row, bits) + (row << bits), return_counts=True)
                    out[0].append(int(block[lo]))
                    out[1].append((cell * 2 + (n > 1)).astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["block", "cells"])

        n = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= HELD:
                yield flush()
                n = 0
        if n:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["block", "cells"])

        for batch in batches:  # in order of block
            for block, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    at, counts = block, np.zeros(ROWS << bits, dtype=np.uint8)
                x = np.frombuffer(cells, dtype="<u4")
                where = x >> 1
                counts[where] = np.minimum(2, counts[where] + 1 + (x & 1))
        if at is not None:
            yield done()

    parts = names.select("name").mapInArrow(partial, "block long, cells binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, cells binary")


def estimated_repeated(names: np.ndarray, packed: np.ndarray, base: np.ndarray | int, bits: int) -> np.ndarray:
    """Whether the estimate, the least over the rows, is two or more; a name's block starts at bit ``base`` of ``packed``."""
    out = np.ones(len(names), dtype=bool)
    for row in range(ROWS):
        at = cells_of(names, row, bits) + (row << bits) + base
        out &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def sent_sketch(merged: DataFrame, blocks: int, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function for tasks: which names pass. The whole sketch, of at most ``SENT`` blocks, goes to all."""
    size = (ROWS << bits) // 8
    whole = np.zeros(blocks * size, dtype=np.uint8)
    for block, cells in merged.toLocalIterator():
        whole[block * size : (block + 1) * size] = np.frombuffer(cells, dtype=np.uint8)
    shared = merged.sparkSession.sparkContext.broadcast(whole.tobytes())

    def passing(names: np.ndarray) -> np.ndarray:
        return estimated_repeated(names, np.frombuffer(shared.value, dtype=np.uint8), block_of(names, blocks) * (size * 8), bits)

    return passing


def joined_names(names: DataFrame, merged: DataFrame, blocks: int, bits: int) -> DataFrame:
    """(doc, tag, names): the names of each document that pass, where names meet the sketch by block; packed in a binary."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_of(batch.column("name").to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", "doc", "tag", "name"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packed = None, None
        for batch in batches:  # in order of block, the sketch's row first
            block = _longs(batch, "block")
            edges = [*np.flatnonzero(np.diff(block, prepend=-1)), len(block)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if block[lo] != at:
                    at, packed = block[lo], np.frombuffer(part.column("cells")[0].as_py(), dtype=np.uint8)
                    part = part.slice(1)
                if part.num_rows:
                    part = part.filter(pa.array(estimated_repeated(part.column("name").to_numpy(zero_copy_only=False).view(np.uint64), packed, 0, bits)))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc", "tag", "name")], ["doc", "tag", "name"])

    rows = names.mapInArrow(number, "block long, doc long, tag long, name long")
    heavy = cut(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select(F.col("block").alias("of"), F.ceil(F.col("n") / HEAVY).cast("int").alias("parts")))
    count = heavy.count()

    def dealt(df: DataFrame, part: Column) -> DataFrame:
        found = with_small(df, heavy, F.col("block") == F.col("of"), count) if count else df.withColumn("parts", F.lit(1))
        return found.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)

    # A name that very many documents have makes its block heavy: the block's names are dealt over parts, its sketch goes to each.
    sides = dealt(rows, F.pmod(F.xxhash64("doc", "tag"), F.col("parts"))).select("block", "part", "doc", "tag", "name", F.lit(None).cast("binary").alias("cells"))
    none = F.lit(None).cast("long")
    cells = dealt(merged, F.explode(F.expr("sequence(0L, parts - 1L)"))).select("block", "part", none.alias("doc"), none.alias("tag"), F.lit(0).cast("long").alias("name"), "cells")
    both = sides.unionByName(cells).repartition("block", "part").sortWithinPartitions("block", "part", F.col("cells").isNull())
    met = both.mapInArrow(look, "doc long, tag long, name long")
    return met.groupBy("doc", "tag").agg(F.collect_set("name").alias("names"))


def _combine(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    """One task's candidates: a row for each window and text with the least id here, and runs of windows of other ids, known to repeat."""
    order = np.argsort(h1, kind="stable")
    s1, s2, d = h1[order], h2[order], doc[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(d, np.flatnonzero(new))
    own = np.flatnonzero(d == least[group])
    # A window several times in one text is one row; the other places are found in the text itself.
    own = own[np.lexsort((order[own], tag[order[own]], group[own]))]
    text = tag[order[own]]
    lead = np.ones(len(own), dtype=bool)
    lead[1:] = (group[own][1:] != group[own][:-1]) | (text[1:] != text[:-1])
    lead = np.sort(order[own[lead]])  # rows of one text stay together, which packs them better
    known = np.sort(order[d != least[group]])
    start = np.ones(len(known), dtype=bool)
    start[1:] = (at[known][1:] != at[known][:-1] + 1) | (doc[known][1:] != doc[known][:-1]) | (tag[known][1:] != tag[known][:-1])
    first = np.flatnonzero(start)
    n = np.append(first[1:], len(known)) - first
    first = known[first]
    spread = mix(h1[first] ^ mix(at[first].astype(np.uint64) ^ doc[first].astype(np.uint64)))
    column = lambda a, b: pa.array(np.concatenate((a, b)).astype(np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [
            column(h1[lead], spread),
            column(h2[lead], spread),
            pa.array(np.concatenate((np.zeros(len(lead), dtype=bool), np.ones(len(first), dtype=bool)))),
            *[pa.array(np.concatenate((x[lead], x[first]))) for x in (doc, tag, at)],
            pa.array(np.concatenate((np.ones(len(lead)), n)).astype(np.int32)),
        ],
        ["h1", "h2", "known", "doc", "tag", "at", "n"],
    )


def repeated_windows(docs: DataFrame, window: int, ngram: int, bits: int, block_names: int, sent: int) -> DataFrame:
    """(doc, tag, at, n): runs of ``n`` windows, from word ``at`` of a text on, that a smaller id also has.

    Of a window that a text holds several times, one place is enough.
    """
    keys = tuple(secrets.randbits(64) for _ in range(3))
    names = stored(document_names(docs, window, ngram, keys))
    blocks = max(1, -(-names.count() // block_names))
    merged = sketch(names, blocks, bits)
    passing = None
    if blocks <= sent:
        passing, source = sent_sketch(merged, blocks, bits), docs.select("doc", "tag", "text")
    else:
        passed = joined_names(names, stored(merged), blocks, bits)
        source = docs.join(passed, ["doc", "tag"]).select("doc", "tag", "text", "names")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            texts, doc, tag = _texts(batch, "text"), _longs(batch, "doc"), _longs(batch, "tag")
            for lo, hi in slices(texts):
                words = Batch(texts[lo:hi], keys)
                found, good = _names(words, window, ngram)
                if not len(found):
                    continue
                if passing:
                    edge = np.concatenate(([True], found[1:] != found[:-1]))
                    good &= passing(found[edge])[np.cumsum(edge) - 1]
                else:
                    lists = batch.column("names").slice(lo, hi - lo)
                    for k in range(hi - lo):
                        a, b = words.first[k], min(words.first[k + 1], len(found))
                        good[a:b] &= np.isin(found[a:b], lists[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                owner = words.owner[at]
                h1, h2 = window_hashes(words.hashes, window)[at], window_hashes(words.second, window, SECOND_BASE)[at]
                held.append((doc[lo:hi][owner], tag[lo:hi][owner], at - words.first[owner], h1, h2))
                n += len(at)
                if n >= HELD:
                    yield _combine(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield _combine(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = source.mapInArrow(probe, _CANDIDATES)
    w = Window.partitionBy("h1", "h2", "known").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("least", F.first("doc").over(w)).where("known or least < doc").select("doc", "tag", "at", "n")


def covered(words: Batch, at: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Whether each word of one text lies in a found window: in the given runs, or in a window equal to a single one given."""
    marks = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    one = at[n == 1]
    if len(one):
        h1, h2 = window_hashes(words.hashes, window), window_hashes(words.second, window, SECOND_BASE)
        order = one[np.argsort(h1[one], kind="stable")]
        same = np.minimum(np.searchsorted(h1[order], h1), len(order) - 1)
        found = np.flatnonzero((h1[order[same]] == h1) & (h2[order[same]] == h2))
        marks[found] += 1
        marks[found + window] -= 1
    np.add.at(marks, at[n > 1], 1)
    np.add.at(marks, (at + n - 1 + window)[n > 1], -1)
    return np.cumsum(marks[:-1]) > 0


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ngram: int = NGRAM, cell_bits: int = CELL_BITS, block_names: int = NAMES, sent: int = SENT) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, kept_text (kept words joined by a space)."""
    if not 0 < ngram <= window:
        raise ValueError("0 < ngram <= window must hold")
    rows = pick(small_batches(df), id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    docs = rows.withColumn("doc", F.coalesce("id", F.lit(NULL_ID))).withColumn("tag", F.xxhash64("text"))
    found = repeated_windows(docs, window, ngram, cell_bits, block_names, sent)
    runs = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    both = docs.join(runs, ["doc", "tag"], "left").select("id", "text", "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs, out = _texts(batch, "text"), batch.column("runs"), ([], [], [], [])
            for i, text in enumerate(texts):
                words, n = text.split(), 0
                total = len(words)
                if runs[i].is_valid:
                    at, size = (runs[i].values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                    gone = covered(Batch([text]), at, size, window)
                    n = int(gone.sum())
                    words = [words[k] for k in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                for column, value in zip(out, (total, n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = both.mapInArrow(remove, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("id", id_col)
