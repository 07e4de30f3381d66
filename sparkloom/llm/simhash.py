"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: text with A-Z lower-cased, 4-word shingles with repeats, XXH64 (seed 42) of each, and a bit is one
if set in over half of the shingles' hashes. Two fingerprints link at ``RADIUS`` or fewer differing bits, and a
document's component is the smallest id reachable over links.

Equal fingerprints are merged first, with map-side minima. The 64 bits are cut into six parts; fingerprints within
four bits agree on two whole parts at least, so each goes under its 15 pairs of parts. Rows under one key are
compared bit-sliced: bit planes are packed 64 rows to a machine word, ``plane ^ (plane shifted by d)`` says for 64
pairs at once whether they differ in that bit, a carry-save counter of bit planes adds it up, and words in which
every pair is over the radius are abandoned. Pairs that earlier links under the key have joined are not compared again. A key
with more than ``TILE`` rows is split into tiles whose pairs are compared by different tasks. What leaves a task is a spanning forest of the links that it found, never
all pairs; components then come from a distributed star contraction.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; a
text of under four words has one shingle, the whole sequence; null ids are never the smallest, and a component
with null ids only has a null id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut

from .common import join_counted, small_batches, text_or_empty, with_small
from .components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: (shift, width) of the six parts.
PARTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Rows under one key that one task compares with each other.
TILE = 8192
#: Bits that are added before words are abandoned.
STEP = 8
#: Distances up to ALONE are compared one by one, as they join most; later ones together, about WORDS machine words.
ALONE, WORDS = 16, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words)), out=at[1:])
    starts, ends = at[:-shingle].tolist(), (at[shingle:] - 1).tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """(doc, fp) and what ``more`` names: one row per input row."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())

    return small_batches(df).select(df[id_col].cast("long").alias("doc"), of(df[text_col].cast("string")).alias("fp"), *[c.alias(name) for name, c in more.items()])


class Planes:
    """Fingerprints stored vertically: plane b holds bit b of 64 rows in each machine word."""

    def __init__(self, fps: np.ndarray):
        words = -(-len(fps) // 64)
        bits = np.zeros((64, words * 64), dtype=np.uint8)
        for b in range(64):
            bits[b, : len(fps)] = (fps >> np.uint64(b)).astype(np.uint8) & np.uint8(1)
        # Two empty words follow, so that every shifted read stays inside.
        self.planes = np.zeros((64, words + 2), dtype=np.uint64)
        self.planes[:, :words] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def within(self, pairs: list[tuple[int, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, i + shift) within ``radius``, of the pairs given as (shift, mask over i); many shifts go together."""
        masks, words, shifts = [], [], []
        for shift, mask in pairs:
            packed = np.packbits(mask, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8, dtype=np.uint8))).view(np.uint64)
            used = np.flatnonzero(packed)
            masks.append(packed[used])
            words.append(used)
            shifts.append(np.full(len(used), shift))
        alive, where, shift = np.concatenate(masks), np.concatenate(words), np.concatenate(shifts)
        ones, twos, fours = (np.zeros(len(where), dtype=np.uint64) for _ in range(3))
        for bit in range(0, 64, STEP):
            if not len(where):
                break
            step, end = self.planes[bit : bit + STEP], self.planes.shape[1] - 1
            at, part = where + shift // 64, (shift % 64).astype(np.uint64)
            # A shift by 64 gives zero.
            moved = step[:, np.minimum(at, end)] >> part | step[:, np.minimum(at + 1, end)] << (np.uint64(64) - part)
            for plane in (step[:, where] ^ moved) & alive:
                carry = ones & plane
                ones = ones ^ plane
                twos, carry = twos ^ carry, twos & carry
                fours, carry = fours ^ carry, fours & carry
                alive = alive & ~(carry | _over(ones, twos, fours, radius))
            left = np.flatnonzero(alive)
            if len(left) < len(where):
                where, shift, alive, ones, twos, fours = (x[left] for x in (where, shift, alive, ones, twos, fours))
        found = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        first = where[:, None] * 64 + np.arange(64)
        return first[found], (first + shift[:, None])[found]


def _over(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Pairs whose three-bit count is over the radius (at most 7)."""
    if radius == 4:
        return fours & (ones | twos)
    out = np.zeros_like(ones)
    for value in range(radius + 1, 8):
        out |= (ones if value & 1 else ~ones) & (twos if value & 2 else ~twos) & (fours if value & 4 else ~fours)
    return out


def compare(fps: np.ndarray, runs: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links among rows of one run; the rows of a run are neighbours.

    Pairs are taken by their distance in the run, near ones first. A pair whose rows are joined already needs no
    comparison, as only its component matters: a group of near copies closes after a few distances.
    """
    a, b, shift = [], [], 1
    while len(fps):
        # Rows of runs that are too short for this distance, or all joined, leave; done whenever the distance doubles.
        starts = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
        counts = np.diff(np.append(starts, len(runs)))
        if shift > 1:
            lowest, highest = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            stay = np.repeat((counts > shift) & (lowest < highest), counts)
        else:
            stay = np.repeat(counts > shift, counts)
        fps, runs = fps[stay], runs[stay]
        if shift == 1:
            label = np.arange(len(fps))
        else:
            # A label is the least row of its component, which leaves or stays with the whole run.
            label = (np.cumsum(stay) - 1)[label[stay]]
        if not len(fps):
            break
        planes, last = Planes(fps), 2 * shift
        together = 1 if shift < ALONE else max(1, WORDS * 64 // len(fps))
        while shift < min(last, len(fps)):
            pairs = []
            for d in range(shift, min(shift + together, last, len(fps))):
                may = (runs[d:] == runs[:-d]) & (label[d:] != label[:-d])
                if may.any():
                    pairs.append((d, may))
            if pairs:
                found, other = planes.within(pairs, radius)
                joined = _join(label, found, other)
                a.append(fps[found[joined]])
                b.append(fps[other[joined]])
            shift += together
        if shift < last:
            break
        shift = last
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins rows a[i] and b[i] in ``label`` (the least row of each component), and returns the i that joined two components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(i)
    if parent:
        new = np.arange(len(label))
        for x in parent:
            new[x] = root(x)
        label[:] = new[label]
    return np.array(kept, dtype=np.int64)


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that link."""
    fp = F.col("fp")
    part = [F.shiftrightunsigned(fp, s).bitwiseAND((1 << w) - 1) for s, w in PARTS]
    key = [part[i] * (1 << 11) + part[j] + (k << 22) for k, (i, j) in enumerate(combinations(range(len(PARTS)), 2))]
    keyed = nodes.select("fp", F.explode(F.array(*key)).alias("key"))
    large = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile))
    large_n = large.count()
    rows = keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    if large_n:
        sized = with_small(keyed, large.withColumnRenamed("key", "large_key"), F.col("key") == F.col("large_key"), large_n)
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        tiles = sized.withColumn("tiles", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")).withColumn("own", own)
        other = F.explode(F.expr("sequence(0, tiles - 1)")).alias("other")
        rows = tiles.select("key", "fp", "own", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def run(batches):
        held: list[np.ndarray] = []

        def out(rows):
            changes = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
            a, b = compare(rows[3].view(np.uint64), np.concatenate(([0], np.cumsum(changes))), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        size = 0
        for batch in batches:  # in order of (key, i, j)
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= 1 << 17:
                rows = np.concatenate(held, axis=1)
                same = (rows[:3] == rows[:3, -1:]).all(axis=0)
                cutoff = size - int(same.sum())  # the last run may go on in the next batch
                if cutoff:
                    yield out(rows[:, :cutoff])
                held, size = [rows[:, cutoff:]], size - cutoff
        if size:
            yield out(np.concatenate(held, axis=1))

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _placed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the root of their component."""
    roots = cut(components(links(nodes)))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per component: id and text_sha256 of the row that stays, which has the smallest id (null last), then digest."""
    docs = fingerprints(df, id_col, text_col, digest=F.sha2(text_or_empty(df[text_col]), 256))
    first = F.struct(F.col("doc").isNull().alias("none"), "doc", "digest")
    nodes = cut(docs.groupBy("fp").agg(F.min(first).alias("first")))
    least = _placed(nodes).groupBy("root").agg(F.min("first").alias("first"))
    return least.select(F.col("first.doc").alias(id_col), F.col("first.digest").alias("text_sha256"))


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    docs = cut(fingerprints(df, id_col, text_col))
    nodes = cut(docs.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies")))
    placed = cut(_placed(nodes))
    least = cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = join_counted(placed.select("fp", "root", "copies"), least, "root", "n")
    named = cut(named.select("fp", "component_id", "copies"))
    return join_counted(docs, named, "fp", "copies").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
