"""Periodic runs of words by recompression.

A run is a stretch of words with smallest period q, of at least ``least`` words and ``times`` periods, that no neighbouring word extends.

The texts of a batch become one sequence of word numbers with a mark of its own around each text. Recompression turns it into a
run-length grammar: by turns, each block of one repeated symbol becomes one symbol named by (symbol, length), and each pair of a
"left" and a "right" symbol (a bit of the symbol's hash, drawn anew in each round) becomes one symbol named by the pair. Equal names
stand for equal stretches, and whether two neighbours are joined depends on these two alone. So the longest common extension (LCE) of two
places climbs from level to level while both stand at the start of equal symbols, steps over at most a few symbols in each, and
comes down at the first that differ: a number of steps in the order of the logarithm of the length. Read backwards, the same
levels give extensions to the left. Many queries go through the levels together, as arrays.

A run of period p and at least 4 p words has a place i in every multiple of 3 p that also has i + p inside it, so the harmonic grid of
such places over all p up to a fourth of the text (n log n / 3 candidates, those whose two words differ dropped at once) finds every
run; two LCE queries give its exact bounds. The smallest p among equal bounds is the smallest period.

``collapsed`` is the text without the words that any run has after its first period, joined by one space; ``best`` is the place in
``runs`` of the greatest length/period, compared exactly (ties: smallest start, then period).

Defined cases: null or empty text has no words and no runs (``best`` null, ``collapsed`` empty); a row is one text, so null and
repeated ids stay apart; runs come by start, then period.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .rolling import mix, slices

LEAST, TIMES = 6, 4
#: A level of so few symbols is the last, and so many candidates are extended together.
TOP, TOGETHER = 16, 1 << 20


@dataclass
class Level:
    """The symbols of one level, and how they join into those of the next."""

    symbols: np.ndarray
    left: np.ndarray | None = None  # symbols of one block from here on; None: each stands alone
    starts: np.ndarray | None = None  # whether a symbol of the next level starts here
    up: np.ndarray | None = None  # the place in the next level
    first: np.ndarray | None = None  # of each place in the next level, the first place here

    def backwards(self) -> Level:
        """The same level read from its end."""
        if self.up is None:
            return Level(self.symbols[::-1].copy())
        n, above = len(self.symbols), len(self.first)
        ends = np.append(self.first[1:], n) - 1
        starts = np.append(self.starts[1:], True)
        left = None
        if self.left is not None:
            left = (np.arange(n) - self.first[self.up] + 1)[::-1].copy()
        return Level(self.symbols[::-1].copy(), left, starts[::-1].copy(), (above - 1 - self.up)[::-1].copy(), (n - 1 - ends)[::-1].copy())


def grammar(sequence: np.ndarray) -> list[Level]:
    """The levels of the recompression of a sequence of numbers from 0 on."""
    levels, symbols = [], sequence.astype(np.int64)
    named, turn = int(symbols.max(initial=-1)) + 1, 0
    while len(symbols) > TOP:
        n = len(symbols)
        same = symbols[1:] == symbols[:-1]
        if same.any():
            starts = np.concatenate(([True], ~same))
            first = np.flatnonzero(starts)
            size = np.diff(np.append(first, n))
            after, long = symbols[first], size > 1
            found, name = np.unique(after[long] * (size.max() + 1) + size[long], return_inverse=True)
            after[long] = named + name
            named += len(found)
            left = np.repeat(first + size, size) - np.arange(n)
        else:
            turn += 1
            right = (mix(symbols.astype(np.uint64) ^ np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
            joined = np.flatnonzero(~right[:-1] & right[1:])
            if not len(joined):
                continue
            starts = np.ones(n, dtype=bool)
            starts[joined + 1] = False
            first, left = np.flatnonzero(starts), None
            up = np.cumsum(starts) - 1
            after = symbols[first]
            found, name = np.unique(symbols[joined] << 32 | symbols[joined + 1], return_inverse=True)
            after[up[joined]] = named + name
            named += len(found)
        levels.append(Level(symbols, left, starts, np.cumsum(starts) - 1, first))
        symbols = after
    levels.append(Level(symbols))
    return levels


def extensions(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols from x and y on are equal, for each pair of different places; a mark must end both."""
    out = np.zeros(len(x), dtype=np.int64)
    differ: list[list] = [[] for _ in levels]
    q, a, b = np.arange(len(x)), x, y
    for k, level in enumerate(levels):
        climbing = []
        while len(q):
            equal = level.symbols[a] == level.symbols[b]
            if not equal.all():
                differ[k].append((q[~equal], a[~equal], b[~equal]))
                q, a, b = q[equal], a[equal], b[equal]
            if level.up is not None:
                ready = level.starts[a] & level.starts[b]
                climbing.append((q[ready], level.up[a[ready]], level.up[b[ready]]))
                q, a, b = q[~ready], a[~ready], b[~ready]
            a, b = _over(level, a, b)
        if not climbing:
            break
        q, a, b = (np.concatenate(c) for c in zip(*climbing, strict=True))
    q = a = b = np.empty(0, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        q, a, b = (np.concatenate(c) for c in zip((q, a, b), *differ[k], strict=True))
        moving = np.flatnonzero(level.symbols[a] == level.symbols[b])
        while len(moving):
            a[moving], b[moving] = _over(level, a[moving], b[moving])
            moving = moving[level.symbols[a[moving]] == level.symbols[b[moving]]]
        if k:
            a, b = levels[k - 1].first[a], levels[k - 1].first[b]
    out[q] = a - x[q]
    return out


def _over(level: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places after equal symbols, or after what two blocks of one symbol share."""
    step = 1 if level.left is None else np.minimum(level.left[a], level.left[b])
    return a + step, b + step


def grid(first: np.ndarray, size: np.ndarray, times: int = TIMES):
    """(i, p) in parts of about TOGETHER: for each text and each p up to a ``times``-th of it, i at multiples of (times - 1) p."""
    periods = size // times
    text = np.repeat(np.arange(len(size)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    stride = (times - 1) * p
    count = (size[text] - 1 - p) // stride + 1
    total = np.cumsum(count)
    lo = 0
    while lo < len(p):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + TOGETHER, side="right")))
        c = count[lo:hi]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(first[text[lo:hi]], c) + k * np.repeat(stride[lo:hi], c), np.repeat(p[lo:hi], c)
        lo = hi


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period; ``texts`` hold word numbers from 0 on."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(size + 1) - size  # a mark stands before each text and after the last
    n = int(size.sum()) + len(texts) + 1
    words = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    sequence = np.empty(n, dtype=np.int64)
    marks = np.append(first - 1, n - 1)
    sequence[marks] = words + np.arange(len(marks))
    for at, t in zip(first.tolist(), texts, strict=True):
        sequence[at : at + len(t)] = t
    levels = grammar(sequence)
    backwards = [level.backwards() for level in levels]
    found = [np.empty((3, 0), dtype=np.int64)]
    for i, p in grid(first, size, times):
        equal = sequence[i] == sequence[i + p]
        i, p = i[equal], p[equal]
        end = i + p + extensions(levels, i, i + p)
        start = i - extensions(backwards, n - i, n - i - p)
        long = end - start >= np.maximum(least, times * p)
        found.append(np.stack((start[long], end[long], p[long])))
    start, end, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    start, end, p = start[order], end[order], p[order]
    text = np.searchsorted(first, start, side="right") - 1
    return text, start - first[text], end - start, p


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text, and their numbers: equal words have equal ones."""
    numbers: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    return words, [np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), dtype=np.int64, count=len(ws)) for ws in words]


def _best(length: list[int], period: list[int]) -> int | None:
    best = None
    for k, (n, p) in enumerate(zip(length, period, strict=True)):
        if best is None or n * period[best] > length[best] * p:
            best = k
    return best


def periodic_runs(df: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, runs (array of start, length, period), best (place in runs or null), collapsed text."""
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(texts: list[bytes]):
        words, numbers = _numbered(texts)
        text, start, length, period = runs_of(numbers, least, times)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        for k, ws in enumerate(words):
            lo, hi = bounds[k], bounds[k + 1]
            starts, lengths, periods = (v[lo:hi].tolist() for v in (start, length, period))
            if starts:
                gone = np.zeros(len(ws) + 1, dtype=np.int64)
                np.add.at(gone, start[lo:hi] + period[lo:hi], 1)
                np.add.at(gone, start[lo:hi] + length[lo:hi], -1)
                ws = [ws[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            yield list(zip(starts, lengths, periods, strict=True)), _best(lengths, periods), b" ".join(ws)

    @F.arrow_udf("struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, best: int, collapsed: string>")
    def of(texts: pa.Array) -> pa.Array:
        data = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
        found = [row for lo, hi in slices(data) for row in scan(data[lo:hi])]
        runs, best, collapsed = zip(*found, strict=True) if found else ((), (), ())
        as_runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
        return pa.StructArray.from_arrays(
            [pa.array(as_runs, pa.list_(run)), pa.array(best, pa.int32()), pa.array(collapsed, pa.binary()).cast(pa.string())], ["runs", "best", "collapsed"]
        )

    return small_batches(df).select(df[id_col].alias("__id"), of(df[text_col].cast("string")).alias("__x")).select(F.col("__id").alias(id_col), "__x.*")
