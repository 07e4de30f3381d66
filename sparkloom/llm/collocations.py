"""Phrase collocation mining by marginalising windows of the top order.

Texts are split into pieces and words. Lead-window columns ``w1 .. wk`` hold each word and the k - 1 that follow it in its piece, padded
with empty strings, and equal windows are counted as they are. A phrase's count is the sum over the windows that begin with it, so one
ROLLUP over the columns gives the counts of all shorter phrases; no shorter n-gram is made by itself. Windows are at most as many as words.

Hashes of pairs of neighbouring words come first, then those of three words whose pairs both pass. A pair or three words under the bar
can't be inside a candidate, so the longest windows are cut (padded) where such would follow, which keeps every count at or over the bar
exact and leaves few windows to count. Words, hashes and windows are made as arrays, some MB of texts at a time; sorted hashes with their numbers meet by
ranges of hashes. The hashes that occur often enough go to all tasks as bit tables of bounded size; one that they
wrongly let pass only leaves a window longer than it need be, so windows themselves never meet a table of pairs by a shuffle. Counting is by
partial sums in each task, so that a hot word, pair or language is one row a task.

A candidate is a phrase of 2 to ``longest`` words that occurs ``least`` times or more. Each cut in two gives floor(1000 a n / (l r)),
in decimals of 38 digits; the lowest counts. Candidates inside a longer one that occurs ``share`` percent as often or more are dropped.
The first ``top`` of each language (the feature's own limit) are ranked in salted parts first, so that no task sorts a whole language.

Defined cases: null text counts as empty, null language as ``und``; repeated rows count each; a table without candidates gives no row.
Counts up to 10^15 are exact (1000 a n stays under 10^38).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import stored

from .common import BROADCAST_ROWS, join_counted, pick, small_batches, text_or_empty

LEAST, LONGEST, SHARE, TOP = 100, 5, 100, 2000
#: What parts pieces, and words within them.
PIECES, SPACES = ".,;:!?\n\x0b\x0c\r", " \t"
#: Parts in which a language's phrases are ranked before the best of each meet.
PARTS = 64


#: Bits of a table for each hash, bits that a hash sets in its word of 64, and such words at most (32 MB, for 17 million hashes;
#: with more of them, more windows than need be stay long). Tables are made for phrases of 2 to SIFTED words.
BITS, SET, MOST_WORDS, SIFTED = 16, 4, 1 << 22, 3
#: Bytes of texts that are split at once (or one longer text), hashes that a task sorts together, and bytes of the input for each group
#: in which hashes meet.
SLICE, HELD, GROUP = 1 << 22, 1 << 22, 10 << 20

_LOW, _KIND = np.arange(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
_LOW[65:91] += 32
_KIND[list(SPACES.encode())], _KIND[list(PIECES.encode())] = 1, 2
#: What a byte and its place in a word make of the word's hash.
_CODE, _PLACE = np.random.default_rng(13).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pieces(df: DataFrame) -> DataFrame:
    """(lang, text) whose pieces are read in tasks: null text as empty, null language as ``und``."""
    return small_batches(df).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty(F.col("text")).alias("text"))


@dataclass(frozen=True)
class Words:
    """The lower-cased words of some texts in order: themselves, their hashes, whether they end a piece, and the places of their languages in ``langs``."""

    words: pa.Array
    hashes: np.ndarray
    last: np.ndarray
    lang: np.ndarray
    langs: pa.Array


def _words(langs: pa.Array, texts: pa.Array) -> Words | None:
    """None if there are none."""
    texts, langs = texts.cast(pa.large_string()), langs.dictionary_encode()
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return None
    kept, offsets = _LOW[data[inside]], np.flatnonzero(begins[inside])
    text = np.searchsorted(ends, starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts] + text
    sizes = np.diff(offsets, append=len(kept))
    place = (np.arange(len(kept)) - np.repeat(offsets, sizes)) & 255
    own = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
    lang = langs.indices.to_numpy()[text]
    hashes = np.add.reduceat(_CODE[kept] * _PLACE[place], offsets) + own[lang]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(offsets, len(kept)).astype(np.int32)), pa.py_buffer(kept))
    return Words(words, hashes, np.append(piece[1:] != piece[:-1], True), lang, langs.dictionary)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of (lang, text) rows, some SLICE bytes of texts at a time."""
    for batch in batches:
        ends = np.cumsum(np.append(0, pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            found = _words(batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at))
            if found is not None:
                yield found
            at = to


def _counted_rows(columns: dict, name: str) -> pa.Table:
    """Equal rows once, with their number."""
    each = pa.table(columns).group_by(list(columns), use_threads=False).aggregate([([], "count_all")])
    return each.rename_columns([name if c == "count_all" else c for c in each.column_names])


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """The bits of the column ``h``, put together in tasks: word ``h mod size`` of a power of two, SET bits by the upper bits of ``h``."""
    size = 64
    n = hashes.count()
    while size * 64 < n * BITS and size < MOST_WORDS:
        size *= 2
    bits = F.lit(0).cast("long")
    for j in range(SET):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 64 - 6 * (j + 1)).bitwiseAND(F.lit(63)).cast("int")))
    words = hashes.groupBy(F.col("h").bitwiseAND(F.lit(size - 1)).alias("at")).agg(F.bit_or(bits).alias("bits")).toArrow()  # MOST_WORDS rows at most
    table = np.zeros(size, dtype=np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return table


def _next(a: np.ndarray) -> np.ndarray:
    """What stands one place further on; zero at the end."""
    return np.append(a[1:], np.zeros(1, a.dtype))


def _sift(x: Words, tables: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For phrases of each length from 2 to one over the tables' own: (hashes, which are held), by their first words.

    A phrase beyond the last table is held if its two parts of one word less are; none reaches over the end of a piece.
    """
    h, held, levels = x.hashes, None, []
    for table in [*tables, None]:
        h = h * np.uint64(0x9E3779B97F4A7C15) + _next(h)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
        held = ~x.last if held is None else held & _next(held)
        if table is not None:
            at = np.flatnonzero(held)
            some = h[at]
            word = table[(some & np.uint64(len(table) - 1)).astype(np.int64)].view(np.uint64)
            hit = np.ones(len(at), dtype=bool)
            for j in range(SET):
                hit &= (word >> ((some >> np.uint64(64 - 6 * (j + 1))) & np.uint64(63))) & np.uint64(1) == 1
            held = np.zeros(len(h), dtype=bool)
            held[at[hit]] = True
        levels.append((h, held))
    return levels


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, with the sum of its numbers."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.add.reduceat(n, first)


def frequent_hashes(rows: DataFrame, tables: list[np.ndarray], least: int, size: int) -> DataFrame:
    """(h): the hashes, found ``least`` times or more, of the phrases one word longer than the tables' last whose parts are held.

    A task sorts HELD hashes at a time and passes on each once with its number, as arrays, by ranges of hashes: as many ranges as the
    ``size`` of all texts asks for, so that a group that sums them stays of one size.
    """
    shared, groups = rows.sparkSession.sparkContext.broadcast(tables), max(1, size // GROUP)

    def parts(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        group = ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = [*first[1:].tolist(), len(h)]
        columns = [[a[i:j].tobytes() for i, j in zip(first.tolist(), ends)] for a in (h, n.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(group[first]), *[pa.array(c, pa.binary()) for c in columns]], ["g", "h", "n"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in _read(batches):
            h, kept = _sift(x, shared.value)[-1]
            held.append(h[kept])
            n += len(held[-1])
            if n >= HELD:
                yield parts(held)
                held, n = [], 0
        if n:
            yield parts(held)

    def frequent(table: pa.Table) -> pa.Table:
        h, n = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("h", np.uint64), ("n", np.int32)))
        h, n = _summed(h, n.astype(np.int64))
        return pa.table({"h": h[n >= least].view(np.int64)})

    return rows.mapInArrow(hashes, "g int, h binary, n binary").groupBy("g").applyInArrow(frequent, "h long")


def _followers(x: Words, tables: list[np.ndarray], k: int) -> np.ndarray:
    """How many words may follow each word, up to ``k - 1``."""
    held = [h for _, h in _sift(x, tables)[: len(tables)]]
    more = sum(h.astype(np.int32) for h in held)
    for _ in range(k - 1 - len(held)):
        after = _next(more)
        more = np.where(held[-1] & (after >= len(held)), 1 + after, more)
    return np.minimum(more, k - 1)


def windows(rows: DataFrame, tables: list[np.ndarray], k: int) -> DataFrame:
    """(lang, w1 .. wk, f): each word and those that follow in its piece for as long as the tables hold what they make, padded with empty
    strings; counted within slices of the rows of ``pieces``. A word that nothing may follow is a window too.
    """
    shared, names = rows.sparkSession.sparkContext.broadcast(tables), [f"w{j}" for j in range(1, k + 1)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _read(batches):
            more, at = _followers(x, shared.value, k), np.arange(len(x.words))
            own = x.words.dictionary_encode()
            code, blank = own.indices.to_numpy(), len(own.dictionary)
            columns = {n: np.where(more >= j, code[np.minimum(at + j, len(code) - 1)], blank).astype(np.int32) for j, n in enumerate(names)}
            each = _counted_rows({"lang": x.lang, **columns}, "f")
            shown = pa.concat_arrays([own.dictionary, pa.array([""])])
            words = {n: shown.take(each[n].combine_chunks()) for n in names}
            yield from pa.table({"lang": x.langs.take(each["lang"].combine_chunks()), **words, "f": each["f"]}).to_batches()

    return rows.mapInArrow(made, f"lang string, {', '.join(f'{n} string' for n in names)}, f long")


def cut_windows(rows: DataFrame, tables: list[np.ndarray], k: int) -> DataFrame:
    """The windows of two words or more."""
    return windows(rows, tables, k).where("w2 <> ''")


def phrase_counts(df: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, words, phrase, f)): words of each language, and its phrases of up to ``longest`` words found ``least`` times or more."""
    each = pieces(pick(df, lang=lang_col, text=text_col))
    size = each.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tables: list[np.ndarray] = []
    for _ in range(2, min(SIFTED, longest) + 1):
        tables.append(_bit_table(stored(frequent_hashes(each, tables, least, size))))
    names = [f"w{j}" for j in range(1, longest + 1)]
    whole = stored(windows(each, tables, longest).groupBy("lang", *names).agg(F.sum("f").alias("f")))
    levels = whole.groupBy("lang", "w1").agg(F.sum("f").alias("f")).rollup("lang", "w1").agg(F.sum("f").alias("f"), F.grouping_id().alias("g"))
    levels = stored(levels.where((F.col("g") == 1) | ((F.col("f") >= least) & (F.col("g") == 0))))
    sizes = levels.where("g = 1").select("lang", F.col("f").alias("n"))
    single = levels.where("g = 0").select("lang", F.lit(1).alias("words"), F.col("w1").alias("phrase"), "f")
    summed = whole.where("w2 <> ''").rollup("lang", *names).agg(F.sum("f").alias("f"), F.grouping_id().alias("g"))
    # A level of j words leaves the last longest - j columns out; a window that ends before is counted by a shorter level.
    words = sum((F.when(F.col("g") == (1 << (longest - j)) - 1, j).otherwise(0) for j in range(2, longest + 1)), F.lit(0))
    ends = F.coalesce(*[F.when(F.col("words") == j, F.col(f"w{j}")) for j in range(2, longest + 1)])
    several = summed.where(F.col("f") >= least).withColumn("words", words).where("words > 0").where(ends != "")
    several = several.select("lang", "words", F.concat_ws(" ", *names).alias("phrase"), "f")
    return sizes, stored(single.unionByName(several))


def _part(phrase: Column, lo: Column | int, n: Column | int) -> Column:
    """``n`` words of a phrase from word ``lo`` (from 0) on."""
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(lo) + 1 if isinstance(lo, int) else lo + 1, n), " ")


def _counted(rows: DataFrame, phrases: DataFrame, key: str, name: str, small: bool) -> DataFrame:
    """``rows`` with the count ``name`` of the phrase in their column ``key``; every such phrase has one."""
    counts = phrases.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    if small:
        return rows.join(F.broadcast(counts), ["lang", key])
    keyed = rows.withColumn("__key", F.struct("lang", key))
    uses = stored(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).join(counts.select(F.struct("lang", key).alias("__key"), name), "__key"))
    return join_counted(keyed, uses, "__key", "n").drop("__key")


def collocations(
    df: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language."""
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words and one occurrence at least")
    sizes, phrases = phrase_counts(df, least, longest, lang_col, text_col)
    small = phrases.count() <= BROADCAST_ROWS
    found = phrases.where("words > 1").withColumnRenamed("f", "a")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", _part(F.col("phrase"), 0, F.col("k"))).withColumn("tail", _part(F.col("phrase"), F.col("k"), F.col("words") - F.col("k")))
    cuts = _counted(_counted(cuts, phrases, "head", "l", small), phrases, "tail", "r", small)
    cuts = cuts.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "lang")

    def big(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * big("a") * big("n")).withColumn("under", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("x"))

    # For each candidate, the greatest count of a longer one around it.
    longer = found.where("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("m"))))
    longer = longer.select("lang", _part(F.col("phrase"), F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))

    order = [F.col("x.score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "x.l", "x.r", "x.n", "x.score")
