"""Blocks to chunks: sections, splitters, and the parent/child hierarchy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import filled, parent_id, stripped
from sparkloom.runtime import small_batches
from sparkloom.schema import Settings

#: Separators of the recursive splitter, tried in this order; the last splits anywhere.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", ", ", " ", "")
ATOMIC = ("table", "image")
#: Bytes of texts that are Python strings at once.
SLICE = 1 << 20
#: Columns that say where a block stands; tables and images keep those that the blocks have.
PLACE = ("bbox", "page_width", "page_height", "image_path")


def section_groups(blocks: DataFrame) -> DataFrame:
    """Adds ``grp``: a heading, another section path or another page than the block before starts a group."""
    w = Window.partitionBy("source").orderBy("block_seq")
    before = [F.lag(c).over(w) for c in ("section_path", "page")]
    new = (F.col("type") == "heading") | ~before[0].eqNullSafe(F.col("section_path")) | ~before[1].eqNullSafe(F.col("page"))
    first = F.row_number().over(w) == 1
    return blocks.withColumn("starts", F.when(first | new, 1).otherwise(0)).withColumn("grp", F.sum("starts").over(w) - 1).drop("starts")


def heading_paths(blocks: DataFrame, levels: int = 3, heading: str | None = None) -> DataFrame:
    """Adds ``path``: the open headings above each block, joined by " > "; and the last of them, as the column that ``heading`` names.

    A heading closes all of its level and deeper, so the open heading of a level is its last one that no shallower
    heading follows: a running maximum per level, no ordered fold.
    """
    w = Window.partitionBy("source").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, last = blocks, []
    for n in range(1, levels + 1):
        own = F.col("level") == n
        out = out.withColumn(f"__at{n}", F.max(F.when(own, F.col("block_seq"))).over(w)).withColumn(f"__h{n}", F.last(F.when(own, F.col("content")), ignorenulls=True).over(w))
        above = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"__at{m}"), F.lit(-1)) for m in range(1, n)]) if n > 1 else F.lit(-1)
        last.append(F.when(F.col(f"__at{n}") > above, F.col(f"__h{n}")))
    if heading:
        out = out.withColumn(heading, F.coalesce(*reversed(last), F.lit("")))
    return out.withColumn("path", F.concat_ws(" > ", *last)).drop(*[f"__{k}{n}" for k in ("at", "h") for n in range(1, levels + 1)])


def _merge(pieces: list[str], joiner: str, size: int, overlap: int) -> list[str]:
    """Fill chunks up to ``size`` and start each with the last pieces of the one before, up to ``overlap``."""
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit() -> None:
        if text := joiner.join(held).strip():
            out.append(text)

    for piece in pieces:
        more = lambda: total + len(piece) + (len(joiner) if held else 0) > size  # noqa: B023, E731
        if held and more():
            emit()
            while held and (total > overlap or more() and total > 0):
                total -= len(held[0]) + (len(joiner) if len(held) > 1 else 0)
                held.pop(0)
        total += len(piece) + (len(joiner) if held else 0)
        held.append(piece)
    emit()
    return out


def split_fixed(text: str, size: int, overlap: int) -> list[str]:
    """Lines merged up to ``size``; a longer line stays whole."""
    return _merge([p for p in text.split("\n") if p], "\n", size, overlap)


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The first separator that occurs cuts before itself; small pieces merge, large ones go on with the others."""
    at = next(k for k, s in enumerate(separators) if s in text)
    mark, rest = separators[at], separators[at + 1 :]
    if mark:
        first, *others = text.split(mark)
        pieces = [p for p in (first, *(mark + o for o in others)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    small: list[str] = []
    for p in pieces:
        if len(p) < size:
            small.append(p)
            continue
        out += _merge(small, "", size, overlap) if small else []
        small = []
        out += split_recursive(p, size, overlap, rest) if rest else [p]
    return out + (_merge(small, "", size, overlap) if small else [])


def slices(texts: pa.Array):
    """(first, number) of texts that follow one another and hold about SLICE bytes together, or of one longer text."""
    ends = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield at, to - at
        at = to


def splitter(strategy: str, size: int, overlap: int):
    """A column function: text -> array of chunks, by ``fixed_size`` or ``recursive``."""
    cut = {"fixed_size": split_fixed, "recursive": split_recursive}[strategy]

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        # Python strings of some texts at a time; those of a whole batch would be several times its size.
        done = [pa.array([], pa.list_(pa.string()))]
        for at, n in slices(texts):
            done.append(pa.array([[c for c in cut(t, size, overlap) if c.strip()] if t else [] for t in texts.slice(at, n).to_pylist()], pa.list_(pa.string())))
        return pa.concat_arrays(done)

    return split


def chunk_documents(docs: DataFrame, strategy: str = "fixed_size", settings: Settings = Settings()) -> DataFrame:
    """One row per chunk of (doc_id, content, type): index, total, strategy; tables and images stay whole."""
    atomic = F.col("type").isin(*ATOMIC)
    parts = F.when(atomic, F.array("content")).otherwise(splitter(strategy, settings.chunk_size, settings.chunk_overlap)(F.col("content")))
    rows = small_batches(docs).withColumn("parts", parts).withColumn("total_chunks", F.size("parts"))
    out = rows.select(*[c for c in docs.columns if c != "content"], "total_chunks", F.posexplode("parts").alias("chunk_index", "content"))
    return out.where(filled(F.col("content"))).withColumn("strategy", F.when(F.col("type").isin(*ATOMIC), "none").otherwise(strategy))


def chunk_hierarchical(blocks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Parents of section groups and their children; tables and images are their own parents.

    The first block of a group gives its metadata. Blank children are left out but keep their index and count. Text stands in several
    blocks' places, so only tables and images keep their box, page size and image path.
    """
    columns = ["source", "page", "type", "heading", "section_path", "content", "parent_id", "parent_content", "chunk_index", "total_chunks", "strategy"]
    text = section_groups(blocks.where(~F.col("type").isin(*ATOMIC)))
    groups = small_batches(text).groupBy("source", "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_seq", "content"))), lambda x: x["content"]), "\n\n").alias("joined"),
        F.min_by(F.struct("page", "type", "heading", "section_path"), "block_seq").alias("m"),
    )
    parents = groups.select("source", "grp", "m", F.posexplode(splitter("recursive", settings.parent_size, settings.parent_overlap)(F.col("joined"))).alias("p", "parent_content"))
    index = F.col("grp") * 1000 + F.col("p")
    parents = parents.withColumn("parent_id", parent_id(F.col("source"), F.col("m.page"), F.col("m.section_path"), index))
    cut = parents.withColumn("parts", splitter("recursive", settings.child_size, settings.child_overlap)(F.col("parent_content"))).withColumn("total_chunks", F.size("parts"))
    children = cut.select("source", "m.page", "m.type", "m.heading", "m.section_path", "parent_id", "parent_content", "total_chunks", F.posexplode("parts").alias("chunk_index", "content")).withColumn("strategy", F.lit("hierarchical"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("block_seq")) - 1
    whole = blocks.where(F.col("type").isin(*ATOMIC) & filled(F.col("content"))).withColumn("a", number)
    atomic = whole.withColumns({"parent_id": parent_id(F.col("source"), F.col("page"), F.col("section_path"), 100000 + F.col("a")), "parent_content": stripped(F.col("content")), "content": stripped(F.col("content")), "chunk_index": F.lit(0), "total_chunks": F.lit(1), "strategy": F.lit("hierarchical")})
    return children.where(filled(F.col("content"))).select(*columns).unionByName(atomic.select(*columns, *[c for c in PLACE if c in blocks.columns]), allowMissingColumns=True)


def chunk_stats(chunks: DataFrame, content: Column | None = None) -> DataFrame:
    n = F.length(F.col("content") if content is None else content)
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.bround(F.avg(n)).cast("long").alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))
