"""Tables on pages from their ruling lines and the words between them, as joins and windows over (source, page) rows.

Coordinates are points from the top left of a page. A page's lines become edges, edges cross in corners, corners bound cells, words fall
into cells, and cells that hang together are a table. Each step is linear in what a page has: corners come from an interval join over
bins of coordinates, and a cell's far corners are the first ones along its own edges that bound it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import filled, stripped
from sparkloom.runtime import cut

#: Lines this near to each other are one, words this near in height stand on one line (points).
SNAP, LINE = 3.0, 3.0
#: Width of the bins that intervals are dealt over (points).
BIN = 64

PAGE = ["source", "page"]


def _bins(low: Column, high: Column) -> Column:
    """The bins that an interval touches."""
    return F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN)))


def edges(lines: DataFrame) -> DataFrame:
    """(source, page, flat, at, low, high, edge) from lines (source, page, x0, y0, x1, y1): rulings along x (flat) or y, of one height or place.

    Lines whose height (place) is within ``SNAP`` of the one before count as one ruling, at their mean; its pieces that touch or overlap are joined. Slanted
    lines and lines without a coordinate are no rulings.
    """
    box = {c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}
    rows = lines.select(*PAGE, *[c.alias(n) for n, c in box.items()]).dropna(subset=list(box))
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    rows = rows.where((F.least(wide, high) <= SNAP) & (F.greatest(wide, high) > SNAP)).withColumn("flat", wide > high)
    across = lambda f, side: F.when(F.col("flat"), f(f"x{side}")).otherwise(f(f"y{side}"))
    a, b = across(F.col, 0), across(F.col, 1)
    middle = F.when(F.col("flat"), (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)
    rows = rows.select(*PAGE, "flat", middle.alias("at"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    kind = [*PAGE, "flat"]
    by_at = Window.partitionBy(*kind).orderBy("at")
    rows = rows.withColumn("fresh", F.coalesce(F.col("at") - F.lag("at").over(by_at) > SNAP, F.lit(True)).cast("int"))
    rows = rows.withColumn("ruling", F.sum("fresh").over(by_at.rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("at", F.avg("at").over(Window.partitionBy(*kind, "ruling")))
    along = Window.partitionBy(*kind, "ruling").orderBy("low", "high")
    reached = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce(F.col("low") - reached > SNAP, F.lit(True)).cast("int"))
    rows = rows.withColumn("piece", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*kind, "ruling", "piece").agg(F.first("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high")).select(*kind, "at", "low", "high", F.struct("flat", "ruling", "piece").alias("edge"))


def corners(rulings: DataFrame) -> DataFrame:
    """(source, page, x, y, h, v, right, down): where a flat edge h meets an upright one v, and whether they go on from there to the right and down."""
    flat = rulings.where("flat").select(*PAGE, F.col("at").alias("y"), F.col("low").alias("left"), F.col("high").alias("end"), F.col("edge").alias("h"))
    up = rulings.where("not flat").select(*PAGE, F.col("at").alias("x"), F.col("low").alias("top"), F.col("high").alias("foot"), F.col("edge").alias("v"))
    flat = flat.withColumn("x_bin", _bins(F.col("left") - SNAP, F.col("end") + SNAP)).withColumn("y_bin", F.floor(F.col("y") / BIN))
    up = up.withColumn("y_bin", _bins(F.col("top") - SNAP, F.col("foot") + SNAP)).withColumn("x_bin", F.floor(F.col("x") / BIN))
    met = flat.join(up, [*PAGE, "x_bin", "y_bin"]).where(F.col("x").between(F.col("left") - SNAP, F.col("end") + SNAP) & F.col("y").between(F.col("top") - SNAP, F.col("foot") + SNAP))
    return met.select(*PAGE, "x", "y", "h", "v", (F.col("end") - F.col("x") > SNAP).alias("right"), (F.col("foot") - F.col("y") > SNAP).alias("down"))


def boxes(met: DataFrame) -> DataFrame:
    """(source, page, x0, y0, x1, y1, h): a cell for each corner whose edges go right and down and are closed by two more.

    Its right end is the first corner along h from which an edge goes down, its foot the first along v from which one goes right; a corner must
    lie where these two meet. Cells that span several rows or columns are one cell so.
    """
    ahead = lambda edge, order: Window.partitionBy(*PAGE, edge).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    side = F.first(F.when(F.col("down"), F.struct("x", "v")), ignorenulls=True).over(ahead("h", "x"))
    foot = F.first(F.when(F.col("right"), F.struct("y", "h")), ignorenulls=True).over(ahead("v", "y"))
    rows = met.withColumn("side", side).withColumn("foot", foot).where("right and down and side is not null and foot is not null")
    far = met.select(*PAGE, F.col("h").alias("far_h"), F.col("v").alias("far_v"))
    closed = rows.withColumns({"far_h": F.col("foot.h"), "far_v": F.col("side.v")}).join(far, [*PAGE, "far_h", "far_v"], "left_semi")
    return closed.select(*PAGE, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("side.x").alias("x1"), F.col("foot.y").alias("y1"), "h")


def _tables(met: DataFrame) -> DataFrame:
    """(source, page, h, table): flat edges that hang together by upright ones get the smallest of their places, passed on until nothing changes."""
    links = cut(met.select(*PAGE, "h", "v").distinct())
    named = cut(met.groupBy(*PAGE, "h").agg(F.min(F.struct("y", "x")).alias("table")))
    while True:
        by_v = links.join(named, [*PAGE, "h"]).groupBy(*PAGE, "v").agg(F.min("table").alias("table"))
        after = cut(links.join(by_v, [*PAGE, "v"]).groupBy(*PAGE, "h").agg(F.min("table").alias("table")))
        moved = after.join(named.withColumnRenamed("table", "was"), [*PAGE, "h"]).where(F.col("table") != F.col("was"))
        if not moved.limit(1).count():
            return after
        named = after


def _cell_texts(cells: DataFrame, words: DataFrame) -> DataFrame:
    """(source, page, x0, y0, text): a cell's words by line, then by place; a word is in the cell that holds its middle."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    own = words.where(filled(F.col("text"))).select(*PAGE, x.alias("x"), y.alias("y"), F.col("x0").alias("word_x"), "top", "text")
    own = own.withColumn("x_bin", F.floor(F.col("x") / BIN)).withColumn("y_bin", F.floor(F.col("y") / BIN))
    spread = cells.select(*PAGE, "x0", "y0", "x1", "y1").withColumn("x_bin", _bins(F.col("x0"), F.col("x1"))).withColumn("y_bin", _bins(F.col("y0"), F.col("y1")))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    held = own.join(spread, [*PAGE, "x_bin", "y_bin"]).where(inside)
    cell = [*PAGE, "x0", "y0"]
    by_top = Window.partitionBy(*cell).orderBy("top")
    held = held.withColumn("fresh", F.coalesce(F.col("top") - F.lag("top").over(by_top) > LINE, F.lit(True)).cast("int"))
    held = held.withColumn("line", F.sum("fresh").over(by_top.rangeBetween(Window.unboundedPreceding, 0)))
    lines = held.groupBy(*cell, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_x", "text"))), lambda w: w["text"]), " ").alias("text"))
    return lines.groupBy(*cell).agg(stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda w: w["text"]), "\n")).alias("text"))


def ruled_tables(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(source, page, table, bbox, content): the tables of pages, numbered from the top from 1, as labelled markdown.

    lines: (source, page, x0, y0, x1, y1); words: (source, page, x0, top, x1, bottom, text). A column is a left side that any cell of the
    table has; rows without such a cell get an empty one, rows without a word are left out, and so are tables of fewer than two rows with words.
    Repeated lines change nothing, repeated words are written as often as they are there; null pages and sources name none.
    """
    lines, words = (d.dropna(subset=PAGE) for d in (lines, words))
    met = cut(corners(edges(lines)))
    cells = boxes(met).join(_tables(met), [*PAGE, "h"]).drop("h")
    cells = cut(cells)
    own = [*PAGE, "table"]
    texts = cells.join(_cell_texts(cells, words), [*PAGE, "x0", "y0"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    head = cells.groupBy(*own).agg(F.array_sort(F.collect_set("x0")).alias("columns"), F.transform(F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")), lambda c: F.round(c, 2)).alias("bbox"))
    rows = texts.groupBy(*own, "y0").agg(F.map_from_entries(F.collect_list(F.struct("x0", "text"))).alias("at"), F.max(F.col("text") != "").alias("filled"))
    rows = rows.where("filled").join(head, own)
    line = F.concat(F.lit("| "), F.array_join(F.transform("columns", lambda c: F.coalesce(F.try_element_at("at", c), F.lit(""))), " | "), F.lit(" |"))
    whole = rows.withColumn("line", line).groupBy(*own, "columns", "bbox").agg(F.transform(F.array_sort(F.collect_list(F.struct("y0", "line"))), lambda r: r["line"]).alias("lines"))
    number = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("table")).alias("number")
    ranked = head.select(*own, number)
    rule = F.concat(F.lit("|"), F.array_join(F.transform("columns", lambda _: F.lit("---")), "|"), F.lit("|"))
    body = F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.expr("slice(lines, 2, greatest(size(lines) - 1, 0))")), "\n")
    label = F.concat(F.lit("[TABLE "), F.col("number").cast("string"), F.lit(" — Page "), F.col("page").cast("string"), F.lit("]\n"))
    return whole.where(F.size("lines") >= 2).join(ranked, own).select(*PAGE, F.col("number").alias("table"), "bbox", F.concat(label, body).alias("content"))
