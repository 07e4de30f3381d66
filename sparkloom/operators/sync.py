"""Keeping a local store in step with an authoritative one, and clients in step with the server."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import content_hash, filename_of, or_else, stripped
from sparkloom.runtime import stored


def plan(cloud: DataFrame, local: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, action): ids to pull and ids to delete, by id alone."""
    pull = cloud.select(key).join(local.select(key), key, "left_anti").select(key, F.lit("pull").alias("action"))
    return pull.unionByName(local.select(key).join(cloud.select(key), key, "left_anti").select(key, F.lit("delete").alias("action")))


def apply(cloud: DataFrame, local: DataFrame, key: str = "point_id") -> DataFrame:
    """The local store after a sync: stale rows go, missing ones come with their vectors."""
    kept = local.join(cloud.select(key), key, "left_semi")
    return kept.unionByName(cloud.join(local.select(key), key, "left_anti"))


def pending(cloud: DataFrame, local: DataFrame, key: str = "point_id") -> DataFrame:
    return cloud.select(key).join(local.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("pending_count"))


def url_filenames(chunks: DataFrame) -> DataFrame:
    """(url, filename): the first source of each non-blank url, else the url's last part; both without white space around."""
    url = stripped(F.col("source_url"))
    rows = chunks.where(url != "").select("ord", url.alias("url"), or_else(stripped(F.col("source")), filename_of(url)).alias("name"))
    return rows.where("name <> ''").groupBy("url").agg(F.min_by("name", "ord").alias("filename"))


def missing_files(sources: DataFrame, manifest: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Manifest entries of local sources that are not on disk yet."""
    wanted = manifest.where((F.coalesce(F.col("filename"), F.lit("")) != "") & (F.coalesce(F.col("url"), F.lit("")) != ""))
    return wanted.join(sources.select(F.col("source").alias("filename")).distinct(), "filename", "left_semi").join(on_disk.select("filename"), "filename", "left_anti").select("filename", "url")


def log_entries(log: DataFrame, keep: int = 50) -> DataFrame:
    return log.orderBy(F.col("timestamp").desc()).limit(keep)


def client_diff(client: DataFrame, server: DataFrame) -> DataFrame:
    """(source, action) from (source, hash) of both sides: delete, add (new or changed), unchanged."""
    c, s = client.select("source", F.col("hash").alias("ch")), server.select("source", F.col("hash").alias("sh"))
    action = F.when(F.col("sh").isNull(), "to_delete").when(F.col("ch").isNull() | (F.col("ch") != F.col("sh")), "to_add").otherwise("unchanged")
    return c.join(s, "source", "full").select("source", action.alias("action"))


#: Rows of a range of a page index.
RANGE_ROWS = 50_000


@dataclass(frozen=True)
class PageIndex:
    """Rows in a folder for each range of the export order, and how many rows of each source a range has (range, source, n)."""

    rows: DataFrame
    counts: DataFrame
    order: str

    def page(self, offset: int, limit: int, source: str | None = None) -> DataFrame:
        """The rows at these places of the order: the ranges that hold them are found by their counts, and only these are opened and sorted."""
        counts = self.counts if source is None else self.counts.where(F.col("source") == source)
        sums = counts.groupBy("range").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.orderBy("range"))  # a row a range
        hit = sums.withColumn("upto", upto).where((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit)).orderBy("range").collect()  # limit + 1 at most
        rows = self.rows.where(F.col("range").isin(*[r["range"] for r in hit])) if hit else self.rows.limit(0)
        if source is not None:
            rows = rows.where(F.col("source") == source)
        before = hit[0]["upto"] - hit[0]["n"] if hit else 0
        return rows.orderBy(self.order).offset(offset - before if hit else 0).limit(limit).drop("range")


def page_index(chunks: DataFrame, order: str = "ord", path: str | None = None) -> PageIndex:
    """Deal the rows over ranges of the order, once, under ``path`` or in the checkpoint folder; order values must not repeat."""
    n = chunks.count()
    dealt = chunks.repartitionByRange(max(1, -(-n // RANGE_ROWS)), order).withColumn("range", F.spark_partition_id())
    rows = stored(dealt, path, by="range")
    return PageIndex(rows, stored(rows.groupBy("range", "source").agg(F.count(F.lit(1)).alias("n"))), order)


def export_page(chunks: DataFrame | PageIndex, vectors: DataFrame, offset: int = 0, limit: int = 2000, source: str | None = None, order: str = "ord") -> DataFrame:
    """A page of chunks in the thirteen columns of an export; equal content keys inside the page keep the first.

    chunks: the order column and any canonical ones, as a table, all of which is put in order, or as a page index, of which a few ranges are opened; vectors: content_hash, embedding. A chunk without a vector has null.
    """
    if not 1 <= limit <= 3000 or offset < 0:
        raise ValueError("limit must be 1 to 3000 and offset not negative")
    if isinstance(chunks, PageIndex):
        order, taken = chunks.order, chunks.page(offset, limit, source)
    else:
        rows = chunks if source is None else chunks.where(F.col("source") == source)
        taken = rows.orderBy(order).offset(offset).limit(limit)
    page = taken.withColumn("content_hash", content_hash(F.col("source"), F.col("page"), F.col("content")))
    first = page.withColumn("copy", F.row_number().over(Window.partitionBy("content_hash").orderBy(order))).where("copy = 1").drop("copy")
    out = first.select(
        order, F.col("content_hash").alias("id"), "source", "content", or_else(F.col("parent_content"), F.col("content")).alias("parent_content"), "parent_id", "page", F.col("type").alias("chunk_type"),
        "section_path", "heading", "bbox", "page_width", "page_height",
    )
    return out.join(vectors.select(F.col("content_hash").alias("id"), "embedding"), "id", "left")


def export_vectors(chunks: DataFrame, vector: str = "vector", key: str = "point_id") -> DataFrame:
    """(content_hash, embedding) of a store; of chunks with one content key, the last by key gives the vector."""
    rows = chunks.select(content_hash(F.col("source"), F.col("page"), F.col("content")).alias("content_hash"), key, vector)
    return rows.groupBy("content_hash").agg(F.max_by(vector, key).alias("embedding"))


def matched(page: DataFrame) -> DataFrame:
    """(chunks, matched): how many chunks of an export page have a vector."""
    return page.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("matched"))


def key_overlap(chunks: DataFrame, vectors: DataFrame, first: int | None = None, order: str = "ord") -> DataFrame:
    """(chunks, vectors, overlap): distinct content keys that both sides have; ``first`` looks at so many chunks only, as a diagnostic."""
    rows = chunks if first is None else chunks.orderBy(order).limit(first)
    keys, held = rows.select(content_hash(F.col("source"), F.col("page"), F.col("content")).alias("k")), vectors.select(F.col("content_hash").alias("k"))
    both = keys.intersect(held).agg(F.count(F.lit(1)).alias("overlap"))
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(vectors.agg(F.countDistinct("content_hash").alias("vectors")))  # one row each
    return counts.crossJoin(both)


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with the text of their parent by id, their own fields first: (parent_id, content) of ``parents`` are looked up; of several with one id, the shortest."""
    p = parents.groupBy("parent_id").agg(F.min_by("content", F.struct(F.length("content"), "content")).alias("__parent"))
    return children.join(p, "parent_id", "left").withColumn("parent_content", or_else(F.col("parent_content"), F.col("__parent"))).drop("__parent")


def transitions(samples: DataFrame, key: str, at: str, status: str, tie: str | None = None) -> DataFrame:
    """Rows whose status differs from the one before, by key, with both; ``tie`` orders rows of one time."""
    w = Window.partitionBy(key).orderBy(at, *([tie] if tie else []))
    return samples.withColumn("before", F.lag(status).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(status)))
