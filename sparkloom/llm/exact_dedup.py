"""Exact dedup of a batch against immutable snapshots, by static binary-fuse filters.

Texts are equal when identical after lower-casing A-Z. Of equal texts, the row with the largest id stays.

1. A snapshot is frozen once: the SHA-256 of each row's normalised text, a group per distinct digest, and, for each bucket of about
   ``BUCKET_KEYS`` of them, one static 3-wise binary-fuse filter (8-bit fingerprints, about 9 bits a key). All three
   are written tables, under a path of the caller's if there is one, and are only read from then on.
2. Duplicates inside the new batch are grouped separately, with map-side sums: a text that a third of all rows share is one
   row per task.
3. Distinct incoming digests meet each snapshot's filters by bucket: a negative is new for certain. Filters are small and go
   to as many parts of a bucket as its incoming digests need, which stream past them, so that a small or empty
   snapshot gathers nothing in one task.
4. Positives join the snapshot's exact groups. Snapshots are taken in turn; what one holds alone is looked up in the next.
   Each row has a number of its own from the first writing on, and a group names the row that stays, so that no text's rows have to meet to
   be counted through. Groups of many rows are sent to all tasks when rows look up their group; their rows stay where they are.
5. Byte check: texts whose digest two rows or more have are grouped by (digest, text), again with map-side sums; a digest of one
   row needs no check, and its text is not shuffled. Should texts of one digest ever differ, their rows are split by text.

Defined cases: null text counts as empty; a group of null ids only keeps one row with null; rows that repeat both
id and text count in group_size, and one of them is kept; empty tables and snapshots give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import cut, stored

from .common import join_counted, lower_ascii, text_or_empty

#: Digests that a filter's bucket holds, and incoming digests that one part of a bucket takes, about.
BUCKET_KEYS, PART_KEYS = 2_000, 200_000
#: Repeated digests, eight bytes each, that are sent to all tasks of the byte check; more are joined by shuffling.
SENT = 1_000_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class FuseFilter:
    """A static 3-wise binary-fuse filter: any key put in is found, and about 1 in 256 others."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        at = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        places = np.stack([(at + i) * segment + ((_mix(h, i + 1) >> np.uint64(20)).astype(np.int64) & (segment - 1)) for i in range(3)])
        return places, (h & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))))
        for seed in range(1, 1000):
            segments = max(1, -(-size // segment) - 2)
            places, prints = cls._places(keys, seed, segment, segments)
            order = cls._peel(places, (segments + 2) * segment)
            if order is not None:
                table = np.zeros((segments + 2) * segment, dtype=np.uint8)
                for key, free in reversed(order):
                    a, b, c = places[:, key]
                    table[free] = prints[key] ^ table[a] ^ table[b] ^ table[c] ^ table[free]
                return cls(seed, segment, segments, table)
            size += size // 20 + segment
        raise RuntimeError("no seed gave a peelable filter")

    @staticmethod
    def _peel(places: np.ndarray, size: int) -> list[tuple[int, int]] | None:
        n = places.shape[1]
        count = np.bincount(places.ravel(), minlength=size).tolist()
        owner = np.zeros(size, dtype=np.int64)
        for row in places:
            np.bitwise_xor.at(owner, row, np.arange(n))
        owner, rows = owner.tolist(), places.T.tolist()
        stack, order = [i for i, c in enumerate(count) if c == 1], []
        while stack:
            at = stack.pop()
            if count[at] != 1:
                continue
            key = owner[at]
            order.append((key, at))
            for p in rows[key]:
                count[p] -= 1
                owner[p] ^= key
                if count[p] == 1:
                    stack.append(p)
        return order if len(order) == n else None

    def holds(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return self.table[places[0]] ^ self.table[places[1]] ^ self.table[places[2]] == prints


def _keys(digests: list[str]) -> np.ndarray:
    return np.array([int(d[16:32], 16) for d in digests], dtype=np.uint64)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


@dataclass(frozen=True)
class Snapshot:
    """An immutable snapshot: texts (doc, norm), digests (doc, digest, part, row), groups (digest, top, n), top being the (doc, part, row) that stays, and filters, one a bucket."""

    texts: DataFrame
    digests: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, buckets, seed, segment, segments, cells): one filter for the distinct digests of each bucket of a snapshot."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(_keys(pdf["digest"].tolist()))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "buckets": [buckets], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.table.tobytes()]})

    return groups.select(_bucket(buckets), "digest").groupBy("bucket").applyInPandas(build, "bucket long, buckets long, seed long, segment long, segments long, cells binary")


def screen(incoming: DataFrame, count: int, snapshot: Snapshot) -> DataFrame:
    """Those of ``count`` distinct incoming digests that the snapshot may hold; it holds none of the others."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:  # in order of (bucket, part), the filter's row first
            place = list(zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), strict=True))
            edges = [0, *[k for k in range(1, len(place)) if place[k] != place[k - 1]], len(place)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if place[lo] != at:
                    at, held = place[lo], None
                    r = part.slice(0, 1).to_pylist()[0]
                    if r["cells"] is not None:
                        held, part = FuseFilter(r["seed"], r["segment"], r["segments"], np.frombuffer(r["cells"], dtype=np.uint8)), part.slice(1)
                if held and part.num_rows:
                    digests = part.column("digest")
                    yield pa.RecordBatch.from_arrays([digests.filter(pa.array(held.holds(_keys(digests.to_pylist()))))], ["digest"])

    parts = max(1, -(-count // (snapshot.buckets * PART_KEYS)))
    number = lambda k: F.lit(k).cast("long")
    rows = incoming.select(_bucket(snapshot.buckets), F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(parts)).alias("part"), "digest", *[number(None).alias(c) for c in ("seed", "segment", "segments")], F.lit(None).cast("binary").alias("cells"))
    filters = snapshot.filters.select("bucket", F.explode(F.sequence(number(0), number(parts - 1))).alias("part"), F.lit(None).cast("string").alias("digest"), "seed", "segment", "segments", "cells")
    both = rows.unionByName(filters).repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("cells").isNull())
    return both.mapInArrow(look, "digest string")


def _groups(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max(F.struct("doc", "part", "row")).alias("top"), F.count(F.lit(1)).alias("n"))


def _numbered(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` written with ``part``, a number of this table, and ``row``, a number in it: both differ between rows that are equal else."""
    return stored(rows.withColumns({"part": F.lit(uuid.uuid4().int >> 65), "row": F.monotonically_increasing_id()}), path)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc"), lower_ascii(text_or_empty(df[text_col])).alias("norm"))


def _freeze(texts: DataFrame, digests: DataFrame, path: str | None) -> Snapshot:
    groups = stored(_groups(digests), path and f"{path}/groups")
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))
    return Snapshot(texts, digests, groups, stored(build_filters(groups, buckets), path and f"{path}/filters"), buckets)


def take_snapshot(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Freeze a table that no longer changes; with a path, ``open_snapshot`` finds what was built there."""
    texts = _texts(df, id_col, text_col)
    return _freeze(texts, _numbered(texts.select("doc", F.sha2("norm", 256).alias("digest")), path and f"{path}/digests"), path)


def open_snapshot(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """The snapshot that was frozen under ``path``; ``df`` is the table it was taken of."""
    digests, groups, filters = (df.sparkSession.read.parquet(f"{path}/{name}") for name in ("digests", "groups", "filters"))
    first = filters.first()
    return Snapshot(_texts(df, id_col, text_col), digests, groups, filters, first["buckets"] if first else 1)


def _decide(texts: DataFrame, digests: DataFrame, batch: DataFrame, snapshots: Sequence[Snapshot], id_col: str) -> DataFrame:
    groups = cut(_groups(batch))
    for s in snapshots:
        maybe = screen(groups.select("digest"), groups.count(), s)
        met = cut(maybe.join(s.groups, "digest").select("digest", F.col("top").alias("old_top"), F.col("n").alias("old_n")))
        more = groups.join(met, "digest", "left").select("digest", F.greatest("top", "old_top").alias("top"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"))
        groups = cut(more.unionByName(s.groups.join(met, "digest", "left_anti").select("digest", "top", "n")))
    groups = groups.select("digest", "top", F.col("n").alias("group_size"))

    # Byte check. The first sixteen digits of a digest are enough to leave out texts that no other row has.
    short = lambda digest: F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    repeated = cut(groups.where("group_size > 1").select(short(F.col("digest")).alias("short")).distinct())
    sent = repeated.count() <= SENT
    rows = texts.select("doc", "norm", F.sha2("norm", 256).alias("digest"))
    rows = rows.join(F.broadcast(repeated) if sent else repeated, short(F.col("digest")) == F.col("short"), "left_semi")
    checked = cut(rows.groupBy("digest", "norm").count().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))
    columns = ["doc", "keep_id", "group_size", "kept", "digest"]
    differ = checked.limit(1).count()  # one digest, different bytes
    normal = cut(groups.join(checked, "digest", "left_anti")) if differ else groups
    met = join_counted(digests.select("doc", "digest", "part", "row"), normal.withColumn("rows", F.col("group_size")), "digest", "rows")
    out = met.withColumns({"keep_id": F.col("top.doc"), "kept": F.struct("doc", "part", "row").eqNullSafe(F.col("top"))}).select(*columns)
    if differ:
        own = rows.join(checked, "digest", "left_semi")
        parts = own.groupBy("digest", "norm").agg(F.max("doc").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        first = F.row_number().over(Window.partitionBy("digest", "norm", "doc").orderBy(F.lit(0))) == 1
        apart = own.withColumn("first", first).join(parts, ["digest", "norm"])
        out = out.unionByName(apart.withColumn("kept", F.col("doc").eqNullSafe(F.col("keep_id")) & F.col("first")).select(*columns))
    return out.select(F.col("doc").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def dedup_batch(df: DataFrame, snapshots: Sequence[Snapshot], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the new batch ``df`` and of every snapshot: id, keep_id, group_size, kept, text_sha256."""
    texts = _texts(df, id_col, text_col)
    batch = _numbered(texts.select("doc", F.sha2("norm", 256).alias("digest")))
    every, digests = texts, batch
    for s in snapshots:
        every, digests = every.unionByName(s.texts), digests.unionByName(s.digests)
    return _decide(every, digests, batch, snapshots, id_col)


def exact_dedup(df: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup_batch`` where one table holds both: ``in_snapshot`` says which rows are the snapshot's, the others are the new batch."""
    texts = _texts(df, id_col, text_col)
    digests = _numbered(df.select(df[id_col].cast("long").alias("doc"), F.sha2(lower_ascii(text_or_empty(df[text_col])), 256).alias("digest"), F.coalesce(in_snapshot, F.lit(False)).alias("old")))
    held = _freeze(texts, digests.where("old").drop("old"), None)
    return _decide(texts, digests, digests.where("not old"), [held], id_col)
