"""Files to chunks with vectors in a store and a sparse index."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import filled, query_text, tokens
from sparkloom.operators import chunking, store
from sparkloom.runtime import cut, stored
from sparkloom.schema import Settings, canonical

#: A model as a column function: text -> array<float>.
Embedder = Callable[[Column], Column]


def hashed_embedder(size: int = 64) -> Embedder:
    """The built-in embedder: tokens counted by a hash with a sign, scaled to length one; no model, the same everywhere."""

    @F.arrow_udf("array<float>")
    def embed(lists: pa.Array) -> pa.Array:
        out = []
        for words in lists.to_pylist():
            v = np.zeros(size)
            for w in words or ():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h >> 16 & 1 else -1
            length = np.linalg.norm(v)
            out.append((v / length if length else v).astype(np.float32))
        return pa.array(out, pa.list_(pa.float32()))

    return lambda text: embed(tokens(F.coalesce(text, F.lit(""))))


def embed_chunks(chunks: DataFrame, embed: Embedder) -> DataFrame:
    return chunks.withColumn("vector", embed(F.col("content")))


def embed_questions(questions: DataFrame, embed: Embedder, prefix: str | None = None) -> DataFrame:
    """(query, text, vector): trimmed, and with the prefix that an asymmetric encoder wants in front, for the vector only."""
    asked = query_text(F.col("text"), prefix) if prefix is not None else query_text(F.col("text"))
    return questions.withColumn("vector", embed(asked))


def with_ids(chunks: DataFrame) -> DataFrame:
    """``point_id`` from what makes a chunk itself, so that a task that runs again names it the same."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("source", "page", "parent_id", "chunk_index", "content")]
    return chunks.withColumn("point_id", F.md5(F.concat_ws("|", *parts).cast("binary")))


class Names(Sequence):
    """The names in a table's column ``source``, sorted, as a list that is read to the driver only when somebody looks at it."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @cached_property
    def held(self) -> list[str]:
        return sorted(r[0] for r in self.rows.select("source").collect())

    def __getitem__(self, at):
        return self.held[at]

    def __len__(self) -> int:
        return len(self.held)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Sequence) and self.held == list(other)

    __hash__ = None

    def __repr__(self) -> str:
        return repr(self.held) if "held" in self.__dict__ else "Names(not read)"


@dataclass(frozen=True)
class Summary:
    files_indexed: Sequence[str]
    skipped: Sequence[str]
    total_chunks: int
    total_parents: int


class KnowledgeBase:
    """A store of chunks with vectors, its sparse index, and the registry of file hashes, kept together.

    ``chunks`` holds the canonical columns, ``point_id`` and ``vector``; ``registry`` (source, sha256).
    """

    def __init__(self, chunks: store.ChunkStore, sparse: store.SparseStore, registry: store.ChunkStore, embed: Embedder, settings: Settings = Settings()):
        self.chunks, self.sparse, self.registry, self.embed, self.settings = chunks, sparse, registry, embed, settings

    def ingest(self, files: DataFrame, blocks: DataFrame, urls: DataFrame | None = None) -> Summary:
        """Index a batch: files (seq, source, content), their blocks by any loader, and (source, url) where they were put.

        A file that is there already is replaced, whatever its bytes; of equal files in the batch, the first counts and the others are
        skipped, as are files without blocks. Neither names of files nor chunks pass through the driver; the summary's names are read when
        looked at.
        Each of the three parts changes once. If a run dies between them, ingesting the batch again puts all three right, as
        it replaces whatever is there; ``rebuild_sparse`` does so for the index alone.
        """
        seen = cut(store.batch_files(files).join(files.select("seq", "source"), "seq"))
        first = seen.where("not duplicate").select("source", "sha256")
        own = stored(blocks.where(filled(F.col("content"))).join(first.select("source"), "source", "left_semi"))
        good = cut(first.join(own.select("source").distinct(), "source", "left_semi").dropDuplicates(["source"]))
        skipped = seen.where("duplicate").select("source").unionByName(first.join(good, "source", "left_anti").select("source"))
        parts = chunking.chunk_hierarchical(own, self.settings)
        if urls is not None:
            parts = parts.join(urls.select("source", F.col("url").alias("source_url")), "source", "left").withColumn("source_url", F.coalesce("source_url", F.lit("")))
        rows = stored(embed_chunks(with_ids(canonical(parts)), self.embed))
        held = cut(seen.select("source").distinct())
        self.chunks.replace_sources(held, rows)
        self.sparse.replace_sources(held, rows)
        self.registry.replace_sources(held, good)
        return Summary(Names(good), Names(skipped), rows.count(), rows.select("parent_id").distinct().count())

    def delete_file(self, source: str) -> tuple[int, int]:
        """Remove a file everywhere: (chunks, sparse rows) deleted. Copies of the store follow at their next sync."""
        gone = self.chunks.delete_by_source(source), self.sparse.delete_by_source(source)
        self.registry.delete_by_source(source)
        return gone

    def rebuild_sparse(self) -> None:
        """The sparse index anew from the stored chunks; searches see the old one until it is whole."""
        self.sparse.rebuild(self.chunks.read())

    def wipe(self) -> None:
        for part in (self.chunks, self.sparse, self.registry):
            part.reset()


def knowledge_base(spark: SparkSession, path: str, embed: Embedder, settings: Settings = Settings()) -> KnowledgeBase:
    """The knowledge base under ``path``, new or as it was left."""
    parts = {"chunks": ("point_id", with_ids(canonical(spark.createDataFrame([], "content string"))).withColumn("vector", F.array(F.lit(0.0).cast("float"))).schema)}
    parts["registry"] = ("source", spark.createDataFrame([], "source string, sha256 string").schema)
    made = {name: store.ChunkStore(spark, f"{path}/{name}", schema, key) for name, (key, schema) in parts.items()}
    return KnowledgeBase(made["chunks"], store.SparseStore(spark, f"{path}/sparse"), made["registry"], embed, settings)
