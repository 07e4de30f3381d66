"""Sparse and dense retrieval, fusion, diversity, reranking and parent expansion, for any number of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkloom.functions.text import counted, let, or_else, stripped, tokens
from sparkloom.operators.postings import PostingIndex, counted_terms, found_rows, raw_weight
from sparkloom.operators.postings import search as search_blocks
from sparkloom.runtime import cut, stored
from sparkloom.schema import Settings

#: Query vectors that are sent to the tasks together, and rows that meet them at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 1024
#: Weighted query terms that are sent to the postings; more meet them by a shuffled join.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class SparseIndex:
    """What BM25 needs of a chunk table: rows (doc, dl, terms), their vocabulary (tok, df), and three numbers."""

    rows: DataFrame
    vocabulary: DataFrame
    n: int
    average: float
    mean: float  # of the vocabulary's raw weights


def document_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", *more: str) -> DataFrame:
    """(doc, dl, terms): the counted tokens of each document with content, inside its row."""
    rows = docs.where(F.coalesce(F.col(text_col), F.lit("")) != "").select(F.col(id_col).alias("doc"), *more, counted(tokens(F.col(text_col))).alias("terms"))
    length = F.aggregate("terms", F.lit(0), lambda n, t: n + t["tf"])
    return rows.select("doc", *more, length.alias("dl"), "terms")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(doc, tok, tf)"""
    return counted_terms(docs, id_col, text_col).where("tok <> ''").select("doc", "tok", F.col("tf").cast("long").alias("tf"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(tok, df) of (doc, dl, terms) rows; counts are summed in each task before they meet."""
    return rows.select(F.explode("terms").alias("t")).groupBy("t.tok").agg(F.count(F.lit(1)).alias("df"))


def indexed(rows: DataFrame, words: DataFrame) -> SparseIndex:
    """An index over written tables."""
    n, average = rows.agg(F.count(F.lit(1)), F.avg("dl")).first()
    mean = words.agg(F.avg(raw_weight(F.col("df"), n))).first()[0] if n else 0.0
    return SparseIndex(rows, words, n, average or 0.0, mean or 0.0)


def sparse_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> SparseIndex:
    """The index of a chunk table, written once to the checkpoint folder."""
    rows = stored(document_terms(docs, id_col, text_col))
    return indexed(rows, stored(vocabulary(rows)))


def search(index: SparseIndex | PostingIndex, queries: DataFrame, k: int, settings: Settings = Settings()) -> DataFrame:
    """(query, doc, score, rank): top k of each query; scores at or under zero are dropped after the cut.

    A ``PostingIndex`` is searched by its blocks. Else, over a table of rows: Okapi weights; negative ones become epsilon times the vocabulary's mean weight. The queries' weighted terms go to the postings where they are
    few, by their counted number; a document's hits then never leave its task, and scores are summed there.
    """
    if isinstance(index, PostingIndex):
        return search_blocks(index, queries, k, settings)
    s = settings
    terms = queries.select("query", F.explode(counted(tokens(F.col("text")))).alias("t")).select("query", "t.tok", F.col("t.tf").alias("qf"))
    w = raw_weight(F.col("df"), index.n)
    weighted = cut(terms.join(index.vocabulary, "tok").select("query", "tok", (F.col("qf") * F.when(w < 0, s.bm25_epsilon * index.mean).otherwise(w)).alias("weight")))
    few = weighted.count() <= BROADCAST_TERMS
    hits = index.rows.select("doc", "dl", F.explode("terms").alias("t")).select("doc", "dl", "t.tok", "t.tf").join(F.broadcast(weighted) if few else weighted, "tok")
    part = F.col("weight") * F.col("tf") * (s.bm25_k1 + 1) / (F.col("tf") + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("dl") / F.lit(index.average)))
    scores = hits.groupBy("query", "doc").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0))


def bm25(docs: DataFrame, queries: DataFrame, k: int, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """``search`` over a chunk table that has no index yet."""
    return search(sparse_index(docs, id_col, text_col), queries, k, settings)


def knn(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, keep_self: bool = True, id_col: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """(query, doc, score, rank): exact cosine top k; ids keep their own types.

    Queries go out in blocks of QUERY_BLOCK; a task keeps k rows a query of each block, and those meet by query.
    The filter comes before the cut, at the scan.
    """
    rows = (vectors if where is None else vectors.where(where)).select(F.col(id_col).alias("doc"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    schema = StructType([StructField("query", queries.schema["query"].dataType), StructField("doc", rows.schema["doc"].dataType), StructField("score", DoubleType())])
    best: DataFrame | None = None
    for ids, matrix in _blocks(queries):
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            top = Top(len(ids), k)
            place = {} if keep_self else {d: i for i, d in enumerate(ids)}
            kind = None
            for batch in (b.slice(at, ROW_BLOCK) for b in batches for at in range(0, b.num_rows, ROW_BLOCK)):
                kind = batch.schema.field(0).type
                doc = np.array(batch.column(0).to_pylist(), dtype=object)
                m = np.vstack(batch.column(1).to_numpy(zero_copy_only=False))
                size = np.linalg.norm(m, axis=1)
                score = q @ (m / np.where(size == 0, 1, size)[:, None]).T
                for j, d in enumerate(doc) if place else ():
                    if (i := place.get(d)) is not None:
                        score[i, j] = -np.inf
                top.offer(score, doc)
            if kind is not None:
                i, doc, score = top.ends()
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], query_kind), pa.array(doc.tolist(), kind), pa.array(score)], ["query", "doc", "score"])

        query_kind = to_arrow_type(schema["query"].dataType)
        part = rows.mapInArrow(search, schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    order = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "doc")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Top:
    """The k best rows of each query, by score with six places, then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.bars = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, 4 * queries * k + 65_536

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        """Scores of all queries by these rows; minus infinity for none."""
        rounded = np.round(score, 6)
        if score.shape[1] > self.k:
            # The k-th best of these rows bounds the k-th best of all.
            self.bars = np.maximum(self.bars, np.partition(rounded, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((rounded >= self.bars[:, None]) & (rounded > -np.inf))
        self.held.append((i, doc[j], score[i, j]))
        self.size += len(i)
        if self.size > self.limit:
            self.held = [self.ends()]
            self.size = len(self.held[0][0])
            self.limit = max(self.limit, 2 * self.size)

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score), k a query at most."""
        i, doc, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((np.unique(doc, return_inverse=True)[1], -np.round(score, 6), i))
        i, doc, score = i[order], doc[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        full = place == self.k - 1
        self.bars[i[full]] = np.maximum(self.bars[i[full]], np.round(score[full], 6))
        kept = place < self.k
        return i[kept], doc[kept], score[kept]


def _blocks(queries: DataFrame):
    ids, rows = [], []
    for r in queries.select("query", F.col("vector").cast("array<double>").alias("v")).where("v is not null").toLocalIterator():
        ids.append(r["query"])
        rows.append(r["v"])
        if len(ids) == QUERY_BLOCK:
            yield ids, _unit(rows)
            ids, rows = [], []
    if ids:
        yield ids, _unit(rows)


def _unit(rows: list | np.ndarray) -> np.ndarray:
    m = np.asarray(rows, dtype=np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def rrf(dense: DataFrame, sparse: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reciprocal rank fusion of (query, doc, content, rank) lists by trimmed content.

    Repeats inside one list add up too. The last dense repeat gives the row, a sparse one only where there is none.
    (query, doc, content, rrf_score, dense_rank, sparse_rank, rank)
    """
    legs = dense.select("query", "doc", "content", "rank", F.lit(0).alias("leg"), F.lit(settings.dense_weight).alias("w")).unionByName(sparse.select("query", "doc", "content", "rank", F.lit(1).alias("leg"), F.lit(settings.sparse_weight).alias("w")))
    choice = F.struct("leg", F.when(F.col("leg") == 0, -F.col("rank")).otherwise(F.col("rank")).alias("r"))
    fused = legs.groupBy("query", stripped(F.col("content")).alias("key")).agg(
        F.round(F.sum(F.col("w") / (settings.rrf_k + F.col("rank"))), 6).alias("rrf_score"),
        F.min_by(F.struct("doc", "content"), choice).alias("row"),
        F.min(F.when(F.col("leg") == 0, F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("leg") == 1, F.col("rank"))).alias("sparse_rank"),
    )
    order = Window.partitionBy("query").orderBy(F.col("rrf_score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    out = fused.select("query", "row.doc", "row.content", "rrf_score", "dense_rank", "sparse_rank").withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rrf_score") >= settings.score_threshold) if settings.score_threshold > 0 else out


def diversify(ranked: DataFrame, k: int, threshold: float = Settings.diversity) -> DataFrame:
    """Greedy diversity over (query, doc, content, vector, rank): (query, doc, rank).

    Equal trimmed contents keep the first. With k rows or fewer all stay. Else rows are taken in order if their cosine
    to every taken row is under the threshold, and the earliest rows left out fill up at the end. A query's list is as
    long as the retrieval depth, so it fits in one fold.
    """
    first = Window.partitionBy("query", stripped(F.col("content"))).orderBy("rank")
    rows = ranked.withColumn("copy", F.row_number().over(first)).where("copy = 1")
    lists = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", F.col("vector").cast("array<double>").alias("v")))).alias("all"))
    kind = f"array<struct<rank:int,doc:{ranked.schema['doc'].dataType.simpleString()},v:array<double>>>"

    def size(a: Column) -> Column:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))

    def like(a: Column, b: Column) -> Column:
        n = size(a) * size(b)
        return F.when(n == 0, 0.0).otherwise(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / n)

    def step(taken: Column, x: Column) -> Column:
        fits = (F.size(taken) < k) & ~F.exists(taken, lambda t: like(t["v"], x["v"]) >= threshold)
        return F.when(fits, F.concat(taken, F.array(x))).otherwise(taken)

    taken = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), step)
    ids, every = F.transform(taken, lambda x: x["doc"]), F.transform("all", lambda x: x["doc"])
    picked = F.when(F.size("all") <= k, every).otherwise(F.slice(F.concat(ids, F.array_except(every, ids)), 1, k))
    return lists.select("query", F.posexplode(picked).alias("pos", "doc")).select("query", "doc", (F.col("pos") + 1).alias("rank"))


def hybrid(chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), pin: Column | None = None, pin_sparse: bool = False, deduplicate: bool = True, index: SparseIndex | PostingIndex | None = None, id_col: str = "doc_id") -> DataFrame:
    """Dense and sparse top lists, fused, thresholded, deduplicated and diversified.

    chunks: ``id_col`` of any type, content, vector; queries: query, text, vector. ``pin`` filters the dense list before its cut, and the
    sparse one only with ``pin_sparse``. ``index`` is that of all chunks, if there is one. (query, doc, rrf_score, rank)
    """
    content = chunks.select(F.col(id_col).alias("doc"), "content", "vector")
    dense = found_rows(cut(knn(chunks, queries, settings.fetch_k, pin, id_col=id_col)), content.select("doc", "content"))
    if pin is not None and pin_sparse:
        index = sparse_index(chunks.where(pin), id_col)
    sparse = found_rows(cut(search(index or sparse_index(chunks, id_col), queries, settings.fetch_k, settings)), content.select("doc", "content"))
    fused = stored(rrf(dense, sparse, settings))
    if not deduplicate:
        return fused.where(F.col("rank") <= settings.top_k).select("query", "doc", "rrf_score", "rank")
    chosen = diversify(found_rows(fused, content.select("doc", "vector")), settings.top_k, settings.diversity)
    return chosen.join(fused.select("query", "doc", "rrf_score"), ["query", "doc"]).select("query", "doc", "rrf_score", "rank")


def lexical_overlap(query: Column, text: Column) -> Column:
    """The built-in pair scorer: the share of the query's distinct tokens that the text has."""
    return let(F.array_distinct(tokens(query)), lambda q: F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q)))


def rerank(rows: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = lexical_overlap, threshold: float | None = None) -> DataFrame:
    """Score (query text, parent content or content), keep the old score, cut to k by score, then prior rank."""
    text = or_else(F.col("parent_content"), F.col("content"))
    scored = rows.withColumn("retrieval_score", F.col("score")).withColumn("rerank_score", F.round(scorer(F.col("query_text"), text), 4))
    if threshold is not None:
        scored = scored.where(F.col("rerank_score") >= threshold)
    order = Window.partitionBy("query").orderBy(F.col("rerank_score").desc(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("rank", "score").withColumnRenamed("new_rank", "rank").withColumn("score", F.col("rerank_score"))


def expand_parents(rows: DataFrame) -> DataFrame:
    """The first child of each parent stands for it and takes its text; rows without a parent's id and text all stay as they are."""
    has = (F.coalesce(F.col("parent_id"), F.lit("")) != "") & (F.coalesce(F.col("parent_content"), F.lit("")) != "")
    key = F.when(has, F.col("parent_id")).otherwise(F.col("rank").cast("string"))
    first = rows.withColumn("copy", F.row_number().over(Window.partitionBy("query", has, key).orderBy("rank"))).where("copy = 1").drop("copy")
    out = first.withColumn("content", F.when(has, F.col("parent_content")).otherwise(F.col("content")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))


def dense_with_parents(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", pin: Column | None = None) -> DataFrame:
    """The plain retriever: the k nearest chunks of each question, each parent once and with its own text. (query, doc, content, score, rank)"""
    rows = found_rows(cut(knn(chunks, queries, k, pin, id_col=id_col)), chunks.select(F.col(id_col).alias("doc"), "content", "parent_id", "parent_content"))
    return expand_parents(rows).select("query", "doc", "content", "score", "rank")


def asked(questions: DataFrame, most: int = 2000) -> DataFrame:
    """Questions of 1 to ``most`` characters; others, null ones too, are refused."""
    return questions.where(F.length("text").between(1, most))


def online(rows: DataFrame, settings: Settings = Settings(), scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """Rerank, expand to parents, rerank again."""
    return rerank(expand_parents(rerank(rows, settings.rerank_top_k, scorer)), settings.rerank_top_k, scorer)


def offline(rows: DataFrame, settings: Settings = Settings(), reranked: bool = False, k: int = 5, scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """Without a model: the first k hits as they are, or the whole path of ``online`` where reranking is switched on."""
    return online(rows, settings, scorer) if reranked else rows.where(F.col("rank") <= k)


def gate(rows: DataFrame, least: float = Settings.min_rerank_score) -> DataFrame:
    """All of a query's rows, or none if its best score is under ``least`` or all of its context is blank."""
    every = Window.partitionBy("query")
    best = F.first("score").over(every.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    some = F.max(stripped(F.col("content")) != "").over(every)
    return rows.withColumn("best_score", best).withColumn("__some", some).where((F.col("best_score") >= least) & F.col("__some")).drop("__some")
