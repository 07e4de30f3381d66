"""The registered queries of the retrieval engine, each with its SQL equivalent where SQL has one.

Fixtures by convention: a document is a chunk (source, page = null, content = text); documents and embeddings pair by
doc_id = vec_id; benchmark items are the questions, with the vector of the same id; searches take as queries every row
whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.vectors import cosine, norm, normalize
from sparkloom.operators import cells, chunking, context, ingest, keytree, postings, retrieval, ruled, store, sync, tables
from sparkloom.runtime import cut, new_folder, stamp, table
from sparkloom.schema import Settings, canonical
from sparkloom.sources import blocks, events

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- fixtures

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _sql_tokens(column: str) -> str:
    plain = rf"trim(regexp_replace(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s.\-°/%]', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"list_filter(string_split({plain}, ' '), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


def _sql_stripped(column: str) -> str:
    white = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
    return f"regexp_replace({column}, '^{white}+|{white}+$', '', 'g')"


_STRIPPED = _sql_stripped("content")
#: White space behind every third text, by id: texts that are equal but for it are one content.
_TAILED = "CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || chr(160) ELSE text END"
_HASH = "md5(source || '|' || 'None' || '|' || content[1:80])"
_CHUNKS = "chunks AS (SELECT doc_id, source, text AS content FROM documents WHERE text <> '')"
_INDEXES: dict[tuple, postings.PostingIndex] = {}
_LINES = rf"""lines AS (
  SELECT doc_id::VARCHAR AS source, i - 1 AS block_seq, l[i] AS content FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE {_sql_stripped("l[i]")} <> ''
), typed AS (
  SELECT *, CASE WHEN length(content) < 40 THEN 'heading' WHEN regexp_matches(content, '^(\s*[•·‣▸▶◦▪▫●○◆◇►]\s+|\s*[-*+]\s+|\s*\d{{1,2}}[.)]\s+|\s*[a-zA-Z][.)]\s+)') THEN 'bullet' ELSE 'text' END AS type,
    CASE WHEN length(content) < 10 THEN 1 WHEN length(content) < 20 THEN 2 WHEN length(content) < 40 THEN 3 END AS level FROM lines
)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content"), F.lit(None).cast("int").alias("page"))


def _paired(spark: SparkSession, sf_dir: str, tail: bool = True) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    c = _chunks(spark, sf_dir)
    return (c.withColumn("content", _tailed(F.col("content"))) if tail else c).join(e, "doc_id")


def _tailed(text: Column) -> Column:
    return F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("\n\u00a0"))).otherwise(text)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return table(spark, sf_dir, "benchmark").join(e, "item_id").select(F.col("item_id").alias("query"), "text", "vector")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _index(spark: SparkSession, sf_dir: str, paired: bool = False) -> postings.PostingIndex:
    """The posting index of the chunks, built at the first query of an application over these very files and kept in its checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir, paired, *[stamp(spark, f"{sf_dir}/{name}.parquet") for name in ("documents", "embeddings")])
    if key not in _INDEXES:
        _INDEXES[key] = postings.posting_index((_paired if paired else _chunks)(spark, sf_dir))
    return _INDEXES[key]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.line_blocks(table(spark, sf_dir, "documents"))


# --- text and vectors


@query(f"SELECT doc_id, tok, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({_sql_tokens('text')}) AS tok FROM documents) GROUP BY doc_id, tok")
def tokenize_terms(spark, sf_dir):
    return retrieval.postings(_chunks(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "tok", "tf")


@query(f"WITH {_CHUNKS} SELECT doc_id, {_HASH} AS content_hash, 'par_' || md5(source || '|pNone|' || lower(source) || '|' || (doc_id % 7))[1:12] AS parent_id FROM chunks")
def content_hash(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("doc_id", T.content_hash(F.col("source"), F.col("page"), F.col("content")).alias("content_hash"), T.parent_id(F.col("source"), F.col("page"), F.lower("source"), F.col("doc_id") % 7).alias("parent_id"))


@query(
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos, round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS size, "
    "1.0::DOUBLE AS unit FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def vector_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("cos"), F.round(norm(F.col("embedding")), 6).alias("size"), F.round(norm(normalize(F.col("b"))), 6).alias("unit"))


@query(
    r"""WITH q AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(trim(string_split(text, chr(10))[1])), '\s+'), lambda w: length(w) > 2 AND NOT list_contains(["""
    + ", ".join(f"'{w}'" for w in T.UNMARKED)
    + r"""], w)) AS w FROM documents)
    SELECT doc_id, md5(CASE WHEN len(w) = 0 THEN text ELSE regexp_replace(text, '(?i)(' || array_to_string(list_transform(w, lambda x: regexp_replace(x, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')), '|') || ')', '<mark>\1</mark>', 'g') END) AS marked,
      md5(CASE WHEN len(string_split(text, chr(10))) > 3 OR length(text) > 300 THEN array_to_string(string_split(text, chr(10))[1:3], chr(10)) ELSE text END) AS preview,
      CASE WHEN length(text) % 101 > 65 THEN 'high' WHEN length(text) % 101 > 35 THEN 'medium' ELSE 'low' END AS band FROM q"""
)
def highlight_preview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    asked = F.element_at(F.split("text", "\n"), 1)
    digest = lambda c: F.md5(c.cast("binary"))
    return d.select("doc_id", digest(T.highlight(F.col("text"), asked)).alias("marked"), digest(T.preview(F.col("text"))).alias("preview"), T.relevance_band((F.length("text") % 101) / 100).alias("band"))


@query("SELECT page_id, url, string_split(rtrim(url, '/'), '/')[-1] AS filename FROM pages")
def url_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", T.filename_of(F.col("url")).alias("filename"))


@query("SELECT 'unknown' AS source, md5(text) AS content, 'text' AS type, '' AS heading, round(n_chars / 7.0::DOUBLE, 4) AS score, NULL::INTEGER AS page FROM documents")
def canonical_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("score", F.col("n_chars") / 7.0).withColumnRenamed("text", "content").drop("source")
    return canonical(d).select("source", F.md5(F.col("content").cast("binary")).alias("content"), "type", "heading", "score", "page")


# --- retrieval

_BM25 = f"""tokens AS (SELECT doc_id, unnest({_sql_tokens("content")}) AS tok FROM chunks
), tf AS (SELECT doc_id, tok, count(*) AS tf FROM tokens GROUP BY ALL
), dl AS (SELECT doc_id, len({_sql_tokens("content")}) AS dl FROM chunks
), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl
), raw AS (SELECT tok, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS w FROM tf, stats GROUP BY tok, n
), idf AS (SELECT tok, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM raw) ELSE w END AS idf FROM raw
), terms AS (SELECT query, tok, count(*) AS qf FROM (SELECT query, unnest({_sql_tokens("text")}) AS tok FROM questions) GROUP BY ALL
), scored AS (
  SELECT query, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN idf USING (tok) JOIN terms USING (tok) JOIN dl USING (doc_id), stats GROUP BY query, doc_id
), sparse AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= {{k}} AND score > 0
)"""


@query(f"WITH {_CHUNKS}, questions AS (SELECT item_id AS query, text FROM benchmark), {_BM25.replace("{k}", "20")} SELECT query, doc_id AS doc, round(score, 4) AS score, rank::INTEGER AS rank FROM sparse")
def bm25_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.search(_index(spark, sf_dir), q, 20).select("query", "doc", F.round("score", 4).alias("score"), "rank")


@query(f"""WITH {_CHUNKS}, tokens AS (SELECT doc_id, unnest({_sql_tokens("content")}) AS tok FROM chunks), df AS (SELECT tok, count(DISTINCT doc_id) AS df FROM tokens GROUP BY tok
), dl AS (SELECT doc_id, len({_sql_tokens("content")}) AS dl FROM chunks), stats AS (SELECT count(*) AS n, avg(dl) AS average FROM dl)
SELECT (SELECT n FROM stats) AS n, (SELECT round(average, 6) FROM stats) AS average, count(*)::BIGINT AS words, sum(df)::BIGINT AS postings, round(avg(ln((SELECT n FROM stats) - df + 0.5) - ln(df + 0.5)), 6) AS mean FROM df""")
def sparse_index(spark, sf_dir):
    """The index built anew: documents, average length, words, postings, and the words' mean raw weight."""
    i = postings.posting_index(_chunks(spark, sf_dir))
    numbers = [F.lit(i.n).cast("long").alias("n"), F.round(F.lit(i.average), 6).alias("average")]
    return postings.vocabulary(i).agg(F.count(F.lit(1)).alias("words"), F.sum("df").alias("postings")).select(*numbers, "words", "postings", F.round(F.lit(i.mean), 6).alias("mean"))


_KNN = """SELECT query, doc, round(score, 4) AS score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM (
    SELECT q.vec_id AS query, e.vec_id AS doc, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {where})) WHERE rank <= 20"""


def _embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


@query(_KNN.format(where="q.vec_id <> e.vec_id"))
def dense_topk(spark, sf_dir):
    return retrieval.knn(_embedded(spark, sf_dir), _vector_queries(spark, sf_dir), 20, keep_self=False).select("query", "doc", F.round("score", 4).alias("score"), "rank")


@query(_KNN.format(where="e.label = 1"))
def dense_topk_filtered(spark, sf_dir):
    return retrieval.knn(_embedded(spark, sf_dir), _vector_queries(spark, sf_dir), 20, F.col("label") == 1).select("query", "doc", F.round("score", 4).alias("score"), "rank")


_FUSED = f"""WITH RECURSIVE chunks AS (SELECT doc_id, source, {_TAILED} AS content, embedding, label FROM documents JOIN embeddings ON doc_id = vec_id
), questions AS (SELECT item_id AS query, text, embedding FROM benchmark JOIN embeddings ON item_id = vec_id
), {_BM25.replace("{k}", "60")}, dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (
    SELECT query, doc_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM questions q, chunks c WHERE {{pin}})) WHERE rank <= 60
), legs AS (
  SELECT query, doc_id, {_STRIPPED} AS key, rank, 0 AS leg FROM dense JOIN chunks USING (doc_id) UNION ALL SELECT query, doc_id, {_STRIPPED}, rank, 1 FROM sparse JOIN chunks USING (doc_id)
), fused AS (
  SELECT query, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, coalesce(arg_max(doc_id, rank) FILTER (WHERE leg = 0), arg_min(doc_id, rank) FILTER (WHERE leg = 1)) AS doc,
    min(rank) FILTER (WHERE leg = 0) AS dr, min(rank) FILTER (WHERE leg = 1) AS sr FROM legs GROUP BY query, key
)
SELECT query, doc, rrf_score, (row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST))::INTEGER AS rank FROM fused"""


def _fused(spark, sf_dir, pin=None):
    chunks, q = _paired(spark, sf_dir), _questions(spark, sf_dir)
    text = chunks.select(F.col("doc_id").alias("doc"), "content")
    s = Settings()
    dense, sparse = cut(retrieval.knn(chunks, q, s.fetch_k, pin)), retrieval.search(_index(spark, sf_dir, True), q, s.fetch_k)
    return retrieval.rrf(postings.found_rows(dense, text), postings.found_rows(sparse, text))


@query(_FUSED.replace("{pin}", "true"))
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query", "doc", "rrf_score", "rank")


@query(_FUSED.replace("{pin}", "c.source = 'src1'"))
def rrf_pinned(spark, sf_dir):
    return _fused(spark, sf_dir, F.col("source") == "src1").select("query", "doc", "rrf_score", "rank")


def _greedy(rows: str, k: int, bar: float) -> str:
    """SQL of the diversity rule over ``rows`` (query, doc, v, rank): one step a row, the list of taken rows as state."""
    return f"""walk AS (
  SELECT DISTINCT query, 0::BIGINT AS n, []::STRUCT(d BIGINT, v DOUBLE[])[] AS taken FROM {rows}
  UNION ALL
  SELECT w.query, w.n + 1, CASE WHEN len(taken) < {k} AND len(list_filter(taken, lambda t: list_cosine_similarity(t.v, r.v) >= {bar})) = 0 THEN list_append(taken, struct_pack(d := r.doc, v := r.v)) ELSE taken END
  FROM walk w JOIN {rows} r ON r.query = w.query AND r.rank = w.n + 1
), ends AS (SELECT query, arg_max(taken, n) AS taken FROM walk GROUP BY query
), every AS (SELECT query, list(doc ORDER BY rank) AS docs FROM {rows} GROUP BY query
), picked AS (
  SELECT query, CASE WHEN len(docs) <= {k} THEN docs ELSE list_concat(list_transform(taken, lambda t: t.d), list_filter(docs, lambda d: NOT list_contains(list_transform(taken, lambda t: t.d), d)))[1:{k}] END AS docs
  FROM ends JOIN every USING (query)
), chosen AS (SELECT query, docs[i] AS doc, i::INTEGER AS rank FROM (SELECT query, docs, unnest(range(1, len(docs) + 1)) AS i FROM picked))"""


_HYBRID = (
    _FUSED.replace("{pin}", "true").rsplit("\nSELECT query, doc, rrf_score", 1)[0]
    + """, listed AS (SELECT query, doc, rrf_score, row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM fused
), candidates AS (SELECT query, doc, rank, embedding::DOUBLE[] AS v FROM listed JOIN embeddings ON doc = vec_id
), """
    + _greedy("candidates", 20, 0.7)
    + " SELECT c.query, c.doc, l.rrf_score, c.rank FROM chosen c JOIN listed l ON c.query = l.query AND c.doc = l.doc"
)


@query(_HYBRID)
def hybrid_retrieve(spark, sf_dir):
    return retrieval.hybrid(_paired(spark, sf_dir), _questions(spark, sf_dir), index=_index(spark, sf_dir, True))


@query(
    "WITH RECURSIVE candidates AS (SELECT query, doc, rank, embedding::DOUBLE[] AS v FROM (" + _KNN.replace("{where}", "true").replace("rank <= 20", "rank <= 60") + ") JOIN embeddings ON doc = vec_id), "
    + _greedy("candidates", 20, 0.2)
    + " SELECT query, doc, rank FROM chosen"
)
def mmr_select(spark, sf_dir):
    e = _embedded(spark, sf_dir)
    near = retrieval.knn(e, _vector_queries(spark, sf_dir), 60).join(e.select(F.col("doc_id").alias("doc"), "vector"), "doc")
    return retrieval.diversify(near.withColumn("content", F.col("doc").cast("string")), 20, 0.2)


@query(_KNN.format(where="true"))
def dense_cells(spark, sf_dir):
    """The cell index with every cell probed: the exact lists."""
    found = cells.cell_knn(cells.cell_index(_embedded(spark, sf_dir)), _vector_queries(spark, sf_dir), 20, cells.MOST)
    return found.select("query", "doc", F.round("score", 4).alias("score"), "rank")


@query()
def dense_approximate(spark, sf_dir):
    """The cell index with the default number of probes; tests hold its recall against the exact lists."""
    return cells.cell_knn(cells.cell_index(_embedded(spark, sf_dir)), _vector_queries(spark, sf_dir), 20, keep_self=False)


#: What the ingest query embeds texts by: how often each of these letters stands in them.
_LETTERS = "aeinorst"


def _letters(text: Column) -> Column:
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("float") for c in _LETTERS], F.lit(1.0).cast("float"))


_INGESTED = (
    f"""WITH RECURSIVE first AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text
), files AS (SELECT id::VARCHAR AS source, {_sql_stripped("text")} AS content FROM first WHERE {_sql_stripped("text")} <> ''
), chunks AS (
  SELECT md5(source || '|None|par_' || md5(source || '|pNone||100000')[1:12] || '|0|' || content) AS doc_id, source, content,
    [{", ".join(f"length(content) - length(replace(content, '{c}', ''))" for c in _LETTERS)}, 1]::DOUBLE[] AS embedding FROM files
), questions AS (SELECT item_id AS query, text, [{", ".join(f"length(trim(text)) - length(replace(trim(text), '{c}', ''))" for c in _LETTERS)}, 1]::DOUBLE[] AS embedding FROM benchmark
), """
    + _HYBRID.split("\n), ", 2)[2].replace("BIGINT, v DOUBLE[]", "VARCHAR, v DOUBLE[]").replace("JOIN embeddings ON doc = vec_id", "JOIN chunks ON doc = doc_id").replace("{pin}", "true")
    + " JOIN chunks x ON x.doc_id = c.doc"
).replace("SELECT c.query, c.doc, l.rrf_score, c.rank", "SELECT c.query, c.doc, x.source, l.rrf_score, c.rank")


@query(_INGESTED)
def ingest_retrieve(spark, sf_dir):
    """Documents as files of one table block each, ingested into a new knowledge base, then hybrid retrieval from what it stored."""
    d = table(spark, sf_dir, "documents")
    source = F.col("doc_id").cast("string")
    files = d.select(F.col("doc_id").alias("seq"), source.alias("source"), F.col("text").alias("content"))
    parts = d.select(source.alias("source"), F.lit(0).cast("long").alias("block_seq"), F.lit("table").alias("type"), F.lit(None).cast("int").alias("page"), F.lit("").alias("heading"), F.lit("").alias("section_path"), F.col("text").alias("content"))
    kb = ingest.knowledge_base(spark, new_folder(spark, "kb"), _letters)
    kb.ingest(files, parts)
    chunks = kb.chunks.read()
    found = retrieval.hybrid(chunks, ingest.embed_questions(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), _letters, ""), index=kb.sparse.index(), id_col="point_id")
    return found.join(chunks.select(F.col("point_id").alias("doc"), "source"), "doc").select("query", "doc", "source", "rrf_score", "rank")


def _hits(spark, sf_dir):
    """BM25 hits as result rows; documents of the same source and language share a parent, whose text every fourth lacks."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"), "text")
    found = retrieval.search(_index(spark, sf_dir), q.select("query", "text"), 20)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", F.col("text").alias("content"), F.concat_ws("-", "source", "lang").alias("parent_id"))
    parent = F.when(F.col("doc") % 4 == 0, "").otherwise(F.concat(F.lit("parent of "), "source", F.lit(": "), "content"))
    hits = postings.found_rows(found, d).withColumn("parent_content", parent)
    more = {"page": (F.col("doc") % 5).cast("int"), "section_path": F.lit(""), "heading": F.col("parent_id"), "type": F.lit("text")}
    return hits.join(q.select("query", "query_text"), "query").withColumns(more)


_HITS = f"""WITH {_CHUNKS}, questions AS (SELECT item_id AS query, text FROM benchmark), {_BM25.replace("{k}", "20")}, hits AS (
  SELECT query, q.text AS query_text, s.doc_id AS doc, score, rank, d.source, d.text AS content, d.source || '-' || d.lang AS parent_id, CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'parent of ' || d.source || ': ' || d.text END AS parent_content,
    CASE WHEN d.doc_id % 4 = 0 THEN d.text ELSE 'parent of ' || d.source || ': ' || d.text END AS best, d.doc_id % 5 AS page
  FROM sparse s JOIN documents d ON s.doc_id = d.doc_id JOIN questions q USING (query))"""
_OVERLAP = f"CASE WHEN len(list_distinct({_sql_tokens('query_text')})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({_sql_tokens('query_text')}), {_sql_tokens('{text}')}))::DOUBLE / len(list_distinct({_sql_tokens('query_text')})) END"


def _over(text: str) -> str:
    return "round(" + _OVERLAP.replace("{text}", text) + ", 4)"


@query(_HITS + f", s AS (SELECT query, doc, {_over('best')} AS rerank_score, rank AS r FROM hits) SELECT query, doc, rerank_score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC, r))::INTEGER AS rank FROM s) WHERE rank <= 5")
def rerank(spark, sf_dir):
    return retrieval.rerank(_hits(spark, sf_dir), 5).select("query", "doc", "rerank_score", "rank")


@query(_HITS + " SELECT query, doc, md5(best) AS content, (row_number() OVER (PARTITION BY query ORDER BY rank))::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, parent_id, parent_content <> '' ORDER BY rank) AS c FROM hits) WHERE c = 1 OR parent_content = ''")
def parent_expand(spark, sf_dir):
    return retrieval.expand_parents(_hits(spark, sf_dir)).select("query", "doc", F.md5(F.col("content").cast("binary")).alias("content"), "rank")


@query(
    "WITH near AS (" + _KNN.format(where="e.vec_id IN (SELECT doc_id FROM documents)") + """), hits AS (
  SELECT n.*, d.source || '-' || d.lang AS parent_id, d.doc_id % 4 <> 0 AS has, CASE WHEN d.doc_id % 4 = 0 THEN d.text ELSE 'parent of ' || d.source || ': ' || d.text END AS best FROM near n JOIN documents d ON n.doc = d.doc_id)
SELECT query, doc, md5(best) AS content, (row_number() OVER (PARTITION BY query ORDER BY rank))::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, has, parent_id ORDER BY rank) AS c FROM hits) WHERE c = 1 OR NOT has"""
)
def dense_parents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.concat_ws("-", "source", "lang").alias("parent_id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("parent of "), "source", F.lit(": "), "text")).alias("parent_content"))
    found = retrieval.dense_with_parents(_embedded(spark, sf_dir).join(d, "doc_id"), _vector_queries(spark, sf_dir), 20)
    return found.select("query", "doc", F.md5(F.col("content").cast("binary")).alias("content"), "rank")


@query("SELECT doc_id AS query FROM documents WHERE length(text) BETWEEN 1 AND 2000")
def asked_questions(spark, sf_dir):
    """Documents as questions: those of an answerable length."""
    return retrieval.asked(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query"), "text")).select("query")


@query(_HITS + f", s AS (SELECT query, doc, rank, {_over('best')} AS score FROM hits), b AS (SELECT *, first_value(score) OVER (PARTITION BY query ORDER BY rank) AS best_score FROM s) SELECT query, doc, best_score FROM b WHERE best_score >= 0.5")
def weak_context_gate(spark, sf_dir):
    rows = _hits(spark, sf_dir).withColumn("score", F.round(retrieval.lexical_overlap(F.col("query_text"), T.or_else(F.col("parent_content"), F.col("content"))), 4))
    return retrieval.gate(rows, 0.5).select("query", "doc", "best_score")


_BLOCK = f"'[Source: ' || source || ' | Page: ' || page || ' | Section: ' || parent_id || ']' || chr(10) || {_STRIPPED}"
_ANSWER = (
    _HITS
    + f""", first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score1 DESC, rank) AS rank1 FROM (SELECT *, {_over("best")} AS score1 FROM hits)) WHERE rank1 <= 5
), expanded AS (
  SELECT * REPLACE (best AS content), row_number() OVER (PARTITION BY query ORDER BY rank1) AS rank2 FROM (SELECT *, row_number() OVER (PARTITION BY query, parent_id, parent_content <> '' ORDER BY rank1) AS c FROM first) WHERE c = 1 OR parent_content = ''
), second AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score1 DESC, rank2) AS rank3 FROM expanded
), gated AS (SELECT *, max(score1) OVER (PARTITION BY query) AS top, bool_or({_STRIPPED} <> '') OVER (PARTITION BY query) AS has_text FROM second WHERE rank3 <= 5
), blocks AS (SELECT query, query_text, rank3, {_BLOCK} AS block FROM gated WHERE top >= 0.1 AND has_text
), budget AS (SELECT *, sum(length(block)) OVER (PARTITION BY query ORDER BY rank3) AS used FROM blocks
) SELECT query, 'Context:' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY rank3) || chr(10) || chr(10) || 'Question: ' || any_value(query_text) AS prompt FROM budget WHERE used <= 6000 GROUP BY query"""
)


@query(_ANSWER)
def answer_context(spark, sf_dir):
    """Rerank, expand, rerank, gate, budget: the context and prompt of each question."""
    rows = retrieval.gate(retrieval.online(_hits(spark, sf_dir)))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return context.context(rows).join(asked, "query").select("query", context.prompt(F.col("context"), F.col("text")).alias("prompt"))


@query(_HITS + " SELECT query, doc, rank::INTEGER AS rank FROM hits WHERE rank <= 3")
def answer_offline(spark, sf_dir):
    """Without a model and with reranking off: the first hits as they are."""
    return retrieval.offline(_hits(spark, sf_dir), k=3).select("query", "doc", "rank")


@query(_HITS + ", b AS (SELECT query, doc, rank, " + _BLOCK + " AS block FROM hits), u AS (SELECT query, doc, rank, sum(length(block)) OVER (PARTITION BY query ORDER BY rank) AS used FROM b) SELECT query, doc, used::BIGINT AS used FROM u WHERE used <= 6000")
def context_budget(spark, sf_dir):
    return context.budgeted(_hits(spark, sf_dir)).select("query", "doc", "used")


@query(_HITS + " SELECT query, doc, source, page FROM (SELECT *, row_number() OVER (PARTITION BY query, source, page ORDER BY rank) AS c FROM hits) WHERE c = 1")
def citations_by_page(spark, sf_dir):
    return context.citations(_hits(spark, sf_dir), context.page_key()).select("query", "doc", "source", "page")


@query(_HITS + " SELECT query, doc, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY query, parent_id ORDER BY rank) AS c FROM hits) WHERE c = 1")
def citations_by_parent(spark, sf_dir):
    return context.citations(_hits(spark, sf_dir), context.parent_key()).select("query", "doc", "parent_id")


@query(_HITS + " SELECT query, rank::INTEGER AS rank, md5(best) AS content, source, page::INTEGER AS page, 'text' AS chunk_type, round(score, 4) AS score FROM hits")
def offline_view(spark, sf_dir):
    return context.offline_view(_hits(spark, sf_dir)).withColumn("content", F.md5(F.col("content").cast("binary")))


@query(_HITS + """, c AS (SELECT *, row_number() OVER (PARTITION BY query, parent_id ORDER BY rank) AS n FROM hits), l AS (SELECT query, rank, source || ', p.' || page || ' [' || parent_id || ']' AS line FROM c WHERE n = 1
), k AS (SELECT query, rank, '  [' || row_number() OVER (PARTITION BY query ORDER BY rank) || '] ' || line AS line FROM l) SELECT query, 'Sources:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS citations FROM k GROUP BY query""")
def citation_lists(spark, sf_dir):
    return context.format_citations(context.citation_rows(_hits(spark, sf_dir)))


@query(_HITS + ", c AS (SELECT *, row_number() OVER (PARTITION BY query, source, page ORDER BY rank) AS n FROM hits) SELECT query, rank::INTEGER AS rank, source, page::INTEGER AS page, '◈' AS icon, CASE WHEN length(parent_id) > 22 THEN parent_id[1:22] || '…' ELSE parent_id END AS section FROM c WHERE n = 1")
def citation_marks(spark, sf_dir):
    return context.citation_marks(_hits(spark, sf_dir))


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY " + _sql_stripped(_TAILED))
def content_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.stripped(_tailed(F.col("text"))).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("key")


# --- blocks and chunks


@query(f"WITH {_LINES}, s AS (SELECT *, CASE WHEN type = 'heading' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS starts FROM typed WINDOW w AS (PARTITION BY source ORDER BY block_seq)) SELECT source, block_seq::BIGINT AS block_seq, type, (sum(starts) OVER (PARTITION BY source ORDER BY block_seq) - 1)::BIGINT AS grp FROM s")
def section_groups(spark, sf_dir):
    b = _lines(spark, sf_dir).withColumn("section_path", F.lit(""))
    return chunking.section_groups(b).select("source", "block_seq", "type", "grp")


@query(f"""WITH RECURSIVE {_LINES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY block_seq) AS n FROM typed
), walk AS (
  SELECT source, block_seq, n, CASE WHEN level IS NULL THEN [] ELSE [struct_pack(l := level, c := content)] END AS open FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.source, b.block_seq, b.n, CASE WHEN b.level IS NULL THEN w.open ELSE list_append(list_filter(w.open, lambda x: x.l < b.level), struct_pack(l := b.level, c := b.content)) END
  FROM walk w JOIN numbered b ON b.source = w.source AND b.n = w.n + 1
) SELECT source, block_seq::BIGINT AS block_seq, array_to_string(list_transform(open, lambda x: x.c), ' > ') AS path FROM walk""")
def breadcrumbs(spark, sf_dir):
    return chunking.heading_paths(_lines(spark, sf_dir)).select("source", "block_seq", "path")


def _spans(spark, sf_dir) -> DataFrame:
    """Lines of documents as printed text: five to a page, each a block of one span whose font follows its length."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    n = F.length("text")
    size = F.when(n < 20, 20.0).when(n < 60, 15.0).when(n < 200, 12.0).otherwise(10.0)
    box = {"x0": F.lit(10.0), "y0": (F.col("k") % 5) * 12.0, "x1": 10 + n * 5.125, "y1": (F.col("k") % 5) * 12.0 + 10}
    return lines.withColumns({"page": F.floor(F.col("k") / 5).cast("int") + 1, "block": F.col("k"), "line": F.lit(0), "span": F.lit(0), "size": size, **box})


@query(rf"""WITH RECURSIVE spans AS (
  SELECT source, i - 1 AS block_seq, (i - 1) // 5 + 1 AS page, t AS text, ((i - 1) % 5) * 12.0::DOUBLE AS y0, 10 + length(t) * 5.125::DOUBLE AS x1, CASE WHEN length(t) < 20 THEN 20.0 WHEN length(t) < 60 THEN 15.0 WHEN length(t) < 200 THEN 12.0 ELSE 10.0 END::DOUBLE AS size
  FROM (SELECT doc_id::VARCHAR AS source, i, string_split(text, chr(10))[i] AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE {_sql_stripped("t")} <> ''
), body AS (SELECT source, page, list_sort(list(size))[count(*) // 2 + 1] AS body FROM spans GROUP BY source, page
), typed AS (
  SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY block_seq) AS n, {_sql_stripped("text")} AS content, y0, round(x1, 2) AS x1, size >= 1.15 * body AND length({_sql_stripped("text")}) < 200 AS head,
    CASE WHEN size >= 1.8 * body THEN 1 WHEN size >= 1.4 * body THEN 2 ELSE 3 END AS level FROM spans JOIN body USING (source, page)
), walk AS (
  SELECT source, page, n, head, y0, x1, CASE WHEN head THEN [struct_pack(l := level, c := content)] ELSE [] END AS open FROM typed WHERE n = 1
  UNION ALL
  SELECT b.source, b.page, b.n, b.head, b.y0, b.x1, CASE WHEN b.head THEN list_append(list_filter(w.open, lambda x: x.l < b.level), struct_pack(l := b.level, c := b.content)) ELSE w.open END FROM walk w JOIN typed b ON b.source = w.source AND b.n = w.n + 1
) SELECT source, n - 1 AS block_seq, page::INTEGER AS page, head, md5(array_to_string(list_transform(open, lambda x: x.c), ' > ')) AS section_path, md5(CASE WHEN len(open) > 0 THEN open[-1].c ELSE '' END) AS heading, y0, x1, 595.28::DOUBLE AS page_width FROM walk""")
def span_geometry(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    sizes = spans.select("source", "page", F.lit(595.2756).alias("width"), F.lit(841.8898).alias("height")).distinct()
    text = {c: F.md5(F.col(c).cast("binary")) for c in ("section_path", "heading")}
    return blocks.span_blocks(spans, sizes).withColumns(text).select("source", "block_seq", "page", (F.col("type") == "heading").alias("head"), "section_path", "heading", F.col("bbox")[1].alias("y0"), F.col("bbox")[2].alias("x1"), "page_width")


@query(f"WITH {_LINES} SELECT type, count(*)::BIGINT AS n FROM typed GROUP BY type")
def block_types(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _plain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit("text").alias("type"))


@query()
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_documents(_plain(spark, sf_dir), "fixed_size")


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.chunk_documents(_plain(spark, sf_dir), "recursive")


@query()
def chunk_hierarchical(spark, sf_dir):
    b = _lines(spark, sf_dir).withColumns({"section_path": F.lit(""), "heading": F.lit("")})
    return chunking.chunk_hierarchical(b)


@query()
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunk_recursive(spark, sf_dir))


@query()
def html_blocks(spark, sf_dir):
    return blocks.html_blocks(table(spark, sf_dir, "pages"))


# --- store, sync, export


@query("SELECT source FROM documents WHERE source <> '' GROUP BY source")
def list_sources(spark, sf_dir):
    return store.list_sources(_chunks(spark, sf_dir))


@query("SELECT count(*)::BIGINT AS total_chunks, count(DISTINCT source)::BIGINT AS total_sources FROM documents")
def store_stats(spark, sf_dir):
    return store.stats(_chunks(spark, sf_dir))


@query("SELECT source, lang AS type, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def type_histogram(spark, sf_dir):
    return store.type_histogram(table(spark, sf_dir, "documents").withColumn("type", F.col("lang")))


@query("SELECT source, md5(string_agg(md5(text), '|' ORDER BY md5(text))) AS hash FROM documents GROUP BY source")
def source_fingerprint(spark, sf_dir):
    return store.source_fingerprints(_chunks(spark, sf_dir))


@query("SELECT md5(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id::VARCHAR)) AS etag, count(*)::BIGINT AS n FROM embeddings")
def export_etag(spark, sf_dir):
    return store.etag(table(spark, sf_dir, "embeddings"), "vec_id")


@query("""WITH server AS (SELECT source, md5(string_agg(md5(text), '|' ORDER BY md5(text))) AS h FROM documents WHERE source <> 'src3' GROUP BY source
), client AS (SELECT source, md5(string_agg(md5(text), '|' ORDER BY md5(text))) AS h FROM documents WHERE source <> 'src5' AND NOT (source = 'src7' AND lang = 'en') GROUP BY source)
SELECT source, CASE WHEN s.h IS NULL THEN 'to_delete' WHEN c.h IS NULL OR c.h <> s.h THEN 'to_add' ELSE 'unchanged' END AS action FROM client c FULL JOIN server s USING (source)""")
def kb_diff(spark, sf_dir):
    c = table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    client = c.where("source <> 'src5' and not (source = 'src7' and lang = 'en')")
    return sync.client_diff(store.source_fingerprints(client), store.source_fingerprints(c.where("source <> 'src3'")))


_PAGE = f"""WITH page AS (SELECT doc_id AS ord, source, text AS content, CASE WHEN doc_id % 3 = 0 THEN 'parent of ' || text ELSE '' END AS parent_content FROM documents ORDER BY doc_id LIMIT 300 OFFSET 100
), h AS (SELECT *, {_HASH} AS id FROM page), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS c FROM h
), v AS (SELECT id, max(vec_id) AS embedding FROM (SELECT md5(source || '|None|' || text[1:80]) AS id, vec_id FROM documents JOIN embeddings ON doc_id = vec_id) GROUP BY id
), exported AS (SELECT ord, id, source, md5(content) AS content, md5(CASE WHEN parent_content <> '' THEN parent_content ELSE content END) AS parent_content, embedding FROM f LEFT JOIN v USING (id) WHERE c = 1)"""


def _export_vectors(spark, sf_dir):
    """Of the vectors, their ids stand for them here."""
    return sync.export_vectors(_paired(spark, sf_dir, tail=False).withColumn("vector", F.col("doc_id")), key="doc_id")


def _page(spark, sf_dir):
    parent = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("parent of "), "content")).otherwise("")
    c = _chunks(spark, sf_dir).withColumn("parent_content", parent)
    rows = canonical(c, "doc_id").withColumnRenamed("doc_id", "ord")
    return sync.export_page(sync.page_index(rows), _export_vectors(spark, sf_dir), 100, 300)


@query(_PAGE + " SELECT *, '' AS parent_id, 'text' AS chunk_type FROM exported")
def export_page(spark, sf_dir):
    digest = {c: F.md5(F.col(c).cast("binary")) for c in ("content", "parent_content")}
    return _page(spark, sf_dir).withColumns(digest).select("ord", "id", "source", "content", "parent_content", "embedding", "parent_id", "chunk_type")


@query(_PAGE + " SELECT count(*)::BIGINT AS chunks, count(embedding)::BIGINT AS matched FROM exported")
def export_matched(spark, sf_dir):
    return sync.matched(_page(spark, sf_dir))


@query("""WITH a AS (SELECT DISTINCT md5(source || '|None|' || text[1:80]) AS k FROM documents), b AS (SELECT DISTINCT md5(source || '|None|' || text[1:80]) AS k FROM documents JOIN embeddings ON doc_id = vec_id)
SELECT (SELECT count(*) FROM documents)::BIGINT AS chunks, (SELECT count(*) FROM b)::BIGINT AS vectors, (SELECT count(*) FROM a JOIN b USING (k))::BIGINT AS overlap""")
def key_overlap(spark, sf_dir):
    return sync.key_overlap(_chunks(spark, sf_dir), _export_vectors(spark, sf_dir))


def _sheet(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as printed pages of 40 rows: ruling lines, and words with their boxes."""
    place = {"page": F.floor(F.col("p_partkey") / 40) + 1, "row": F.col("p_partkey") % 40 + 1, "source": F.lit("part")}
    rows = table(spark, sf_dir, "part").withColumns(place).select("source", "page", "row", F.array("p_name", "p_brand", F.col("p_size").cast("string")).alias("cells"))
    head = rows.select("source", "page").distinct().select("*", F.lit(0).cast("long").alias("row"), F.array(*map(F.lit, ("name", "brand", "size"))).alias("cells"))
    every = rows.unionByName(head)
    y = F.col("row") * 20.0
    box = lambda *c: [v.cast("double").alias(n) for v, n in zip(c, ("x0", "y0", "x1", "y1"), strict=True)]
    flat = every.select("source", "page", F.explode(F.array(y, y + 20)).alias("y")).select("source", "page", *box(F.lit(0), F.col("y"), F.lit(450), F.col("y")))
    up = every.select("source", "page", y.alias("y"), F.explode(F.array(*[F.lit(150 * k) for k in range(4)])).alias("x")).select("source", "page", *box(F.col("x"), F.col("y"), F.col("x"), F.col("y") + 20))
    words = every.select("source", "page", y.alias("y"), F.posexplode("cells").alias("column", "cell")).select("source", "page", "y", "column", F.posexplode(F.split("cell", " ")).alias("k", "text"))
    x = F.col("column") * 150.0 + 4 + F.col("k") * 40
    return flat.unionByName(up), words.select("source", "page", x.alias("x0"), (F.col("y") + 5).alias("top"), (x + 30).alias("x1"), (F.col("y") + 15).alias("bottom"), "text")


@query("""SELECT 'part' AS source, p_partkey // 40 + 1 AS page, 1 AS number, 450.0::DOUBLE AS wide, 20.0::DOUBLE * (max(p_partkey % 40) + 2) AS foot,
  '[TABLE 1 — Page ' || (p_partkey // 40 + 1) || ']' || chr(10) || '| name | brand | size |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS content
  FROM part GROUP BY p_partkey // 40""")
def ruled_tables(spark, sf_dir):
    return ruled.ruled_tables(*_sheet(spark, sf_dir)).select("source", "page", F.col("table").alias("number"), F.col("bbox")[2].alias("wide"), F.col("bbox")[3].alias("foot"), "content")


def _stores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "point_id")
    return e.where("label <> 2"), e.where("label <> 1")


@query("SELECT vec_id AS point_id, CASE WHEN label = 1 THEN 'pull' ELSE 'delete' END AS action FROM embeddings WHERE label IN (1, 2)")
def sync_plan(spark, sf_dir):
    return sync.plan(*_stores(spark, sf_dir))


@query(_SQL["sync_plan"])
def sync_plan_tree(spark, sf_dir):
    return keytree.plan(*[keytree.KeyTree(spark, new_folder(spark, "tree")).take(s) for s in _stores(spark, sf_dir)])


@query("SELECT vec_id AS point_id, label FROM embeddings WHERE label <> 2")
def sync_apply(spark, sf_dir):
    return sync.apply(*_stores(spark, sf_dir)).select("point_id", "label")


@query("SELECT count(*)::BIGINT AS pending_count FROM embeddings WHERE label = 1")
def pending_count(spark, sf_dir):
    return sync.pending(*_stores(spark, sf_dir))


def _changed_store(spark, sf_dir) -> store.ChunkStore:
    """Documents in a store: all come, a source goes, every tenth is replaced, every seventh goes by its id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("point_id"), "source", F.col("lang").alias("type"), F.lit(0).alias("v"), "doc_id")
    s = store.ChunkStore(spark, new_folder(spark, "store"), d.drop("doc_id").schema)
    s.upsert(d.drop("doc_id"))
    s.delete_by_source("src2")
    s.upsert(d.where("doc_id % 10 = 3").drop("doc_id").withColumns({"v": F.lit(1), "type": F.lit("new")}))
    s.delete_by_ids(d.where("doc_id % 7 = 0").select("point_id"))
    return s


_CHANGED = "changed AS (SELECT doc_id::VARCHAR AS point_id, source, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE lang END AS type, (doc_id % 10 = 3)::INTEGER AS v FROM documents WHERE (source <> 'src2' OR doc_id % 10 = 3) AND doc_id % 7 <> 0)"


@query(f"WITH {_CHANGED} SELECT point_id, source, type, v FROM changed")
def store_after_changes(spark, sf_dir):
    return _changed_store(spark, sf_dir).read()


@query(f"WITH {_CHANGED} SELECT source, type, count(*)::BIGINT AS n FROM changed GROUP BY ALL")
def store_kept_counts(spark, sf_dir):
    """Counts from the changes' own signed counts; no row of the store is read for them."""
    return _changed_store(spark, sf_dir).histogram()


@query(f"WITH {_CHANGED} SELECT point_id, v FROM changed WHERE source = 'src3'")
def store_by_source(spark, sf_dir):
    """One source's rows, from the files that may hold it."""
    return _changed_store(spark, sf_dir).read(sources=["src3"]).select("point_id", "v")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src2'")
def delete_by_source(spark, sf_dir):
    return store.without_source(_chunks(spark, sf_dir), "src2").select("doc_id", "source")


@query("SELECT vec_id AS point_id, CASE WHEN label = 3 THEN -1 ELSE label END AS label FROM embeddings")
def upsert_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    return store.upsert(e, e.where("label = 3").withColumn("label", F.lit(-1)))


@query("SELECT vec_id AS point_id FROM embeddings WHERE label <> 4")
def delete_by_ids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    return store.without_ids(e, e.where("label = 4")).select("point_id")


@query("SELECT doc_id AS seq, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_seq, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents")
def batch_file_dedup(spark, sf_dir):
    return store.batch_files(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content")))


@query("SELECT regexp_extract(url, '^[^?#]*') AS url, arg_min(CASE WHEN page_id % 3 = 0 THEN 'file' || page_id ELSE string_split(rtrim(regexp_extract(url, '^[^?#]*'), '/'), '/')[-1] END, page_id) AS filename FROM pages GROUP BY 1")
def url_filename_map(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit(" "), F.regexp_extract("url", "^[^?#]*", 0), F.lit("\n ")).alias("source_url"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" file"), F.col("page_id").cast("string"))).otherwise(" ").alias("source"), F.col("page_id").alias("ord"))
    return sync.url_filenames(p)


@query("SELECT event_id, user_id, event_type, value FROM events")
def event_log(spark, sf_dir):
    """Events written as a log of server events, and read back by a stream that runs until it has caught up."""
    events.register(spark)
    log, out, state = (new_folder(spark, name) for name in ("event-log", "event-rows", "event-state"))
    line = F.concat(F.lit("data: "), F.to_json(F.struct("event_id", "user_id", "event_type", "value")))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(log)
    parsed = blocks.server_events(spark.readStream.format("event_lines").load(log), "event_id long, user_id long, event_type string, value double")
    run = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(parsed.schema).parquet(out)


@query("SELECT DISTINCT source AS filename, 'http://files/' || source AS url FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'fr') AND source NOT IN ('src1', 'src4')")
def manifest_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    entries = d.select(F.col("source").alias("filename"), F.concat(F.lit("http://files/"), "source").alias("url")).distinct()
    disk = d.where("source in ('src1', 'src4')").select(F.col("source").alias("filename")).distinct()
    return sync.missing_files(d.where("lang = 'fr'").select("source"), entries, disk)


@query("""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN value > 50 THEN 'online' ELSE 'offline' END AS status FROM events
), b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) SELECT event_id, user_id, before, status FROM b WHERE before <> status""")
def transition_detect(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("value") > 50, "online").otherwise("offline").alias("status"))
    return sync.transitions(s, "user_id", "ts", "status", "event_id").select("event_id", "user_id", "before", "status")


# --- chat


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations), a AS (SELECT *, max(CASE WHEN role = 'user' THEN place END) OVER (PARTITION BY conv_id) AS asked FROM p)
SELECT conv_id, turn, role FROM a WHERE asked IS NULL OR place > asked - 4""")
def chat_window(spark, sf_dir):
    return context.chat_window(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


@query("""WITH n AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS replies, row_number() OVER w AS seen, array_to_string(list(upper(role) || ': ' || text[1:200]) OVER (PARTITION BY conv_id ORDER BY turn ROWS 3 PRECEDING), chr(10)) AS input
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, replies::BIGINT AS replies, input FROM n WHERE role = 'assistant' AND replies % 2 = 0 AND seen >= 4""")
def summary_trigger(spark, sf_dir):
    return context.summary_inputs(table(spark, sf_dir, "conversations"), 2)


@query("SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_turn(spark, sf_dir):
    return context.last_user_message(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, md5('system:be brief;' || string_agg(role || ':' || text, ';' ORDER BY turn)) AS digest, count(*)::INTEGER + 1 AS n FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    m = context.model_messages(table(spark, sf_dir, "conversations"), "be brief")
    joined = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), ";")
    return m.select("conv_id", F.md5(joined.cast("binary")).alias("digest"), F.size("messages").alias("n"))


# --- tables

_SUMMARY = " UNION ALL ".join(
    [f"SELECT count(*)::BIGINT AS rows, '{c}' AS \"column\", count_if({c} IS NULL)::BIGINT AS nulls, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean FROM part" for c in ("p_partkey", "p_size", "p_retailprice")]
    + [f"SELECT count(*)::BIGINT, '{c}', count_if({c} IS NULL)::BIGINT, NULL, NULL, NULL FROM part" for c in ("p_name", "p_brand", "p_type")]
)


@query(_SUMMARY)
def table_summary(spark, sf_dir):
    return tables.summary(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_name", "p_brand", "p_type"))


@query("SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || trim(n_name) || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def table_markdown(spark, sf_dir):
    return tables.markdown(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("SELECT r_regionkey AS row, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def table_json(spark, sf_dir):
    return tables.json_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")
