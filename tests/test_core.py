"""The retrieval engine on hand-made fixtures, properties, and its SQL equivalents."""

import os
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunking, context, ingest, retrieval, store, sync, tables
from sparkloom.plans import catalogue
from sparkloom.schema import Settings, canonical
from sparkloom.sources import blocks
from sparkloom.streaming import jobs


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    df = catalogue.queries()[name](spark, small)
    r = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(norm(x[c]) for c in columns) for x in df.collect()) == sorted(tuple(map(norm, x)) for x in r.fetchall())


def texts_of(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name, split", [("chunk_fixed", chunking.split_fixed), ("chunk_recursive", chunking.split_recursive)])
def test_chunk_queries_are_row_by_row(spark, small, name, split):
    rows = {(r["doc_id"], r["chunk_index"]): r for r in catalogue.queries()[name](spark, small).collect()}
    expected = {(d, k): c for d, t in texts_of(spark, small).items() for k, c in enumerate([x for x in split(t, 500, 50) if x.strip()] if t else [])}
    assert {k: r["content"] for k, r in rows.items()} == expected
    assert {r["strategy"] for r in rows.values()} == {"fixed_size" if name == "chunk_fixed" else "recursive"}
    sizes = {}
    for d, _ in expected:
        sizes[d] = sizes.get(d, 0) + 1
    assert all(r["total_chunks"] == sizes[d] for (d, _), r in rows.items())


def test_chunk_stats_query(spark, small):
    n = [len(c) for t in texts_of(spark, small).values() if t for c in chunking.split_recursive(t, 500, 50) if c.strip()]
    assert tuple(catalogue.queries()["chunk_stats"](spark, small).first()) == (len(n), round(sum(n) / len(n)), min(n), max(n))


def test_hierarchical_query_is_row_by_row(spark, small):
    """Sections start at short lines, as line_blocks has it; parents and children by the splitter in plain Python."""
    expected = {}
    for d, t in texts_of(spark, small).items():
        groups = []
        for line in (t or "").split("\n"):
            if line.strip(" "):
                if not groups or len(line) < 40:
                    groups.append([])
                groups[-1].append(line)
        for lines in groups:
            for parent in chunking.split_recursive("\n\n".join(lines), 1500, 100):
                parts = chunking.split_recursive(parent, 512, 80)
                for k, child in enumerate(parts):
                    if child.strip():
                        key = (str(d), parent, k, len(parts), child)
                        expected[key] = expected.get(key, 0) + 1
    got = {}
    for r in catalogue.queries()["chunk_hierarchical"](spark, small).collect():
        key = (r["source"], r["parent_content"], r["chunk_index"], r["total_chunks"], r["content"])
        got[key] = got.get(key, 0) + 1
    assert got == expected


def test_html_blocks_query_is_row_by_row(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    expected = sorted((r["url"], k, *b) for r in pages for k, b in enumerate(blocks.html_block_list(r["html"])))
    key = lambda x: tuple(map(str, x))
    got = [(r["source"], r["block_seq"], r["type"], r["level"], r["content"]) for r in catalogue.queries()["html_blocks"](spark, small).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_tokenizer(spark):
    row = spark.range(1).select(T.tokens(F.lit("The engine cooling-water temperature must be 60°C!")).alias("t"), T.tokens(F.lit("")).alias("e")).first()
    assert row["t"] == ["engine", "cooling-water", "temperature", "60°c"] and row["e"] == []
    assert len(set(T.STOPWORDS)) == 126
    df = spark.createDataFrame([("b a b c a b",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.counted(F.filter(F.split("t", " "), lambda x: x != ""))).collect()] == [[("a", 2), ("b", 3), ("c", 1)], [], []]


def test_small_functions(spark):
    df = spark.createDataFrame([("Report.PDF", [1.0, 2.5, 11.0, 22.5], "  First line\nsecond  ", " why? ")], "name string, box array<double>, page string, q string")
    r = df.select(
        T.bbox_json(F.col("box")), T.bbox_of(T.bbox_json(F.col("box"))), T.bbox_of(F.lit("{bad")), T.bbox_of(F.lit("")), T.canvas_box(F.col("box"), F.lit(100.0), F.lit(2.0)),
        T.image_label(F.lit(3), F.lit(1), F.col("page"), F.col("name")), T.image_label(F.lit(3), F.lit(2), F.lit(None).cast("string"), F.col("name")), T.image_url(F.lit("/a/b/c.png")),
        T.public_url("http://x", "docs", F.col("name")), T.file_icon(F.col("name")), T.chunk_icon(F.lit("table")), T.short_section(F.lit("x" * 30)), T.query_text(F.col("q")), T.breadcrumb(F.lit("A > B/ C")),
    ).first()
    assert list(r) == [
        "[1.0,2.5,11.0,22.5]", [1.0, 2.5, 11.0, 22.5], None, None, (2.0, 5.0, 20.0, 40.0), "[IMAGE — Page 3, Figure 1] Figure on this page. Page context: First line second",
        "[IMAGE — Page 3, Figure 2] Visual figure or diagram from Report.PDF", "/images/c.png", "http://x/storage/v1/object/public/docs/Report.PDF", "📄", "⊞", "x" * 22 + "…", T.QUERY_PREFIX + "why?", ["A", "B", "C"],
    ]


def test_rrf_repeats_add_up_and_dense_wins(spark):
    rows = lambda x: spark.createDataFrame(x, "query long, doc long, content string, rank int")
    fused = retrieval.rrf(rows([(1, 10, "same", 1), (1, 11, " same ", 2), (1, 12, "b", 3)]), rows([(1, 20, "same", 1), (1, 21, "c", 2)])).orderBy("rank").collect()
    assert [(r["doc"], r["rrf_score"]) for r in fused] == [(11, round(1 / 61 + 1 / 62 + 1 / 61, 6)), (21, round(1 / 62, 6)), (12, round(1 / 63, 6))]


def greedy(vectors, k, bar):
    if len(vectors) <= k:
        return list(range(len(vectors)))
    taken = []
    for i, v in enumerate(vectors):
        if len(taken) < k and all(v @ vectors[j] < bar for j in taken):
            taken.append(i)
    return (taken + [i for i in range(len(vectors)) if i not in taken])[:k]


def test_diversity_is_greedy_with_backfill(spark):
    rng = np.random.default_rng(1)
    data, expected = [], {}
    for q, n in enumerate((3, 8, 30, 40)):
        v = rng.normal(size=(n, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        data += [(q, i, f"c{i}", v[i].tolist(), i + 1) for i in range(n)]
        expected[q] = greedy(v, 8, 0.7)
    df = spark.createDataFrame(data, "query long, doc long, content string, vector array<double>, rank int")
    got = {q: [r["doc"] for r in retrieval.diversify(df, 8).where(f"query = {q}").orderBy("rank").collect()] for q in expected}
    assert got == expected


def test_empty_corpus_and_stopword_query(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, content string")
    q = spark.createDataFrame([(1, "the of and")], "query long, text string")
    assert retrieval.bm25(docs, q, 5).count() == 0 and retrieval.bm25(docs.limit(0), q, 5).count() == 0


def test_knn_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "doc_id long, vector array<double>")
    q = df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    got = {(r["query"], r["rank"]): r["doc"] for r in retrieval.knn(df.repartition(5), q, 3).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == {(i, r + 1): int(d) for i in range(0, 300, 20) for r, d in enumerate(np.argsort(-(unit[i] @ unit.T))[:3])}


def test_sections_break_on_heading_page_and_path(spark):
    b = spark.createDataFrame([("d", 0, "heading", "p", 1), ("d", 1, "text", "p", 1), ("d", 2, "text", "p", 2), ("d", 3, "text", "q", 2), ("d", 4, "text", "q", None)], "source string, block_seq long, type string, section_path string, page int")
    assert [r["grp"] for r in chunking.section_groups(b).orderBy("block_seq").collect()] == [0, 0, 1, 2, 3]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.,!?", max_size=300), st.integers(8, 40))
def test_recursive_splitter(text, size):
    parts = chunking.split_recursive(text, size, size // 4)
    assert all(p == p.strip() and 0 < len(p) <= size for p in parts)
    for word in re.findall("[ab]+", text):
        if len(word) <= size // 4:
            assert any(word in p for p in parts)


def test_fixed_splitter_keeps_long_lines_and_overlaps():
    lines = ["a" * 30, "b" * 30, "c" * 200, "d" * 30]
    assert chunking.split_fixed("\n".join(lines), 70, 35) == [f"{lines[0]}\n{lines[1]}", lines[2], lines[3]]
    assert chunking.split_fixed("\n".join(["x" * 10] * 5), 32, 10) == ["\n".join(["x" * 10] * 3)] * 2


def test_hierarchy(spark):
    b = spark.createDataFrame([("d", 0, "heading", 1, "Head", ""), ("d", 1, "text", 1, "word " * 500, ""), ("d", 2, "table", 1, "| a |", ""), ("d", 3, "image", 2, "  ", "")], "source string, block_seq long, type string, page int, content string, section_path string").withColumn("heading", F.lit(""))
    rows = chunking.chunk_hierarchical(b).collect()
    text = [r for r in rows if r["type"] != "table"]
    assert all(len(r["content"]) <= 512 and len(r["parent_content"]) <= 1500 and r["content"] in r["parent_content"] for r in text)
    assert [(r["content"], r["chunk_index"], r["total_chunks"]) for r in rows if r["type"] == "table"] == [("| a |", 0, 1)]
    assert len({r["parent_id"] for r in text}) == 3 and all(r["parent_id"].startswith("par_") for r in rows)


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, k + 1, "s", None, "", "", "x" * n) for k, n in enumerate((3000, 2900, 200, 20))], "query long, rank int, source string, page int, section_path string, heading string, content string")
    assert [r["rank"] for r in context.budgeted(rows).orderBy("rank").collect()] == [1, 2]


def test_store_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", "s1", 1), ("b", "s2", 2), ("c", None, 3)], "point_id string, source string, v int")
    s = store.ChunkStore(spark, str(tmp_path / "store"), df.schema)
    assert s.count() == 0
    s.append(df)
    s.upsert(df.where("point_id = 'b'").withColumn("v", F.lit(9)))
    assert {r["point_id"]: r["v"] for r in s.read().collect()} == {"a": 1, "b": 9, "c": 3}
    assert s.delete_by_source("s1") == 1 and s.delete_by_source("none") == 0
    assert s.delete_by_ids(spark.createDataFrame([("b",), ("z",)], "point_id string")) == 1
    assert [r["point_id"] for r in s.read().collect()] == ["c"]
    s.reset()
    assert s.count() == 0


def okapi(docs, query, k1=1.5, b=0.75, epsilon=0.25):
    """BM25 in plain Python over {doc: tokens}."""
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for w in docs.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    raw = {t: np.log(n - f + 0.5) - np.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: epsilon * mean if w < 0 else w for t, w in raw.items()}
    return {d: s for d, w in docs.items() if (s := sum(idf.get(t, 0) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / average)) for t in query)) > 0}


def test_sparse_store_is_an_index_of_what_it_holds(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    rows = [(f"p{k}", f"s{k % 4}", " ".join(rng.choice(words, rng.integers(1, 12)))) for k in range(60)] + [("blank", "s1", ""), ("none", "s1", None)]
    df = spark.createDataFrame(rows, "point_id string, source string, content string")
    s = store.SparseStore(spark, str(tmp_path / "sparse"))
    question = spark.createDataFrame([(1, "w1 w2 w3 w1 unknown")], "query long, text string")

    def check(held):
        docs = {p: c.split() for p, src, c in rows if src in held and c}
        expected = okapi(docs, ["w1", "w2", "w3", "w1"])
        got = {r["doc"]: r["score"] for r in retrieval.search(s.index(), question, 100).collect()}
        assert got.keys() == expected.keys() and all(abs(got[d] - expected[d]) < 1e-9 for d in got)

    assert retrieval.search(s.index(), question, 5).count() == 0
    s.add(df.where("source <> 's3'"))
    check({"s0", "s1", "s2"})
    s.add(df.where("source = 's3'"))
    assert s.delete_by_source("s1") == 15 and s.delete_by_source("s1") == 0
    check({"s0", "s2", "s3"})
    s.add(df.where("source = 's1'"))
    check({"s0", "s1", "s2", "s3"})
    s.reset()
    assert s.index().n == 0
    s.add(df.where("source = 's2'"))
    check({"s2"})


def test_ingest_replaces_skips_and_deletes(spark, tmp_path):
    schema = ingest.with_ids(canonical(spark.createDataFrame([], "content string"))).withColumn("vector", F.array(F.lit(0.0).cast("float"))).schema
    registry = spark.createDataFrame([], "source string, sha256 string").schema
    new = lambda name, s, key: store.ChunkStore(spark, str(tmp_path / name), s, key)
    kb = ingest.KnowledgeBase(new("chunks", schema, "point_id"), store.SparseStore(spark, str(tmp_path / "sparse")), new("registry", registry, "source"), ingest.hashed_embedder(16))

    def batch(*files):
        f = spark.createDataFrame([(k, n, c.encode()) for k, (n, c) in enumerate(files)], "seq long, source string, content binary")
        b = spark.createDataFrame([(n, j, "text", 1, p) for n, c in files for j, p in enumerate(c.split("|"))], "source string, block_seq long, type string, page int, content string")
        return f, b.withColumn("section_path", F.lit("")).withColumn("heading", F.lit(""))

    urls = spark.createDataFrame([("a.txt", "http://files/a.txt")], "source string, url string")
    first = kb.ingest(*batch(("a.txt", "red fox|blue whale"), ("b.txt", "green tree"), ("copy.txt", "green tree"), ("empty.txt", " ")), urls)
    assert first == ingest.Summary(["a.txt", "b.txt"], ["copy.txt", "empty.txt"], 2, 2)
    held = {r["source"]: r for r in kb.chunks.read().collect()}
    assert held["a.txt"]["content"] == "red fox\n\nblue whale" and held["a.txt"]["source_url"] == "http://files/a.txt" and held["b.txt"]["source_url"] == ""
    assert abs(sum(x * x for x in held["a.txt"]["vector"]) - 1) < 1e-6
    again = kb.ingest(*batch(("a.txt", "red wolf")))
    assert again.files_indexed == ["a.txt"] and {r["content"] for r in kb.chunks.read().collect()} == {"red wolf", "green tree"}
    ask = ingest.embed_questions(spark.createDataFrame([(1, " red wolf ")], "query long, text string"), ingest.hashed_embedder(16), "")
    sparse = retrieval.search(kb.sparse.index(), ask, 5)
    dense = retrieval.knn(kb.chunks.read().withColumn("doc_id", F.xxhash64("point_id")), ask, 1)
    assert sparse.count() == 0 and kb.sparse.index().n == 2  # a word of one of two documents weighs nothing
    assert abs(dense.first()["score"] - 1) < 1e-6
    assert kb.delete_file("a.txt") == (1, 1) and kb.delete_file("none") == (0, 0)
    assert store.list_sources(kb.chunks.read()).collect() == [("b.txt",)] and kb.sparse.rows().count() == 1 and [r["source"] for r in kb.registry.read().collect()] == ["b.txt"]
    kb.wipe()
    assert kb.chunks.count() == 0 and kb.sparse.index().n == 0


def test_sync_with_deletes(spark, tmp_path):
    schema = "point_id string, source string, v int"
    s = store.ChunkStore(spark, str(tmp_path / "local"), spark.createDataFrame([], schema).schema)
    cloud = lambda x: spark.createDataFrame([(i, "s", k) for k, i in enumerate(x)], schema)
    assert jobs.reconcile(cloud("abc"), s) == (3, 0) and jobs.reconcile(cloud("bcd"), s) == (1, 1) and jobs.reconcile(cloud("bcd"), s) == (0, 0)
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("b", "s", 9, 1, False), ("b", "s", 8, 2, False), ("c", "s", 0, 3, True), ("e", "s", 5, 4, True), ("e", "s", 6, 5, False)], schema + ", seq int, gone boolean").coalesce(1).write.parquet(feed)
    stream = spark.readStream.schema(schema + ", seq int, gone boolean").parquet(feed)
    jobs.sync_into(stream, s, str(tmp_path / "cp"), order="seq", deleted="gone").awaitTermination(120)
    assert {r["point_id"]: r["v"] for r in s.read().collect()} == {"b": 8, "d": 2, "e": 6}


def test_parents_citations_and_images(spark):
    rows = spark.createDataFrame([(1, 1, "p1", "c1", ""), (1, 2, "p2", "c2", "own"), (1, 3, "", "c3", None)], "query long, rank int, parent_id string, content string, parent_content string")
    parents = spark.createDataFrame([("p1", "parent one"), ("p2", "parent two")], "parent_id string, content string")
    assert [r["parent_content"] for r in sync.with_parents(rows, parents).orderBy("rank").collect()] == ["parent one", "own", None]
    same = spark.createDataFrame([(1, 1, 1.0, "x", "p", ""), (1, 2, 0.5, "y", "p", "")], "query long, rank int, score double, content string, parent_id string, parent_content string")
    assert [r["content"] for r in retrieval.expand_parents(same).orderBy("rank").collect()] == ["x", "y"]
    hits = spark.createDataFrame([(1, 1, "image", "/gone/a.png"), (1, 2, "image", "/img/b.png"), (1, 3, "text", "/img/b.png"), (1, 4, "image", "/gone/z.png")], "query long, rank int, type string, image_path string")
    there = spark.createDataFrame([("/img/b.png", "b.png"), ("/img/a.png", "a.png")], "path string, name string")
    assert sorted((r["rank"], r["path"], r["url"]) for r in context.images(hits, there).collect()) == [(1, "/img/a.png", "/images/a.png"), (2, "/img/b.png", "/images/b.png")]
    turns = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(10)], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in context.chat_window(turns, 2).orderBy("turn").collect()] == [5, 6, 7, 8, 9]
    prompts = spark.createDataFrame([(1, 8, "Context: ... m8")], "conv_id long, turn long, prompt string")
    assert [(r["stored"], r["sent"]) for r in context.stored_and_sent(turns, prompts).orderBy("turn").collect()][-2:] == [("m6", "m6"), ("m8", "Context: ... m8")]
    summary = context.rolling_summary(turns, F.upper, 2).first()
    assert summary["turn"] == 7 and summary["summary"].endswith("USER: M4\nASSISTANT: M5\nUSER: M6\nASSISTANT: M7")


def test_sync_is_idempotent(spark):
    ids = lambda x: spark.createDataFrame([(i, i.upper()) for i in x], "point_id string, v string")
    cloud, local = ids("abc"), ids("bcd")
    assert {tuple(r) for r in sync.plan(cloud, local).collect()} == {("a", "pull"), ("d", "delete")}
    after = sync.apply(cloud, local)
    assert sync.plan(cloud, after).count() == 0 and sync.pending(cloud, after).first()[0] == 0


def test_client_diff_classes(spark):
    f = lambda x: spark.createDataFrame(x, "source string, hash string")
    got = {r["source"]: r["action"] for r in sync.client_diff(f([("only_client", "1"), ("same", "1"), ("changed", "1")]), f([("only_server", "1"), ("same", "1"), ("changed", "2")])).collect()}
    assert got == {"only_client": "to_delete", "only_server": "to_add", "same": "unchanged", "changed": "to_add"}


def test_canonical_keeps_nulls_and_zeros(spark):
    row = canonical(spark.createDataFrame([("x", 0, None, 0.123456)], "content string, chunk_index int, heading string, score double")).first()
    assert (row["chunk_index"], row["heading"], row["type"], row["score"], row["page"]) == (0, None, "text", 0.1235, None)


def test_span_blocks(spark):
    spans = [("f", 1, 0, 0, 0, "Big title", 20.0), ("f", 1, 1, 0, 0, "plain ", 10.0), ("f", 1, 1, 0, 1, "text", 10.0), ("f", 1, 2, 0, 0, "- item", 10.0), ("f", 1, 2, 1, 0, "  ", 10.0)]
    rows = blocks.span_blocks(spark.createDataFrame(spans, "source string, page int, block int, line int, span int, text string, size double")).orderBy("block_seq").collect()
    assert [(r["type"], r["level"], r["content"]) for r in rows] == [("heading", 1, "Big title"), ("text", None, "plain text"), ("bullet", None, "- item")]
    assert [(r["heading"], r["section_path"], r["bbox"], r["page_width"]) for r in rows] == [("Big title", "Big title", None, None)] * 3


def test_span_geometry_and_headings_across_pages(spark):
    box = lambda k: (1.006, 10.0 * k, 90.0 + k, 10.0 * k + 9)
    spans = [("f", 1, 0, 0, 0, "before", 10.0, *box(0)), ("f", 1, 1, 0, 0, "One", 20.0, *box(1)), ("f", 1, 2, 0, 0, "Two", 15.0, *box(2)), ("f", 1, 3, 0, 0, "a", 10.0, *box(3)), ("f", 1, 3, 1, 0, " ", 10.0, *box(9)), ("f", 1, 4, 0, 0, "b", 10.0, *box(4)), ("f", 1, 5, 0, 0, "c", 10.0, *box(5))]
    spans += [("f", 2, 0, 0, 0, "d", 10.0, *box(0)), ("f", 2, 1, 0, 0, "Three", 18.0, *box(1)), ("f", 2, 2, 0, 0, "e", 10.0, None, 1.0, 2.0, 3.0), ("f", 2, 3, 0, 0, " ", 30.0, *box(3)), ("g", 1, 0, 0, 0, "x", 10.0, *box(0))]
    df = spark.createDataFrame(spans, "source string, page int, block int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    sizes = spark.createDataFrame([("f", 1, 595.276, 841.89), ("f", 1, 595.276, 841.89), ("f", 2, 100.0, 50.0)], "source string, page int, width double, height double")
    rows = blocks.span_blocks(df, sizes).orderBy("source", "block_seq").collect()
    assert [(r["content"], r["section_path"], r["heading"]) for r in rows] == [
        ("before", "", ""), ("One", "One", "One"), ("Two", "One > Two", "Two"), ("a", "One > Two", "Two"), ("b", "One > Two", "Two"), ("c", "One > Two", "Two"),
        ("d", "One > Two", "Two"), ("Three", "Three", "Three"), ("e", "Three", "Three"), ("x", "", ""),
    ]
    assert (rows[3]["bbox"], rows[3]["page_width"], rows[3]["page_height"]) == ([1.01, 30.0, 99.0, 99.0], 595.28, 841.89)
    assert rows[8]["bbox"] is None and rows[8]["page_height"] == 50.0 and rows[9]["page_width"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\fthree")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    rows = blocks.binary_blocks(spark, str(tmp_path), blocks.text_extractor, "*.txt").collect()
    assert sorted((r["source"], r["type"], r["page"]) for r in rows if r["type"] != "error") == [("a.txt", "text", 1), ("a.txt", "text", 1), ("a.txt", "text", 2)]
    assert [r["source"] for r in rows if r["type"] == "error"] == ["b.txt"]
    (tmp_path / "t.csv").write_text("a,b,c\n1, x ,\n,,\n2,y,\n")
    t = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert t.columns == ["a", "b"] and t.count() == 2
    assert tables.to_chunk(t, "t.csv", "b").first()["content"].splitlines()[2] == "| 1 | x |"
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.doc")
    (tmp_path / "m.json").write_text('{"docs": [{"filename": "f", "sha256": "s", "url": "u"}]}')
    assert [tuple(r) for r in blocks.manifest(spark, str(tmp_path / "m.json")).collect()] == [("f", "s", "u")]
    lines = spark.createDataFrame([('data: {"a": 1}',), ("data: {oops",), (": ping",)], "value string")
    assert [r["a"] for r in blocks.server_events(lines, "a int").collect() if r["a"] is not None] == [1]
    assert blocks.html_block_list("<h2>T</h2><p>a <b>b</b><ul><li>x</ul><table><tr><th>h<tr><td>1</table>") == [("heading", 2, "T"), ("text", None, "a b"), ("bullet", None, "x"), ("table", None, "| h |\n|---|\n| 1 |")]
    ocr = spark.createDataFrame([("i", 0, "confident", 90.0), ("i", 1, "", 80.0), ("i", 2, "words", 70.0), ("i", 3, "in image", 80.0), ("i", 4, "bad", -1.0), ("j", 0, "short", 99.0)], "source string, seq int, word string, conf double")
    assert [(r["content"], r["confidence"]) for r in blocks.image_text_chunks(ocr).collect()] == [("confident words in image", 80.0)]


def test_tables_and_images_as_blocks(spark, tmp_path):
    page = "<p>x</p><table><tr><th>a<th>b<tr><td>1<td>2<tr><td>3<td>4</table><table><tr><td>only</table><table><tr><th>c<tr><td>5</table>"
    (tmp_path / "p.html").write_text(page)
    rows = tables.to_chunks(spark, str(tmp_path / "p.html"), max_rows=1).orderBy("source").collect()
    assert [(r["source"], r["content"]) for r in rows] == [("p.html::table_0", "| a | b |\n|---|---|\n| 1 | 2 |"), ("p.html::table_1", "| c |\n|---|\n| 5 |")]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert tables.to_chunks(spark, str(tmp_path / "t.csv")).first()["content"].splitlines()[2:] == ["| 1 | x |", "| 2 | y |"]
    images = spark.createDataFrame([("f.pdf", 1, 1, 9000, "/i/1.png"), ("f.pdf", 1, 2, 100, "/i/2.png"), ("f.pdf", 2, 1, 5000, "/i/3.png")], "source string, page int, figure int, bytes long, path string")
    pages = spark.createDataFrame([("f.pdf", 1, "Some\ntext")], "source string, page int, text string")
    text = spark.createDataFrame([("f.pdf", 0, "text", None, 1, "Some"), ("f.pdf", 1, "text", None, 2, "more")], "source string, block_seq long, type string, level int, page int, content string")
    table = text.where("block_seq = 0").withColumn("type", F.lit("table"))
    all_of = blocks.united(text, table, blocks.image_blocks(images, pages)).orderBy("block_seq").collect()
    assert [(r["block_seq"], r["type"], r["image_path"]) for r in all_of] == [(0, "text", ""), (1, "text", ""), (2, "table", ""), (3, "image", "/i/1.png"), (4, "image", "/i/3.png")]
    assert all_of[3]["content"].endswith("Page context: Some text") and all_of[4]["content"].endswith("diagram from f.pdf")


def test_rerank_expand_and_gate(spark):
    cols = "query long, query_text string, rank int, score double, content string, parent_id string, parent_content string"
    rows = spark.createDataFrame([(1, "red fox", 1, 0.5, "cat", "p1", "a red thing"), (1, "red fox", 2, 0.4, "dog", "p2", "red fox here"), (1, "red fox", 3, 0.3, "cow", "p2", "red fox here"), (1, "red fox", 4, 0.2, "red fox", "", None)], cols)
    got = [(r["content"], r["rerank_score"], r["retrieval_score"]) for r in retrieval.rerank(rows, 3).orderBy("rank").collect()]
    assert got == [("dog", 1.0, 0.4), ("cow", 1.0, 0.3), ("red fox", 1.0, 0.2)]
    assert [r["content"] for r in retrieval.expand_parents(rows).orderBy("rank").collect()] == ["a red thing", "red fox here", "red fox"]
    assert retrieval.gate(rows, 0.6).count() == 0 and retrieval.gate(rows, 0.5).count() == 4
    assert [r["score"] for r in retrieval.online(rows).orderBy("rank").collect()] == [1.0, 1.0, 0.5]


def test_streaming_sync_and_edges(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "point_id string, source string, v int"
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("a", "s", 1), ("b", "s", 2)], schema).write.parquet(feed)
    target = store.ChunkStore(spark, str(tmp_path / "target"), spark.createDataFrame([], schema).schema)
    for _ in range(2):
        jobs.sync_into(spark.readStream.schema(schema).parquet(feed), target, str(tmp_path / "cp")).awaitTermination(120)
    assert target.count() == 2
    samples = str(tmp_path / "samples")
    spark.sql("select 1L key, timestamp_seconds(id) ts, if(id % 4 < 2, 'up', 'down') status from range(8)").coalesce(1).write.parquet(samples)
    q = jobs.status_edges(spark.readStream.schema("key long, ts timestamp, status string").parquet(samples)).writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["before"], r["status"]) for r in spark.table("edges").orderBy("ts").collect()] == [("up", "down"), ("down", "up"), ("up", "down")]
    talk = str(tmp_path / "talk")
    spark.sql("select 1L conv_id, id turn, if(id % 2 = 0, 'user', 'assistant') role, 't' text from range(9)").coalesce(1).write.parquet(talk)
    q = jobs.conversation_memory(spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(talk), 2).writeStream.format("memory").queryName("memory_out").option("checkpointLocation", str(tmp_path / "cp3")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("memory_out").collect()] == [(1, 4, 5, 8)]


def test_summaries_are_kept_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, talk = "conv_id long, turn long, role string, text string", str(tmp_path / "talk")

    def summarise(prompt):
        if "fail" in prompt.splitlines()[-1]:
            raise ValueError("no model")
        lines = prompt.split("\n\n", 1)[1].splitlines()
        return f" {len(lines)} {lines[0]} {lines[-1]} "

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(talk)
        stream = jobs.kept_summaries(spark.readStream.schema(schema).parquet(talk), summarise, every=2, cut=5)
        out = str(tmp_path / name)
        q = stream.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema("conv_id long, turn long, summary string").parquet(out).collect())

    say = lambda c, t, text=None: (c, t, "user" if t % 2 == 0 else "assistant", text or f"m{t}")
    assert run([say(1, 0, "longer than five"), say(1, 1), say(1, 2), say(2, 0), say(2, 1)], "sum0") == []  # nothing is due
    assert run([say(1, 3)], "sum1") == [(1, 3, "4 USER: longe ASSISTANT: m3")]  # three of the messages come from the state
    assert run([say(1, 4), say(1, 5), (2, 2, None, None)], "sum2") == [(1, 3, "4 USER: longe ASSISTANT: m3")]  # kept
    assert run([say(1, 6), say(1, 7, "fail"), say(2, 3)], "sum3") == [(1, 3, "4 USER: longe ASSISTANT: m3"), (2, 3, "4 USER: m0 ASSISTANT: m3")]
    assert run([say(1, k) for k in range(8, 12)], "sum4") == [(1, 11, "4 USER: m8 ASSISTANT: m11")]


def test_hybrid_threshold_and_pins(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"s{k % 2}", f"term{k % 5} term{k % 7} common{k}", rng.normal(size=4).tolist()) for k in range(40)]
    chunks = spark.createDataFrame(rows, "doc_id long, source string, content string, vector array<double>")
    q = spark.createDataFrame([(1, "term1 term3", rows[3][3])], "query long, text string, vector array<double>")
    plain = {r["doc"]: r["rrf_score"] for r in retrieval.hybrid(chunks, q, Settings(top_k=40), deduplicate=False).collect()}
    bar = sorted(plain.values())[len(plain) // 2]
    over = retrieval.hybrid(chunks, q, Settings(top_k=40, score_threshold=bar), deduplicate=False).collect()
    assert {r["doc"] for r in over} == {d for d, x in plain.items() if x >= bar} and 0 < len(over) < len(plain)
    pin = F.col("source") == "s1"
    dense_only = {r["doc"] for r in retrieval.hybrid(chunks, q, Settings(top_k=40), pin, deduplicate=False).collect()}
    both = {r["doc"] for r in retrieval.hybrid(chunks, q, Settings(top_k=40), pin, pin_sparse=True, deduplicate=False).collect()}
    assert {d % 2 for d in both} == {1} and {d % 2 for d in dense_only} == {0, 1}


def test_arrivals_log_and_timed_sync(spark, tmp_path):
    feed = str(tmp_path / "in")
    spark.createDataFrame([(1,), (2,)], "v int").coalesce(1).write.parquet(feed)
    out = jobs.arrivals(spark, feed, "v int").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {r["v"] for r in spark.table("arrived").collect()} == {1, 2} and all(r["file"].endswith(".parquet") for r in spark.table("arrived").collect())
    log = spark.sql("select timestamp_seconds(id) as timestamp, id as vectors_added from range(80)")
    assert [r["vectors_added"] for r in sync.log_entries(log).collect()] == list(range(79, 29, -1))
    s = store.ChunkStore(spark, str(tmp_path / "local"), spark.createDataFrame([], "point_id string, v int").schema)
    tries = []

    def cloud():
        tries.append(1)
        if len(tries) == 1:
            raise OSError("offline")
        return spark.createDataFrame([("a", 1)], "point_id string, v int")

    q = jobs.sync_every(spark.readStream.format("rate").option("rowsPerSecond", 5).load(), cloud, s, str(tmp_path / "cp2"), "1 second")
    q.awaitTermination(25)
    q.stop()
    assert len(tries) >= 2 and s.count() == 1


def test_settings():
    assert Settings().fetch_k == 60 and Settings(top_k=5).fetch_k == 20
