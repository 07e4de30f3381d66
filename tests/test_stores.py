"""Stores that merge on read, the posting index, the cell index, and the path from files to retrieval."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.operators import cells, chunking, ingest, postings, retrieval, store, sync
from sparkloom.schema import Settings, canonical

SCHEMA = "point_id string, source string, type string, v int"


def table_of(s, version=None):
    return sorted(map(tuple, s.read(version).collect()), key=repr)


def check(s, held):
    assert table_of(s) == sorted(((k, *r) for k, r in held.items()), key=repr)
    counts = {}
    for src, kind, _ in held.values():
        counts[src, kind] = counts.get((src, kind), 0) + 1
    assert {(r["source"], r["type"]): r["n"] for r in s.histogram().collect()} == counts
    assert tuple(s.stats().first()) == (len(held), len({src for src, _ in counts} - {None})) and s.count() == len(held)
    assert {r[0] for r in s.list_sources().collect()} == {src for src, _ in counts if src}


@pytest.mark.parametrize(("sent", "layers"), [(store.SENT, store.LAYERS), (0, 3)])
def test_store_is_a_dictionary_after_any_changes(spark, tmp_path, monkeypatch, sent, layers):
    monkeypatch.setattr(store, "SENT", sent)
    monkeypatch.setattr(store, "LAYERS", layers)
    s = store.ChunkStore(spark, str(tmp_path / "store"), spark.createDataFrame([], SCHEMA).schema, order="v")
    rng, held, old = random.Random(1), {}, {}
    check(s, held)
    for step in range(12):
        what = rng.choice(["upsert", "upsert", "append", "source", "ids", "replace"]) if step else "upsert"
        rows = [(f"p{rng.randrange(30)}", rng.choice(["a", "b", "c", None, ""]), rng.choice(["text", "table"]), 100 * step + k) for k in range(rng.randrange(1, 12))]
        last = {r[0]: r[1:] for r in rows}
        if what in ("upsert", "append"):
            getattr(s, what)(spark.createDataFrame(rows, SCHEMA))
            held |= last
        elif what == "replace":
            gone = [k for k, r in held.items() if r[0] in ("a", None)]
            assert s.replace_sources(["a", None], spark.createDataFrame(rows, SCHEMA)) == len(set(gone) | {k for k in last if k in held})
            held = {k: r for k, r in held.items() if k not in gone} | last
        elif what == "source":
            src = rng.choice(["a", "b", None, "none"])
            gone = [k for k, r in held.items() if r[0] == src]
            assert s.delete_by_source(src) == len(gone)
            held = {k: r for k, r in held.items() if k not in gone}
        else:
            ids = [f"p{k}" for k in range(0, 40, 7)]
            assert s.delete_by_ids(spark.createDataFrame([(i,) for i in ids + ids], "point_id string")) == sum(i in held for i in ids)
            held = {k: r for k, r in held.items() if k not in ids}
        old[s.versions()[-1]] = dict(held)
    check(s, held)
    for version, rows in old.items():
        assert table_of(s, version) == sorted(((k, *r) for k, r in rows.items()), key=repr)
    before = table_of(s)
    s.compact()
    assert table_of(s) == before and not s.manifest()["gone"] and s.vacuum() > 0 and len(s.versions()) == 1
    check(s, held)
    s.reset()
    check(s, {})


def test_a_small_change_writes_few_rows(spark, tmp_path):
    df = spark.range(20_000).selectExpr("cast(id as string) as point_id", "concat('s', id % 40) as source", "'text' as type", "0 as v")
    s = store.ChunkStore(spark, str(tmp_path / "store"), df.schema)
    s.upsert(df)
    first, version = s.manifest(), s.versions()[-1]
    s.upsert(df.where("cast(point_id as int) % 40 = 3").withColumn("v", F.lit(1)))
    now = s.manifest()
    new = {f: x for f, x in now["files"].items() if f not in first["files"]}
    assert sum(x["rows"] for x in new.values()) == 500 == now["gone"][0]["rows"] and first["files"].items() <= now["files"].items()
    assert s.count() == 20_000 and s.read().where("v = 1").count() == 500 and s.read(version).where("v = 1").count() == 0
    writer = store.ChunkStore(spark, str(tmp_path / "store"), df.schema)
    writer.versions = lambda: s.versions()[:-1]  # has not seen the last version
    with pytest.raises(RuntimeError):
        writer.upsert(df.limit(1))
    assert s.count() == 20_000


def test_only_files_that_may_hold_a_source_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 100)
    df = spark.range(4_000).selectExpr("cast(id as string) as point_id", "concat('s', lpad(id % 40, 2, '0')) as source", "'text' as type", "0 as v")
    s = store.ChunkStore(spark, str(tmp_path / "store"), df.schema)
    s.upsert(df)
    s.compact()
    few = s.files(["s07"])
    assert len(s.files()) >= 20 and 1 <= len(few) <= 4 and s.files(["zz"]) == [] == s.files(["s07x"])
    read = s.read(sources=["s07"])
    assert read.count() == 100 and {f.rsplit("/", 1)[1] for f in read.inputFiles()} >= {f.split("/")[1] for f in few} and len([f for f in read.inputFiles() if "/data/" in f]) == len(few)
    # Bounds that overlap: the filter tells sources apart.
    odd = store.ChunkStore(spark, str(tmp_path / "odd"), df.schema)
    odd.upsert(df.where("source in ('s00', 's39')").coalesce(1))
    assert len(odd.files(["s00"])) == 1 and odd.files(["s20"]) == []
    assert s.has_source("s07") and not s.has_source("zz") and s.delete_by_source("s07") == 100 and not s.has_source("s07")


def test_filter_places_are_the_same_on_both_sides(spark):
    names = ["", "a", "é" * 50, "x" * 1000]
    got = spark.createDataFrame([(n,) for n in names], "s string").select(store._bit_columns(F.col("s")).alias("b")).collect()
    assert [list(r["b"]) for r in got] == [store._bits(n) for n in names]


def test_sparse_store_merges_parts_and_swaps_rebuilds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store.SparseStore, "FANOUT", 3)
    s = store.SparseStore(spark, str(tmp_path / "sparse"))
    rng, held = random.Random(2), {}
    for step in range(14):
        src = f"s{rng.randrange(5)}"
        rows = [(f"p{step}-{k}", src, " ".join(rng.choice(["red", "blue", "green", "fox"]) for _ in range(4))) for k in range(rng.randrange(1, 4))]
        if step % 4 == 3:
            gone = [p for p, r in held.items() if r[0] == src]
            assert s.delete_by_source(src) == len(gone)
            held = {p: r for p, r in held.items() if p not in gone}
        else:
            df = spark.createDataFrame(rows, "point_id string, source string, content string")
            if step % 4 == 2:
                s.replace_sources([src], df)
                held = {p: r for p, r in held.items() if r[0] != src}
            else:
                s.add(df)
            held |= {p: (a, c) for p, a, c in rows}
        assert len(s.parts()) <= 8
    index = s.index()
    df = {}
    for _, c in held.values():
        for w in set(c.split()):
            df[w] = df.get(w, 0) + 1
    assert {(r["tok"], r["df"]) for r in index.vocabulary.collect()} == set(df.items())
    assert (index.n, index.average) == (len(held), 4.0) and {r["doc"] for r in s.rows().collect()} == set(held)
    chunks = spark.createDataFrame([("x", "s9", "red fox")], "point_id string, source string, content string")
    seen = s.rows()  # opened before the rebuild
    s.rebuild(chunks)
    assert {r["doc"] for r in seen.collect()} == set(held) and [r["doc"] for r in s.rows().collect()] == ["x"] and s.index().n == 1
    assert s.vacuum() > 0 and [r["doc"] for r in s.rows().collect()] == ["x"]


QUESTIONS = [(1, "w1 w2 w3 w1 unknown"), (2, "w0"), (3, "zzz"), (4, ""), (5, "w7 w8 w9 w10 w11 w25"), (6, None)]


@pytest.mark.parametrize(("size", "named", "sent"), [(4, 2000, 200_000), (16, 0, 0), (128, 2000, 0)])
def test_posting_blocks_give_the_full_scan(spark, monkeypatch, size, named, sent):
    monkeypatch.setattr(postings, "RANGE", size)
    monkeypatch.setattr(postings, "NAMED", named)
    monkeypatch.setattr(postings, "SENT", sent)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    weight = np.array([1 / (k + 1) for k in range(30)])
    texts = [(f"p{k}", " ".join(rng.choice(words, rng.integers(1, 40), p=weight / weight.sum()))) for k in range(300)] + [("same", "w3 w4"), ("like", "w3 w4"), ("blank", ""), ("none", None), ("stop", "the of")]
    docs = spark.createDataFrame(texts, "doc_id string, content string")
    asked = spark.createDataFrame(QUESTIONS, "query long, text string")
    plain, index = retrieval.sparse_index(docs), postings.posting_index(docs)
    assert (index.n, index.average) == (plain.n, plain.average) and abs(index.mean - plain.mean) < 1e-9
    for k in (1, 7, 1000):
        expected = {(r["query"], r["rank"]): (r["doc"], round(r["score"], 6)) for r in retrieval.search(plain, asked, k).collect()}
        assert {(r["query"], r["rank"]): (r["doc"], round(r["score"], 6)) for r in retrieval.search(index, asked, k).collect()} == expected
    with pytest.raises(ValueError):
        retrieval.search(index, asked, 5, Settings(bm25_b=0.5))
    empty = postings.posting_index(docs.limit(0))
    assert empty.n == 0 and retrieval.search(empty, asked, 5).count() == 0


def test_search_opens_its_tokens_folders_and_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 10)
    docs = spark.range(2_000).selectExpr("id as doc_id", "concat_ws(' ', 'common', if(id % 50 = 0, concat_ws(' ', repeat('rare ', 5)), ''), concat('pad', id % 97), repeat(concat('f', id % 7, ' '), cast(id % 13 as int))) as content")
    index = postings.posting_index(docs)
    asked = spark.createDataFrame([(1, "rare common")], "query long, text string")
    opened = postings.of_tokens(index, spark.createDataFrame([("rare",), ("common",)], "tok string"))
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]
    tokens = {r["tok"] for r in opened.select("tok").distinct().collect()}
    assert tokens == {"rare", "common"} and opened.count() < index.blocks.count() / 4
    scored = []
    plain = postings._scores
    monkeypatch.setattr(postings, "_scores", lambda i, t, w, few, chosen: scored.append(chosen.count()) or plain(i, t, w, few, chosen))
    got = [tuple(r) for r in retrieval.search(index, asked, 5).orderBy("rank").select("doc", "rank").collect()]
    every = opened.select("range").distinct().count()
    assert sum(scored) < every / 2
    assert got == [tuple(r) for r in retrieval.search(retrieval.sparse_index(docs), asked, 5).orderBy("rank").select("doc", "rank").collect()]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_knn_keeps_ids_of_any_type(spark, kind, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 7)
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(120, 6)), 1)
    m[10:14] = m[3]  # ties
    m[50] = 0
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(999, None)], "doc_id long, vector array<float>").withColumn("doc_id", F.col("doc_id").cast(kind))
    asked = rows.where("doc_id % 20 = 0 or doc_id = 3").withColumnRenamed("doc_id", "query")
    unit = m.astype(np.float32).astype(float)
    unit = unit / np.where(np.linalg.norm(unit, axis=1) == 0, 1, np.linalg.norm(unit, axis=1))[:, None]
    name = str if kind == "string" else int
    for keep in (True, False):
        got = {(r["query"], r["rank"]): r["doc"] for r in retrieval.knn(rows, asked, 5, keep_self=keep).collect()}
        for i in [3, *range(0, 120, 20)]:
            order = sorted((j for j in range(120) if keep or j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 6) + 0.0, name(j)))[:5]
            assert [got[name(i), r] for r in range(1, 6)] == [name(j) for j in order]


def clustered(spark, n=3_000, size=16):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, size))
    m = centres[rng.integers(0, 40, n)] + 0.25 * rng.normal(size=(n, size))
    return spark.createDataFrame([(f"d{k:05d}", [float(x) for x in v]) for k, v in enumerate(m)], "doc_id string, vector array<float>")


def test_cells_recall_and_all_probes(spark, monkeypatch):
    rows = clustered(spark)
    asked = rows.where("substring(doc_id, 2) % 20 = 0").withColumnRenamed("doc_id", "query")
    exact = retrieval.knn(rows, asked, 10).cache()
    index = cells.cell_index(rows)
    assert index.rows.count() == 3_000 and len(index.centroids) == 15
    every = cells.cell_knn(index, asked, 10, cells.MOST)
    key = lambda df: sorted((r["query"], r["rank"], r["doc"], round(r["score"], 9)) for r in df.collect())
    assert key(every) == key(exact) and cells.recall(every, exact) == 1.0
    few = cells.cell_knn(index, asked, 10, 3)
    assert cells.recall(few, exact) >= 0.9
    one = asked.limit(1)
    probed = cells.cell_knn(index, one, 10, 2)
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") or "cell#" in plan.split("PartitionFilters")[1][:80]
    monkeypatch.setattr(cells, "PART", 20)  # a hot cell in many parts
    assert key(cells.cell_knn(cells.cell_index(rows), asked, 10, cells.MOST)) == key(exact)


def test_cells_recall_on_the_sample_vectors(spark, medium):
    e = spark.read.parquet(f"{medium}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query")
    assert cells.recall(cells.cell_knn(cells.cell_index(e), asked, 20), retrieval.knn(e, asked, 20)) >= 0.9


def test_cells_odd_tables(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "doc_id string, vector array<float>")
    index = cells.cell_index(rows)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query long, vector array<float>")
    assert [(r["doc"], r["rank"]) for r in cells.cell_knn(index, asked, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert cells.cell_knn(cells.cell_index(rows.limit(0)), asked, 2).count() == 0


def test_pages_open_the_ranges_that_hold_them(spark, monkeypatch):
    monkeypatch.setattr(sync, "RANGE_ROWS", 50)
    rows = canonical(spark.range(1_000).selectExpr("id * 3 as ord", "concat('s', id % 7) as source", "concat('text ', id) as content", "cast(null as int) as page"), "ord")
    index = sync.page_index(rows)
    vectors = spark.createDataFrame([], "content_hash string, embedding array<float>")
    assert index.rows.select("range").distinct().count() >= 15
    for offset, limit, source in ((0, 1, None), (0, 60, None), (333, 100, None), (999, 10, None), (1_000, 10, None), (0, 3_000, None), (20, 30, "s3"), (140, 30, "s3"), (0, 5, "none")):
        page = sync.export_page(index, vectors, offset, limit, source)
        assert sorted(page.select("ord", "content").collect()) == sorted(sync.export_page(rows, vectors, offset, limit, source).select("ord", "content").collect())
    plan = index.page(333, 100)._jdf.queryExecution().executedPlan().toString()
    opened = re.search(r"PartitionFilters: \[[^\]]*range#\d+ IN \(([\d,]+)\)", plan)
    assert opened and 2 <= len(opened[1].split(",")) <= 6


def test_equal_but_for_white_space(spark):
    legs = lambda rows: spark.createDataFrame(rows, "query long, doc string, content string, rank int")
    fused = retrieval.rrf(legs([(1, "a", "same text\n", 1), (1, "c", "other", 2)]), legs([(1, "b", " same text", 1)])).collect()
    assert sorted((r["doc"], r["rrf_score"]) for r in fused) == [("a", round(2 / 61, 6)), ("c", round(1 / 62, 6))]


def test_atomic_blocks_keep_their_place(spark):
    blocks = spark.createDataFrame(
        [("f", 0, "text", 1, "h", "h", "some text", [0.0, 0.0, 1.0, 1.0], 100.0, ""), ("f", 1, "table", 1, "h", "h", "\n", None, None, ""), ("f", 2, "image", 2, "h", "h", " [IMAGE] x\n", [1.0, 2.0, 3.0, 4.0], 50.0, "/img/a.png")],
        "source string, block_seq long, type string, page int, heading string, section_path string, content string, bbox array<double>, page_width double, image_path string",
    )
    got = {r["type"]: r for r in chunking.chunk_hierarchical(blocks).collect()}
    assert set(got) == {"text", "image"} and got["text"]["bbox"] is None
    image = got["image"]
    assert (image["content"], image["parent_content"], image["bbox"], image["page_width"], image["image_path"]) == ("[IMAGE] x", "[IMAGE] x", [1.0, 2.0, 3.0, 4.0], 50.0, "/img/a.png")


def test_from_files_to_hybrid_retrieval(spark, tmp_path):
    kb = ingest.knowledge_base(spark, str(tmp_path / "kb"), ingest.hashed_embedder(16))
    texts = {"a.txt": "red fox jumps", "b.txt": "green tree stands", "c.txt": "blue whale swims"}
    files = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(texts.items())], "seq long, source string, content string")
    blocks = spark.createDataFrame([(n, 0, "text", 1, "", "", t) for n, t in texts.items()], "source string, block_seq long, type string, page int, heading string, section_path string, content string")
    kb.ingest(files, blocks)
    ask = ingest.embed_questions(spark.createDataFrame([(1, "the red fox")], "query long, text string"), kb.embed, "")
    chunks = kb.chunks.read()
    found = retrieval.hybrid(chunks, ask, index=kb.sparse.index(), id_col="point_id").join(chunks.select(F.col("point_id").alias("doc"), "source"), "doc")
    assert found.orderBy("rank").first()["source"] == "a.txt" and found.count() == 3
    pinned = retrieval.hybrid(chunks, ask, pin=F.col("source") == "b.txt", pin_sparse=True, id_col="point_id").join(chunks.select(F.col("point_id").alias("doc"), "source"), "doc")
    assert [r["source"] for r in pinned.collect()] == ["b.txt"]
    before = kb.sparse.index().n
    kb.rebuild_sparse()
    assert kb.sparse.index().n == before == 3


def test_ingest_names_no_file_to_the_driver(spark, tmp_path, monkeypatch):
    """A batch's files, however many, are joined: none is a literal of a condition, and none is collected before the summary is looked at."""
    kb = ingest.knowledge_base(spark, str(tmp_path / "kb"), ingest.hashed_embedder(8))
    files = spark.range(40).selectExpr("id as seq", "concat('file', id) as source", "concat('text ', id % 39, ' of a file') as content")
    named, collected, kind = [], [], type(files)
    isin, collect = Column.isin, kind.collect
    monkeypatch.setattr(Column, "isin", lambda self, *names: named.extend(map(str, names)) or isin(self, *names))
    monkeypatch.setattr(kind, "collect", lambda df: collected.append(collect(df)) or collected[-1])
    monkeypatch.setattr(store, "SENT", 0)
    for words in (1, 2):
        batch = files.withColumn("content", F.expr(f"concat(content, repeat(' more', {words}))"))
        found = kb.ingest(batch, batch.selectExpr("source", "0L as block_seq", "'text' as type", "1 as page", "'' as heading", "'' as section_path", "content"))
        assert "file3" not in named and not any(r["source"] for rows in collected for r in rows if "source" in r)
    assert (found.total_chunks, kb.chunks.count(), kb.sparse.index().n, kb.sparse.rows().count(), kb.registry.count()) == (39,) * 5
    assert all(r["content"].endswith("more more") for r in kb.chunks.read().collect())
    assert len(found.files_indexed) == 39 and found.skipped == ["file39"]


def test_index_and_search_shuffle_no_rows_by_query(spark, monkeypatch):
    """Found rows are sent to the documents, and only the k best of each query and part leave the task that scored them."""
    monkeypatch.setattr(postings, "RANGE", 8)
    monkeypatch.setattr(postings, "PART", 64)
    docs = spark.range(600).selectExpr("id as doc_id", "concat_ws(' ', 'common', 'word', concat('w', id % 7), repeat('more ', cast(id % 5 as int))) as content")
    index = postings.posting_index(docs)
    asked = spark.createDataFrame([(k, f"common word w{k}") for k in range(7)], "query long, text string")
    scored = []
    plain = postings._scores
    monkeypatch.setattr(postings, "_scores", lambda *a: scored.append(plain(*a)) or scored[-1])
    got = sorted((r["query"], r["rank"], r["doc"], round(r["score"], 6)) for r in retrieval.search(index, asked, 3).collect())
    assert got == sorted((r["query"], r["rank"], r["doc"], round(r["score"], 6)) for r in retrieval.search(retrieval.sparse_index(docs), asked, 3).collect())
    for rows in scored:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "part" in rows.columns and "hashpartitioning(part" in plan and "hashpartitioning(query" not in plan
        assert rows.groupBy("query", "doc").count().where("count > 1").count() == 0
    found = spark.createDataFrame([(1, 5)], "query long, doc long").checkpoint()
    plan = postings.found_rows(found, docs.withColumnRenamed("doc_id", "doc"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_ranges_of_long_documents_hold_fewer(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id as doc_id", "repeat('long words here ', 20) as content")
    wide = postings.posting_index(docs)
    monkeypatch.setattr(postings, "LONG", 120)
    narrow = postings.posting_index(docs)
    assert wide.blocks.select("range").distinct().count() == 1 < narrow.blocks.select("range").distinct().count()
    assert narrow.blocks.selectExpr("sum(n)").first()[0] == wide.blocks.selectExpr("sum(n)").first()[0] == 40 * 2


def test_cells_pass_on_k_rows_a_query_and_task(spark):
    """Not k rows a query and cell: what leaves the scoring tasks follows queries and tasks alone."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(400)], "doc_id long, vector array<double>")
    index = cells.cell_index(rows, cells=20)
    asked = rows.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query")
    ids, matrix = next(cells._blocks(asked))
    shared = spark.sparkContext.broadcast((ids, matrix, None))
    batches = index.rows.select("cell", "doc", "v").coalesce(1).toArrow().to_batches(max_chunksize=30)
    out = list(cells._scorer(shared, 5, True)(iter(batches)))
    assert sum(b.num_rows for b in out) == 5 * len(ids)
    key = lambda df: sorted((r["query"], r["rank"], r["doc"]) for r in df.collect())
    assert key(cells.cell_knn(index, asked, 5, cells.MOST)) == key(retrieval.knn(rows, asked, 5))
    assert cells.recall(cells.cell_knn(index, asked, 5, 19), retrieval.knn(rows, asked, 5)) > 0.9


def test_texts_are_split_some_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunking, "SLICE", 10)
    texts = pa.array(["abcd", "efgh", None, "x" * 30, "", "é" * 4, "ij", "k"])
    parts = list(chunking.slices(texts))
    assert parts == [(0, 3), (3, 1), (4, 3), (7, 1)]
    assert list(chunking.slices(pa.array([], pa.string()))) == [] and list(chunking.slices(texts.slice(3))) == [(0, 1), (1, 3), (4, 1)]
