"""Periodic runs, SentencePiece and collocations against brute force, the library and defined cases."""

import collections
import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from sparkloom.llm import collocations, common, periodic_runs, queries, sentence_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def frame(spark, texts, ids=None, langs=None):
    return spark.createDataFrame([(ids[k] if ids else k, t, langs[k] if langs else "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11: periodic runs


def brute_runs(w, least=6, times=4):
    """(start, length, period) by walking every period."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, times * p):
                found.setdefault((start, i + p), p)
            i += i == start
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_text(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(200))]
    if kind == 1:
        return [rng.randrange(40) for _ in range(10)] + [rng.randrange(40) for _ in range(rng.randrange(1, 20))] * rng.randrange(1, 12) + [rng.randrange(40) for _ in range(rng.randrange(10))]
    if kind == 2:
        return (([rng.randrange(3) for _ in range(3)] * 4 + [5]) * 5 + [7]) * 4
    return []


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (3, 3)])
@pytest.mark.parametrize("together", [periodic_runs.TOGETHER, 50])
def test_runs_are_brute_force(monkeypatch, least, times, together):
    monkeypatch.setattr(periodic_runs, "TOGETHER", together)
    rng = random.Random(least)
    for _ in range(60):
        texts = [np.array(periodic_text(rng), dtype=np.int64) for _ in range(rng.randrange(1, 8))]
        found = zip(*(v.tolist() for v in periodic_runs.runs_of(texts, least, times)), strict=True)
        assert list(found) == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t.tolist(), least, times)]


def test_extensions_are_brute_force_both_ways():
    rng = random.Random(5)
    for _ in range(30):
        body = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 300))]
        s = np.array([100, *body, 101])
        levels = periodic_runs.grammar(s)
        x, y = (np.array(v) for v in zip(*[sorted(rng.sample(range(1, len(s)), 2)) for _ in range(50)], strict=True)) if len(s) > 3 else (np.array([1]), np.array([2]))
        ahead = periodic_runs.extensions(levels, x, y).tolist()
        n = len(s)
        behind = periodic_runs.extensions([v.backwards() for v in levels], n - y, n - x).tolist()
        for a, b, f, g in zip(x.tolist(), y.tolist(), ahead, behind, strict=True):
            assert f == next(k for k in range(n) if b + k == n or s[a + k] != s[b + k])
            assert g == next(k for k in range(n) if a - k == 0 or s[a - 1 - k] != s[b - 1 - k])


def planted(doc_id, text):
    w = re.findall(r"[^ \x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_digests(w):
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query_is_brute_force(spark, tmp_path, small):
    rows = [r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    rng = random.Random(2)
    odd = [None, "", " \n", "a", "a " * 7, "x\x0by\tz " * 9, "é\x85b " * 8] + [" ".join(f"w{v}" for v in periodic_text(rng)) for _ in range(60)]
    docs = [(r["doc_id"], r["text"]) for r in rows] + [(10_000 + k, t) for k, t in enumerate(odd)]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs) > 10
    spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {d: run_digests(planted(d, t)) for d, t in docs}
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got) > 20


def test_periodic_runs_odd_tables(spark):
    df = frame(spark, ["a b " * 6, "a b " * 6, None], ids=[None, None, 3])
    df = df.withColumnsRenamed({"doc_id": "runs", "text": "best"}).withColumn("collapsed", df["lang"])
    got = periodic_runs.periodic_runs(df, id_col="runs", text_col="best").toPandas()
    assert list(got.columns) == ["runs", "runs", "best", "collapsed"] and got["collapsed"].tolist() == ["a b", "a b", ""]
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, times=1)


def test_periodic_runs_of_very_long_texts():
    rng = np.random.default_rng(1)
    for text, expected in (
        (np.zeros(300_000, dtype=np.int64), (0, 300_000, 1)),
        (np.arange(300_000) % 2, (0, 300_000, 2)),
        (np.tile(rng.permutation(50_000), 5), (0, 250_000, 50_000)),
    ):
        began = time.perf_counter()
        found = periodic_runs.runs_of([text])
        assert [tuple(int(v[0]) for v in found[1:])] == [expected] and len(found[0]) == 1
        assert time.perf_counter() - began < 10


# --- 12: SentencePiece


def odd_text(rng, pieces):
    if rng.random() < 0.5:
        pool = ["▁", " ", "  ", " " * 15, " " * 31, "a", "the", "ing", "é", "\U0001f600", "日", "\n", "\t", "\0", "<s>", "<0x41>", "23", "̀", "가", "==", "�"]
        return "".join(rng.choice(pool) for _ in range(rng.randrange(30)))
    return "".join(rng.choice(pieces).replace("▁", rng.choice(" ▁")) for _ in range(rng.randrange(12)))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("bounds", [{}, {"KEPT": 3, "KEPT_PAIRS": 5}, {"KEPT_LENGTH": 0}])
def test_pieces_are_the_librarys(library, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(sentence_pieces, name, value)
    own, rng = sentence_pieces.Pieces(open(MODEL, "rb").read()), random.Random(7)
    names = list(own.ids)
    for _ in range(3000):
        text = odd_text(rng, names)
        ids = library.encode(text)
        assert np.frombuffer(own.encode(text), dtype=np.int32).tolist() == ids and own.decode(ids) == library.decode(ids)
        some = [rng.randrange(32_000 if rng.random() < 0.6 else 300) for _ in range(rng.randrange(12))]
        assert own.decode(some) == library.decode(some)


def test_pieces_without_kept_stretches(library):
    own, rng = sentence_pieces.Pieces(open(MODEL, "rb").read()), random.Random(8)
    own.cuts = False  # the whole text in one table
    for _ in range(500):
        text = odd_text(rng, list(own.ids))
        assert np.frombuffer(own.encode(text), dtype=np.int32).tolist() == library.encode(text)


def test_pieces_of_very_long_texts(library):
    own, rng = sentence_pieces.Pieces(open(MODEL, "rb").read()), random.Random(9)
    for text in ("a" * 10**6, " " * 10**5, "".join(rng.choice("abcdefgh0123") for _ in range(10**5)), "日本" * 10**5, "\U0001f600" * 10**5):
        began = time.perf_counter()
        ids = np.frombuffer(own.encode(text), dtype=np.int32).tolist()
        assert time.perf_counter() - began < 20 and ids == library.encode(text) and own.decode(ids) == text


def test_pieces_that_stand_apart(library):
    own = sentence_pieces.Pieces(open(MODEL, "rb").read())
    for n in (1, 2, 63, 64, 65, 66, 1500):
        for text in ("日" * n, "本日" * n, "ab" + "日" * n, "日" * n + ",", "a " + "本" * n + " b"):
            assert np.frombuffer(own.encode(text), dtype=np.int32).tolist() == library.encode(text)


def test_sentence_pieces_query_is_the_library(spark, tmp_path, library, small):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "▁a", "\U0001f600 x"] + [odd_text(rng, ["the", "▁of", "ing"]) for _ in range(50)]
    texts += [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in queries.op12_sentence_pieces(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[k] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else ""))


def test_sentence_pieces_odd_tables(spark):
    df = frame(spark, ["a b", "a b", None], ids=[None, None, 3]).withColumnsRenamed({"lang": "ids", "source": "decoded"})
    got = sentence_pieces.encode_and_decode(df, MODEL).collect()
    assert [(r["doc_id"], r["decoded"], len(r["ids"])) for r in got] == [(None, "a b", 2), (None, "a b", 2), (3, "", 0)]
    assert sentence_pieces.encode_and_decode(frame(spark, []), MODEL).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>").select(sentence_pieces.decoded(common.F.col("ids"), MODEL).alias("t"))
    assert [r["t"] for r in nulls.collect()] == ["", "", sentencepiece.SentencePieceProcessor(model_file=MODEL).decode([0, 1])]


# --- 13: collocations


def brute_phrases(docs, least, longest, share, top):
    size, f = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            size[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    around = collections.Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, w[i : i + k]] = max(around[lang, w[i : i + k]], a)
    rows = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if 100 * around[lang, w] >= share * a:
            continue
        cuts = [(1000 * a * size[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, r, size[lang], -score)
        for lang, found in rows.items()
        for rank, (score, a, phrase, left, r) in enumerate(sorted(found)[:top], 1)
    )


PHRASES = [({}, 3, 3, 60, 7), ({}, 5, 5, 100, 2000), ({"rows": 0}, 5, 5, 100, 2000), ({"rows": 0, "hot": 1}, 4, 4, 100, 50)]


@pytest.mark.parametrize(("options", "least", "longest", "share", "top"), PHRASES)
def test_collocations_are_brute_force(spark, monkeypatch, options, least, longest, share, top):
    if "rows" in options:
        monkeypatch.setattr(collocations, "BROADCAST_ROWS", options["rows"])
    if "hot" in options:
        monkeypatch.setattr(common, "HOT_ROWS", options["hot"])
    rng = random.Random(least)
    docs = [(None, "en"), ("", None), (" ., ", "fr"), ("a\x0bb a\tb", "en"), ("É é. É é", "de")]
    for _ in range(60):
        w = [rng.choice(["The", "the", "of", "ab", "b", "é", "c.", "d,", "e"]) for _ in range(rng.randrange(40))]
        docs.append((" ".join(w + ["new", "york", "city"] * rng.randrange(3) + ["x"] * rng.randrange(9)), rng.choice(["en", "en", "fr", None])))
    got = collocations.collocations(frame(spark, [d[0] for d in docs], langs=[d[1] for d in docs]), least, longest, share, top)
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, least, longest, share, top)


def test_collocation_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(10**15, 10**15)], "a long, n long").selectExpr("1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) as over", "cast(3 as decimal(19,0)) * cast(10000000000000007 as decimal(19,0)) as under")
    assert df.selectExpr("over div under").first()[0] == 1000 * 10**30 // (3 * 10000000000000007)


def test_collocations_odd_tables(spark):
    df = frame(spark, ["a b"] * 120, ids=[None] * 120).withColumnsRenamed({"source": "phrase", "n_chars": "w1"})
    assert [tuple(r) for r in collocations.collocations(df).collect()] == [("en", 1, "a b", 120, 120, 120, 240, 2000)]
    assert collocations.collocations(frame(spark, [])).count() == 0 == collocations.collocations(frame(spark, ["a b"])).count()
    long = frame(spark, ["a b " * 100_000])
    assert [(r["phrase"], r["a"]) for r in collocations.collocations(long, longest=2).orderBy("rank").collect()] == [("a b", 100_000), ("b a", 99_999)]
    with pytest.raises(ValueError):
        collocations.collocations(df, longest=1)


def test_collocation_windows_meet_no_table_of_pairs(spark, monkeypatch):
    """However many pairs there are, windows are cut where they are made; a full bit table lets more of them pass and changes no count."""
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    rng = random.Random(5)
    docs = [(" ".join(rng.choice(["a", "b", "c", "d.", f"x{rng.randrange(50)}"]) for _ in range(60)), rng.choice(["en", "fr"])) for _ in range(30)]
    df = frame(spark, [d[0] for d in docs], langs=[d[1] for d in docs])
    joined = []
    plain = collocations.join_counted
    monkeypatch.setattr(collocations, "join_counted", lambda rows, *more: joined.append(rows.columns) or plain(rows, *more))
    counts = [sorted(map(tuple, collocations.phrase_counts(df, 4)[1].collect()))]
    assert not joined and any(words > 2 for _, words, _, _ in counts[0])
    table = collocations._bit_table
    monkeypatch.setattr(collocations, "_bit_table", lambda hashes: np.full(64, -1))
    counts.append(sorted(map(tuple, collocations.phrase_counts(df, 4)[1].collect())))
    assert counts[0] == counts[1]
    monkeypatch.setattr(collocations, "_bit_table", table)
    for sifted in (2, 4, 5):
        monkeypatch.setattr(collocations, "SIFTED", sifted)
        assert sorted(map(tuple, collocations.phrase_counts(df, 4)[1].collect())) == counts[0]
    table = np.zeros(64, dtype=np.int64)
    assert collocations.cut_windows(collocations.pieces(df), [table], 5).count() == 0


def test_collocation_texts_are_split_as_arrays(spark, monkeypatch):
    """Words, hashes and counts don't depend on how texts are sliced or hashes are sorted and grouped."""
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 10**6)
    rng, docs = random.Random(8), [("A" * 300 + " b." + "A" * 300 + " b", None), ("\tA  b\r\x0cA b", "fr"), ("É\u00a0b É\u00a0b", "fr"), ("...", "en"), ("İK a", "en"), ("", "en"), (None, "en")]
    docs += [(" ".join(rng.choice(["a", "B", "c.", "É", "日本", "x"]) for _ in range(rng.randrange(50))), rng.choice(["en", "fr", None])) for _ in range(40)]
    df, want = frame(spark, [d[0] for d in docs], langs=[d[1] for d in docs]), brute_phrases(docs, 2, 5, 100, 2000)
    for slice_, held, group in ((1, 1, 1), (100, 50, 64), (1 << 22, 1 << 22, 1 << 21)):
        for name, value in (("SLICE", slice_), ("HELD", held), ("GROUP", group)):
            monkeypatch.setattr(collocations, name, value)
        assert sorted(map(tuple, collocations.collocations(df, 2).collect())) == want
    plan = collocations.frequent_hashes(collocations.pieces(df), [], 2, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "translate" not in plan  # no row for each pair, and texts are not rebuilt by Spark's translate
