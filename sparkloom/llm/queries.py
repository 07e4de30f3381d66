"""The registered corpus queries, one per operator, over whole tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.runtime import table

from . import collocations, decontaminate, exact_dedup, html_extract, language_id, license_scan, mixing, periodic_runs, secret_scan, sentence_pieces, simhash, substring_dedup, token_count
from .common import SPACE


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def first_half(id_col: str = "doc_id"):
    """The part of a table that plays the held snapshot when a query has no other; the rest is the new batch."""
    return F.xxhash64(F.col(id_col), F.lit("snapshot")) < 0


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), first_half())


@cache
def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.identify(docs, model)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``documents`` with op11's planted repeats: with h = crc32 of the decimal id and g = h // 10, a text of n words where h ends in 0 repeats,
    from word a = g % n on, a passage of 1 + (n - a) // (3 + g % 8) words."""
    h, w = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("__words")
    g, n = F.floor(h / 10), F.size(w)
    a = (g % n).cast("int")
    p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")))), " ")
    planted = (h % 10 == 0) & F.col("text").isNotNull()
    split = docs.withColumn("__words", F.when(planted, F.filter(F.split("text", SPACE), lambda x: x != "")))
    split = split.withColumns({"__a": F.when(n > 0, a), "__p": F.when(n > 0, p)})
    return split.withColumn("text", F.when(F.col("__a").isNotNull(), repeated).otherwise(F.col("text"))).drop("__words", "__a", "__p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    best = F.get("runs", F.col("best"))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * runs[best].length div runs[best].period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_QUERIES = (op1_substring_dedup, op2_secret_scan, op3_decontaminate, op4_exact_dedup, op5_token_counts, op6_html_extract, op7_simhash, op8_mixing, op9_language_id, op10_license_scan, op11_periodic_runs, op12_sentence_pieces, op13_collocations)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), first_doc AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h
), marked AS (SELECT doc_id, i FROM windows JOIN first_doc USING (h) WHERE d < doc_id
), gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM marked)
), each AS (
  SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM words)
), kept AS (
  SELECT e.doc_id, count(g.j) AS n_removed, sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.j) FILTER (WHERE g.j IS NULL), '')) AS kept_sha256
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_OP4_SQL = """
WITH norm AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM norm WINDOW g AS (PARTITION BY text_sha256)
"""


_OP13_SQL = r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(p) AS piece, unnest(range(len(p))) AS k FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM (SELECT row_number() OVER () AS doc_id, lang, text FROM documents))
), words AS (
  SELECT doc_id, lang, k, unnest(w) AS w1, unnest(range(len(w))) AS i
  FROM (SELECT doc_id, lang, k, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces)
), lead_words AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5
  FROM words WINDOW p AS (PARTITION BY doc_id, k ORDER BY i)
), f AS (
  SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM lead_words GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM lead_words WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM lead_words WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM lead_words WHERE w4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM lead_words WHERE w5 IS NOT NULL GROUP BY ALL
), frequent AS (SELECT * FROM f WHERE f >= 100
), n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang
), cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM frequent WHERE m > 1)
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.head JOIN frequent r ON r.lang = c.lang AND r.phrase = c.tail JOIN n ON n.lang = c.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, a, array_to_string(w[s:s + j - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - j + 2)) AS s FROM (SELECT lang, m, f AS a, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS j FROM frequent WHERE m > 2))
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank, phrase, a, l, r, n, score
  FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 100 * c.a)
)
SELECT * FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are tested against brute force in tests/llm."""
    return {"op1_substring_dedup": _OP1_SQL, "op4_exact_dedup": _OP4_SQL, "op13_collocations": _OP13_SQL}
