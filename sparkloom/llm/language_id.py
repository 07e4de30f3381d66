"""Language identification by compression with per-language dictionaries.

Training takes, for each language, whole texts in hash order of their ids until ``DICTIONARY`` bytes are full, from at
most ``TEXTS`` texts, and makes them a raw-content Zstandard dictionary. A text goes to the language whose dictionary
compresses it to the fewest bytes. Letters alone are compared: text is lower-cased and everything else is one space.
Text is compressed in pieces of ``PIECE`` bytes, each against the dictionary afresh, and sizes are summed over all pieces:
a dictionary saves a bounded number of bytes in one run, so the saved part of a long text compressed at once goes to zero.

``score`` is the saved part, (second - first) / second of the two smallest sizes. Where it is narrow, sizes are taken
again at a finer level. A text is rejected when it has no letter, and when it stays below ``MARGIN``; ties always are.

Defined cases: null text and text without letters give ``und`` with score zero; equal sizes go to the first language
in code-point order; without any training row every text is ``und``; all pieces of very long texts are compressed.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Bounds of the training sample, for each language.
TEXTS, DICTIONARY = 400, 96 << 10
#: Rows beyond twice TEXTS that are looked at, so that chance leaves none wanted.
SPARE = 200
LEVEL, MARGIN = 6, 0.005
#: Bytes of a text that are compressed together.
PIECE = 16 << 10
#: Where the two smallest sizes are closer than NARROW of the second, the text is compressed again at level FINE.
NARROW, FINE = 0.04, 12
_OTHER = regex.compile(r"[^\p{L}]+")
UNKNOWN = "und"

Model = tuple[tuple[str, bytes], ...]


def letters(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", texts: int = TEXTS, size: int = DICTIONARY) -> Model:
    """Per-language dictionaries; the driver gets at most ``texts`` texts a language, cut to ``size`` characters together."""
    rows = small_batches(df).where(df[lang_col].isNotNull() & (F.length(df[text_col]) > 0)).select(df[lang_col].cast("string").alias("lang"), df[text_col].cast("string").alias("text"), F.xxhash64(df[id_col].cast("string")).alias("h"))
    # The hashes of a language are even, so those up to about twice as many as are wanted are known from its count; these narrow
    # rows find the language's last hash, and only the texts up to it are then read out.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    bars = counts.select("lang", (F.least(F.lit(1.0), (2.0 * texts + SPARE) / F.col("n")) * (2.0**64) - 2.0**63).alias("bar"))
    near = rows.join(F.broadcast(bars), "lang").where(F.col("h").cast("double") <= F.col("bar"))  # a row per language
    order = Window.partitionBy("lang").orderBy("h")
    first = near.select("lang", "h", F.length("text").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= texts)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = first.withColumn("before", before).where(F.col("before") < size).groupBy("lang").agg(F.max("h").alias("last")).collect()
    if not last:
        return ()
    chosen = F.broadcast(df.sparkSession.createDataFrame([(r["lang"], r["last"]) for r in last], "lang string, last long"))  # a row per language
    found: dict[str, list[str]] = {}
    for r in rows.join(chosen, "lang").where("h <= last").orderBy("lang", "h", "text").toLocalIterator():
        found.setdefault(r["lang"], []).append(letters(r["text"]))
    return tuple((lang, " ".join(t).encode()[:size]) for lang, t in sorted(found.items()))


@lru_cache(maxsize=2)
def _compressors(model: Model, level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def predict(text: str | None, model: Model, level: int = LEVEL, margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score, accepted)."""
    plain = letters(text)
    if not plain or not model:
        return UNKNOWN, 0.0, False
    data = f" {plain} ".encode()
    pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
    for at in (level, FINE):
        sizes = sorted((sum(len(c.compress(x)) for x in pieces), lang) for lang, c in _compressors(model, at))
        first, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else 2 * sizes[0][0]
        score = (second - first) / second
        if score >= NARROW:
            break
    return sizes[0][1], score, second > first and score >= margin


def classifier(model: Model, level: int = LEVEL, margin: float = MARGIN):
    """A column function: text -> struct(lang, score, accepted)."""
    shared = model

    @F.arrow_udf("struct<lang: string, score: double, accepted: boolean>")
    def classify(texts: pa.Array) -> pa.Array:
        rows = [predict(t, shared, level, margin) for t in texts.to_pylist()]
        lang, score, accepted = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["lang", "score", "accepted"])

    return classify


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves remainder two by four."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, accepted."""
    found = small_batches(df).select(df[id_col], held_out(df[id_col]).alias("held_out"), classifier(model)(df[text_col].cast("string")).alias("found"))
    return found.select(id_col, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.accepted").alias("accepted"))
