"""Documents, pages and binary files as blocks with an explicit order."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import block_type, filled, heading_level, image_label, is_bullet, stripped
from sparkloom.operators.chunking import heading_paths

BLOCK = "block_seq long, type string, level int, content string"


def line_blocks(docs: DataFrame, source: str = "doc_id", text: str = "text") -> DataFrame:
    """Each non-blank line of a document as a block; short lines stand for headings, by their length."""
    rows = docs.select(F.col(source).cast("string").alias("source"), F.posexplode(F.split(F.col(text), "\n")).alias("block_seq", "content")).where(filled(F.col("content")))
    size = F.length("content")
    kind = F.when(size < 40, "heading").when(is_bullet(F.col("content")), "bullet").otherwise("text")
    level = F.when(size < 40, F.when(size < 10, 1).when(size < 20, 2).otherwise(3))
    return rows.select("source", F.col("block_seq").cast("long").alias("block_seq"), "content", F.lit(None).cast("int").alias("page"), kind.alias("type"), level.cast("int").alias("level"))


def span_blocks(spans: DataFrame, page_sizes: DataFrame | None = None) -> DataFrame:
    """Blocks from font spans (source, page, block, line, span, text, size, and box x0, y0, x1, y1 if known): body size per page is the upper median.

    Spans of a line are joined, lines of a block are joined by new lines, and the block's largest span classifies it. Every block gets
    the box around its spans (``bbox``, null where no span has one), the size of its page from ``page_sizes`` (source, page, width,
    height), and its place among headings: ``section_path`` joins the open headings from the highest level down, the block itself included if it
    is one, and ``heading`` is the last of them. Headings stay open across pages until one of the same or a higher level comes.
    """
    sides = ("x0", "y0", "x1", "y1")
    boxed = spans.withColumns({c: F.lit(None).cast("double") for c in sides if c not in spans.columns})
    body = spans.where(filled(F.col("text"))).groupBy("source", "page").agg(F.array_sort(F.collect_list("size")).alias("s")).select("source", "page", F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("body"))
    around = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    held = lambda c: F.when(filled(F.col("text")), c)
    lines = boxed.groupBy("source", "page", "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(held(F.struct("span", "text")))), lambda x: x["text"]), "").alias("text"), F.max(held(F.col("size"))).alias("size"), *around)
    blocks = lines.groupBy("source", "page", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line", stripped(F.col("text")).alias("text"))))), lambda x: x["text"]), "\n").alias("content"), F.max("size").alias("size"), *around)
    typed = blocks.where("content <> ''").join(body, ["source", "page"]).withColumn("type", block_type(F.col("size"), F.col("body"), F.col("content")))
    order = F.row_number().over(Window.partitionBy("source").orderBy("page", "block")) - 1
    typed = typed.withColumn("level", F.when(F.col("type") == "heading", heading_level(F.col("size"), F.col("body")))).withColumn("block_seq", order.cast("long"))
    box = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in sides]) == 0, F.array(*[F.round(c, 2) for c in sides]))
    out = heading_paths(typed.withColumn("bbox", box), heading="heading").withColumnRenamed("path", "section_path").drop("size", "body", *sides)
    if page_sizes is None:
        return out.withColumns({"page_width": F.lit(None).cast("double"), "page_height": F.lit(None).cast("double")})
    sizes = page_sizes.groupBy("source", "page").agg(*[F.round(F.max(c), 2).alias(f"page_{c}") for c in ("width", "height")])
    return out.join(sizes, ["source", "page"], "left")


class _Blocks(HTMLParser):
    KINDS = {**{f"h{n}": ("heading", n) for n in range(1, 7)}, "p": ("text", None), "li": ("bullet", None), "td": ("text", None), "th": ("text", None)}

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, int | None, str]] = []
        self.rows: list[list[list[str]]] = []
        self.open: tuple[str, int | None] | None = None
        self.text: list[str] = []
        self.skip = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and self.rows and self.rows[-1] and self.rows[-1][-1] is not None and self.open:
            self.rows[-1][-1].append(text)
        elif text and self.open:
            self.found.append((*self.open, text))
        self.text, self.open = [], None

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.flush()
            self.rows[-1].append([])
        elif tag in self.KINDS:
            self.flush()
            self.open = self.KINDS[tag]

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.KINDS:
            self.flush()
        elif tag == "table" and self.rows:
            self.flush()
            rows = [r for r in self.rows.pop() if r]
            if len(rows) >= 2:
                head, *rest = ("| " + " | ".join(r) + " |" for r in rows)
                self.found.append(("table", None, "\n".join([head, "|" + "|".join(["---"] * len(rows[0])) + "|", *rest])))

    def handle_data(self, data) -> None:
        if not self.skip:
            self.text.append(data)


def html_block_list(page: str | None) -> list[tuple[str, int | None, str]]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.found


def html_blocks(pages: DataFrame, source: str = "url", html: str = "html") -> DataFrame:
    """Headings, paragraphs, list items and tables of HTML pages, in order."""

    @F.arrow_udf("array<struct<type: string, level: int, content: string>>")
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("content", pa.string())]))
        return pa.array([[dict(zip(("type", "level", "content"), b, strict=True)) for b in html_block_list(p)] for p in column.to_pylist()], kind)

    rows = pages.select(F.col(source).alias("source"), F.posexplode(run(F.col(html))).alias("block_seq", "b"))
    return rows.select("source", F.col("block_seq").cast("long").alias("block_seq"), "b.content", F.lit(None).cast("int").alias("page"), "b.type", "b.level")


def html_tables(pages: DataFrame, source: str = "url", html: str = "html", max_rows: int = 50) -> DataFrame:
    """Each table of a page as one chunk of its own source, ``page::table_i``: (source, table, content, type, page)."""
    found = html_blocks(pages, source, html).where("type = 'table'")
    number = F.row_number().over(Window.partitionBy("source").orderBy("block_seq")) - 1
    lines = F.slice(F.split("content", "\n"), 1, max_rows + 2)  # a head, its rule, and the rows
    rows = found.withColumn("table", number).withColumn("content", F.array_join(lines, "\n"))
    return rows.select(F.concat("source", F.lit("::table_"), F.col("table").cast("string")).alias("source"), "table", "content", "type", "page")


#: Fixed value: images of fewer bytes are icons and rules.
LEAST_IMAGE = 5_000


def image_blocks(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images (source, page, figure, bytes, path) as blocks, labelled by the text of their page (source, page, text)."""
    rows = images.where(F.col("bytes") >= LEAST_IMAGE).join(pages.select("source", "page", "text"), ["source", "page"], "left")
    return rows.select("source", "page", "figure", F.lit("image").alias("type"), F.lit(None).cast("int").alias("level"), image_label(F.col("page"), F.col("figure"), F.col("text"), F.col("source")).alias("content"), F.col("path").alias("image_path"))


def united(text: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """All blocks of each source in one order: its text, its tables, then its images; block_seq counts from zero again.

    text and tables: (source, block_seq, type, level, page, content); images: as ``image_blocks`` gives.
    """
    columns = ["source", "kind", "at", "type", "level", "page", "content", "image_path"]
    part = lambda df, kind, at, path: df.withColumns({"kind": F.lit(kind), "at": at, "image_path": path}).select(*columns)
    own = [part(df, kind, F.col("block_seq"), F.lit("")) for kind, df in enumerate((text, tables))]
    every = own[0].unionByName(own[1]).unionByName(part(images, 2, F.col("page") * 100_000 + F.col("figure"), F.col("image_path")))
    order = F.row_number().over(Window.partitionBy("source").orderBy("kind", "at")) - 1
    return every.withColumn("block_seq", order.cast("long")).drop("kind", "at")


def binary_blocks(spark: SparkSession, path: str, extractor: Callable[[str, bytes], list[tuple[str, int | None, int | None, str]]], pattern: str = "*.pdf") -> DataFrame:
    """Blocks of binary files by an extractor: (path, bytes) -> [(type, level, page, content)].

    A file that the extractor rejects gives no block and does not stop the others; ``error`` rows say why.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source", "block_seq", "type", "level", "page", "content"]
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = name.rsplit("/", 1)[-1]
                try:
                    rows += [(source, k, t, level, page, c) for k, (t, level, page, c) in enumerate(extractor(source, data)) if c.strip()]
                except Exception as x:  # one bad file must not stop a load
                    rows.append((source, -1, "error", None, None, str(x)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names)

    return files.mapInArrow(run, "source string, block_seq long, type string, level int, page int, content string")


def text_extractor(name: str, data: bytes) -> list[tuple[str, int | None, int | None, str]]:
    """The built-in extractor: UTF-8 text, a page per form feed, a block per paragraph."""
    return [("text", None, n + 1, p) for n, page in enumerate(data.decode().split("\f")) for p in page.split("\n\n")]


def excel_rows(spark: SparkSession, path: str) -> DataFrame:
    """(source, row, json) of every non-empty sheet, read where the file is."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sheet, pdf in pd.read_excel(io.BytesIO(data), sheet_name=None).items():
                    pdf = pdf.dropna(how="all").dropna(how="all", axis=1)
                    if len(pdf):
                        lines = pdf.to_json(orient="records", lines=True).splitlines()
                        yield pa.RecordBatch.from_arrays([pa.array([f"{name.rsplit('/', 1)[-1]}::{sheet}"] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array(lines)], ["source", "row", "json"])

    return files.mapInArrow(run, "source string, row long, json string")


def server_events(lines: DataFrame, schema: str) -> DataFrame:
    """``data: {json}`` lines of an event stream as rows; lines whose data is no whole JSON object are left out.

    A field that an object lacks, or has of another type, is null.
    """
    data = stripped(F.substring("value", 7, (1 << 31) - 1))
    found = lines.where(F.col("value").startswith("data: ")).select(data.alias("data"))
    # JSON functions stop at the end of a value: what follows it shows inside a list and inside an object.
    one = (F.json_array_length(F.concat(F.lit("["), "data", F.lit("]"))) == 1) & F.json_object_keys(F.concat(F.lit('{"v":'), "data", F.lit("}"))).isNotNull()
    found = found.where(one & F.json_object_keys("data").isNotNull())
    return found.select(F.from_json("data", schema).alias("e")).select("e.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, sha256, url) of a JSON manifest."""
    docs = spark.read.schema("docs array<struct<filename: string, sha256: string, url: string>>").json(path, multiLine=True)
    return docs.select(F.explode("docs").alias("d")).select("d.*")


def image_text_chunks(ocr: DataFrame, least: int = 20) -> DataFrame:
    """OCR words (source, seq, word, conf) as one chunk per image: confident words only, 20 characters or more."""
    rows = ocr.where((F.col("conf") > 0) & filled(F.col("word")))
    out = rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]), " ").alias("content"), F.round(F.avg("conf"), 2).alias("confidence"))
    return out.where(F.length("content") >= least).withColumn("type", F.lit("image"))
