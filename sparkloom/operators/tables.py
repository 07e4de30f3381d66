"""Tables as documents: cleaning, summaries, markdown and JSON renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from sparkloom.functions.text import stripped


def clean(df: DataFrame) -> DataFrame:
    """Strip strings, then drop rows and columns without any value."""
    df = df.select(*[stripped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema.fields]).dropna("all")
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first() if df.columns else None
    return df.select(*[c for c in df.columns if counts[c]])


def summary(df: DataFrame) -> DataFrame:
    """One row per column: its null count and, for numbers, minimum, maximum and mean."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    sums = [F.count(F.lit(1)).alias("rows")]
    for c in df.columns:
        sums.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if c in numeric:
            sums += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"), F.round(F.avg(c), 4).alias(f"{c}__mean")]
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__nulls").alias("nulls"), *[(F.col(f"{c}__{k}") if c in numeric else none).alias(k) for k in ("min", "max", "mean")]) for c in df.columns]
    return df.agg(*sums).select("rows", F.explode(F.array(*cells)).alias("c")).select("rows", "c.*")


def _row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(stripped(c.cast("string")), F.lit("")) for c in cells]), F.lit(" |"))


def markdown(df: DataFrame, order: str, max_rows: int = 50) -> DataFrame:
    """The first rows as one markdown table."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "|".join(["---"] * len(df.columns)) + "|"
    rows = df.orderBy(order).limit(max_rows).select(F.col(order).alias("o"), _row([F.col(c) for c in df.columns]).alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("body")).select(F.concat(F.lit(head + "\n"), F.col("body")).alias("markdown"))


def json_rows(df: DataFrame, order: str) -> DataFrame:
    return df.select(F.col(order).alias("row"), F.to_json(F.struct(*df.columns)).alias("json"))


def to_chunk(df: DataFrame, source: str, order: str, form: str = "markdown", max_rows: int = 50) -> DataFrame:
    """A table as one chunk; the JSON form has all rows."""
    if form == "markdown":
        text = markdown(df, order, max_rows).select(F.col("markdown").alias("content"))
    elif form == "json":
        rows = json_rows(df, order)
        text = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("content"))
    else:
        raise ValueError(f"unknown form {form}")
    return text.select("content", F.lit(source).alias("source"), F.lit("table").alias("type"), F.lit(None).cast("int").alias("page"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or the sheets of an Excel file where pandas can read them; by extension."""
    name = path.lower()
    if name.endswith(".csv"):
        return clean(spark.read.csv(path, header=True, inferSchema=True))
    if name.endswith((".xlsx", ".xls")):
        from sparkloom.sources.blocks import excel_rows

        return excel_rows(spark, path)
    raise ValueError(f"unsupported file type: {path}")


def to_chunks(spark: SparkSession, path: str, form: str = "markdown", max_rows: int = 50) -> DataFrame:
    """Every table of a file as a chunk (content, source, type, page), by the file's kind: CSV, the sheets of Excel, or the tables of HTML."""
    name, lower = path.rsplit("/", 1)[-1], path.lower()
    if lower.endswith((".html", ".htm")):
        from sparkloom.sources.blocks import html_tables

        page = spark.read.text(path, wholetext=True).select(F.lit(name).alias("url"), F.col("value").alias("html"))
        return html_tables(page, max_rows=max_rows).select("content", "source", "type", "page")
    rows = read_table(spark, path)
    if lower.endswith(".csv"):
        return to_chunk(rows, name, rows.columns[0], form, max_rows)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "json"))), lambda x: x["json"])
    sheets = rows.where(F.lit(form == "json") | (F.col("row") < max_rows)).groupBy("source").agg(lines.alias("lines"))
    return sheets.select(F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]")).alias("content"), "source", F.lit("table").alias("type"), F.lit(None).cast("int").alias("page"))
