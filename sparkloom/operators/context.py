"""What a model is shown: context blocks under a budget, citations, prompts, and chat history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import chunk_icon, context_block, image_url, or_else, short_section, stripped
from sparkloom.schema import Settings


def budgeted(rows: DataFrame, budget: int = Settings.context_budget) -> DataFrame:
    """Blocks in rank order up to the first that does not fit; lengths are positive, so a running sum says so."""
    blocks = rows.withColumn("block", context_block(F.col("source"), F.col("page"), F.col("section_path"), F.col("heading"), F.col("content")))
    used = F.sum(F.length("block")).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("used", used).where(F.col("used") <= budget)


def context(rows: DataFrame, budget: int = Settings.context_budget) -> DataFrame:
    """(query, context)"""
    lists = budgeted(rows, budget).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return lists.select("query", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def citations(rows: DataFrame, key: Column) -> DataFrame:
    """The first row of each key and query, in rank order."""
    first = Window.partitionBy("query", key).orderBy("rank")
    return rows.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")


def page_key() -> Column:
    return F.concat_ws("|", "source", F.coalesce(F.col("page").cast("string"), F.lit("None")))


def parent_key() -> Column:
    return or_else(F.col("parent_id"), page_key())


def citation_rows(rows: DataFrame) -> DataFrame:
    """The first row of each parent, else of each source and page, as the five fields that a client gets."""
    first = citations(rows, parent_key())
    return first.select("query", "rank", F.coalesce("source", F.lit("unknown")).alias("source"), "page", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("section_path", F.lit("")).alias("section_path"), F.coalesce("type", F.lit("text")).alias("type"))


def citation_marks(rows: DataFrame) -> DataFrame:
    """(query, rank, source, page, icon, section): citations by source and page as an interface shows them."""
    first = citations(rows, page_key())
    return first.select("query", "rank", "source", "page", chunk_icon(F.col("type")).alias("icon"), short_section(or_else(F.col("section_path"), F.col("heading"))).alias("section"))


def format_citations(cited: DataFrame) -> DataFrame:
    """(query, citations): the numbered list of (query, rank, source, page, heading, section_path)."""
    section = or_else(F.col("section_path"), F.col("heading"))
    tail = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" ["), section, F.lit("]"))).otherwise("")
    line = F.concat("source", F.coalesce(F.concat(F.lit(", p."), F.col("page").cast("string")), F.lit("")), tail)
    lists = cited.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("c"))
    numbered = F.transform("c", lambda x, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), x["line"]))
    return lists.select("query", F.concat(F.lit("Sources:\n"), F.array_join(numbered, "\n")).alias("citations"))


def images(rows: DataFrame, present: DataFrame) -> DataFrame:
    """(query, rank, path, url) of image hits whose file is there, at its own path or by name among ``present`` (path, name)."""
    wanted = rows.where((F.col("type") == "image") & (F.coalesce("image_path", F.lit("")) != "")).select("query", "rank", "image_path", F.element_at(F.split("image_path", "/"), -1).alias("name"))
    paths, names = present.select(F.col("path").alias("own")).distinct(), present.groupBy("name").agg(F.min("path").alias("other"))
    found = wanted.join(paths, F.col("image_path") == F.col("own"), "left").join(names, "name", "left").withColumn("path", F.coalesce("own", "other")).where("path is not null")
    return found.select("query", "rank", "path", image_url(F.col("path")).alias("url"))


def prompt(context_col: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context_col, F.lit("\n\nQuestion: "), question)


def offline_view(rows: DataFrame) -> DataFrame:
    """The projection for clients without a model: parent text first, score with four places."""
    return rows.select("query", "rank", or_else(F.col("parent_content"), F.col("content")).alias("content"), "source", "page", F.col("type").alias("chunk_type"), F.round("score", 4).alias("score"))


def chat_window(turns: DataFrame, max_turns: int = Settings.max_turns) -> DataFrame:
    """What each conversation holds: the last ``2 * max_turns`` messages as of its last user message, and all since.

    Only a user's message trims, so the window may begin with a reply and hold more for a while.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("place", F.row_number().over(w))
    asked = F.max(F.when(F.col("role") == "user", F.col("place"))).over(Window.partitionBy("conv_id"))
    return rows.withColumn("asked", asked).where(F.col("asked").isNull() | (F.col("place") > F.col("asked") - 2 * max_turns)).drop("place", "asked")


def summary_inputs(turns: DataFrame, every: int = Settings.summary_every, cut: int = 200) -> DataFrame:
    """At every ``every``-th reply with four messages or more: the last ``2 * every`` messages, each cut short, for a summariser."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    replies = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w)
    line = F.concat(F.upper("role"), F.lit(": "), F.substring("text", 1, cut))
    rows = turns.withColumn("replies", replies).withColumn("seen", F.row_number().over(w)).withColumn("messages", F.collect_list(line).over(w.rowsBetween(1 - 2 * every, 0)))
    return rows.where((F.col("role") == "assistant") & (F.col("replies") % every == 0) & (F.col("seen") >= 4)).select("conv_id", "turn", "replies", F.array_join("messages", "\n").alias("input"))


#: Fixed value: what a summariser is asked.
SUMMARY_PROMPT = "Summarise this conversation in exactly 2 sentences, focusing on key facts and topics discussed:\n\n"


def rolling_summary(turns: DataFrame, summarise: Callable[[Column], Column], every: int = Settings.summary_every) -> DataFrame:
    """(conv_id, turn, summary) of each conversation's last due summary; ``summarise`` is the caller's model as a column function."""
    due = summary_inputs(turns, every).groupBy("conv_id").agg(F.max_by("input", "turn").alias("input"), F.max("turn").alias("turn"))
    return due.select("conv_id", "turn", stripped(summarise(F.concat(F.lit(SUMMARY_PROMPT), F.col("input")))).alias("summary"))


def stored_and_sent(turns: DataFrame, prompts: DataFrame) -> DataFrame:
    """(conv_id, turn, stored, sent): history keeps the clean question; the call sees the prompt with context in its place."""
    sent = prompts.select("conv_id", "turn", "prompt")
    return turns.where("role = 'user'").join(sent, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").alias("stored"), F.coalesce("prompt", "text").alias("sent"))


def last_user_message(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def model_messages(turns: DataFrame, system: str, summary_col: str | None = None) -> DataFrame:
    """The message list of each conversation: system prompt, with a summary if there is one, then the turns."""
    head = F.lit(system)
    if summary_col:
        s = F.coalesce(F.first(summary_col, ignorenulls=True), F.lit(""))
        head = F.when(s != "", F.concat(F.lit(system + "\n\n[Conversation summary: "), s, F.lit("]"))).otherwise(F.lit(system))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), head.alias("head"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.col("head").alias("content")))
    return lists.select("conv_id", F.concat(first, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"))
