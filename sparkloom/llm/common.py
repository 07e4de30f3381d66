"""Pieces that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut, small_batches, stored  # noqa: F401

#: Words are runs of anything but ASCII white space; used in Java regular expressions.
SPACE = r"[ \x09-\x0D]+"
WORD = r"[^ \x09-\x0D]+"

#: A table with at most so many rows may be broadcast.
BROADCAST_ROWS = 200_000

#: Hashes of eight bytes that may be sent to all tasks.
SENT = 1_000_000

#: A key with more rows than this is not shuffled by.
HOT_ROWS = 1_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def with_small(df: DataFrame, small: DataFrame, on: Column, rows: int, how: str = "left") -> DataFrame:
    """Join a table of ``rows`` counted rows: broadcast within BROADCAST_ROWS, else a shuffled join."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def join_counted(df: DataFrame, named: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``df`` joined with one row a key of ``named`` (a written table), whose column ``count`` says how many rows of ``df`` have the key.

    Keys of more than HOT_ROWS rows, at most BROADCAST_ROWS of them, are sent to all tasks, so that their rows stay where they are.
    ``how`` may be "left" where keys of many rows are all named.
    """
    bar = HOT_ROWS
    while (hot := named.where(F.col(count) > bar).count()) > BROADCAST_ROWS:
        bar *= 10
    if not hot:
        return df.join(named.drop(count), key, how)
    large = F.broadcast(named.where(F.col(count) > bar).drop(count))
    rest = df.join(F.broadcast(large.select(key)), key, "left_anti").join(named.where(F.col(count) <= bar).drop(count), key, how)
    return df.join(large, key).unionByName(rest)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """One row of ``docs`` for each (id, text_sha256) of ``kept``; ``digest`` gives a row's own.

    An id alone doesn't name a row where ids are null or repeat: a dropped row would come back with a kept one of its id.
    Both are fields of one struct, in which null equals null; rows that repeat both are merged.

    Rows that go or repeat are few as a rule. Up to SENT of them, their 64-bit hashes are sent to all tasks: rows without such a hash
    are there once and stay, unshuffled, and only the others meet ``kept`` by their whole key.
    """
    row = F.struct(docs[id_col].cast("long").alias("id"), digest.alias("digest"))
    keys = kept.select(F.struct(F.col(id_col).cast("long").alias("id"), F.col("text_sha256").alias("digest")).alias("__kept"))
    counts = stored(docs.select(row.alias("__row")).groupBy("__row").agg(F.count(F.lit(1)).alias("n")))
    short = F.xxhash64("__row.id", "__row.digest").alias("__short")
    odd = counts.join(keys, F.col("__row") == F.col("__kept"), "left_anti").select(short).unionByName(counts.where("n > 1").select(short))
    odd = cut(odd.distinct())
    rows = docs.withColumn("__row", row)

    def exact(some: DataFrame) -> DataFrame:
        return some.join(keys, F.col("__row") == F.col("__kept"), "left_semi").dropDuplicates(["__row"])

    if odd.count() > SENT:
        return exact(rows).drop("__row")
    rows = rows.withColumn("__short", short)
    plain = rows.join(F.broadcast(odd), "__short", "left_anti")
    return plain.unionByName(exact(rows.join(F.broadcast(odd), "__short", "left_semi"))).select(*[F.col(f"`{c}`") for c in docs.columns])
