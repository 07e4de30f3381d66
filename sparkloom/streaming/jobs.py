"""Streaming forms: store sync, arrival of files, status edges, conversation memory and summaries.

Operators that keep state of their own ask for the RocksDB provider in ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators import keytree
from sparkloom.operators.context import SUMMARY_PROMPT
from sparkloom.operators.keytree import KeyTree
from sparkloom.operators.store import SENT, ChunkStore
from sparkloom.runtime import cut
from sparkloom.schema import Settings


def sync_into(changes: DataFrame, store: ChunkStore, checkpoint: str, every: str | None = None, order: str | None = None, deleted: str | None = None) -> StreamingQuery:
    """Apply each micro-batch of changes to a store; one query per checkpoint, so no two syncs overlap.

    Of a key's changes in a batch the last by ``order`` counts, and rows whose ``deleted`` is true take their key out. Both
    are by key, so a batch that runs again after a failure changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.persist()
        if order:
            last = batch.groupBy(store.key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").persist()
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        if last.where(~gone).limit(1).count():
            store.upsert(last.where(~gone))
        if last.where(gone).limit(1).count():
            store.delete_by_ids(last.where(gone))
        last.unpersist()
        batch.unpersist()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def reconcile(cloud: DataFrame, store: ChunkStore) -> tuple[int, int]:
    """Bring a store in step with an authoritative table by id: (rows pulled, rows deleted); nothing is written where there is nothing to do."""
    local = store.read().select(store.key)
    pull = cloud.join(local, store.key, "left_anti")
    added = pull.count()
    if added:
        store.upsert(pull)
    stale = local.join(cloud.select(store.key), store.key, "left_anti")
    return added, store.delete_by_ids(stale)


def reconcile_trees(cloud: DataFrame, cloud_tree: KeyTree, store: ChunkStore, tree: KeyTree) -> tuple[int, int]:
    """As ``reconcile``, with the trees of both sides' keys: keys of ranges that are equal are not read, and ``tree`` follows the store.

    The store changes first. Should its tree's change fail, the next sync does the same rows again, which changes nothing in the store.
    """
    todo = cut(keytree.plan(cloud_tree, tree))
    pull, stale = (todo.where(F.col("action") == a).select(store.key) for a in ("pull", "delete"))
    added = pull.count()
    if added:
        store.upsert(cloud.join(F.broadcast(pull) if added <= SENT else pull, store.key, "left_semi"))
    deleted = store.delete_by_ids(stale)
    tree.change(pull, stale)
    return added, deleted


def sync_every(ticks: DataFrame, cloud: Callable[[], DataFrame], store: ChunkStore, checkpoint: str, every: str = "20 minutes") -> StreamingQuery:
    """``reconcile`` at each trigger of a stream of ticks; a sync that fails is tried again at the next one."""

    def apply(_: DataFrame, number: int) -> None:
        try:
            reconcile(cloud(), store)
        except Exception as x:  # the loop outlives a failed sync
            print(f"sync {number} failed: {x}")

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class _Edges(StatefulProcessor):
    """Emits a row when a key's status changes; the state is the last status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts")
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for ts, status in zip(frame["ts"], frame["status"], strict=True):
            if last is not None and status != last:
                out.append((key[0], ts, last, status))
            last = status
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["key", "ts", "before", "status"])

    def close(self) -> None:
        pass


def status_edges(samples: DataFrame, key: str = "key") -> DataFrame:
    """(key, ts, before, status) of a stream of (key, ts, status)."""
    return samples.groupBy(key).transformWithStateInPandas(_Edges(), "key long, ts timestamp, before string, status string", "Append", "None")


def _memory(limit: int):
    class Memory(StatefulProcessor):
        """The last messages of a conversation; trimmed when a user's message comes in."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getListState("kept", "turn long, role string, text string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            kept = list(self.kept.get())
            for r in pd.concat(list(rows)).sort_values("turn").itertuples():
                kept.append((int(r.turn), r.role, r.text))
                if r.role == "user":
                    kept = kept[-limit:]
            self.kept.put(kept)
            yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [len(kept)], "first_turn": [kept[0][0]], "last_turn": [kept[-1][0]]})

        def close(self) -> None:
            pass

    return Memory()


def conversation_memory(turns: DataFrame, max_turns: int) -> DataFrame:
    """What each conversation remembers after every batch of (conv_id, turn, role, text)."""
    return turns.groupBy("conv_id").transformWithStateInPandas(_memory(2 * max_turns), "conv_id long, n_messages long, first_turn long, last_turn long", "Update", "None")


def _summaries(summarise: Callable[[str], str], every: int, cut: int):
    class Summaries(StatefulProcessor):
        """A conversation's last messages, how many messages and replies it has had, and its summary."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.recent = handle.getListState("recent", "line string")
            self.counts = handle.getValueState("counts", "seen long, replies long")
            self.summary = handle.getValueState("summary", "turn long, text string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            recent = [r[0] for r in self.recent.get()]
            seen, replies = tuple(self.counts.get()) if self.counts.exists() else (0, 0)
            found = None
            for r in pd.concat(list(rows)).sort_values("turn").itertuples():
                recent = [*recent, f"{(r.role or '').upper()}: {(r.text or '')[:cut]}"][-2 * every :]
                seen += 1
                if r.role != "assistant":
                    continue
                replies += 1
                if replies % every == 0 and seen >= 4:
                    try:
                        found = (int(r.turn), summarise(SUMMARY_PROMPT + "\n".join(recent)).strip())
                    except Exception as x:  # the summary before stays
                        print(f"summary of {key[0]} failed: {x}")
            self.recent.put([(line,) for line in recent])
            self.counts.update((seen, replies))
            if found:
                self.summary.update(found)
            if self.summary.exists():
                turn, text = self.summary.get()
                yield pd.DataFrame({"conv_id": [key[0]], "turn": [turn], "summary": [text]})

        def close(self) -> None:
            pass

    return Summaries()


def kept_summaries(turns: DataFrame, summarise: Callable[[str], str], every: int = Settings.summary_every, cut: int = 200) -> DataFrame:
    """(conv_id, turn, summary) of each conversation that a batch of (conv_id, turn, role, text) touches, once it has a summary.

    As ``context.rolling_summary``, with the messages, counts and summary kept between batches: a summary is due at every ``every``-th reply
    with four messages or more, is made of the last ``2 * every`` messages, and stays until the next one; one that fails leaves the last in place.
    ``summarise`` runs in the workers. Null roles and texts count as empty; messages of a batch are taken by turn, batches as they come.
    """
    return turns.groupBy("conv_id").transformWithStateInPandas(_summaries(summarise, every, cut), "conv_id long, turn long, summary string", "Update", "None")


def arrivals(spark, folder: str, schema: str, name_column: str = "file") -> DataFrame:
    """A stream over files as they land, with the name of each."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(name_column, F.element_at(F.split(F.input_file_name(), "/"), -1))
