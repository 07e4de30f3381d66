"""A chunk store and a sparse index over Parquet tables: append, upsert, deletes, listing, fingerprints."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators.postings import raw_weight
from sparkloom.operators.retrieval import SparseIndex, document_terms, vocabulary
from sparkloom.runtime import claim, cut, names_in, remove, stored, text_of


def upsert(target: DataFrame, rows: DataFrame, key: str = "point_id") -> DataFrame:
    """Rows replace those of the same key."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows)


def without_source(target: DataFrame, source: str) -> DataFrame:
    return target.where(~F.col("source").eqNullSafe(F.lit(source)))


def without_ids(target: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return target.join(ids.select(key).distinct(), key, "left_anti")


def list_sources(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.coalesce(F.col("source"), F.lit("")) != "").select("source").distinct().orderBy("source")


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("source").alias("total_sources"))


def type_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))


def etag(chunks: DataFrame, key: str = "point_id") -> DataFrame:
    """The version of a store: digest of its sorted ids, which meet in one row, as the definition asks."""
    ids = F.array_sort(F.collect_list(F.col(key).cast("string")))
    return chunks.agg(F.md5(F.array_join(ids, ",").cast("binary")).alias("etag"), F.count(F.lit(1)).alias("n"))


def source_fingerprints(chunks: DataFrame) -> DataFrame:
    """(source, hash): digest of each source's sorted content digests."""
    parts = F.array_sort(F.collect_list(F.md5(F.col("content").cast("binary"))))
    return chunks.groupBy("source").agg(F.md5(F.array_join(parts, "|").cast("binary")).alias("hash"))


def batch_files(files: DataFrame) -> DataFrame:
    """Files of a batch by SHA-256 of their bytes: the first of equal ones is new, the others are duplicates of it."""
    hashed = files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    firsts = hashed.groupBy("sha256").agg(F.min("seq").alias("first_seq"))
    return hashed.join(firsts, "sha256").select("seq", "sha256", "first_seq", (F.col("seq") != F.col("first_seq")).alias("duplicate"))


def has_source(chunks: DataFrame, source: str) -> bool:
    """Whether a source is there to be pinned or deleted."""
    return bool(chunks.where(F.col("source") == source).limit(1).count())


#: Bits of a file's filter of sources, and places that each source sets.
BITS, HASHES = 4096, 4
#: Rows of a file that a compaction writes; layers, and deleted rows as a share of all, from which it is due.
FILE_ROWS, LAYERS, STALE = 1_000_000, 32, 0.3
#: Rows that may be sent to all tasks.
SENT = 200_000


def _bits(source: str | None) -> list[int]:
    """The places of a source in a filter; the same as ``_bit_columns`` gives. A null counts as an empty name here."""
    h = xxhash.xxh64_intdigest((source or "").encode(), seed=42)
    return [((h & 0xFFFFFFFF) + i * (h >> 32 | 1)) % BITS for i in range(HASHES)]


def _bit_columns(source: Column) -> Column:
    h = F.xxhash64(F.coalesce(source, F.lit("")))
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return F.array(*[(low + i * high) % BITS for i in range(HASHES)])


class ChunkStore:
    """Versions of one table under ``path``, merged on read: small layers of new rows, and the places of rows that are gone.

    A change writes its own rows as a layer, the places (file, row) of the rows that it removes or replaces, and signed counts of both; then a
    version file, which lists them all. Nothing else is rewritten. Readers leave out the places that are gone. When layers are many or
    much is gone, the change that finds it so compacts: rows are written anew, sorted by source, and the lists start again. ``vacuum`` removes
    what only old versions list.

    The version file keeps bounds and a membership filter of each file's sources, so that what is asked for by source opens
    only files that may hold it, and ``stats`` and ``histogram`` add up the signed counts and open no rows at all.

    Keys are unique: a change replaces rows of its keys and keeps, of its own rows with one key, the last by ``order`` if it names a column, else the
    greatest row. Version numbers are claimed exclusively: of two writers at once one gets an error and may try again, and neither's
    rows are lost. A reader keeps the version it has opened, and a failed change leaves the last one in place.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "point_id", order: str | None = None):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.by = [c for c in ("source", "type") if c in schema.fieldNames()]

    # -- versions

    def versions(self) -> list[str]:
        return [n for n in names_in(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def manifest(self, version: str | None = None) -> dict:
        """What the last version, or the one named, consists of."""
        name = version or next(reversed(self.versions()), None)
        return json.loads(text_of(self.spark, f"{self.path}/versions/{name}")) if name else {"files": {}, "layers": 0, "gone": [], "counts": []}

    def _claim(self, manifest: dict, last: str | None) -> None:
        number = int(last.split(".")[0]) + 1 if last else 0
        if not claim(self.spark, f"{self.path}/versions/{number:010d}.json", json.dumps(manifest)):
            raise RuntimeError("another writer has changed the store; try again")

    def files(self, sources: Iterable[str | None] | None = None, manifest: dict | None = None) -> list[str]:
        """The files of a version, or those that may hold one of the sources."""
        found = (manifest or self.manifest())["files"]
        if sources is None:
            return sorted(found)
        wanted = [(s or "", _bits(s)) for s in sources]
        return sorted(f for f, x in found.items() if any(x["low"] <= s <= x["high"] and all(int(x["bits"], 16) >> b & 1 for b in bits) for s, bits in wanted))

    # -- reading

    def _visible(self, manifest: dict, files: list[str], *more: Column) -> DataFrame:
        """Rows of the files that are not gone, with ``more`` columns."""
        names = self.schema.fieldNames()
        if not files:
            kinds = [c for c in ("__file", "__row") if more]
            return self.spark.createDataFrame([], self.schema).select(*names, *[F.lit(None).cast("string" if c == "__file" else "long").alias(c) for c in kinds])
        place = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")]
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in files]).select("*", *place)
        if manifest["gone"]:
            gone = self.spark.read.schema("__file string, __row long").parquet(*[f"{self.path}/gone/{g['folder']}" for g in manifest["gone"]])
            few = sum(g["rows"] for g in manifest["gone"]) <= SENT
            rows = rows.join(F.broadcast(gone) if few else gone, ["__file", "__row"], "left_anti")
        return rows.select(*names, *more)

    def read(self, version: str | None = None, sources: Iterable[str | None] | None = None) -> DataFrame:
        """The rows of the last version or of an older one; with ``sources``, theirs only, from files that may hold them."""
        manifest = self.manifest(version)
        if sources is None:
            return self._visible(manifest, self.files(None, manifest))
        sources = list(sources)
        return self._visible(manifest, self.files(sources, manifest)).where(self._of(sources))

    def has_source(self, source: str) -> bool:
        return bool(self.read(sources=[source]).limit(1).count())

    def count(self) -> int:
        return self.stats().first()["total_chunks"]

    def histogram(self) -> DataFrame:
        """(source, type, n), as far as the table has these columns, from the signed counts of the changes."""
        folders = self.manifest()["counts"]
        schema = ", ".join([f"{c} string" for c in self.by] + ["n long"])
        deltas = self.spark.read.schema(schema).parquet(*[f"{self.path}/counts/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return deltas.groupBy(*self.by).agg(F.sum("n").alias("n")).where("n <> 0")

    def stats(self) -> DataFrame:
        """One row (total_chunks, total_sources), from the signed counts."""
        sources = F.countDistinct("source") if "source" in self.by else F.lit(0).cast("long")
        return self.histogram().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), sources.alias("total_sources"))

    def list_sources(self) -> DataFrame:
        return self.histogram().where(F.coalesce(F.col("source"), F.lit("")) != "").select("source").distinct().orderBy("source")

    # -- changes

    def _of(self, sources: list[str | None]) -> Column:
        named = [s for s in sources if s is not None]
        found = F.col("source").isin(*named) if named else F.lit(False)
        return found | F.col("source").isNull() if None in sources else F.coalesce(found, F.lit(False))

    def _last(self, rows: DataFrame) -> DataFrame:
        names = self.schema.fieldNames()
        by = F.struct(*([self.order] if self.order else []), F.xxhash64(*names), *[F.col(c).cast("string") for c in names])
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*names), by).alias("r")).select("r.*")

    def _write(self, rows: DataFrame) -> dict[str, dict]:
        """Write a layer and describe its files."""
        folder = uuid.uuid4().hex
        rows.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/data/{folder}")
        source = F.coalesce(F.col("source"), F.lit("")) if "source" in self.by else F.lit("")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").select(F.col("_metadata.file_name").alias("file"), source.alias("source"))
        each = written.groupBy("file", "source").agg(F.count(F.lit(1)).alias("n"))
        sums = each.groupBy("file").agg(F.sum("n").alias("n"), F.min("source").alias("low"), F.max("source").alias("high"), F.array_distinct(F.flatten(F.collect_set(_bit_columns(F.col("source"))))).alias("bits"))
        return {f"{folder}/{r['file']}": {"rows": r["n"], "low": r["low"], "high": r["high"], "bits": f"{sum(1 << b for b in r['bits']):x}"} for r in sums.collect()}  # a row a file

    def _count(self, new: DataFrame | None, gone: DataFrame | None) -> str:
        """Signed counts of a change, as a folder of their own."""
        parts = [df.select(*self.by, F.lit(sign).alias("n")) for df, sign in ((new, 1), (gone, -1)) if df is not None]
        both = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        folder = uuid.uuid4().hex
        both.groupBy(*self.by).agg(F.sum("n").cast("long").alias("n")).where("n <> 0").coalesce(1).write.parquet(f"{self.path}/counts/{folder}")
        return folder

    def _change(self, new: DataFrame | None, gone: list[tuple[list[str], DataFrame | Column]]) -> int:
        """Add ``new`` rows (written ones) and remove rows of each (files, keys, sources or condition) in ``gone``; the number removed."""
        last = next(reversed(self.versions()), None)
        manifest = self.manifest(last)
        place = [F.col("__file"), F.col("__row")]
        found = None
        for files, what in gone:
            if not files:
                continue
            rows = self._visible(manifest, files, *place).select(*dict.fromkeys([self.key, *self.by]), *place)
            if isinstance(what, Column):
                hit = rows.where(what)
            else:
                of = what.columns[0]
                small = what.select(F.col(of).alias("__of"))
                same = F.col(of) == F.col("__of") if of == self.key else F.col(of).eqNullSafe(F.col("__of"))
                hit = rows.join(F.broadcast(small) if what.count() <= SENT else small, same, "left_semi")
            found = hit if found is None else found.unionByName(hit).dropDuplicates(["__file", "__row"])
        found = None if found is None else cut(found.select(*self.by, *place))
        removed = found.count() if found is not None else 0
        added = self._write(new) if new is not None else {}
        if not removed and not sum(x["rows"] for x in added.values()):
            return 0
        now = {"files": manifest["files"] | added, "layers": manifest["layers"] + bool(added), "gone": list(manifest["gone"]), "counts": [*manifest["counts"], self._count(new, found)]}
        if removed:
            folder = uuid.uuid4().hex
            found.select(*place).coalesce(max(1, removed // FILE_ROWS)).write.parquet(f"{self.path}/gone/{folder}")
            now["gone"].append({"folder": folder, "rows": removed})
        self._claim(now, last)
        total = sum(x["rows"] for x in now["files"].values())
        if now["layers"] > LAYERS or sum(g["rows"] for g in now["gone"]) > max(STALE * total, FILE_ROWS):
            self.compact()
        return removed

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of the same key."""
        last = stored(self._last(rows).select(*self.schema.fieldNames()))
        self._change(last, [(self.files(), last.select(self.key))])

    append = upsert

    def replace_sources(self, sources: Iterable[str | None] | DataFrame, rows: DataFrame) -> int:
        """All rows of these sources go and ``rows`` come, in one change; the number that went. A table with a column ``source``, as large as
        it may be, meets the rows by a join; a list is named to the scan.
        """
        last = stored(self._last(rows).select(*self.schema.fieldNames()))
        if isinstance(sources, DataFrame):
            old = self.files(), sources.select("source").distinct()
        else:
            sources = list(sources)
            old = self.files(sources), self._of(sources)
        return self._change(last, [old, (self.files(), last.select(self.key))])

    def delete_by_sources(self, sources: Iterable[str | None]) -> int:
        sources = list(sources)
        return self._change(None, [(self.files(sources), self._of(sources))])

    def delete_by_source(self, source: str | None) -> int:
        return self.delete_by_sources([source])

    def delete_by_ids(self, ids: DataFrame) -> int:
        return self._change(None, [(self.files(), ids.select(self.key).distinct())])

    def reset(self) -> None:
        self._claim({"files": {}, "layers": 0, "gone": [], "counts": []}, next(reversed(self.versions()), None))

    def compact(self) -> None:
        """Write all rows anew as one layer, sorted by source, with nothing gone."""
        last = next(reversed(self.versions()), None)
        manifest = self.manifest(last)
        rows = self._visible(manifest, self.files(None, manifest))
        n = sum(x["rows"] for x in manifest["files"].values()) - sum(g["rows"] for g in manifest["gone"])
        order = [c for c in ("source", self.key) if c in self.schema.fieldNames()]
        files = self._write(rows.repartitionByRange(max(1, -(-n // FILE_ROWS)), *order).sortWithinPartitions(*order))
        counts = [self._merged_counts()] if manifest["counts"] else []
        self._claim({"files": files, "layers": 1, "gone": [], "counts": counts}, last)

    def _merged_counts(self) -> str:
        folder = uuid.uuid4().hex
        self.histogram().coalesce(1).write.parquet(f"{self.path}/counts/{folder}")
        return folder

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and remove the folders that only they list; the number of folders removed.

        Not to be run beside a change: what a change has written and not yet listed would go too.
        """
        names = self.versions()
        kept = [self.manifest(n) for n in names[-keep:]]
        used = {f.split("/")[0] for m in kept for f in m["files"]} | {g["folder"] for m in kept for g in m["gone"]} | {c for m in kept for c in m["counts"]}
        stale = [f"{self.path}/{kind}/{f}" for kind in ("data", "gone", "counts") for f in names_in(self.spark, f"{self.path}/{kind}") if f not in used]
        remove(self.spark, [f"{self.path}/versions/{n}" for n in names[:-keep]] + stale)
        return len(stale)


class SparseStore:
    """A kept sparse index under ``path``: counted terms by document, and the vocabulary as counts that add up, in parts.

    ``add`` and ``delete_by_sources`` write a part each and rewrite nothing: a deletion is the sources' names, which hide older rows, and their
    counts with a minus. One file lists all parts, so that reading costs the same however many changes there were: parts of like size are
    merged, FANOUT at a time, into one of the next size. A version counts once its number is claimed: readers see whole changes only, and during
    ``rebuild`` the index as it was.
    """

    ROWS, WORDS, GONE = "doc string, source string, dl int, terms array<struct<tok: string, tf: int>>, part long", "tok string, df long", "source string, part long"
    FANOUT = 8

    def __init__(self, spark: SparkSession, path: str, key: str = "point_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _last(self) -> str | None:
        return next(reversed([n for n in names_in(self.spark, f"{self.path}/parts") if n.endswith(".json")]), None)

    def parts(self) -> list[dict]:
        """The parts of the last version, oldest first: folder, number, documents and tokens that they add, and rows that they hold."""
        last = self._last()
        return json.loads(text_of(self.spark, f"{self.path}/parts/{last}")) if last else []

    def _commit(self, parts: list[dict], last: str | None) -> None:
        number = int(last.split(".")[0]) + 1 if last else 0
        if not claim(self.spark, f"{self.path}/parts/{number:010d}.json", json.dumps(parts)):
            raise RuntimeError("another writer has changed the index; try again")

    def _read(self, kind: str, schema: str, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{p['folder']}/{kind}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, words: DataFrame, gone: DataFrame) -> str:
        folder = uuid.uuid4().hex
        for kind, df in (("rows", rows), ("words", words), ("gone", gone)):
            df.write.parquet(f"{self.path}/data/{folder}/{kind}")
        return folder

    def _visible(self, parts: list[dict]) -> DataFrame:
        gone = self._read("gone", self.GONE, parts).groupBy(F.col("source").alias("gone")).agg(F.max("part").alias("hidden_to"))
        return self._read("rows", self.ROWS, parts).join(gone, (F.col("source") == F.col("gone")) & (F.col("part") < F.col("hidden_to")), "left_anti")

    def rows(self) -> DataFrame:
        """(doc, source, dl, terms) of what is in the index."""
        return self._visible(self.parts()).drop("part")

    def _terms(self, chunks: DataFrame) -> DataFrame:
        return stored(document_terms(chunks.withColumn(self.key, F.col(self.key).cast("string")).withColumn("source", F.coalesce("source", F.lit(""))), self.key, "content", "source"))

    def _change(self, rows: DataFrame | None, sources: list[str] | DataFrame, keep: bool = True) -> int:
        """Hide the sources' rows, add ``rows`` (written), in one part; without ``keep``, nothing older stays. The number hidden."""
        last = self._last()
        parts = self.parts() if keep else []
        number = int(last.split(".")[0]) + 1 if last else 0
        empty = self.spark.createDataFrame([], self.ROWS.removesuffix(", part long"))
        gone = empty
        if parts and isinstance(sources, DataFrame):
            gone = stored(self._visible(parts).join(sources.select(F.coalesce("source", F.lit("")).alias("source")), "source", "left_semi").drop("part").select(*empty.columns))
        elif parts and sources:
            gone = stored(self._visible(parts).where(F.col("source").isin(*sources)).drop("part"))
        new = empty if rows is None else rows
        hidden, less = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        added, more = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if keep and not hidden and not added:
            return 0
        words = vocabulary(new).unionByName(vocabulary(gone).withColumn("df", -F.col("df"))).groupBy("tok").agg(F.sum("df").alias("df")).where("df <> 0")
        # Sources without older rows need not be named.
        names = gone.select("source").distinct().withColumn("part", F.lit(number).cast("long")).coalesce(max(1, hidden // FILE_ROWS))
        folder = self._write(new.withColumn("part", F.lit(number).cast("long")), words, names)
        self._commit(self._merged([*parts, {"folder": folder, "number": number, "docs": added - hidden, "tokens": more - less, "held": added + hidden}]), last)
        return hidden

    def _tier(self, part: dict) -> int:
        tier, n = 0, max(1, part["held"])
        while n >= self.FANOUT:
            tier, n = tier + 1, n // self.FANOUT
        return tier

    def _merged(self, parts: list[dict]) -> list[dict]:
        """Merge the newest FANOUT parts while all of them are of the size of the newest or less."""
        while len(parts) >= self.FANOUT and max(self._tier(p) for p in parts[-self.FANOUT :]) <= max(self._tier(parts[-1]), self._tier(parts[-2])):
            old, young = parts[: -self.FANOUT], parts[-self.FANOUT :]
            number = young[-1]["number"]
            rows = self._visible(young).withColumn("part", F.lit(number).cast("long"))
            words = self._read("words", self.WORDS, young).groupBy("tok").agg(F.sum("df").alias("df")).where("df <> 0")
            gone = self._read("gone", self.GONE, young).coalesce(max(1, sum(p["held"] for p in young) // FILE_ROWS)) if old else self.spark.createDataFrame([], self.GONE).coalesce(1)
            folder = self._write(rows, words, gone)
            docs, tokens = (sum(p[k] for p in young) for k in ("docs", "tokens"))
            parts = [*old, {"folder": folder, "number": number, "docs": docs, "tokens": tokens, "held": max(self.FANOUT ** (self._tier(young[-1]) + 1), sum(p["held"] for p in young))}]
        return parts

    def add(self, chunks: DataFrame) -> None:
        self._change(self._terms(chunks), [])

    def replace_sources(self, sources: Iterable[str | None] | DataFrame, chunks: DataFrame) -> int:
        """Rows of these sources (a list, or a table of any size) go and those of ``chunks`` come, in one change; the number that went."""
        return self._change(self._terms(chunks), sources if isinstance(sources, DataFrame) else [s or "" for s in sources])

    def delete_by_sources(self, sources: Iterable[str | None]) -> int:
        return self._change(None, [s or "" for s in sources])

    def delete_by_source(self, source: str | None) -> int:
        return self.delete_by_sources([source])

    def rebuild(self, chunks: DataFrame) -> None:
        """The index of these chunks and nothing else, put in place of the old one by a single commit."""
        self._change(self._terms(chunks), [], keep=False)

    def reset(self) -> None:
        self._commit([], self._last())

    def index(self) -> SparseIndex:
        """For searches; documents and tokens are counted by the list of parts."""
        parts = self.parts()
        words = self._read("words", self.WORDS, parts).groupBy("tok").agg(F.sum("df").alias("df")).where("df > 0")
        n, tokens = (sum(p[k] for p in parts) for k in ("docs", "tokens"))
        mean = words.agg(F.avg(raw_weight(F.col("df"), n))).first()[0] if n else None
        return SparseIndex(self.rows(), words, n, tokens / n if n else 0.0, mean or 0.0)

    def vacuum(self) -> int:
        """Remove the folders and lists that the last version does not name, as ``ChunkStore.vacuum`` does."""
        last, used = self._last(), {p["folder"] for p in self.parts()}
        stale = [f"{self.path}/data/{f}" for f in names_in(self.spark, f"{self.path}/data") if f not in used]
        remove(self.spark, [f"{self.path}/parts/{n}" for n in names_in(self.spark, f"{self.path}/parts") if n.endswith(".json") and n != last] + stale)
        return len(stale)
