"""Key sets compared by trees of digests, so that ranges of keys that are equal on both sides are never read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.runtime import claim, names_in, stored, text_of

#: Bits of a key's place that a level of the tree adds, and those of the deepest ranges (65,536 of them at most).
FAN, DEEPEST = 4, 16
#: Keys of a range, about; layers from which a change writes the tree anew.
RANGE_KEYS, LAYERS = 50_000, 16


def _place(key: Column, depth: int) -> Column:
    """The range of a key: the first ``depth`` bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(0)), 64 - depth)


class KeyTree:
    """The keys of a table under ``path``, dealt over ranges of their hash, with a digest of each range and of each group of ranges.

    A digest is the number of keys and two sums of their 64-bit hashes: it does not depend on an order, and those of sixteen ranges add up
    to that of the range above, up to the root. Sums also make changes cheap: ``change`` writes its own keys with a sign as a
    layer, and signed digests, which readers add up. Trees of unlike depth share their upper levels. Two sets of keys with equal
    digests would need two 64-bit sums to agree by chance.

    Keys are a set: repeats count once, and null keys, which no sync can address, are left out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "point_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def layers(self) -> list[dict]:
        """The layers since the tree was last written whole."""
        found = []
        for name in reversed([n for n in names_in(self.spark, f"{self.path}/layers") if n.endswith(".json")]):
            found.append(json.loads(text_of(self.spark, f"{self.path}/layers/{name}")) | {"number": int(name.split(".")[0])})
            if found[-1]["whole"]:
                break
        return found[::-1]

    def _add(self, rows: DataFrame, depth: int, whole: bool, last: int) -> None:
        """Write (key, sign) rows and their digests, then the file that names them."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = rows.select(self.key, "sign", _place(F.col(self.key), depth).alias("leaf"))
        kept = stored(rows.repartition("leaf"), f"{folder}/keys", by="leaf")
        total = lambda c: F.sum(c.cast("decimal(28,0)")).cast("decimal(38,0)")
        sums = [total(F.xxhash64(F.col(self.key).cast("string"), F.lit(k)) * F.col("sign").cast("decimal(1,0)")).alias(f"sum{k}") for k in (1, 2)]
        leaves = kept.groupBy("leaf").agg(F.sum("sign").alias("n"), *sums)
        up = F.explode(F.array(*[F.struct(F.lit(b).alias("level"), F.shiftright("leaf", depth - b).alias("node")) for b in range(0, depth + 1, FAN)]))
        nodes = leaves.select(up.alias("at"), "n", "sum1", "sum2").groupBy("at.level", "at.node").agg(F.sum("n").alias("n"), total(F.col("sum1")).alias("sum1"), total(F.col("sum2")).alias("sum2"))
        stored(nodes.coalesce(1), f"{folder}/nodes")  # about 70,000 rows at most
        layer = {"folder": folder.rsplit("/", 1)[-1], "depth": depth, "whole": whole, "type": rows.schema[self.key].dataType.simpleString()}
        if not claim(self.spark, f"{self.path}/layers/{last + 1:010d}.json", json.dumps(layer)):
            raise RuntimeError("another writer has changed the tree; try again")

    def take(self, rows: DataFrame) -> KeyTree:
        """Write the tree of all keys of ``rows``, in place of what is there."""
        layers = self.layers()
        keys = rows.where(F.col(self.key).isNotNull()).select(self.key).distinct().withColumn("sign", F.lit(1))
        ranges, depth = -(-keys.count() // RANGE_KEYS), FAN
        while depth < DEEPEST and 1 << depth < ranges:
            depth += FAN
        self._add(keys, depth, True, layers[-1]["number"] if layers else -1)
        return self

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> KeyTree:
        """Put keys in and take keys out, reading their ranges only; keys that are there, or are not, change nothing. A key on both sides stays in."""
        layers = self.layers()
        depth = layers[-1]["depth"]
        none = self.spark.createDataFrame([], f"{self.key} {layers[-1]['type']}")
        new, old = ((none if d is None else d).where(F.col(self.key).isNotNull()).select(self.key).distinct() for d in (added, removed))
        old = old.join(new, self.key, "left_anti")
        touched = [r[0] for r in new.unionByName(old).select(_place(F.col(self.key), depth)).distinct().collect()]  # ranges
        if not touched:
            return self
        held = self.keys(touched, depth)
        rows = new.join(held, self.key, "left_anti").withColumn("sign", F.lit(1)).unionByName(old.join(held, self.key, "left_semi").withColumn("sign", F.lit(-1)))
        self._add(rows, depth, False, layers[-1]["number"])
        return self.take(self.keys()) if len(layers) >= LAYERS else self

    def keys(self, ranges: Iterable[int] | None = None, depth: int | None = None) -> DataFrame:
        """All keys, or those of ranges of ``depth`` bits; only the folders of these are opened."""
        layers, wanted, paths = self.layers(), None if ranges is None else set(ranges), []
        for x in layers:
            folder, down = f"{self.path}/data/{x['folder']}/keys", x["depth"] - (x["depth"] if depth is None else depth)
            leaves = [n for n in names_in(self.spark, folder) if n.startswith("leaf=")]
            paths += [f"{folder}/{n}" for n in leaves if wanted is None or int(n.split("=")[1]) >> down in wanted]
        schema = f"{self.key} {layers[-1]['type']}, sign int"
        if not paths:
            return self.spark.createDataFrame([], schema).select(self.key)
        rows = self.spark.read.schema(schema).parquet(*paths)
        if len(layers) > 1:
            rows = rows.groupBy(self.key).agg(F.sum("sign").alias("sign")).where("sign > 0")
        return rows.select(self.key)

    def nodes(self) -> DataFrame:
        """(level, node, n, sum1, sum2) of every range and group of ranges that has keys."""
        rows = self.spark.read.schema("level int, node long, n long, sum1 decimal(38,0), sum2 decimal(38,0)").parquet(*[f"{self.path}/data/{x['folder']}/nodes" for x in self.layers()])
        return rows.groupBy("level", "node").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("n", "sum1", "sum2")]).where("n > 0")


def differing(one: KeyTree, other: KeyTree) -> tuple[int, list[int]]:
    """(depth, ranges): the ranges in which two trees differ, found from the root down; below nodes that are equal nothing is looked at."""
    depth, hits = min(t.layers()[-1]["depth"] for t in (one, other)), [0]
    for level in range(0, depth + 1, FAN):
        above = F.shiftright("node", FAN).isin(hits) if level else F.lit(True)
        a, b = (t.nodes().where((F.col("level") == level) & above).select("node", F.struct("n", "sum1", "sum2").alias(side)) for t, side in ((one, "a"), (other, "b")))
        hits = sorted(r["node"] for r in a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect())
        if not hits:
            break
    return depth, hits


def plan(cloud: KeyTree, local: KeyTree) -> DataFrame:
    """(key, action) as ``sync.plan`` gives, from the ranges that differ alone."""
    depth, ranges = differing(cloud, local)
    here, there = (t.keys(ranges, depth).withColumn(side, F.lit(1)) for t, side in ((cloud, "c"), (local, "l")))
    both = here.join(there, cloud.key, "full")
    return both.where("c is null or l is null").select(cloud.key, F.when(F.col("l").isNull(), "pull").otherwise("delete").alias("action"))
