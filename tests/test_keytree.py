"""Trees of key digests against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import keytree, store, sync
from sparkloom.operators.keytree import KeyTree
from sparkloom.streaming import jobs


def keys(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"point_id {kind}")


def planned(df):
    return sorted(map(tuple, df.collect()))


def test_one_changed_key_reads_one_range_a_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keytree, "RANGE_KEYS", 20)
    rows = spark.range(3000).select(F.col("id").cast("string").alias("point_id"))
    one = KeyTree(spark, str(tmp_path / "one")).take(rows)
    other = KeyTree(spark, str(tmp_path / "other")).take(rows)
    assert one.layers()[0]["depth"] == 8 and keytree.differing(one, other) == (8, [])
    assert planned(keytree.plan(one, other)) == []
    other.take(rows.where("point_id <> '77'").unionByName(rows.limit(5)).unionByName(keys(spark, [None])))
    depth, ranges = keytree.differing(one, other)
    assert len(ranges) == 1
    assert [len({f.rsplit("/", 2)[-2] for f in t.keys(ranges, depth).inputFiles()}) for t in (one, other)] == [1, 1]
    assert len({f.rsplit("/", 2)[-2] for f in one.keys().inputFiles()}) > 200
    assert planned(keytree.plan(one, other)) == [("77", "pull")] and planned(keytree.plan(other, one)) == [("77", "delete")]


@pytest.mark.parametrize("kind", ["string", "long"])
def test_trees_follow_any_changes(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(keytree, "RANGE_KEYS", 2)
    monkeypatch.setattr(keytree, "LAYERS", 3)
    rng, of = random.Random(3), (str if kind == "string" else int)
    held = {of(k) for k in range(40)}
    tree = KeyTree(spark, str(tmp_path / "t")).take(keys(spark, sorted(held), kind))
    fixed = {of(k) for k in range(0, 300, 3)}  # a deeper tree
    other = KeyTree(spark, str(tmp_path / "u")).take(keys(spark, sorted(fixed), kind))
    assert other.layers()[0]["depth"] > 4
    for _ in range(5):
        new, old = ({of(rng.randrange(60)) for _ in range(rng.randrange(8))} for _ in range(2))
        tree.change(keys(spark, [*new, *new, None], kind), keys(spark, [*old, None], kind))
        held = held - old | new
        assert {r[0] for r in tree.keys().collect()} == held
        assert planned(keytree.plan(tree, other)) == sorted([(k, "pull") for k in held - fixed] + [(k, "delete") for k in fixed - held])
    fresh = KeyTree(spark, str(tmp_path / "v")).take(keys(spark, sorted(held), kind))
    assert keytree.differing(fresh, tree)[1] == []
    tree.change(removed=tree.keys())
    assert tree.keys().count() == 0 and tree.nodes().count() == 0


def test_empty_trees_and_plan_equals_sync(spark, tmp_path):
    some, none = keys(spark, ["a", "b"]), keys(spark, [])
    full, empty = KeyTree(spark, str(tmp_path / "f")).take(some), KeyTree(spark, str(tmp_path / "e")).take(none)
    assert planned(keytree.plan(full, empty)) == planned(sync.plan(some, none)) and planned(keytree.plan(empty, full)) == planned(sync.plan(none, some))
    assert planned(keytree.plan(empty, empty)) == []
    assert planned(keytree.plan(empty.change(keys(spark, ["b"])), full)) == [("a", "delete")]


def test_reconcile_by_trees(spark, tmp_path):
    schema = "point_id string, source string, type string, v int"
    cloud = spark.createDataFrame([(str(k), "s", "text", k) for k in range(30)], schema)
    s = store.ChunkStore(spark, str(tmp_path / "store"), cloud.schema)
    s.upsert(cloud.where("v < 20").unionByName(spark.createDataFrame([("old", "s", "text", -1)], schema)))
    there, here = KeyTree(spark, str(tmp_path / "c")).take(cloud), KeyTree(spark, str(tmp_path / "l")).take(s.read())
    assert jobs.reconcile_trees(cloud, there, s, here) == (10, 1)
    assert sorted(r["v"] for r in s.read().collect()) == list(range(30)) and keytree.differing(there, here)[1] == []
    before = s.versions()
    assert jobs.reconcile_trees(cloud, there, s, here) == (0, 0) and s.versions() == before
