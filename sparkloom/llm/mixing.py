"""Mixing sources to target weights by entropy balancing.

Sources, in code-point order with null last, weigh 3, 1, 2, repeating, and share ``SHARE`` times all words; no target
is over ``CAP`` times its source's words, and what is over is shared again by weight.

*Rates.* Documents of size s in source k get the rates that are closest in relative entropy to the base rate of one among
those of at most ``CAP`` whose words reach the target: ``r = min(CAP, exp(lambda_k * s / mean size of k))``. The dual
is convex and splits by source; Newton steps on its gradient, kept inside a bracket that holds the root, find all multipliers at once.
Each step is one map-side summed aggregate over (source, size, count) rows that are written once; a row a source is kept between steps.

*Targets.* Sources stop at their cap in order of words by weight. Sums by bands of that ratio, at most a few thousand, say in which band the level
lies, and running sums inside the band give it, however many sources stop.

*Copies.* Rates are rounded to whole copies by systematic sampling, in each source in order of size, then of a hash of id and text: so
many copies of each size are taken as keep the running sum of rates within one, and the smallest hashes of a size get the
larger of its two numbers. As sizes grow along that order, the words of a source are off by less than its longest document.
One document of each source takes that difference, as part of a copy.

Ranks are never taken in one task: sources are ranked over range partitions, documents of one size by hash bins of about ``BIN``
rows. Sums are of integers or decimals, so reruns agree.

Defined cases: null or empty text has size zero and is never taken; null sources form one source; a source without
words has target zero; rows that repeat id and text are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import cut, stored

from .common import WORD, text_or_empty, with_small

#: Fixed by the contract.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Newton stops when every source's words are this close to the target, as a part of it.
TOLERANCE, STEPS = 1e-9, 200
#: Documents of one source and size that are ranked together, about.
BIN = 200
#: Hashes that order documents lie below this.
HASHES = 1 << 40
#: A table of at most so many rows (a few numbers each) is kept in the plan between steps; a larger one is checkpointed.
HELD = 20_000
#: Bands that the ratio of words to weight is split into, for each doubling of it.
BANDS = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _held(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a table of ``rows`` counted rows, without the plan that made it."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema) if rows <= HELD else cut(df)


def _ranked(sources: DataFrame) -> tuple[DataFrame, int]:
    """``sources`` with ``rank``, their place in code-point order, null last, and their number: range partitions are ranked apart and set one after the other."""
    place = F.col("source").asc_nulls_last()
    parts = cut(sources.repartitionByRange(place).withColumn("part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in parts.groupBy("part").count().collect())  # a row per partition
    before = [(part, sum(n for p, n in counts if p < part)) for part, _ in counts]
    if not before:
        return parts.drop("part").withColumn("rank", F.lit(0)), 0
    offsets = F.broadcast(sources.sparkSession.createDataFrame(before, "part int, before long"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(place)) - 1
    ranked = parts.withColumn("own", own).join(offsets, "part").withColumn("rank", F.col("own") + F.col("before"))
    return ranked.drop("part", "own", "before"), sum(n for _, n in counts)


def _level(sources: DataFrame, budget: float) -> float:
    """The level at which (source_size, weight) rows take ``budget`` words, each ``weight * level`` but at most ``CAP`` times its size."""
    ratio = F.col("source_size") * CAP / F.col("weight")
    alike = sources.where("source_size > 0").groupBy(ratio.alias("ratio")).agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight"))
    alike = alike.withColumn("band", F.floor(F.log2("ratio") * BANDS))
    bands = sorted(tuple(r) for r in alike.groupBy("band").agg(F.max("ratio"), F.sum("words"), F.sum("weight")).collect())
    full, free, top = 0, sum(weight for *_, weight in bands), 0.0  # words of sources that are full below a band, and the weight of the others
    for band, top, words, weight in bands:
        if CAP * (full + words) + top * (free - weight) >= budget:
            break
        full, free = full + words, free - weight
    else:
        return top
    order = Window.partitionBy("band").orderBy("ratio")
    inside = alike.where(F.col("band") == band).select("ratio", "words", "weight", F.sum("words").over(order).alias("upto"), F.sum("weight").over(order).alias("past"))
    reached = CAP * (full + F.col("upto")) + F.col("ratio") * (free - F.col("past")) >= budget
    one = inside.where(reached).orderBy("ratio").first()
    return (budget - CAP * (full + one["upto"] - one["words"])) / (free - one["past"] + one["weight"])


def targets(sizes: DataFrame) -> tuple[DataFrame, int]:
    """(source, source_size, docs, target) from (source, size, n) rows, and how many sources there are."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked, count = _ranked(sources)
    sources = _held(ranked.withColumn("weight", weight).drop("rank"), count)
    level = _level(sources, SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0))
    return sources.select("source", "source_size", "docs", F.least(F.col("source_size") * CAP, F.col("weight") * level).alias("target")), count


def _rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(CAP), F.exp(F.least(multiplier * size / mean, F.lit(1.0))))


def multipliers(sizes: DataFrame, goals: DataFrame, count: int) -> DataFrame:
    """goals with ``lam``: the tilt whose rates reach each source's target; null where all is taken."""
    state = goals.withColumn("mean", F.col("source_size") / F.col("docs"))
    # At hi even one word reaches the cap, at lo no document is over its even share of the target.
    state = state.withColumn("lam", F.lit(0.0)).withColumn("lo", F.least(F.lit(0.0), F.col("mean") * F.log(F.try_divide("target", "source_size")))).withColumn("hi", F.col("mean") * log(CAP))
    state = _held(state.withColumn("open", (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * CAP * (1 - 1e-12))), count)
    exact = lambda c: F.sum(c.cast("decimal(32,8)"))
    for _ in range(STEPS):
        if state.where("open").isEmpty():
            break
        now = state.where("open").select(F.col("source").alias("s"), "lam", "mean")
        rows = with_small(sizes.where("size > 0"), now, F.col("source").eqNullSafe(F.col("s")), count, "inner")
        r, x, words = _rate(F.col("lam"), F.col("size"), F.col("mean")), F.col("size") / F.col("mean"), F.col("size") * F.col("n")
        sums = rows.groupBy("s").agg(exact(r * words).cast("double").alias("words"), exact(F.when(r < CAP, r * x * words).otherwise(0.0)).cast("double").alias("slope"))
        j = with_small(state, sums, F.col("source").eqNullSafe(F.col("s")), count)
        gap = F.col("words") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        going = F.col("open") & (F.abs(gap) > TOLERANCE * F.col("target")) & (hi - lo > 1e-12 * F.greatest(F.lit(1.0), F.abs(F.col("lam"))))
        state = _held(j.select("source", "source_size", "docs", "target", "mean", F.when(going, F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)).otherwise(F.col("lam")).alias("lam"), F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi"), F.coalesce(going, F.lit(False)).alias("open")), count)
    full = F.col("target") >= F.col("source_size") * CAP * (1 - 1e-12)
    return state.select("source", "source_size", "target", "mean", F.when(~full, F.col("lam")).alias("lam"))


def _same(a: str, b: str, other_a: str = "size", other_b: str = "of_size") -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col(other_a) == F.col(other_b))


def copies(rows: DataFrame, sizes: DataFrame, tilt: DataFrame, count: int, kinds: int) -> DataFrame:
    """(of, of_size, low, bar) for each source and size: ``low`` copies of all, and one more where the hash is ``bar`` or less.

    rows: (source, size, place), place being the hash; sizes: ``kinds`` rows of (source, size, n); tilt: ``count`` rows, as ``multipliers`` gives.
    """
    rates = with_small(sizes.where("size > 0"), tilt.select(F.col("source").alias("of"), "lam", "mean"), F.col("source").eqNullSafe(F.col("of")), count, "inner")
    rates = rates.withColumn("rate", F.when(F.col("lam").isNull(), CAP).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean"))))
    upto = F.sum(F.col("rate") * F.col("n")).over(Window.partitionBy("source").orderBy("size"))  # a row for each size of a source
    start = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    low = F.floor("rate").cast("long")
    taken = F.floor(F.col("upto") + start) - F.floor(F.col("upto") - F.col("rate") * F.col("n") + start)
    rates = rates.withColumn("upto", upto).select(F.col("source").alias("of"), F.col("size").alias("of_size"), "n", low.alias("low"), F.least(F.col("n"), F.greatest(F.lit(0), taken - low * F.col("n"))).alias("more"))
    rates = _held(rates, kinds)
    # The hash of the last document with one more: its bin first, then its rank there.
    some = rates.where("more > 0 and more < n").select("of", "of_size", "more", F.ceil(F.col("n") / BIN).alias("bins"))
    n_some = some.count()
    binned = with_small(rows, some, _same("source", "of"), n_some, "inner").withColumn("bin", F.floor(F.col("place") * F.col("bins") / HASHES))
    by_bin = binned.groupBy("of", "of_size", "more", "bin").agg(F.count(F.lit(1)).alias("n"))
    ends = F.sum("n").over(Window.partitionBy("of", "of_size").orderBy("bin"))
    last = _held(by_bin.withColumn("ends", ends).where("ends >= more and ends - n < more").select(F.col("of").alias("in"), F.col("of_size").alias("in_size"), F.col("bin").alias("in_bin"), (F.col("more") - F.col("ends") + F.col("n")).alias("need")), n_some)
    inside = with_small(binned, last, _same("of", "in", "of_size", "in_size") & (F.col("bin") == F.col("in_bin")), n_some, "inner")
    rank = F.row_number().over(Window.partitionBy("of", "of_size", "bin").orderBy("place"))
    bars = _held(inside.withColumn("rank", rank).where("rank = need").select(F.col("of").alias("in"), F.col("of_size").alias("in_size"), F.col("place").alias("found")), n_some)
    bar = F.when(F.col("more") == 0, -1).when(F.col("more") == F.col("n"), HASHES).otherwise(F.col("found"))
    return _held(with_small(rates, bars, _same("of", "in", "of_size", "in_size"), n_some).select("of", "of_size", "low", bar.alias("bar")), kinds)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies, rest; ``keep``: after all input columns, prefixed ``mix_``.

    ``taken`` words are ``copies`` whole copies and the first ``rest`` words of one more.
    """
    text = df[text_col]
    own = {"__source": df[source_col].cast("string"), "__size": word_count(text), "__place": F.pmod(F.xxhash64(df[id_col].cast("string"), text.cast("string"), F.lit(8)), F.lit(HASHES))}
    rows = stored(df.select(*[c.alias(name[2:]) for name, c in own.items()]))
    sizes = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    kinds = sizes.count()
    goals, count = targets(sizes)
    tilt = multipliers(sizes, goals, count)
    dealt = copies(rows, sizes, tilt, count, kinds)

    def whole(size: str, place: str) -> Column:
        return F.coalesce(F.col("low") + F.when(F.col(place) <= F.col("bar"), 1).otherwise(0), F.lit(0)) * F.col(size)

    # What each source is off, and the smallest document that can take it, else the one that can take most.
    first = with_small(rows, dealt, _same("source", "of"), kinds, "inner").select("source", "size", "place", whole("size", "place").alias("words"))
    off = _held(with_small(tilt.select("source", "target"), first.groupBy(F.col("source").alias("of")).agg(F.sum("words").alias("words")), F.col("source").eqNullSafe(F.col("of")), count).select(F.col("source").alias("off_of"), (F.round("target").cast("long") - F.coalesce("words", F.lit(0))).alias("off")), count)
    room = F.when(F.col("off") > 0, (F.col("size") * CAP).cast("long") - F.col("words")).otherwise(F.col("words"))
    chosen = with_small(first, off.where("off <> 0"), F.col("source").eqNullSafe(F.col("off_of")), count, "inner").withColumn("room", room)
    enough = F.struct("size", "place", "room")
    chosen = chosen.groupBy("off_of", "off").agg(F.coalesce(F.min(F.when(F.col("room") >= F.abs("off"), enough)), F.max_by(enough, F.struct("room", "place"))).alias("one"))
    chosen = chosen.select("off_of", (F.signum("off") * F.least(F.abs("off"), "one.room")).cast("long").alias("extra"), F.col("one.size").alias("at_size"), F.col("one.place").alias("at_place"))
    sources = _held(with_small(tilt.select("source", "source_size", "target"), chosen, F.col("source").eqNullSafe(F.col("off_of")), count), count).select(*[F.col(c).alias(f"__{c}_of") for c in ("source", "source_size", "target", "extra", "at_size", "at_place")])

    out = (df.withColumns(own) if keep else df.select(df[id_col].alias("__id"), *[c.alias(name) for name, c in own.items()]))
    out = with_small(out, sources, F.col("__source").eqNullSafe(F.col("__source_of")), count, "inner")
    out = with_small(out, dealt.select(*[F.col(c).alias(f"__{c}") for c in dealt.columns]), _same("__source", "__of", "__size", "__of_size"), kinds)
    s = F.col("__size")
    base = F.coalesce(F.col("__low") + F.when(F.col("__place") <= F.col("__bar"), 1).otherwise(0), F.lit(0)) * s
    extra = F.when((s == F.col("__at_size_of")) & (F.col("__place") == F.col("__at_place_of")), F.col("__extra_of")).otherwise(0)
    out = out.withColumn("__taken", (base + extra).cast("long"))
    t = F.col("__taken")
    more = {"size": s, "source_size": F.col("__source_size_of").cast("long"), "target": F.col("__target_of"), "taken": t, "copies": F.when(s > 0, F.floor(t / s)).otherwise(0).cast("long"), "rest": F.when(s > 0, t % s).otherwise(0).cast("long")}
    return out.select(*([*[F.col(f"`{c}`") for c in df.columns], *[c.alias(f"mix_{n}") for n, c in more.items()]] if keep else [F.col("__id").alias(id_col), *[c.alias(n) for n, c in more.items()]]))
