"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

1. Each source gets a target number of words by water filling (`targets`).
2. Each source has a weight schedule over training time [0, 1], linear between knots. Its integral,
   scaled to the target, is the source's cumulative word demand.
3. A source's documents lie in a fixed shuffled order (MD5 of the key). The words before a document
   are its place in the demand; inverting the demand gives its training position.
4. Documents are range-sorted by position.

Prefix sums go over two levels of hash buckets, so no task holds a whole source, whatever its share.

Defined results: null or empty text counts 0 words and is never taken; a null source is one source of
its own, last in order; repeated rows are separate documents; an empty table gives no rows; input
columns named like a result column are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words

#: Mean weights of the sources by rank, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Weight over time for each of WEIGHTS, as (time, multiple) knots: heavy sources lead, light ones close.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
SHARE, CAP = 1.5, 2.0

_S = ["__null", "__source"]


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: (__null, __source, source_size) -> rank, weight and target.

    Of share * all words each source gets its weight's part, no more than cap * its own words; the
    excess goes to the others by weight. In order of cap * size / weight the first sources are full;
    the level of the rest is the largest one that its own first source can bear.
    """
    everything = Window.partitionBy()
    by_name, by_room = Window.orderBy("__null", "__source"), Window.orderBy("__room", "__null", "__source")
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("__rank", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("__weight", w[F.col("__rank")])
    ranked = ranked.withColumn("__room", F.lit(float(cap)) * F.col("source_size") / F.col("__weight"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("__weight").over(onward)
    levels = ranked.withColumn("__level", level)
    best = F.max(F.when(F.col("__level") <= F.col("__room"), F.col("__level"))).over(everything)
    return levels.withColumn("target", F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(best, F.lit(0.0)) * F.col("__weight"))).select(*_S, "source_size", "target", "__rank")


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(start, weight there, slope, demand before) of each piece, with the whole demand scaled to 1."""
    pieces = list(zip(knots, knots[1:]))
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in pieces) or any(m < 0 for _, m in knots):
        raise ValueError("knots go from time 0 to 1 with weights of 0 at least")
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pieces)
    out, done = [], 0.0
    for (t, m), (t2, m2) in pieces:
        out.append((t, m / whole, (m2 - m) / (t2 - t) / whole, done))
        done += (t2 - t) * (m + m2) / 2 / whole
    return out


def invert(part: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time by which the given part (0 to 1) of a source's demand has been met."""
    table = F.array(*[F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(s, ("t", "m", "slope", "done"))]) for s in segments(k)]) for k in schedules])
    seg = F.element_at(F.filter(table[rank], lambda s: s["done"] <= part), -1)
    rest = part - seg["done"]
    step = 2.0 * rest / (seg["m"] + F.sqrt(F.greatest(seg["m"] * seg["m"] + 2.0 * seg["slope"] * rest, F.lit(0.0))))
    return F.when(rest <= 0, seg["t"]).otherwise(seg["t"] + step)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs with size, source_size, target, taken, position and position_again.

    taken: words of the document that the mix holds, repeats counted; a source's sum is its target
    rounded down, the last document being cut. position: when it is first due (null: never);
    position_again: when its repeat is due. size names a column of word counts, else text is counted.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight")
    if not 0 <= share <= cap <= 2:
        raise ValueError("share must not exceed cap, nor cap two passes")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    own = [F.col(c) for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken", "position", "position_again"}]
    keyed = docs.select(*own, (F.col(size).cast("long") if size else n_words(F.col(text))).alias("size"), F.col(source).isNull().alias("__null"), F.coalesce(F.col(source), F.lit("")).alias("__source"), digest.alias("__h"))
    keyed = keyed.withColumns({"__b1": F.substring("__h", 1, 2), "__b2": F.substring("__h", 3, 2)})
    fine = keyed.groupBy(*_S, "__b1", "__b2").agg(F.sum("size").alias("__n"))
    coarse = fine.groupBy(*_S, "__b1").agg(F.sum("__n").alias("__n1"))
    plan = targets(coarse.groupBy(*_S).agg(F.sum("__n1").alias("source_size")), weights, share, cap)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("__before1", F.coalesce(F.sum("__n1").over(upto(Window.partitionBy(*_S).orderBy("__b1"))), F.lit(0)))
    fine = fine.withColumn("__before2", F.coalesce(F.sum("__n").over(upto(Window.partitionBy(*_S, "__b1").orderBy("__b2"))), F.lit(0)))
    starts = fine.join(coarse, [*_S, "__b1"]).join(plan, _S).select(*_S, "__b1", "__b2", "source_size", "target", "__rank", (F.col("__before1") + F.col("__before2")).alias("__start"))
    in_bucket = Window.partitionBy(*_S, "__b1", "__b2").orderBy("__h", key, "size")
    placed = keyed.withColumn("__own", F.coalesce(F.sum("size").over(upto(in_bucket)), F.lit(0))).join(starts, [*_S, "__b1", "__b2"])
    at, most = F.col("__start") + F.col("__own"), F.floor("target")
    again = at + F.col("source_size")
    clip = lambda room: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), room))
    due = lambda start: F.when((F.col("size") > 0) & (start < most), invert(start / F.col("target"), F.col("__rank"), schedules))
    return placed.select(*own, "size", "source_size", "target", (clip(most - at) + clip(most - again)).alias("taken"), due(at).alias("position"), due(again).alias("position_again"))


def in_order(mixed: DataFrame, key: str = "doc_id", position: str = "position") -> DataFrame:
    """Rows in order of training: range partitions, each sorted."""
    return mixed.repartitionByRange(F.col(position), F.col(key)).sortWithinPartitions(position, key)


def training_order(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mixed rows themselves: each whole document once for each time it is due, in order, with docs' columns."""
    mixed = mix(docs, key=key, **options)
    due = mixed.withColumn("__due", F.explode(F.array("position", "position_again"))).where(F.col("__due").isNotNull())
    return in_order(due, key, "__due").select(*docs.columns)
