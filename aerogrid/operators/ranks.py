"""Ranks of a whole table and exact quantiles of many groups and columns at once, without all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, small

#: Values of a group up to which they are sorted at once; of more, they are counted in bins until so few are left.
SORTED, BINS = 100_000, 1000


def with_rank(df: DataFrame, order: Sequence[Column | str], into: str = "rank", parts: int | None = None) -> DataFrame:
    """df with the place of each row, from 0, in the order of the whole table; the order must tell rows apart for places to be always the same.

    Rows are dealt to ranges and sorted there; a range begins where those before it end, by their numbers of rows.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_m", 33))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = dealt.groupBy("_part").count().select("_part", before.alias("_before"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(into, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_m")


def group_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], shares: Sequence[float], most: int = SORTED, bins: int = BINS) -> DataFrame:
    """keys, col, share, value: the interpolated quantiles of each column in each group; null, NaN and infinite values count as unknown.

    A group without a known value has no row for the column; null keys are groups. Without keys the table is one group. Groups of up to `most` values are sorted in an
    aggregate each. Of larger ones only counts meet: values are counted in bins between the least and the greatest, then those of the bin that holds
    a wanted rank again, all groups and ranks together, until at most `most` are left to sort or all are equal.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    known = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), known(c).alias("v")) for c in cols])).alias("_e")
    values = df.select(group.alias("_g"), long).select("_g", "_e.col", "_e.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    stats = cut(values.groupBy("_g", "col").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    wanted = F.array(*[F.lit(float(s)) for s in shares])

    def named(found: DataFrame) -> DataFrame:
        return found.select(*[F.col(f"_g.`{k}`").alias(k) for k in keys], "col", "share", "value")

    large = cut(stats.filter(F.col("n") > most))
    some = values if large.isEmpty() else values.join(small(large.select("_g", "col")), ["_g", "col"], "left_anti")
    at_once = some.groupBy("_g", "col").agg(F.percentile("v", wanted).alias("q"))
    at_once = at_once.select("_g", "col", F.explode(F.arrays_zip(wanted.alias("share"), F.col("q").alias("value"))).alias("_e")).select("_g", "col", "_e.share", "_e.value")
    if large.isEmpty():
        return named(at_once)

    places = large.select("_g", "col", "n", "low", "high", F.explode(wanted).alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    places = places.withColumn("k0", F.floor("at")).withColumn("k1", F.least(F.col("k0") + 1, F.col("n") - 1))
    # of each rank: where its value lies, how many lie below that, and how many there
    state = places.select("_g", "col", "low", "high", F.explode(F.array("k0", "k1")).alias("k"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct()
    by = ["_g", "col", "k"]
    order = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    going = (F.col("inside") > most) & (F.col("low") < F.col("high"))
    state = cut(state)
    while not state.filter(going).isEmpty():
        width = F.col("high") / bins - F.col("low") / bins
        number = F.least(F.coalesce(F.floor((F.col("v") - F.col("low")) / F.nullif(width, F.lit(0.0))), F.when(F.col("v") > F.col("low"), 1).otherwise(0)), F.lit(bins - 1))
        met = values.join(small(state.filter(going)), ["_g", "col"]).filter(F.col("v").between(F.col("low"), F.col("high")))
        held = met.groupBy(*by, "below", number.alias("b")).agg(F.count("v").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        held = held.withColumn("below", F.col("below") + F.coalesce(F.sum("inside").over(order), F.lit(0)))
        held = held.filter((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("inside")))
        state = cut(state.filter(~going).unionByName(held.select(*state.columns)))
    level = state.filter(F.col("low") == F.col("high")).select(*by, F.col("low").alias("v"))
    left = values.join(small(state.filter(F.col("low") < F.col("high"))), ["_g", "col"]).filter(F.col("v").between(F.col("low"), F.col("high")))
    left = left.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1 + F.col("below")).filter(F.col("_i") == F.col("k")).select(*by, "v")
    found = cut(level.unionByName(left))
    ends = [found.select("_g", "col", F.col("k").alias(f"k{i}"), F.col("v").alias(f"v{i}")) for i in (0, 1)]
    both = places.join(ends[0], ["_g", "col", "k0"]).join(ends[1], ["_g", "col", "k1"])
    both = both.withColumn("value", F.col("v0") + (F.col("at") - F.col("k0")) * (F.col("v1") - F.col("v0")))
    return named(at_once.unionByName(both.select("_g", "col", "share", "value")))
