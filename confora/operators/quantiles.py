"""Exact quantiles of groups of any size.

A built-in percentile keeps the distinct values of a group in one buffer. Groups of more than ``HOT`` values are refined instead: a
quantile is made of one or two order statistics, and each is closed in by rounds of histograms. A round counts the values
of the interval that is left in ``BINS`` bins of equal width, which is a map-side aggregation, and goes on with the least and the greatest value
of the bin that holds the rank. It ends when they are equal: ties need no case of their own, and as the least and the greatest value
lie in different bins, every round excludes some.

Nulls are no values. Groups with infinite values or NaN keep to the built-in function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import broadcast_if_few, written

#: Values of a group that a buffer may hold.
HOT = 1_000_000
BINS = 1024


def weighted(low: Column, high: Column, at: Column) -> Column:
    """Between two neighbours in order, as the built-in percentile weighs them."""
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def stepped(low: Column, high: Column, at: Column) -> Column:
    """Between two neighbours in order, as a step from the nearer one. Weights add up to more than the exact value at times (51 and 56 at 0.2 to more than 52), which a strict threshold tells apart."""
    step, share = high - low, at - F.floor(at)
    near = F.when(share < 0.5, low + step * share).otherwise(high - step * (1 - share))
    return F.when(low == high, low).when(F.abs(step) < float("inf"), near).otherwise(weighted(low, high, at))


def stepped_quantile(values: Column, fraction: float) -> Column:
    """Aggregate: a quantile of the values of a group, which are held in one buffer; null where there are none."""
    ordered = F.sort_array(F.collect_list(values.cast("double")))
    at = F.lit(float(fraction)) * (F.size(ordered) - 1)
    return stepped(F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int")), at)


def refined(values: DataFrame, groups: DataFrame, fractions: dict[str, float], between=weighted) -> DataFrame:
    """(key, one column for each fraction) of the ``groups`` (key, n, low, high) among ``values`` (key, v)."""
    at = {name: F.lit(float(f)) * (F.col("n") - 1) for name, f in fractions.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at.values()])))
    state = groups.select("key", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "low", "high")
    done = []
    while True:
        state = written(state, "intervals")
        done.append(state.where("low = high"))
        left = state.where("low < high")
        if left.isEmpty():
            break
        half = lambda a, b: F.col(a) / 2 - F.col(b) / 2  # noqa: E731  differences of large numbers stay finite
        bin_of = F.least(F.floor(half("v", "low") / half("high", "low") * BINS), F.lit(BINS - 1))
        inside = values.join(broadcast_if_few(left), "key").where(F.col("v").between(F.col("low"), F.col("high")))
        counts = inside.groupBy("key", "rank", "below", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.col("below") + F.sum("n").over(Window.partitionBy("key", "rank").orderBy("bin")) - F.col("n")
        counts = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        state = counts.select("key", "rank", F.col("before").alias("below"), "low", "high")
    found = reduce(DataFrame.unionByName, done).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("value"))

    def value(p: Column) -> Column:
        low, high = F.get(F.map_values(F.map_filter("value", lambda k, _: k == F.floor(p))), F.lit(0)), F.get(F.map_values(F.map_filter("value", lambda k, _: k == F.ceil(p))), F.lit(0))
        return between(low, high, p)

    return found.join(groups.select("key", "n"), "key").select("key", *[value(p).alias(name) for name, p in at.items()])


def quantiles(df: DataFrame, by: list, value: str, fractions: dict[str, float], hot: int | None = None, steps: bool = False) -> DataFrame:
    """(by, one column for each fraction): as the built-in percentile gives them, or by ``steps``, with no group of more than ``hot`` values in one buffer."""
    hot = HOT if hot is None else hot
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    d = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null")
    finite = F.abs("v") < float("inf")  # false for NaN, which is the greatest double here
    sizes = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.bool_and(finite).alias("finite"))
    large = written(sizes.where((F.col("n") > hot) & F.col("finite")).drop("finite"), "large")
    plain = [(stepped_quantile(F.col("v"), f) if steps else F.percentile("v", F.lit(float(f)))).alias(name) for name, f in fractions.items()]
    if large.isEmpty():
        found = d.groupBy("key").agg(*plain)
    else:
        few = broadcast_if_few(large.select("key"))
        found = d.join(few, "key", "left_anti").groupBy("key").agg(*plain).unionByName(refined(d.join(few, "key", "left_semi"), large, fractions, stepped if steps else weighted))
    names = [c if isinstance(c, str) else f"k{i}" for i, c in enumerate(by)]
    return found.select(*[F.col(f"key.k{i}").alias(c) for i, c in enumerate(names)], *fractions)
