"""Exact quantiles of groups of any size: no task holds a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.scratch import materialised


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and quantiles: for each group the values at those shares (0 to 1), as `percentile` interpolates them.

    Equal values are counted first, then ranges of (keys, value) are dealt over tasks. Each range's counts, summed up over
    the ranges before it, tell which range holds a wanted place; running sums inside that range tell the value. So a
    group is as many tasks' work as it has values for. Null values don't count, and a group of such only has no row.
    Without keys all rows are one group; a null key is a group like others.
    """
    named = {f"_k{i}": F.col(k) for i, k in enumerate(keys)} or {"_k0": F.lit(0)}
    group = list(named)
    counts = rows.select(*[c.alias(n) for n, c in named.items()], F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL").groupBy(*group, "_value").agg(F.count("*").alias("_n"))
    dealt = materialised(counts.repartitionByRange(*group, "_value").withColumn("_part", F.spark_partition_id()), "values")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*group, "_part").agg(F.sum("_n").alias("_own")).withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    parts = materialised(parts, "ranges")  # a row a group and range
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)])).alias("_x")
    places = parts.groupBy(*group).agg(F.sum("_own").alias("_all")).select(*group, "_all", wanted).select(*group, F.col("_x.i").alias("_i"), ((F.col("_all") - 1) * F.col("_x.share")).alias("_at"))
    # an interpolated value lies between two places; these may be in two ranges
    ends = places.select(*group, "_i", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_place"))
    a, b = ends.alias("a"), parts.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group])
    holding = a.join(b, same & (F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_own"))).select("a.*", "_part", "_before")
    inside = Window.partitionBy(*group, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.withColumn("_upto", F.sum("_n").over(inside))
    c, d = holding.alias("c"), running.alias("d")
    same = reduce(Column.__and__, [F.col(f"c.{g}").eqNullSafe(F.col(f"d.{g}")) for g in group])
    found = c.join(d, (F.col("c._part") == F.col("d._part")) & same & (F.col("_place") - F.col("_before") < F.col("_upto")) & (F.col("_place") - F.col("_before") >= F.col("_upto") - F.col("_n")))
    low, high = F.floor("_at"), F.ceil("_at")
    weight = F.when(low == high, F.lit(1.0)).when(F.col("_place") == low, high - F.col("_at")).otherwise(F.col("_at") - low)
    values = found.select(*[F.col(f"c.{g}") for g in group], "_i", "_value", (weight * F.col("_value")).alias("_share")).groupBy(*group, "_i")
    values = values.agg(F.when(F.min("_value") == F.max("_value"), F.min("_value")).otherwise(F.sum("_share")).alias("_value"))
    out = values.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_value"))), lambda x: x["_value"]).alias("quantiles"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "quantiles")
