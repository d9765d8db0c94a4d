"""Exact quantiles by rank: no group's values ever meet in one task.

Equal values are counted first. The distinct values are sorted apart in ranges over (keys, value) and written once; the ranges' sizes,
a few rows a key, tell in which range each rank lies, and only those ranges are looked into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.sources.tables import materialize


def counted(rows: DataFrame, value: Column, *keys: str, **flags: Column) -> DataFrame:
    """Distinct (keys, flags, v) with their number n, in ranges of (keys, v): what the functions below take. Null values are kept, for counts."""
    own = rows.select(*keys, *(c.alias(n) for n, c in flags.items()), value.cast("double").alias("v")).groupBy(*keys, *flags, "v").agg(F.count(F.lit(1)).alias("n"))
    return materialize(own.repartitionByRange(*keys, "v").withColumn("_range", F.spark_partition_id()), "counted")


def _met(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """A join on names in which null meets null; of b's names only a's stay."""
    other = b.select(*(F.col(c).alias(f"_b_{c}") if c in names else F.col(c) for c in b.columns))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in names), F.lit(True) if also is None else also)
    return a.join(other, same, how).drop(*(f"_b_{c}" for c in names))


def quantiles(table: DataFrame, wanted: dict[str, float], *keys: str) -> DataFrame:
    """keys and a column for each wanted quantile (name -> share), linearly interpolated, of a counted table; keys without a value have no row."""
    own = table.where("v is not null")
    sizes = own.groupBy(*keys, "_range").agg(F.sum("n").alias("_size"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    placed = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_size").over(whole)})
    place = lambda q: F.lit(q) * (F.col("_total") - 1)
    ranks = [F.struct(F.lit(name).alias("q"), F.lit(upper).alias("upper"), (F.ceil(place(q)) if upper else F.floor(place(q))).alias("rank"), (place(q) - F.floor(place(q))).alias("share")) for name, q in wanted.items() for upper in (False, True)]
    asked = placed.select(*keys, "_range", "_before", "_size", F.explode(F.array(*ranks)).alias("w")).select(*keys, "_range", "_before", "w.*")
    asked = asked.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_size"))).drop("_size")
    looked = _met(own, asked.select(*keys, "_range").distinct(), [*keys, "_range"], "left_semi")
    counts = looked.groupBy(*keys, "_range", "v").agg(F.sum("n").alias("n"))
    running = Window.partitionBy(*keys, "_range").orderBy("v")
    ends = counts.withColumn("_end", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.col("rank") - F.col("_before")
    found = _met(ends, asked, [*keys, "_range"], also=(here >= F.col("_end") - F.col("n")) & (here < F.col("_end")))
    value = lambda name, upper: F.max(F.when((F.col("q") == name) & (F.col("upper") == F.lit(upper)), F.col("v")))
    share = lambda name: F.max(F.when(F.col("q") == name, F.col("share")))
    return found.groupBy(*keys).agg(*((value(n, False) * (1 - share(n)) + value(n, True) * share(n)).alias(n) for n in wanted))


def exact_quantiles(rows: DataFrame, value: Column, wanted: dict[str, float], *keys: str) -> DataFrame:
    return quantiles(counted(rows, value, *keys), wanted, *keys)


def with_quantiles(groups: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Groups with their quantiles, null where they have no value."""
    return _met(groups, found, list(keys), "left") if keys else groups.crossJoin(F.broadcast(found))
