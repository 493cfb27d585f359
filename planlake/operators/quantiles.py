"""Exact quantiles of groups of any size: ranges of values are counted and narrowed until each holds the value that is sought.

A group's values are never ordered or gathered. In each pass every group's open ranges are split into BINS equal ones, which are counted with partial
aggregation; the bin that holds the rank sought is the next range. A range ends when its values are all one, or too close to split, and then the few distinct
values in it are counted. Only bins move, at most BINS for each range and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.sources.folders import written

BINS = 1024
#: Distinct values of a range that are counted outright.
FEW = 4096


def _same(group: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in group:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def order_statistics(rows: DataFrame, value: str, ranks: DataFrame, *group: str, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(group, rank, value) for each (group, rank) of ranks: the value at that place, from 0, of the group's values in order. Null values take no places.

    value is a numeric column; a rank past the group's end has no row.
    """
    known = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"))
    ends = known.groupBy(*group).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__c")).select(*[F.col(c).alias(f"__of_{c}") for c in group], "__lo", "__hi", "__c")
    open_ = ranks.join(ends, _same(group, "__of_")).where("rank >= 0 AND rank < __c").select(*group, "rank", F.col("rank").alias("__left"), "__lo", "__hi", "__c")
    open_ = written(open_, "ranks")
    done = open_.where("__lo = __hi").select(*group, "rank", F.col("__lo").alias("value"))
    open_ = open_.where("__lo < __hi")
    while not open_.isEmpty():
        ranges = open_.select(*group, "__lo", "__hi", "__c").distinct()
        sought = ranges.select(*[F.col(c).alias(f"__of_{c}") for c in group], "__lo", "__hi", "__c")
        inside = known.join(sought, _same(group, "__of_") & F.col("__v").between(F.col("__lo"), F.col("__hi"))).select(*group, "__v", "__lo", "__hi", "__c")
        width = (F.col("__hi").cast("double") - F.col("__lo").cast("double")) / bins
        split = F.least(F.lit(bins - 1), F.floor((F.col("__v").cast("double") - F.col("__lo").cast("double")) / width).cast("long"))
        # few values, or values that doubles cannot part, are told by themselves
        outright = (F.col("__c") <= few) | (width <= 0) | (F.col("__lo").cast("double") + width == F.col("__lo").cast("double"))
        keyed = inside.withColumns({"__bin": F.when(~outright, split), "__own": F.when(outright, F.col("__v"))})
        counts = keyed.groupBy(*group, "__lo", "__hi", "__bin", "__own").agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        w = Window.partitionBy(*group, "__lo", "__hi").orderBy("__least").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("__upto", F.sum("__n").over(w)).select(*[F.col(c).alias(f"__of_{c}") for c in group], F.col("__lo").alias("__of_lo"), F.col("__hi").alias("__of_hi"), "__n", "__least", "__most", "__upto")
        place = (F.col("__left") >= F.col("__upto") - F.col("__n")) & (F.col("__left") < F.col("__upto"))
        hit = open_.join(upto, _same(group, "__of_") & (F.col("__lo") == F.col("__of_lo")) & (F.col("__hi") == F.col("__of_hi"))).where(place)
        hit = written(hit.select(*group, "rank", (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__left"), F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), F.col("__n").alias("__c")), "ranks")
        done = done.union(hit.where("__lo = __hi").select(*group, "rank", F.col("__lo").alias("value")))
        open_ = hit.where("__lo < __hi")
    return done


def _ranked(rows: DataFrame, value: str, shares: dict[str, float], places: dict[str, list[Column]], group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(group, __n, the places of each share), and the values at all places."""
    sizes = rows.groupBy(*group).agg(F.count(value).alias("__n"))
    sizes = written(sizes.withColumns({f"__{k}_{i}": p for k in shares for i, p in enumerate(places[k])}), "group-sizes")
    ranks = sizes.select(*group, F.explode(F.array_distinct(F.array(*[f"__{k}_{i}" for k in shares for i in range(len(places[k]))]))).alias("rank"))
    return sizes, order_statistics(rows, value, ranks, *group)


def _looked_up(sizes: DataFrame, found: DataFrame, group: Sequence[str]) -> DataFrame:
    """sizes with a map from rank to value; a group has a few ranks."""
    maps = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__at"))
    return sizes.join(maps.select(*[F.col(c).alias(f"__of_{c}") for c in group], "__at"), _same(group, "__of_"), "left")


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *group: str) -> DataFrame:
    """(group, a double for each of shares): the value at share * (n - 1), between two values in proportion; null for a group without values."""
    at = {k: F.lit(float(p)) * (F.col("__n") - 1) for k, p in shares.items()}
    sizes, found = _ranked(rows, value, shares, {k: [F.floor(x).cast("long"), F.ceil(x).cast("long")] for k, x in at.items()}, group)
    known = _looked_up(sizes, found, group)

    def between(k: str) -> Column:
        low, high = (F.col("__at")[F.col(f"__{k}_{i}")].cast("double") for i in (0, 1))
        part = at[k] - F.floor(at[k])
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)

    return known.select(*group, *[between(k).alias(k) for k in shares])


def nearest_ranks(rows: DataFrame, value: str, shares: dict[str, float], *group: str) -> DataFrame:
    """(group, a value for each of shares): the value at share * (n - 1), rounded half to even; null for a group without values."""
    sizes, found = _ranked(rows, value, shares, {k: [F.bround(F.lit(float(p)) * (F.col("__n") - 1)).cast("long")] for k, p in shares.items()}, group)
    return _looked_up(sizes, found, group).select(*group, *[F.col("__at")[F.col(f"__{k}_0")].alias(k) for k in shares])
