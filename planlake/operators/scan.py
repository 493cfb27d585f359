"""Running values over long series, as a prefix scan: no series is ever ordered or gathered in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlake.sources.folders import written

#: Rows of a series that are summed in one task.
BUCKET = 4096


def bucket_rows(decay: float, most: int = BUCKET) -> int:
    """Rows of a bucket: so few that the powers of decay over a bucket stay within a double's range, but two at least, so that each level is shorter than the one below."""
    if decay <= 0 or decay >= 1:
        return max(2, most)
    return max(2, min(most, int(200 * math.log(10) / -math.log(decay))))


def placed(rows: DataFrame, order: list[str], *group: str, bucket: int = BUCKET) -> DataFrame:
    """rows with __place, from 0 in the order of the columns order (which tell rows of a group apart) within group.

    Ranges of the order are written and counted first; rows are only numbered inside one, so a hot group spreads over as many tasks as it has ranges.
    """
    n = rows.count()
    parts = max(1, -(-n // max(bucket, 8 * math.isqrt(n))))
    dealt = written(rows.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()), "series")
    counts = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"__of_{c}") for c in group], F.col("__part").alias("__of_part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = dealt.withColumn("__inside", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order)) - 1)
    same = F.col("__part") == F.col("__of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return inside.join(offsets, same).select(*rows.columns, (F.col("__inside") + F.col("__offset")).alias("__place"))


def _carried(rows: DataFrame, decay: float, group: list[str], bucket: int) -> DataFrame:
    """rows (group, __place, __x) with __y: __y at a place is decay times that at the place before it, plus __x.

    A step is the affine map y -> decay * y + x, and steps compose: those of a bucket make one map, whose constant is the bucket's own last value. The last values of
    buckets are a series themselves, shorter by a factor of bucket, with decay ** bucket for decay.
    """
    size = bucket_rows(decay, bucket)
    most = rows.agg(F.coalesce(F.max("__place"), F.lit(-1))).first()[0] + 1
    known = rows.withColumns({"__bucket": F.expr(f"__place div {size}"), "__k": F.expr(f"__place % {size}")})
    w = Window.partitionBy(*group, "__bucket").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    power = F.pow(F.lit(float(decay)), F.col("__k").cast("double"))
    # sum of decay ** (k - j) * x_j; with decay 0 only the step's own x is left
    own = F.sum(F.col("__x") / power).over(w) * power if decay else F.col("__x")
    known = known.withColumn("__own", own)
    if most <= size:
        return known.withColumn("__y", F.col("__own")).drop("__bucket", "__k", "__own")
    known = written(known, "buckets")
    lasts = known.where(F.col("__k") == size - 1).select(*group, F.col("__bucket").alias("__place"), F.col("__own").alias("__x"))
    ends = _carried(lasts, decay**size, group, bucket)
    into = ends.select(*[F.col(c).alias(f"__of_{c}") for c in group], (F.col("__place") + 1).alias("__of_bucket"), F.col("__y").alias("__into"))
    same = F.col("__bucket") == F.col("__of_bucket")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    carry = F.coalesce(F.col("__into"), F.lit(0.0)) * F.pow(F.lit(float(decay)), (F.col("__k") + 1).cast("double"))
    return known.join(into, same, "left").select(*rows.columns, (F.col("__own") + carry).alias("__y"))


def moving_averages(rows: DataFrame, value: str, order: list[str], *group: str, decay: float = 0.9, start: DataFrame | None = None, name: str = "average", bucket: int = BUCKET) -> DataFrame:
    """rows with name: each group's exponential moving average in the order of the columns order, which begins at its first value.

    start: (group, average) of what came before, which the first value is then averaged with; a group that it lacks begins anew. Null values and orders that do not tell
    rows apart are the caller's to settle; an empty table stays empty.
    """
    rows = placed(rows, order, *group, bucket=bucket)
    first = F.col("__place") == 0
    x = F.col(value).cast("double")
    if start is None:
        known = rows.withColumn("__x", F.when(first, x).otherwise((1 - decay) * x))
    else:
        same = F.lit(True)
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
        before = start.select(*[F.col(c).alias(f"__of_{c}") for c in group], F.col("average").alias("__before"))
        begun = F.when(F.col("__before").isNull(), x).otherwise(decay * F.col("__before") + (1 - decay) * x)
        known = rows.join(before, same, "left").withColumn("__x", F.when(first, begun).otherwise((1 - decay) * x)).select(*rows.columns, "__x")
    return _carried(known, decay, list(group), bucket).withColumnRenamed("__y", name).drop("__x", "__place")


def last_averages(averages: DataFrame, order: list[str], *group: str, name: str = "average") -> DataFrame:
    """(group, average): where each group's moving average stands, pre-aggregated."""
    return averages.groupBy(*group).agg(F.max_by(F.col(name), F.struct(*order)).alias("average"))
