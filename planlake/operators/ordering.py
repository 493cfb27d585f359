"""Dense positions in a shuffled order, without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.sources.folders import written

#: Rows that are ordered in one task, about.
BUCKET_ROWS = 8192


def shuffled(key: Column, seed: int) -> Column:
    """A stable order that looks random: a digest of the seed and a key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ranked(rows: DataFrame, digest: Column, key: str, *within: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with place, from 1 in the order of digest (hexadecimal text, then key), and n, the number of rows; both among rows alike in within. Columns so named are replaced.

    Digests deal rows into buckets of bounded size. Buckets are counted first, and rows are only ordered inside one, so that a hot group is
    spread over many tasks.
    """
    keyed = written(rows.withColumn("__digest", digest), "digests")  # the caller's plan runs once
    buckets = max(1, keyed.count() // bucket_rows)
    leading = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("double")
    dealt = keyed.withColumn("__bucket", F.floor(leading * F.lit(buckets / 2.0**32)).cast("long"))
    counts = dealt.groupBy(*within, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"__of_{c}") for c in within],
        F.col("__bucket").alias("__of_bucket"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(*within)).alias("__all"),
    )
    inside = dealt.withColumn("__inside", F.row_number().over(Window.partitionBy(*within, "__bucket").orderBy("__digest", key)))
    same = F.col("__bucket") == F.col("__of_bucket")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    kept = [c for c in rows.columns if c not in ("place", "n")]
    return inside.join(offsets, same).select(*kept, (F.col("__inside") + F.col("__offset")).alias("place"), F.col("__all").alias("n"))
