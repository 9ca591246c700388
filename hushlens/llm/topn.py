"""Top N items within every group, by a hot-cold split.

Exact group counts tell heavy groups from light ones. Light groups go through one ordinary window. Rows of heavy groups get
a salt, are range-sorted by (group, salt), each slice keeps its first N, and a last window over the few survivors merges the
slices. Both results are united; no group is ever handled whole by one task.

Defined results: rows whose group is null are left out; null scores come last; remaining ties go to the smaller id; repeated
rows count by themselves; groups with fewer than N rows are kept whole; an empty table gives no rows. All columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, free_name

#: At most this many groups can be heavy, whatever the table's size: a heavy group has more than total / MAX_HEAVY rows.
MAX_HEAVY = 4_096


def top_n(df: DataFrame, group: str, order: Sequence[Column], n: int, *, salt_by: str, heavy_rows: int = 20_000, slice_rows: int = 10_000) -> DataFrame:
    """The first n rows of every group in the given order, with their rank.

    heavy_rows: a group is heavy if it has more rows than this and than total / MAX_HEAVY; so the list of heavy groups has
    a proven bound and is broadcast. slice_rows: rows of one salted slice, at least; the square root of the group's rows if that
    is more, so that neither a slice nor what the slices leave is large. The counts are checkpointed; the rows are read once for
    them, once for the light and once for the heavy groups.
    """
    count, salt, slices, rank = (free_name(df, c) for c in ("_count", "_salt", "_slices", "rank"))
    known = df.where(F.col(group).isNotNull())
    counts = cut_lineage(known.groupBy(group).agg(F.count(F.lit(1)).alias(count)))
    total = counts.agg(F.sum(count)).first()[0] or 0
    bound = max(heavy_rows, total // MAX_HEAVY)
    heavy = counts.where(F.col(count) > bound).select(F.col(group), F.ceil(F.col(count) / F.greatest(F.lit(float(slice_rows)), F.sqrt(count))).alias(slices))

    light_rows = known.join(F.broadcast(heavy.select(group)), group, "left_anti")
    light = light_rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)

    hot = known.join(F.broadcast(heavy), group).withColumn(salt, F.pmod(F.xxhash64(salt_by), F.col(slices))).drop(slices)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = hot.repartitionByRange(parts, group, salt).withColumn(rank, F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))).where(F.col(rank) <= n)
    merged = sliced.drop(salt, rank).withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)
    return light.unionByName(merged)
