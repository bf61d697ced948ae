"""Row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import materialize


def numbered(frame: DataFrame, name: str, *keys: Column) -> DataFrame:
    """frame with a long column name: 1 for the first row by keys, and so on; rows equal in all keys are in any order.

    Rows are dealt out by ranges of the keys and written with their range's number, which fixes it; a range's rows are
    numbered in their task, and the counts of the ranges before, one row a range, are added.
    """
    taken = {c.lower() for c in frame.columns}
    part, before = (next(n for n in (f"{'_' * i}{base}" for i in range(1, 99)) if n not in taken) for base in ("range", "before"))
    order = [f"{part}_{i}" for i in range(len(keys))]
    keyed = frame.withColumns(dict(zip(order, keys))).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    dealt = materialize(keyed, "ranges")
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))
    offsets = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(offsets), part).select(*frame.columns, (F.col(name) + F.col(before)).alias(name))
