"""Dense numbering of rows in a global order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def dense_index(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with `name` = 0, 1, ... in the given order (which should have no ties).  Rows are range-partitioned and
    sorted; one count for each partition reaches the driver."""
    low = (1 << 33) - 1
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(low))
    placed = staged(placed, "order")
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    if not before:
        return placed.drop("_part").withColumnRenamed("_at", name)
    offsets = F.create_map(*[x for p, o in before.items() for x in (F.lit(p), F.lit(o).cast("bigint"))])
    return placed.withColumn(name, F.col("_at") + F.element_at(offsets, F.col("_part"))).drop("_part", "_at")
