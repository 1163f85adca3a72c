"""Running numbers and sums over a whole table, without one task that sees all of it.

Rows are dealt out by ranges of the order, once. Each partition counts and adds up its own; what comes before a
partition is a sum over one row per partition, added back afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

PLACE_BITS = 33  # of monotonically_increasing_id: the row in its partition; above it the partition


def _before(per_part: DataFrame, value: str) -> DataFrame:
    """(part, ahead): the sum of `value` over the partitions before each. One row per partition."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("part", F.coalesce(F.sum(value).over(ahead), F.lit(0)).alias("ahead"))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds `name`, the number of each row in this order, from 0. The rows are written."""
    place = f"_{name}"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    written = materialize(dealt, "numbered")
    part, inside = F.shiftrightunsigned(place, PLACE_BITS), F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = materialize(_before(sizes, "n"), "ahead").withColumnRenamed("part", "_part")
    return written.join(ahead, part == F.col("_part")).select(*df.columns, (F.col("ahead") + inside).alias(name))


def sum_below(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` (whole numbers, no null) over all rows before each one in this order."""
    schema = T.StructType([
        *df.schema.fields, T.StructField(name, T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_sum", T.LongType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = batch[value].to_numpy(zero_copy_only=False).astype(np.int64)
            sums = total + np.cumsum(own)
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums - own), batch.columns[-1], pa.array(own)], schema.names)

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    written = materialize(dealt.mapInArrow(add_up, schema), "sums")
    ahead = materialize(_before(written.groupBy(F.col("_part").alias("part")).agg(F.sum("_sum").alias("sum")), "sum"), "ahead")
    return written.join(ahead, F.col("_part") == F.col("part")).select(*df.columns, (F.col("ahead") + F.col(name)).alias(name))
