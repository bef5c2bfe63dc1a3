"""Places in a total order over tables of any size, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored

_LOCAL_BITS = 33  # monotonically_increasing_id(): the partition above them, the row's number in it below


def numbered(df: DataFrame, order: list[Column], out: str, name: str, running: dict[str, str] | None = None) -> DataFrame:
    """df with `out`, the place of each row from 0 in the given order, and running sums: {new column: summed column}, the row itself included.

    df is stored first, as ranges take a look at all of it before rows are dealt. Rows are dealt by ranges of the order and sorted where they are, so a hot value is split as long as the order tells its rows
    apart; the sorted rows are stored, and each part's count and sums are added to its rows. What is broadcast is one
    row for each part. Nulls come first. Rows that are equal in the order get places in no certain order."""
    running = running or {}
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    rows = stored(rows, name).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", _LOCAL_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_before_part"), *[F.sum(c).alias(f"_s_{o}") for o, c in running.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    before = sizes.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sizes.columns[1:]])
    rows = rows.withColumn("_part", part)
    if running:
        so_far = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({o: F.sum(c).over(so_far) for o, c in running.items()})
    rows = rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_before_part") + F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    return rows.withColumns({o: F.col(o) + F.col(f"_s_{o}") for o in running}).select(*df.columns, out, *running)
