"""Places of rows in an order, and values of rows before, without bringing a large group together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shared_table

#: Rows up to which a window per group is used; beyond it, groups are spread over tasks by range.
WINDOW_ROWS = 2_000_000


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, window_rows: int | None = None) -> DataFrame:
    """df with `name` bigint: how many rows of the same `by` come before in `order` (which has no equals within a group).

    Large tables are sorted over tasks by range; a row's place is its place in its task plus the rows of its group in the
    tasks before, of which there is one number for each group and task.
    """
    df = shared_table(df, "unranked")  # made once, counted and ranked from there
    if df.count() <= (WINDOW_ROWS if window_rows is None else window_rows):
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    keys = [*by, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = shared_table(dealt.withColumn("task_", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id()), "ranked")
    parts = table.groupBy(*by, "task_").agg(F.min("row_").alias("first_"), F.count("*").alias("rows_"))
    before = F.coalesce(F.sum("rows_").over(Window.partitionBy(*by).orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("before_", before).drop("rows_")
    return table.join(offsets, [*by, "task_"]).withColumn(name, (F.col("before_") + F.col("row_") - F.col("first_")).cast("long")).select(*df.columns, name)


def before(df: DataFrame, by: list[str], order: list[str], value: str, name: str, window_rows: int | None = None) -> DataFrame:
    """df with `name`: the value of the row before in `order` of the same `by` (null for the first; no equals within a group).

    Large tables are sorted over tasks by range; only the first row of a group in a task looks at another task, of which
    there is one value for each group and task.
    """
    df = shared_table(df, "unordered")
    if df.count() <= (WINDOW_ROWS if window_rows is None else window_rows):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    keys = [*by, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = shared_table(dealt.withColumn("task_", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id()), "ordered")
    ends = table.groupBy(*by, "task_").agg(F.max_by(value, "row_").alias("end_"))
    carried = ends.withColumn("carried_", F.lag("end_").over(Window.partitionBy(*by).orderBy("task_"))).drop("end_")
    here = table.withColumn("here_", F.lag(value).over(Window.partitionBy(*by, "task_").orderBy("row_")))
    first = F.row_number().over(Window.partitionBy(*by, "task_").orderBy("row_")) == 1
    return here.withColumn("first_", first).join(carried, [*by, "task_"]).withColumn(name, F.when(F.col("first_"), F.col("carried_")).otherwise(F.col("here_"))).select(*df.columns, name)
