"""Places of rows inside groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_in_groups(rows: DataFrame, group: list[str], key: str, prefix: int = 2) -> DataFrame:
    """``rows`` with ``rank`` (from 0) by ``key`` inside ``group``.

    Keys are strings, distinct inside a group.  Rows are first ranked inside
    (group, first ``prefix`` characters of the key); the number of rows with
    smaller first characters is added from a table of counts.
    """
    head = rows.withColumn("_head", F.substring(F.col(key), 1, prefix))
    inside = F.row_number().over(Window.partitionBy(*group, "_head").orderBy(key)) - 1
    counts = head.groupBy(*group, "_head").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_head")) - F.col("_n")
    base = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_head").alias("_h"), before.alias("_before"))
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_head").eqNullSafe(F.col("_h"))]
    return (head.withColumn("_inside", inside).join(base, on)
            .withColumn("rank", F.col("_inside") + F.col("_before")).select(*rows.columns, "rank"))
