"""Positions inside groups without sending a whole group to one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` puts every row of a group
into one task; with one group holding a third of all rows that task becomes
the job.  Here the rows are range-partitioned on (g, o) — the sampler splits
a hot group across many partitions — numbered locally, and shifted by the
row counts of the same group in earlier partitions (a table with at most
#partitions rows per group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row within its group by ``order``.

    ``order`` must be unique within a group (ties are not broken).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group + order]
    ranged = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    # Reliable checkpoint: the partition ids must not change if a task is retried.
    from judgefuse.session import checkpoint_dir
    checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    w_local = Window.partitionBy("_pid", *group).orderBy(*order)
    local = ranged.withColumn("_lpos", F.row_number().over(w_local) - 1)
    counts = ranged.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0))).drop("_cnt")
    out = local.join(offsets, group + ["_pid"], "left")
    return out.withColumn(name, (F.col("_off") + F.col("_lpos")).cast("long")).drop("_pid", "_lpos", "_off")
