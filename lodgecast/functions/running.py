"""Running totals of groups of any size, by a prefix sum in two passes.

A window over a whole group is one task. Here the rows are dealt by ranges of (group, order), so a large group spreads over
many parts; the parts' totals are few (one row for each group and part), and their running sum says where each part begins.
What is left is a window inside each part.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodgecast.functions.lookups import join_lookup
from lodgecast.functions.stored import stored


def running_total(df: DataFrame, group: str, order: str, amount: str) -> DataFrame:
    """Add ``below``, the amounts of the group's rows before this one, and ``total``, those of all its rows.

    ``group`` and ``order`` together must tell the rows apart. The number of parts is that of the session's shuffles.
    """
    # Written, so that a part keeps its number when a task runs again.
    dealt = stored(df.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(group, "__part").agg(F.sum(amount).alias("__sum"))
    whole = Window.partitionBy(group)
    ahead = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        group, "__part", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start"), F.sum("__sum").over(whole).alias("total")
    )
    inside = Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = join_lookup(summed, starts, [group, "__part"], "inner")
    return joined.withColumn("below", F.col("__start") + F.col("__inside")).drop("__part", "__start", "__inside")
