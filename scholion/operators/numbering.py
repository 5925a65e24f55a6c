"""Row numbers over a whole table without bringing it into one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bfs import checkpoint


def numbered(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """df with the number of each row, from 1, in the order of columns or expressions, which must have no ties.

    Rows are dealt by ranges of the order and sorted there; what comes before a range is a sum over one row a range. The
    dealt rows are written to the shared folder first, so both steps see the same ranges."""
    dealt = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
