"""Folds by crc32 of the id's text, and bounded samples of labelled rows."""

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def folds(ids, of: int) -> np.ndarray:
    """crc32 of each id as text, mod `of`; -1 for null."""
    return np.fromiter((-1 if i is None else zlib.crc32(str(i).encode()) % of for i in ids), np.int64, len(ids))


def fold(column, of: int):
    """The same as a column; null ids are in no fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(of)), F.lit(-1))


def sample(labels: DataFrame, label: str, size: int, doc: str = "doc_id") -> DataFrame:
    """(doc, label, weight) of at most `size` labelled rows of each value, those of smallest hash; weight makes their
    sum the number of rows of that value. At most size x values rows, so it may be broadcast."""
    rows = labels.select(doc, label).where(F.col(doc).isNotNull() & F.col(label).isNotNull()).distinct()
    order = Window.partitionBy(label).orderBy(F.xxhash64(doc), doc)
    kept = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("place")
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    return kept.join(F.broadcast(n), label).withColumn("weight", F.col("n") / F.least(F.col("n"), F.lit(size))).drop("n")
