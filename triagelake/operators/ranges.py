"""Running sums and places over a whole table without a window over all of it: by ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators.similarity import cut


def running_sums(df: DataFrame, keys: list[Column], *values: str) -> DataFrame:
    """df with ``before_<value>`` for each value: its sum over all rows before a row in the order of the keys.

    The keys must tell rows apart. Rows are dealt by range; sums run inside a range, and each range starts with the total
    of those before it, of which there is one row each.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.select("*", *(k.alias(n) for n, k in zip(names, keys)))
    rows = cut(rows.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()))
    before = Window.unboundedPreceding, -1
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = rows.groupBy("_range").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    ahead = Window.orderBy("_range").rowsBetween(*before)
    totals = F.broadcast(totals.select(F.col("_range").alias("_of"), *(zero(F.sum(f"_{v}").over(ahead)).alias(f"_{v}") for v in values)))
    own = Window.partitionBy("_range").orderBy(*names).rowsBetween(*before)
    rows = rows.withColumns({f"before_{v}": zero(F.sum(v).over(own)) for v in values})
    joined = rows.join(totals, F.col("_range") == F.col("_of"))
    return joined.select(*df.columns, *((F.col(f"before_{v}") + F.col(f"_{v}")).alias(f"before_{v}") for v in values))


def ranked(df: DataFrame, *keys: Column) -> DataFrame:
    """df with ``place``, from 1 on, in the order of the keys, which must tell rows apart."""
    rows = running_sums(df.withColumn("_one", F.lit(1)), list(keys), "_one")
    return rows.select(*df.columns, (F.col("before__one") + 1).alias("place"))
