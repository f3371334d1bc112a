"""Numbering rows in order without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of an order at most; each is a literal in the plan.
STRETCHES = 256


def stretches(rows: DataFrame, order: str, by: str | None = None, most: int = STRETCHES) -> Column:
    """A column that deals rows into stretches of a number's order that hold about as many rows each.

    Where each stretch ends is read off quantiles, for each value of `by` (of which there are few) on its own. These come to the
    driver, `most` numbers at most for each, and stand in the plan, so that a row falls into the same stretch whenever it is computed.
    """
    n = min(most, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    if not shares:
        return F.lit(0)
    found = rows.groupBy(*([by] if by else [])).agg(F.percentile_approx(order, shares).alias("ends")).collect()

    def at(ends: Sequence | None) -> Column:
        literals = [F.lit(e) for e in sorted(set(ends or []))]
        return F.size(F.filter(F.array(*literals), lambda e: e < F.col(order))) if literals else F.lit(0)

    if not by:
        return at(found[0]["ends"])
    return F.coalesce(*[F.when(F.col(by) == r[by], at(r["ends"])) for r in found], F.lit(0))


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """rows with their place in the order of a number, from 1: places within stretches, and how many rows the stretches before hold."""
    dealt = rows.withColumn("_stretch", stretches(rows, order))
    sizes = dealt.groupBy("_stretch").agg(F.count("*").alias("_size"))
    before = sizes.select("_stretch", (F.sum("_size").over(Window.orderBy("_stretch")) - F.col("_size")).alias("_before"))  # a row for each stretch
    own = F.row_number().over(Window.partitionBy("_stretch").orderBy(order))
    return dealt.withColumn(name, own.cast("long")).join(F.broadcast(before), "_stretch").withColumn(name, F.col(name) + F.col("_before")).drop("_stretch", "_before")
