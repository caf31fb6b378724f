"""Running sums in the order of a value without putting a group in order in one task.

A group's values are dealt into ranges: by sign and logarithm, 32 ranges for each power of two, so that heavy tails don't
meet in one range. A range with more than MOST rows is dealt again into 2^13 finer ones, and one of those, if need be, into
2^12 more. Sums run inside a range, and what lies before a range is a sum over the totals of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range that one task puts in order.
MOST = 1_000_000
#: Low bits of a value's place that a coarse, a finer and the finest range leave out.
_COARSE, _FINE, _FINEST = 29, 16, 4


def _place(value: Column) -> Column:
    """A whole number that never falls as the value rises: 2^34 steps for each power of two. NaN comes last, as in sorting."""
    size = F.floor((F.log2(F.abs(value)) + 1100.0) * float(1 << 34)) + 1
    own = F.when(value == 0, F.lit(0)).when(F.abs(value) == float("inf"), F.lit(1 << 47)).otherwise(size)
    return F.when(F.isnan(value), F.lit(1 << 48)).otherwise(F.when(value < 0, -own).otherwise(own)).cast("long")


def _range(place: Column, bits: int) -> Column:
    return F.shiftright(place, bits)


def with_ranges(rows: DataFrame, by: list[str], value: str, most: int | None = None) -> DataFrame:
    """rows with `_range`, which never falls as value rises; a group has few rows in each, if its values can be told apart."""
    most = most or MOST
    own = rows.withColumn("_place", _place(F.col(value).cast("double"))).withColumn("_fine", _range(F.col("_place"), _FINE))
    fine = own.groupBy(*by, "_fine").agg(F.count(F.lit(1)).alias("_c"))
    coarse = F.sum("_c").over(Window.partitionBy(*by, F.shiftright("_fine", _COARSE - _FINE)))
    bits = F.when(coarse <= most, F.lit(_COARSE)).when(F.col("_c") <= most, F.lit(_FINE)).otherwise(F.lit(_FINEST))
    dealt = own.join(fine.select(*by, "_fine", bits.alias("_bits")), [*by, "_fine"])
    return dealt.select(*rows.columns, F.expr("shiftleft(shiftright(_place, _bits), _bits)").alias("_range"))


def running(dealt: DataFrame, by: list[str], value: str, columns: list[str], falling: bool = False, least: bool = False) -> DataFrame:
    """dealt (by with_ranges) with, for each of the columns c, `c_upto`: its sum, or its least value, over the group's rows
    up to this one as value rises (or falls)."""
    func, both = (F.min, F.least) if least else (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))
    by_range, by_value = (F.col(c).desc() if falling else F.col(c) for c in ("_range", value))
    totals = dealt.groupBy(*by, "_range").agg(*[func(c).alias(f"_t{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(*by).orderBy(by_range).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select(*by, "_range", *[func(f"_t{i}").over(before).alias(f"_b{i}") for i in range(len(columns))])
    inside = Window.partitionBy(*by, "_range").orderBy(by_value).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *[func(c).over(inside).alias(f"_s{i}") for i, c in enumerate(columns)]).join(starts, [*by, "_range"])
    return summed.select(*dealt.columns, *[both(F.col(f"_s{i}"), F.col(f"_b{i}")).alias(f"{c}_upto") for i, c in enumerate(columns)])


def running_sums(rows: DataFrame, by: list[str], value: str, columns: list[str], most: int | None = None) -> DataFrame:
    """rows with, for each of the columns c, `c_upto`: its sum over the group's rows up to this one in order of value.

    value: a number that no two rows of a group share, and never null; group by it first.
    """
    return running(with_ranges(rows, by, value, most), by, value, columns).drop("_range")
