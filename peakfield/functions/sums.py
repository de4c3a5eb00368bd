"""Sums of doubles that do not depend on the order of the rows.

A double is split into two whole numbers in units of powers of two, the greater set by the group's largest value. Whole numbers add
exactly, in any order and over any number of tasks, so the sum is the same in every run. The value keeps 62 bits below the largest of its
group; whole numbers and all that 62 bits hold are summed without any error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of each of the two numbers: 2 ** 32 of them add up without overflow.
BITS = 31


def unit(largest: Column) -> Column:
    """A power of two above the absolute values of a group, whose greatest is ``largest``."""
    return F.when(largest > 0, F.pow(F.lit(2.0), F.ceil(F.log2(largest)) + 1)).otherwise(F.lit(1.0))


def limbs(value: Column, unit: Column) -> tuple[Column, Column]:
    """The two whole numbers of a double. No step rounds: all divide by powers of two or cut bits off."""
    step = unit / (1 << BITS)
    high = F.floor(value / step)
    return high, F.floor((value - high * step) / step * (1 << BITS))


def total(high: Column, low: Column, unit: Column) -> Column:
    """The double that sums of limbs stand for."""
    step = unit / (1 << BITS)
    return high * step + low * (step / (1 << BITS))


def exact_sums(df: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """(group, a sum for each of ``values``), in two passes that both combine within tasks: the largest values, then the sums."""
    rows = df.select(*group, *(v.cast("double").alias(f"_v_{k}") for k, v in values.items()))
    units = rows.groupBy(*group).agg(*(unit(F.max(F.abs(f"_v_{k}"))).alias(f"_u_{k}") for k in values))
    parts = [x.alias(f"_{s}_{k}") for k in values for s, x in zip("hl", limbs(F.col(f"_v_{k}"), F.col(f"_u_{k}")), strict=True)]
    keep = [f"_u_{k}" for k in values]
    sums = rows.join(units, group).select(*group, *keep, *parts).groupBy(*group, *keep).agg(*(F.sum(f"_{s}_{k}").alias(f"_{s}_{k}") for k in values for s in "hl"))
    return sums.select(*group, *(total(F.col(f"_h_{k}"), F.col(f"_l_{k}"), F.col(f"_u_{k}")).alias(k) for k in values))
