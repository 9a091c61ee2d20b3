"""Ratios of measured features. A zero or null denominator gives null; ``ieee`` gives infinities and NaN instead."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, ieee: bool = False) -> Column:
    if not ieee:
        return F.try_divide(a.cast("double"), b.cast("double"))
    a = a.cast("double")
    edge = F.when(a > 0, math.inf).when(a < 0, -math.inf).otherwise(math.nan)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, edge).otherwise(F.try_divide(a, b.cast("double")))


def circularity(area: Column, perimeter: Column) -> Column:
    return 4 * math.pi * ratio(area, perimeter * perimeter)


def compactness(area: Column, perimeter: Column) -> Column:
    return ratio(area, perimeter)
