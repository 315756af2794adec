"""Yeo-Johnson power transform as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yeo_johnson(value: Column, lam: Column) -> Column:
    up = F.when(lam == 0, F.log1p(value)).otherwise((F.pow(value + 1, lam) - 1) / lam)
    down = F.when(lam == 2, -F.log1p(-value)).otherwise(
        -(F.pow(1 - value, 2 - lam) - 1) / (2 - lam)
    )
    return F.when(value >= 0, up).otherwise(down)


def yeo_johnson_inverse(value: Column, lam: Column) -> Column:
    up = F.when(lam == 0, F.expm1(value)).otherwise(F.pow(lam * value + 1, 1 / lam) - 1)
    down = F.when(lam == 2, -F.expm1(-value)).otherwise(
        1 - F.pow(1 - (2 - lam) * value, 1 / (2 - lam))
    )
    return F.when(value >= 0, up).otherwise(down)
