"""Seeded hash order: a random order that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(seed: int, purpose: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|{purpose}|"), key.cast("string")))
