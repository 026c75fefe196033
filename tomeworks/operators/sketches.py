"""Sketches of loads and windows that are kept as tables and merged without reading the rows again.

*Frequent values*: one frequent-items sketch per window. A sketch of ``m`` counters errs by at most
3.5 / m of its rows, after merging too; its size is chosen so that every value above the share is found.
What it names are candidates: an exact count of these alone decides.

*Distinct values*: one theta sketch per load. Union, difference and intersection of loads come from the
sketches. Up to ``2 ** log_entries`` distinct values they are exact; beyond, an estimate is within
``distinct_bound`` of the values in the union of what is compared, but for one in some 30 000 cases (four
standard errors).

Nulls are left out of both: neither a frequent nor a distinct value.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_COUNTERS = 1_000_000


def counters_for(share: float) -> int:
    """Counters with which no value of at least ``share`` of the rows is missed.

    A value is surely named from twice the error on; the sketch has at least 4 / 3 as many places.
    """
    if not 0 < share <= 1:
        raise ValueError("share lies above 0 and is at most 1")
    counters = ceil(8 / share)
    if counters > MOST_COUNTERS:
        raise ValueError(f"share is too small for a sketch of {MOST_COUNTERS} counters")
    return counters


def window_sketches(values: DataFrame, share: float, window: str = "window", value: str = "value") -> DataFrame:
    """``window, rows, sketch`` of the values that are not null; partially aggregated."""
    kept = values.where(F.col(value).isNotNull())
    return kept.groupBy(F.col(window).alias("window")).agg(
        F.count("*").alias("rows"), F.expr(f"approx_top_k_accumulate(`{value}`, {counters_for(share)})").alias("sketch"))


def merged_sketches(sketches: DataFrame, window: Column, share: float) -> DataFrame:
    """The sketches of longer windows, from those of their parts."""
    return sketches.groupBy(window.alias("window")).agg(
        F.sum("rows").alias("rows"), F.expr(f"approx_top_k_combine(sketch, {counters_for(share)})").alias("sketch"))


def candidates(sketches: DataFrame, share: float) -> DataFrame:
    """``window, rows, value``: every value that may reach ``share`` of its window's rows, at most
    ``counters_for(share)`` a window."""
    named = F.explode(F.expr(f"approx_top_k_estimate(sketch, {counters_for(share)})"))
    found = sketches.select("window", "rows", named.alias("_e")).select("window", "rows", F.col("_e.item").alias("value"), F.col("_e.count").alias("_most"))
    # estimates are never too small
    return found.where(F.col("_most") >= share * F.col("rows")).drop("_most")


def frequent_values(values: DataFrame, sketches: DataFrame, share: float, window: str = "window", value: str = "value") -> DataFrame:
    """``window, value, n, rows``, exact: the values of at least ``share`` of their window's rows.

    Only rows of candidates are counted, in partial aggregates, so a hot value costs a row a task.
    """
    counted = values.select(F.col(window).alias("window"), F.col(value).alias("value"))
    named = candidates(sketches, share)
    found = counted.join(named.select("window", "value"), ["window", "value"], "left_semi").groupBy("window", "value").agg(F.count("*").alias("n"))
    return found.join(sketches.select("window", "rows"), "window").where(F.col("n") >= share * F.col("rows"))


def load_sketches(df: DataFrame, load: Column, columns: list[str], log_entries: int = 12) -> DataFrame:
    """``load, rows`` and a sketch of the distinct values of each column, of any type, under its name.

    Sketches get 64-bit hashes: they would leave out the empty text.
    """
    def sketch(c: str) -> Column:
        return F.theta_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), log_entries).alias(c)

    return df.groupBy(load.alias("load")).agg(F.count("*").alias("rows"), *[sketch(c) for c in columns])


def distinct_of_all(sketches: DataFrame, columns: list[str], log_entries: int = 12) -> DataFrame:
    """One row: ``rows`` and the distinct values of each column over all loads, without a rescan."""
    return sketches.agg(F.sum("rows").alias("rows"), *[
        F.expr(f"theta_sketch_estimate(theta_union_agg(`{c}`, {log_entries}))").alias(c) for c in columns])


def compared_loads(sketches: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``load, other`` of ``pairs`` and for each column how many of the load's distinct values the other lacks
    (``c_new``) and shares (``c_shared``)."""
    mine = sketches.select("load", *[F.col(c).alias(f"_a_{c}") for c in columns])
    theirs = sketches.select(F.col("load").alias("other"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    met = pairs.select("load", "other").join(mine, "load").join(theirs, "other")
    return met.select("load", "other", *[
        F.expr(f"theta_sketch_estimate(theta_{how}(`_a_{c}`, `_b_{c}`))").alias(f"{c}_{name}")
        for c in columns for how, name in (("difference", "new"), ("intersection", "shared"))])


def distinct_bound(union: Column, log_entries: int = 12) -> Column:
    """How far an estimate may be from the exact number, ``union`` being the values of all that is compared."""
    exact = 2**log_entries
    return F.when(union <= exact, 0.0).otherwise(4.0 / sqrt(exact - 1) * union)
