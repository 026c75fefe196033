"""Exact selection in hash order, splits, de-duplication and lookups that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeworks.functions.ordering import rnd

BUCKET_DIGITS = 3


def rank_in_hash_order(
    df: DataFrame,
    order: str,
    strata: Sequence[str] = (),
    limit: Column | None = None,
    rank: str = "rank",
    rows: str = "stratum_rows",
) -> DataFrame:
    """Position of each row by the hex column ``order`` inside its stratum, and the stratum size.

    A plain ``row_number`` would sort a whole stratum in one task. Here the leading hash digits
    cut every stratum into up to 4096 even buckets: one narrow count per bucket gives the
    offsets, rows are numbered inside their bucket only. With ``limit`` (a column over ``rows``
    and the strata) whole buckets past it are dropped before anything but counts is shuffled.
    Strata must not be NULL, ``order`` must be unique. With many strata the counts have at most one
    row for each row.
    """
    strata = list(strata)
    keyed = df.withColumn("_bucket", F.substring(F.substring_index(order, ":", -1), 1, BUCKET_DIGITS))
    counts = keyed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*strata)
    before = within.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *strata,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(within).alias(rows),
    )
    if limit is not None:
        offsets = offsets.where(F.col("_before") < limit)
    in_bucket = Window.partitionBy(*strata, "_bucket").orderBy(order)
    out = keyed.join(offsets, [*strata, "_bucket"]).withColumn(
        rank, F.row_number().over(in_bucket) + F.col("_before")
    )
    if limit is not None:
        out = out.where(F.col(rank) <= limit)
    return out.drop("_bucket", "_before")


def take_in_hash_order(df: DataFrame, n: int, order: str, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows by hash, for any ``n``."""
    return rank_in_hash_order(df, order, limit=F.lit(n), rank=rank).drop("stratum_rows")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                  rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows per key. Spark prunes to ``k`` per key and task before the shuffle,
    so a key holding a third of the table moves only ``k`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dedupe(df: DataFrame, fingerprint: str, order: str) -> DataFrame:
    """Keep the first row of every fingerprint."""
    return first_per_key(df, [fingerprint], [F.col(order)]).drop("_rank")


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, spread: Column, per_task: int = 200_000) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row per key and in ``count`` how many ``rows`` it meets.

    Keys of more than ``per_task`` rows are dealt over as many tasks as that takes; all others are
    looked up once. There are at most rows / per_task such keys, so their list may be broadcast.
    """
    parts = F.ceil(F.col(count) / per_task).cast("int")
    hot = groups.where(F.col(count) > per_task).select(key, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    # one row per key has no bound, and a small file may hold many rows: no broadcast by file size
    return dealt.join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def stratified_split(df: DataFrame, ratio: float, order: str, stratum: str = "type") -> DataFrame:
    """``split`` column: per stratum the first ``max(1, round(n * ratio))`` rows are holdout."""
    ranked = rank_in_hash_order(df, order, [stratum])
    cut = F.greatest(F.lit(1), F.bround(F.col("stratum_rows") * F.lit(ratio)).cast("bigint"))
    return ranked.withColumn("split", F.when(F.col("rank") <= cut, "holdout").otherwise("train")).drop(
        "rank", "stratum_rows"
    )


def attach_ids(df: DataFrame, prefix: Column, order: str, strata: Sequence[str] = (), name: str = "id") -> DataFrame:
    """Sequence ids ``prefix-000001`` in hash order, numbered inside each stratum."""
    ranked = rank_in_hash_order(df, order, strata)
    number = F.col("rank").cast("string")
    wide = F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0"))
    return ranked.withColumn(name, F.concat(prefix, F.lit("-"), wide)).drop("rank", "stratum_rows")


def with_order(df: DataFrame, seed: int, purpose: str, key: Column, name: str = "ord") -> DataFrame:
    return df.withColumn(name, rnd(seed, purpose, key))


def review_quotas(counts: DataFrame, strata: Sequence[str], frac: float, weight: str = "rows") -> DataFrame:
    """``quota`` for each stratum of ``counts(strata, rows)``: ``ceil(all rows * frac)`` rows in all, dealt in
    proportion to ``weight`` by largest remainders, at least one and at most all rows of a stratum.

    The sum is larger where many strata have less than one row due, smaller where weights ask for more
    rows than a stratum has.
    """
    every = Window.partitionBy(F.lit(0))  # one row a stratum
    wanted = F.ceil(F.round(F.sum("rows").over(every) * F.lit(frac), 9))
    total = F.sum(weight).over(every)
    share = F.when(total > 0, F.col(weight) / total).otherwise(F.col("rows") / F.sum("rows").over(every))
    due = counts.withColumn("_wanted", wanted).withColumn("_due", F.round(F.col("_wanted") * share, 9))
    floored = due.withColumn("_base", F.least(F.greatest(F.floor("_due"), F.lit(1)), F.col("rows")))
    rest = (F.col("_due") - F.floor("_due")) * (F.col("_due") >= 1).cast("int")
    ranked = floored.withColumn("_open", F.col("_wanted") - F.sum("_base").over(every)).withColumn(
        "_place", F.row_number().over(every.orderBy(rest.desc(), *[F.asc(s) for s in strata])))
    extra = F.when(F.col("_place") <= F.col("_open"), 1).otherwise(0)
    return ranked.select(*strata, "rows", F.least(F.col("_base") + extra, F.col("rows")).cast("bigint").alias("quota"))


def review_sample(samples: DataFrame, order: str, strata: Sequence[str] = ("type", "subtype"), frac: float = 0.10,
                  spread: Column | None = None) -> DataFrame:
    """Rows for people to check: of every stratum its quota (``review_quotas``), the first by the hash ``order``.

    With ``spread``, a number of each row, strata where it varies more get more rows (rows times
    standard deviation). NULL is a stratum of its own. Columns ``rank``, ``stratum_rows`` and ``quota`` are added.
    """
    if not 0 < frac <= 1:
        raise ValueError("frac must be above 0 and at most 1")
    keyed = samples.withColumn("_stratum", F.to_json(F.struct(*[F.coalesce(F.col(s).cast("string"), F.lit("\x00")).alias(s) for s in strata])))
    if spread is not None:
        keyed = keyed.withColumn("_spread", spread.cast("double"))
    weight = F.count("*").cast("double") if spread is None else F.count("*") * F.coalesce(F.stddev_pop("_spread"), F.lit(0.0))
    counts = keyed.groupBy("_stratum").agg(F.count("*").alias("rows"), weight.alias("_weight"))
    quotas = review_quotas(counts, ["_stratum"], frac, "_weight").select("_stratum", "quota")
    ranked = rank_in_hash_order(keyed, order, ["_stratum"])
    return ranked.join(quotas, "_stratum").where(F.col("rank") <= F.col("quota")).drop("_stratum", "_spread")
