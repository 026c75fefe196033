"""Input columns under names that no operator uses for itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def sheltered(df: DataFrame, *named: str, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``df`` with neutral column names, those of ``named``, and a function that puts the old names back.

    Columns that the result replaces are left out, unless they are among ``named``. Helper columns of
    an operator can then have any name but ``column_0``, ``column_1`` and so on.
    """
    lowered = [c.lower() for c in df.columns]
    wanted = [lowered.index(n.lower()) for n in named]
    out = {r.lower() for r in replaced}
    places = [i for i, c in enumerate(lowered) if i in wanted or c not in out]
    old = {f"column_{i}": df.columns[i] for i in places}
    renamed = df.toDF(*[f"column_{i}" for i in range(len(lowered))]).select(*old)

    def restore(made: DataFrame) -> DataFrame:
        return made.toDF(*[old.get(c, c) for c in made.columns])

    return renamed, [f"column_{i}" for i in wanted], restore
