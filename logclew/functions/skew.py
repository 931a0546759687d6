"""An equality join whose hot keys adaptive execution can split, on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logclew.session import is_staged, stage


def skew_join(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", name: str = "join"
) -> DataFrame:
    """``left.join(right, on, how)`` with both sides written to the shared folder first.

    A side that comes out of an aggregate or another join is partitioned by its own
    shuffle, and Spark then leaves a hot key in one task. From a table each side gets a
    plain exchange, whose measured partitions the adaptive skew join splits, whichever
    side is hot and however many keys are. What a side was computed from is read once,
    and a side whose files are small enough is broadcast. A side that is a staged table
    already is taken as it is.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("skew_join supports inner, left and left_semi joins")
    sides = [
        side if is_staged(side) else stage(side, f"{name}-{which}")
        for side, which in ((left, "left"), (right, "right"))
    ]
    return sides[0].join(sides[1], on, how)
