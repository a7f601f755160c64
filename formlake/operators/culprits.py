"""Group tests: which items make a whole fail, found by halving all failing groups of all documents at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.rounds import settled

Test = Callable[[DataFrame], DataFrame]


def find_culprits(items: DataFrame, test: Test, key: str = "doc", place: str = "n") -> tuple[DataFrame, DataFrame]:
    """The items that fail by themselves, and key, tests, rounds: how many groups of each document were tested, in how many rounds.

    items: key, place (from 0 within the document) and what the test needs. test: from items with their group (key, grp) to the groups
    that fail. A group of the k-th last round holds 2**k neighbouring places; only halves of failing groups are tested on. A round is one test over
    all documents, and the rounds are as many as halvings of the longest document.
    """
    most = items.agg(F.max(place)).first()[0]
    level = 0 if most is None else int(most).bit_length()
    open_, tested = items, None
    for k in range(level, -1, -1):
        grouped = open_.withColumn("grp", F.shiftright(F.col(place).cast("long"), k))
        counted = grouped.select(key, "grp").distinct().groupBy(key).agg(F.count("*").alias("tests")).withColumn("rounds", F.lit(1).cast("long"))
        tested = counted if tested is None else tested.unionByName(counted)
        failing = test(grouped).select(key, "grp").distinct()
        open_ = settled(grouped.join(failing, [key, "grp"], "left_semi").drop("grp"))
    return open_, tested.groupBy(key).agg(F.sum("tests").alias("tests"), F.sum("rounds").alias("rounds"))
