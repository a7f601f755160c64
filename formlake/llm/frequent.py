"""The most frequent keys of a table of counts, without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the histogram in a doubling of n.
STEPS = 16


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of the largest n, at most `limit` of them: a histogram of n (a few hundred numbers) gives the bound. Rows about as frequent as the last are in or out together, so fewer may come."""
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()
    bound, total = None, 0
    for r in sorted(sizes, key=lambda r: -r.step):
        total += r["rows"]
        if total > limit:
            break
        bound = r.step
    return counts.filter(step >= bound) if bound is not None else counts.filter("false")
