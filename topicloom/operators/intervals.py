"""Contexts of tokens: whole documents, or all windows of so many tokens, as intervals.

A window is known by its document and the place of its first token. A word at place p of a document
of n tokens is in the windows from p-W+1 to p, within 0 to n-W; a document shorter than a window is
one window. Neighbouring windows stay one interval: nothing is exploded, and joint counts are sums of
overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contexts(occurrences: DataFrame, key: str, window: int | None) -> DataFrame:
    """(doc_id, key, lo, hi): disjoint intervals of the windows that hold key. occurrences(doc_id,
    key, pos, size, len): size tokens from pos on, in a document of len tokens."""
    if not window:
        return occurrences.select("doc_id", key).distinct().select("doc_id", key, F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    last = F.greatest(F.col("len") - window, F.lit(0))
    lo = F.least(F.greatest(F.col("pos") + F.col("size") - window, F.lit(0)), last)
    hi = F.least(F.col("pos"), last)
    at = occurrences.where((F.col("size") <= window)).select("doc_id", key, lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    before = F.lag("hi").over(Window.partitionBy("doc_id", key).orderBy("lo", "hi"))
    return at.withColumn("lo", F.greatest(F.col("lo"), F.coalesce(before + 1, F.lit(0)))).where("lo <= hi")


def length() -> Column:
    return F.col("hi") - F.col("lo") + 1


def overlap(a: str, b: str) -> Column:
    return F.least(F.col(f"{a}.hi"), F.col(f"{b}.hi")) - F.greatest(F.col(f"{a}.lo"), F.col(f"{b}.lo")) + 1
