"""Document priors from metadata: categories, and polynomials of numbers."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.special import legendre


def exponents(degrees: list[int]) -> list[tuple[int, ...]]:
    """The degrees of each term, one for each numeric column; the constant term first."""
    return list(itertools.product(*[range(n + 1) for n in degrees]))


def tdf_grid(spark: SparkSession, lam: list[list[float]], degrees: list[int], ranges: list[tuple[float, float]], points: list[int]) -> DataFrame:
    """(x array, z, p): topic shares on a grid of numeric metadata: the softmax over topics of
    lam[z] . Legendre terms. Grid points are made by exploding sequences, in parallel."""
    grid = spark.range(1).select(F.array().cast("array<double>").alias("x"))

    def axis(low: float, high: float, n: int):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / max(n - 1, 1))

    for (low, high), n in zip(ranges, points):
        grid = grid.select(F.explode(F.transform(axis(low, high, n), lambda v: F.concat("x", F.array(v)))).alias("x"))
    unit = [(F.col("x")[i] - low) / (high - low) for i, (low, high) in enumerate(ranges)]
    terms = []
    for powers in exponents(degrees):
        t = F.lit(1.0)
        for x, n in zip(unit, powers):
            t = t * legendre(x, n)
        terms.append(t)
    scores = [sum((t * float(w) for t, w in zip(terms, row)), F.lit(0.0)) for row in lam]
    e = F.transform(F.array(*scores), lambda s: F.exp(s))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    return grid.withColumn("e", e).select("x", F.posexplode(F.transform("e", lambda v: v / total)).alias("z", "p"))
