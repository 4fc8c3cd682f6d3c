"""The N highest-scoring items of every group, by score histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score histogram: so many bins for each doubling of the score.
BINS_PER_OCTAVE = 2
#: Thresholds are broadcast: this bounds their number, whatever the number of groups.
MAX_THRESHOLDS = 1_000_000


def score_bin(score: Column) -> Column:
    """An integer that never falls as the score rises."""
    octave = F.floor(F.log2(F.abs(score)) * BINS_PER_OCTAVE).cast("int") + 3000 * BINS_PER_OCTAVE
    return F.when(score > 0, octave).when(score < 0, -octave).otherwise(0)


def top_n(rows: DataFrame, group_col: str, item_col: str, score_col: str, n: int, *, max_thresholds: int = MAX_THRESHOLDS) -> DataFrame:
    """(group_col, rank_no, item_col, score_col): the n best items of every group, by falling score,
    equal scores by rising item. An item repeated in a group counts once, with its highest score.

    Rows without an item or a finite score take no part; a null group is a group of its own. Groups
    with fewer than n items come out whole. Other columns are not read, whatever their names.

    1. Histogram by group and score bin. Each bin has a bitmap of item hashes, at least four bits
       an item wanted. The bits set in the bins from the top down are never more than the distinct
       items there, so the first bin that brings them to n is a safe threshold: n different items
       score that or better, hence all of the n best do, ties included.
    2. Rows below their group's threshold go, in the scan's stage: thresholds are broadcast. Only
       groups of at least total / max_thresholds rows have one, so there are max_thresholds at most.
       Rows of the smaller groups all go on, with the same exact end.
    3. The rest is merged by group and item (which spreads a hot group), cut to n by group within
       each task and ranked exactly.
    """
    valid = rows.select(F.col(group_col).alias("g"), F.col(item_col).alias("item"), F.col(score_col).cast("double").alias("score"))
    valid = valid.where(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    longs = -(-4 * n // 64)
    bit, maps = F.pmod(F.xxhash64("item"), F.lit(64 * longs)), [f"m{i}" for i in range(longs)]
    with_bits = valid.select("g", score_bin(F.col("score")).alias("bin"), bit.cast("int").alias("bit"))
    one = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(m) for i, m in enumerate(maps)]
    bins = with_bits.groupBy("g", "bin").agg(F.count("*").alias("c"), *one)

    down = Window.partitionBy("g").orderBy(F.desc("bin"))
    distinct = sum((F.bit_count(F.bit_or(m).over(down)) for m in maps), F.lit(0))
    reached = bins.select("g", "bin", "c", distinct.alias("distinct"))
    thresholds = reached.groupBy("g").agg(F.sum("c").alias("c"), F.max(F.when(F.col("distinct") >= n, F.col("bin"))).alias("least"))
    total = valid.agg((F.count("*") / max_thresholds).alias("heavy"))
    heavy = thresholds.where("least is not null").join(F.broadcast(total), F.col("c") >= F.col("heavy")).select(F.col("g").alias("heavy_g"), "least")

    kept = valid.join(F.broadcast(heavy), F.col("g").eqNullSafe(F.col("heavy_g")), "left").where(F.col("least").isNull() | (score_bin(F.col("score")) >= F.col("least"))).select("g", "item", "score")
    best = kept.groupBy("g", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "item"))
    return best.withColumn("rank_no", rank).where(F.col("rank_no") <= n).select(F.col("g").alias(group_col), "rank_no", F.col("item").alias(item_col), F.col("score").alias(score_col))
