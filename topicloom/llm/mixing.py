"""Mixing sources to target shares of the tokens, by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm._common import written
from topicloom.llm.bpe import DEFAULT_VOCABULARY, count_tokens

#: Bits of the document hash that one histogram resolves.
BITS = 20
HASH_BITS = 60


#: Tables with a row for each source are broadcast up to so many rows, else joined by shuffle.
SMALL_ROWS = 100_000


def _small(per_source: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(per_source) if small else per_source


def _few(weights: DataFrame) -> bool:
    return weights.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def source_name(source: Column) -> Column:
    """In lower case, without surrounding blanks."""
    return F.lower(F.trim(source))


def sized(docs: DataFrame, weights: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, h): documents of the sources of weights, counted once and written.

    h is a hash of the id, uniform on 60 bits; it orders a source's documents for good, so that a
    smaller budget selects part of what a larger one does.
    """
    named = docs.select("doc_id", "text", source_name(F.col("source")).alias("source"))
    named = named.join(_small(weights.select("source"), _few(weights)), "source", "left_semi")
    counted = count_tokens(named, ["doc_id", "source"], vocabulary=vocabulary)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(20), "doc_id", F.lit("mix")), 64 - HASH_BITS)
    return written(counted.withColumn("h", h), "sized")


def budgets(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, all_tokens, want): for each source of weights its
    tokens t (0 without documents), the tokens T of all, and target_share * T. A null share or repeat
    number counts as 0; a source listed more than once counts with its largest share and repeats."""
    listed = weights.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    got = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    joined = listed.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = joined.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    want = F.col("target_share") * F.col("all_tokens")
    return joined.crossJoin(F.broadcast(total)).withColumn("want", want)


def thresholds(sizes: DataFrame, report: DataFrame, small: bool) -> DataFrame:
    """(source, full, below): full passes over the whole source, and one more over the documents
    with h < below.

    The rest of the budget after full passes is found by nested histograms: tokens by source and the
    next BITS bits of h give the bucket in which the budget ends; only that bucket is split further.
    A source costs 2 ** BITS sums a level, however many documents it has. Budgets end at the document
    that would exceed them. Sources that cannot reach their share, those without tokens among them,
    get all their max_repeats passes.
    """
    t, repeats = F.col("tokens"), F.col("max_repeats")
    full = F.when(t == 0, repeats).otherwise(F.least(repeats, F.floor(F.col("want") / t))).cast("int")
    open_ = report.withColumn("full", full).withColumn("left", F.when((F.col("full") < repeats) & (t > 0), F.col("want") - F.col("full") * t).otherwise(0.0))
    state = open_.select("source", "full", "left", F.lit(0).cast("long").alias("prefix"))
    for level in range(HASH_BITS // BITS):
        shift = HASH_BITS - BITS * (level + 1)
        here = sizes.join(_small(state, small), "source").where(F.shiftright("h", shift + BITS) == F.col("prefix")) if level else sizes.join(_small(state, small), "source")
        bucket = here.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        ends = bucket.withColumn("run", run).join(_small(state, small), "source").where(F.col("run") > F.col("left"))
        first = ends.groupBy("source").agg(F.min(F.struct("bucket", (F.col("run") - F.col("n")).alias("before"))).alias("e"))
        past = F.shiftleft(F.col("prefix") + 1, BITS) if level else F.lit(1 << BITS).cast("long")
        state = state.join(_small(first, small), "source", "left").select("source", "full", (F.col("left") - F.coalesce("e.before", F.lit(0))).alias("left"), F.coalesce("e.bucket", past).alias("prefix"))
        state = written(state, "mix")  # a row for each source
    return state.select("source", "full", F.col("prefix").alias("below"))


def mix(sizes: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, report). documents: (doc_id, source, n_tokens, copies) of each document taken at
    least once. report: budgets() with mixed_tokens, actual_share of the mixture and short: whether
    the source stays below its budget although the mixture takes all its max_repeats passes.

    Two filters and no sort over the documents: copies = full passes + (h < below).
    """
    report = written(budgets(sizes, weights), "budgets")
    small = _few(weights)
    cut = thresholds(sizes, report, small)
    copies = F.col("full") + (F.col("h") < F.col("below")).cast("int")
    taken = sizes.join(_small(cut, small), "source").select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")
    mixed = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    full = report.join(cut.select("source", "full"), "source").join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    full = full.withColumn("short", (F.col("full") == F.col("max_repeats")) & (F.col("mixed_tokens") < F.col("want"))).drop("full")
    whole = mixed.agg(F.sum("mixed_tokens").alias("mixture_tokens"))
    return taken, full.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.col("mixed_tokens") / F.col("mixture_tokens")).drop("mixture_tokens")
