"""Read-outs of topic assignments: assigned(doc_id, wid, z, w), z in 0..k-1.

Counts are sparse tables; distributions are dense over topics (a column of an exploded sequence,
never a cross join of documents with words).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.special import digamma_rising, log_rising
from topicloom.operators.corpus import Rows

#: Counts of words by topic are broadcast for a sweep up to this many; beyond, tokens are joined with them.
MAX_COUNTS = 4_000_000


def topic_word_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("z", "wid").agg(F.sum("w").alias("n"))


def doc_topic_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("doc_id", "z").agg(F.sum("w").alias("n"))


def count_by_topics(assigned: DataFrame) -> DataFrame:
    """(z, n): tokens of each topic, whatever their weights."""
    return assigned.groupBy("z").agg(F.count("*").alias("n"))


def doc_arrays(assigned: DataFrame, k: int) -> DataFrame:
    """(doc_id, n array<double> by topic)."""
    return assigned.groupBy("doc_id").agg(F.array(*[F.sum(F.when(F.col("z") == i, F.col("w")).otherwise(0.0)) for i in range(k)]).alias("n"))


def word_arrays(assigned: DataFrame, k: int) -> DataFrame:
    """(wid, n array<double> by topic)."""
    return assigned.groupBy("wid").agg(F.array(*[F.sum(F.when(F.col("z") == i, F.col("w")).otherwise(0.0)) for i in range(k)]).alias("n"))


def topic_word_dist(assigned: DataFrame, vocab: DataFrame, k: int, eta: float) -> DataFrame:
    """(z, wid, word, p): (n_kw + eta) / (n_k + V * eta) of every topic and used word."""
    used = vocab.where("used").select("wid", "word")
    arrays = word_arrays(assigned, k)
    totals = assigned.groupBy().agg(F.array(*[F.coalesce(F.sum(F.when(F.col("z") == i, F.col("w"))), F.lit(0.0)) for i in range(k)]).alias("t"))
    size = used.agg(F.count("*").alias("v"))
    zero = F.array_repeat(F.lit(0.0), k)
    every = used.join(arrays, "wid", "left").select("wid", "word", F.posexplode(F.coalesce("n", zero)).alias("z", "n"))
    every = every.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(size))
    p = (F.col("n") + eta) / (F.element_at("t", F.col("z") + 1) + F.col("v") * eta)
    return every.select("z", "wid", "word", p.alias("p"))


def topic_top_words(dist: DataFrame, top_n: int = 10) -> DataFrame:
    """(z, rank_no, word, p); ties by wid."""
    rank = F.row_number().over(Window.partitionBy("z").orderBy(F.desc("p"), "wid"))
    return dist.withColumn("rank_no", rank).where(F.col("rank_no") <= top_n).select("z", "rank_no", "word", "p")


def doc_topic_dist(assigned: DataFrame, k: int, alpha: Column | float) -> DataFrame:
    """(doc_id, z, p): (n_dk + alpha_k) / (N_d + sum of alpha). alpha: a number or an array column."""
    a = alpha if isinstance(alpha, Column) else F.array_repeat(F.lit(float(alpha)), k)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    theta = F.zip_with("n", a, lambda n, b: n + b)
    shares = F.transform(theta, lambda x: x / (total(F.col("n")) + total(a)))
    return doc_arrays(assigned, k).select("doc_id", F.posexplode(shares).alias("z", "p"))


def doc_top_topics(dist: DataFrame, top_n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("p"), "z"))
    return dist.withColumn("rank_no", rank).where(F.col("rank_no") <= top_n).select("doc_id", "rank_no", "z", "p")


def doc_ll(assigned: DataFrame, k: int, alpha: float) -> DataFrame:
    """(doc_id, ll): log-likelihood of each document's topics. Weights are whole numbers here."""
    a = F.lit(float(alpha))
    per = doc_arrays(assigned, k)
    topics = F.aggregate("n", F.lit(0.0), lambda s, n: s + log_rising(n, a))
    total = F.aggregate("n", F.lit(0.0), lambda s, n: s + n)
    return per.select("doc_id", (topics - log_rising(total, a * k)).alias("ll"))


def state_ll(assigned: DataFrame, vocab: DataFrame, eta: float) -> DataFrame:
    """(ll): log-likelihood of the words given the topics."""
    size = vocab.agg(F.sum(F.col("used").cast("long")).alias("v"))
    counts = topic_word_counts(assigned)
    words = counts.agg(F.sum(log_rising(F.col("n"), F.lit(float(eta)))).alias("words"))
    topics = counts.groupBy("z").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(size)).agg(F.sum(log_rising(F.col("n"), F.col("v") * eta)).alias("topics"))
    return words.crossJoin(topics).select((F.col("words") - F.col("topics")).alias("ll"))


def ll_per_word(assigned: DataFrame, vocab: DataFrame, k: int, alpha: float, eta: float) -> DataFrame:
    """(ll_per_word, perplexity)."""
    docs = doc_ll(assigned, k, alpha).agg(F.sum("ll").alias("docs"))
    n = assigned.agg(F.sum("w").alias("n"))
    per = (F.col("docs") + F.col("ll")) / F.col("n")
    return docs.crossJoin(state_ll(assigned, vocab, eta)).crossJoin(n).select(per.alias("ll_per_word"), F.exp(-per).alias("perplexity"))


def alpha_step(assigned: DataFrame, k: int, alpha: list[float]) -> DataFrame:
    """(z, alpha): one fixed-point step of the document prior."""
    n = doc_arrays(assigned, k)
    a = F.array(*[F.lit(float(x)) for x in alpha])
    total = F.aggregate("n", F.lit(0.0), lambda s, x: s + x)
    sums = n.agg(F.array(*[F.sum(digamma_rising(F.element_at("n", i + 1), F.lit(float(alpha[i])))) for i in range(k)]).alias("num"), F.sum(digamma_rising(total, F.lit(float(sum(alpha))))).alias("den"))
    new = F.zip_with("num", a, lambda x, y: F.greatest(x / F.col("den") * y, F.lit(1e-5)))
    return sums.select(F.posexplode(new).alias("z", "alpha"))


def uniform(seed: Column) -> Column:
    """A number in (0, 1) from whole numbers: a linear congruential step, the same in any SQL engine.
    The seed's remainder comes first, since its product with the factor can pass 64 bits."""
    rest = F.pmod(seed.cast("long"), F.lit(2147483648))
    return (F.pmod(rest * 1103515245 + 12345, F.lit(2147483648)) + 0.5) / 2147483648.0


def jacobi_sweep(assigned: DataFrame, vocab: DataFrame, k: int, alpha: float, eta: float, seed: Column, allowed: Column | None = None) -> DataFrame:
    """assigned with z drawn anew for all tokens at once from the counts of before, each token's own
    left out. seed: a whole number for each token. allowed: array<boolean> by topic, or all."""
    v = vocab.agg(F.sum(F.col("used").cast("long")).alias("v"))
    totals = assigned.agg(F.array(*[F.coalesce(F.sum(F.when(F.col("z") == i, F.col("w"))), F.lit(0.0)) for i in range(k)]).alias("nk"))
    base = assigned if allowed is None else assigned.withColumn("_ok", allowed)
    t = base.join(doc_arrays(assigned, k).withColumnRenamed("n", "nd"), "doc_id").join(word_arrays(assigned, k).withColumnRenamed("n", "nw"), "wid").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(v))
    zs = F.sequence(F.lit(0), F.lit(k - 1))
    own = lambda i: F.when(F.col("z") == i, F.col("w")).otherwise(0.0)
    p = F.transform(zs, lambda i: (F.get("nd", i) - own(i) + alpha) * (F.get("nw", i) - own(i) + eta) / (F.get("nk", i) - own(i) + F.col("v") * eta))
    if allowed is not None:
        p = F.zip_with(p, "_ok", lambda x, ok: x * ok.cast("double"))
    # a running sum and, when it first passes the bound, the topic: one pass over the array each
    t = t.withColumn("_p", p).withColumn("_u", uniform(seed) * F.aggregate("_p", F.lit(0.0), lambda s, x: s + x))
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("z"))
    passed = F.aggregate("_p", none, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["z"] + (s["sum"] + x <= F.col("_u")).cast("int")).alias("z")))
    return t.withColumn("z", F.least(passed["z"], F.lit(k - 1)).cast("int")).select(*assigned.columns)


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(v: int, k: int):
    """mapInArrow function: (wid, z), lists both -> (at, n): how often wid * k + z occurs in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(v * k, np.int64)
        for batch in batches:
            n += np.bincount(_flat(batch.column(0)) * k + _flat(batch.column(1)), minlength=v * k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["at", "n"])

    return run


def _drawn(shared, k: int, alpha: float, eta: float, seed: Callable):
    """mapInArrow function: (doc_id, pos, wid, z) and perhaps the allowed topics, lists but the first -> a
    row for each token, z drawn anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nw = shared.value.astype(np.float64)
        nk, topics, step = nw.sum(axis=0), np.arange(k), max(1, (1 << 20) // k)
        for batch in batches:
            row, pos, wid, z = Rows(batch.column(1)).row, *(_flat(batch.column(i)) for i in (1, 2, 3))
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            ok = _flat(batch.column(4)).reshape(-1, k).astype(np.float64) if batch.num_columns > 4 else None
            nd = np.bincount(row * k + z, minlength=batch.num_rows * k).reshape(-1, k).astype(np.float64)
            for at in (slice(a, a + step) for a in range(0, len(row), step)):  # bounds what is held by token and topic
                d, w = doc[row[at]], wid[at]
                own = (z[at, None] == topics).astype(np.float64)
                p = (nd[row[at]] - own + alpha) * (nw[w] - own + eta) / (nk - own + len(nw) * eta)
                sums = np.cumsum(p if ok is None else p * ok[row[at]], axis=1)
                # the seed may wrap around at 64 bits, which its remainder by 2^31 doesn't notice
                u = (((seed(d, pos[at]) * 1103515245 + 12345) & 2147483647) + 0.5) / 2147483648.0
                new = np.minimum((sums <= (u * sums[:, -1])[:, None]).sum(axis=1), k - 1)
                yield pa.RecordBatch.from_arrays([pa.array(d), *(pa.array(x.astype(np.int32)) for x in (pos[at], w, new))], ["doc_id", "pos", "wid", "z"])

    return run


def sweep_lists(docs: DataFrame, vocab: DataFrame, k: int, alpha: float, eta: float, seed: Callable, allowed: Column | None = None, *, limit: int = MAX_COUNTS) -> DataFrame:
    """(doc_id, pos, wid, z): jacobi_sweep of documents in rows, docs(doc_id bigint, pos, wid, z), lists but
    the first, every weight 1. A document's counts are made inside its row, those of words are broadcast, so
    no token is shuffled. More than limit counts are joined, by jacobi_sweep. docs is read three times.
    seed(doc_id, pos): a whole number for each token, of columns or of arrays. allowed: array<boolean> by
    topic, of doc_id, or all."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # rows of one doc_id are one document
        docs = docs.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "wid", "z")).alias("t")).select("doc_id", *[F.flatten(f"t.{c}").alias(c) for c in ("pos", "wid", "z")])
    v = vocab.where("used").count()
    if v * k > limit:
        each = docs.select("doc_id", F.explode(F.arrays_zip("pos", "wid", "z")).alias("t")).select("doc_id", "t.pos", "t.wid", "t.z", F.lit(1.0).alias("w"))
        return jacobi_sweep(each, vocab, k, alpha, eta, seed(F.col("doc_id"), F.col("pos")), allowed).drop("w")
    n = docs.select("wid", "z").mapInArrow(_counted(v, k), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(v * k, np.int64)
    counts[n.column("at").to_numpy()] = n.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts.reshape(v, k))
    return docs.select("doc_id", "pos", "wid", "z", *([] if allowed is None else [allowed.alias("ok")])).mapInArrow(_drawn(shared, k, alpha, eta, seed), "doc_id long, pos int, wid int, z int")
