"""Queries that train a model; their rows depend on the draws, so they have no SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom import models
from topicloom.plans.catalog import word_docs
from topicloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def add(build: Callable) -> Callable:
    QUERIES[build.__name__] = build
    return build


def records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document of tmdocs, words in lower case without blanks; null metadata are a
    category of their own."""
    t = table(spark, d, "tmdocs").where("doc_id is not null")
    one = t.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in t.columns if c != "doc_id"]), "added_at").alias("r")).select("doc_id", "r.*")
    words = F.filter(F.transform("words", lambda w: F.lower(F.trim(w, F.lit(" \t")))), lambda w: w.isNotNull() & (w != ""))
    return one.withColumn("words", words).where(F.size("words") > 0).withColumn("metadata", F.coalesce("metadata", F.lit("")))


def _top(model: models.LDA, iterations: int = 10) -> DataFrame:
    model.train(iterations, sync_interval=5)
    return model.topic_words(10)


PRUNE = {"min_df": 3, "rm_top": 20}


@add
def lda_train(spark, d):
    return _top(models.LDA(20, min_df=5, rm_top=10).add(word_docs(spark, d)), 20)


@add
def lda_train_idf(spark, d):
    return _top(models.LDA(10, tw="idf", **PRUNE).add(records(spark, d)))


@add
def lda_infer(spark, d):
    m = models.LDA(10, **PRUNE).add(records(spark, d))
    m.train(10, sync_interval=5)
    theta = m.infer(word_docs(spark, d).unionByName(records(spark, d).select("doc_id", "words").withColumn("doc_id", -F.col("doc_id"))), 20)
    return theta.select("doc_id", F.posexplode("theta").alias("topic", "p"))


@add
def lda_coherence(spark, d):
    from topicloom.operators.coherence import coherence

    r = records(spark, d)
    top = _top(models.LDA(10, **PRUNE).add(r))
    return coherence(top.select("topic", "rank_no", "word"), r.select("doc_id", "words"), "c_npmi")


@add
def lda_infer_together(spark, d):
    m = models.LDA(10, **PRUNE).add(records(spark, d))
    m.train(5, sync_interval=5)
    theta = m.infer(word_docs(spark, d), 6, together=True, sync_interval=3)
    return theta.select("doc_id", F.posexplode("theta").alias("topic", "p"), "ll")


@add
def llda_train(spark, d):
    return _top(models.LLDA(**PRUNE).add(records(spark, d)))


@add
def plda_train(spark, d):
    return _top(models.PLDA(latent_topics=2, topics_per_label=2, **PRUNE).add(records(spark, d)))


@add
def dmr_train(spark, d):
    return _top(models.DMR(8, **PRUNE).add(records(spark, d)))


@add
def gdmr_train(spark, d):
    r = records(spark, d).where((F.size("numeric_metadata") == 2) & F.forall("numeric_metadata", lambda x: x.isNotNull() & ~F.isnan(x)))
    m = models.GDMR(6, degrees=[2, 1], optim_interval=5, **PRUNE).add(r)
    m.train(10, sync_interval=5)
    return m.tdf_linspace([5, 5])


@add
def slda_train(spark, d):
    m = models.SLDA(8, vars="l", **PRUNE).add(records(spark, d))
    m.train(10, sync_interval=2)
    return m.estimate().select("doc_id", F.get("y_hat", F.lit(0)).alias("y_hat"))


@add
def pa_train(spark, d):
    return _top(models.PA(4, 10, **PRUNE).add(records(spark, d)))


@add
def hpa_train(spark, d):
    return _top(models.HPA(4, 10, **PRUNE).add(records(spark, d)))


@add
def mglda_train(spark, d):
    return _top(models.MGLDA(5, 5, 3, delimiter="and", **PRUNE).add(records(spark, d)))


@add
def pt_train(spark, d):
    return _top(models.PT(8, p=40, **PRUNE).add(records(spark, d)), 11)


@add
def hdp_train(spark, d):
    return _top(models.HDP(4, **PRUNE).add(records(spark, d)))


@add
def hlda_train(spark, d):
    m = models.HLDA(3, **PRUNE).add(records(spark, d))
    m.train(10, sync_interval=1)
    return m.nodes()


@add
def ct_train(spark, d):
    return _top(models.CT(6, **PRUNE).add(records(spark, d)), 6)


@add
def dt_train(spark, d):
    r = records(spark, d).where("timepoint is not null")
    points = r.agg(F.max("timepoint")).first()[0] + 1
    return _top(models.DT(5, t=points, **PRUNE).add(r))
