"""Browsing a topic model: filter and page documents, compare topics, metadata statistics."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_page(docs: DataFrame, theta: DataFrame, *, sort_topic: int = -1, target: int = 0, least: float = 0.0, keywords: tuple[str, ...] = (), where: Column | None = None, page: int = 0, per_page: int = 30, text_col: str = "text") -> DataFrame:
    """(doc_id, p): a page of the documents with all keywords in their lower-case text, for which
    `where` holds and theta[target] >= least; by falling theta[sort_topic] (p), or by doc_id if that
    is negative. theta(doc_id, z, p)."""
    kept = docs
    for word in keywords:
        kept = kept.where(F.lower(text_col).contains(word))
    if where is not None:
        kept = kept.where(where)
    of = theta.where((F.col("z") == target) & (F.col("p") >= least)).select("doc_id")
    shown = theta.where(F.col("z") == max(sort_topic, 0)).select("doc_id", "p")
    kept = kept.select("doc_id").join(of, "doc_id", "left_semi").join(shown, "doc_id")
    order = [F.desc("p"), F.desc("doc_id")] if sort_topic >= 0 else [F.asc("doc_id")]
    return kept.orderBy(*order).offset(page * per_page).limit(per_page)


def top1_topics(theta: DataFrame) -> DataFrame:
    """(doc_id, z): the largest topic of each document, the first of equal ones."""
    return theta.groupBy("doc_id").agg(F.max(F.struct("p", (-F.col("z")).alias("nz"))).alias("m")).select("doc_id", (-F.col("m.nz")).alias("z"))


def top1_by_metadata(theta: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """(metadata, z, n)."""
    return top1_topics(theta).join(docs.select("doc_id", F.col(column).alias("metadata")), "doc_id").groupBy("metadata", "z").agg(F.count("*").alias("n"))


def topic_overlap(dist: DataFrame) -> DataFrame:
    """(a, b, overlap) for topics a < b: sum over words of the smaller probability."""
    per_word = dist.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("z", "p"))).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x: F.transform(F.filter("t", lambda y: y["z"] > x["z"]), lambda y: F.struct(x["z"].alias("a"), y["z"].alias("b"), F.least(x["p"], y["p"]).alias("m")))))
    return per_word.select(F.explode(pairs).alias("q")).groupBy("q.a", "q.b").agg(F.sum("q.m").alias("overlap"))


def pseudo_idf_words(dist: DataFrame, k: int, alpha: float, top_n: int = 10) -> DataFrame:
    """(z, rank_no, word, p): top words by p * ln(K / sum over topics of p ** alpha)."""
    idf = F.log(k / F.sum(F.pow("p", F.lit(alpha))).over(Window.partitionBy("wid")))
    scored = dist.withColumn("s", F.col("p") * idf)
    rank = F.row_number().over(Window.partitionBy("z").orderBy(F.desc("s"), "wid"))
    return scored.withColumn("rank_no", rank).where(F.col("rank_no") <= top_n).select("z", "rank_no", "word", "p")


def density(docs: DataFrame, group: str, value: str, *, low: float, high: float, points: int, width: float) -> DataFrame:
    """(metadata, x, density): kernel density of value by group on an even grid, largest 1."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * ((high - low) / (points - 1)))
    each = docs.where(F.col(value).isNotNull()).select(F.col(group).alias("metadata"), F.col(value).cast("double").alias("v"), F.explode(grid).alias("x"))
    summed = each.groupBy("metadata", "x").agg(F.sum(F.exp(-F.pow((F.col("x") - F.col("v")) / width, F.lit(2.0)))).alias("d"))
    return summed.select("metadata", "x", (F.col("d") / F.max("d").over(Window.partitionBy("metadata"))).alias("density"))


def density_interval(alpha: list[float], share: float = 0.95, samples: int = 16384) -> list[tuple[float, float]]:
    """The narrowest interval with the share of each part of a Dirichlet variable that holds its mean."""
    rng = np.random.default_rng(0)
    draws = np.sort(rng.dirichlet(np.asarray(alpha, float), samples), axis=0)
    inside = int(samples * share)
    mean = np.asarray(alpha, float) / np.sum(alpha)
    out = []
    for k in range(draws.shape[1]):
        d = draws[:, k]
        start = np.arange(samples - inside)
        width = d[start + inside] - d[start]
        holds = (d[start] <= mean[k]) & (mean[k] <= d[start + inside])
        i = int(np.where(holds, width, np.inf).argmin())
        out.append((float(d[i]), float(d[i + inside])))
    return out


def topic_html(docs: DataFrame, *, text_col: str = "raw") -> DataFrame:
    """(doc_id, html): each text with a span of class topic-k around the tokens that have a topic.
    docs(doc_id, text, start, len, topic): lists of token spans in characters, in order, and of the
    tokens' topics, null or negative for none. Everything else is escaped."""

    def marked(text: str, start: list[int], size: list[int], topic: list[int | None]) -> str:
        out, at = [], 0
        for a, n, k in zip(start, size, topic):
            out.append(html.escape(text[at:a]))
            word = html.escape(text[a : a + n])
            out.append(word if k is None or k < 0 else f'<span class="topic-{k}">{word}</span>')
            at = a + n
        return "".join([*out, html.escape(text[at:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 5)))
            made = [marked(t, s or [], n or [], k or []) if t is not None else None for t, s, n, k in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "html"])

    return docs.select("doc_id", text_col, "start", "len", F.col("topic").cast("array<int>")).mapInArrow(run, "doc_id long, html string")
