"""Automatic topic labels by first-order relevance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.hashing import mix
from topicloom.functions.packed import batches_of, parted, parts_for
from topicloom.functions.text import TOKEN_PATTERN
from topicloom.operators.corpus import Rows, span_lists
from topicloom.operators.intervals import contexts, length, overlap
from topicloom.operators.ngrams import Phrases, find_phrases, listed
from topicloom.sources.tables import written

#: A topic-word distribution of at most so many numbers is broadcast; a larger one is joined.
MAX_DIST = 50_000_000
#: Pairs of label and word counted in memory before they are handed on, and different ones of a part.
HELD, PART = 8_000_000, 4_000_000


def topic_labels(dist: DataFrame, candidates: DataFrame, word_docs: DataFrame, *, k: int, min_df: int = 5, smoothing: float = 0.01, mu: float = 0.25, window_size: int = -1) -> DataFrame:
    """(topic, label, score) of every candidate. dist(z, wid, word, p): topic-word distribution over
    the used words; candidates(words array); word_docs(doc_id, words array).

    A candidate's relevance to a topic is the sum over words of p * ln((contexts with both +
    smoothing) * contexts / contexts with the candidate / contexts with the word). The words that
    never meet it share one closed form, so only joint contexts are counted. The score takes off what
    it is relevant to other topics, times mu. Contexts are documents, or windows of window_size
    tokens. Candidates in fewer than min_df contexts are left out; with one topic mu has no effect.
    """
    if window_size <= 0:
        phrases = listed(candidates)
        if phrases is not None and dist.count() <= MAX_DIST:
            return _combined(*_document_sums(dist, phrases, word_docs, k, smoothing), k, min_df, smoothing, mu)
    window = window_size if window_size > 0 else None
    sized = word_docs.select("doc_id", F.size("words").alias("len"))
    cand = candidates.select("words").distinct()
    found = find_phrases(word_docs, cand).withColumn("label", F.concat_ws(" ", "words")).withColumn("size", F.size("words")).join(sized, "doc_id")
    of_label = contexts(found.select("doc_id", "label", "pos", "size", "len"), "label", window)
    words = dist.select("word").distinct()
    at = word_docs.select("doc_id", F.size("words").alias("len"), F.posexplode("words").alias("pos", "word")).join(words, "word").withColumn("size", F.lit(1))
    of_word = contexts(at, "word", window)
    total = sized.agg((F.sum(F.greatest(F.col("len") - window + 1, F.lit(1))) if window else F.count("*")).alias("d"))
    docs = of_label.groupBy("label").agg(F.sum(length()).alias("dc"))
    df = of_word.groupBy("word").agg(F.sum(length()).alias("df"))

    met = of_label.join(docs.where(F.col("dc") >= min_df), "label", "left_semi").alias("x").join(of_word.alias("y"), F.col("x.doc_id") == F.col("y.doc_id")).select("label", "word", overlap("x", "y").alias("o")).where("o > 0").groupBy("label", "word").agg(F.sum("o").alias("c"))
    more = met.join(dist.select("z", "word", "p"), "word").groupBy("label", "z").agg(F.sum(F.col("p") * F.log((F.col("c") + smoothing) / F.lit(smoothing))).alias("more"))
    base = dist.join(df, "word").groupBy("z").agg(F.sum("p").alias("mass"), F.sum(F.col("p") * F.log("df")).alias("logs"))
    return _combined(docs, base, total, more, k, min_df, smoothing, mu)


def _combined(docs: DataFrame, base: DataFrame, total: DataFrame, more: DataFrame, k: int, min_df: int, smoothing: float, mu: float) -> DataFrame:
    every = docs.where(F.col("dc") >= min_df).crossJoin(F.broadcast(base)).crossJoin(F.broadcast(total)).join(more, ["label", "z"], "left")
    s = F.log(F.lit(smoothing) * F.col("d") / F.col("dc")) * F.col("mass") - F.col("logs") + F.coalesce("more", F.lit(0.0))
    scored = every.select("label", "z", s.alias("s"))
    rest = mu / (k - 1) if k > 1 else 0.0
    over = F.sum("s").over(Window.partitionBy("label"))
    return scored.select(F.col("z").alias("topic"), "label", (F.col("s") * (1 + rest) - over * rest).alias("score"))


def _document_sums(dist: DataFrame, phrases: list[tuple[str, ...]], word_docs: DataFrame, k: int, smoothing: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs(label, dc), base(z, mass, logs), total(d) and more(label, z, more) with documents as
    contexts. Labels and used words of a document are found inside its row; only counts of pairs
    (label, word), summed within a task, are shuffled. Column V of the pairs counts documents with the
    label, row L documents with the word."""
    spark = word_docs.sparkSession
    got = dist.select("z", "word", "p").toArrow()
    words = pc.unique(got.column("word")).cast(pa.string())
    v = len(words)
    phi = np.zeros((k, v))
    phi[got.column("z").to_numpy(), pc.index_in(got.column("word"), value_set=words).to_numpy()] = got.column("p").to_numpy()
    trie = Phrases(phrases)
    n_labels = len(trie.phrases)
    shared = spark.sparkContext.broadcast((trie, words, phi))
    tokens = word_docs.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = parts_for(tokens * 4, PART, spark.sparkContext.defaultParallelism)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words, _ = shared.value
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            return parted(mix(keys.view(np.uint64)), parts, {"pairs": keys, "counts": counts.astype(np.int64)})

        size = 0
        for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            rows = Rows(batch.column(1))
            at, which = trie.find(rows)
            labels = np.unique(rows.row[at] * (n_labels + 1) + which)
            wid = pc.fill_null(pc.index_in(rows.values, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            here = np.unique((rows.row * (v + 1) + wid)[wid >= 0])
            every = np.arange(len(rows.size))
            here = np.sort(np.r_[here, every * (v + 1) + v])  # column V: the document itself
            labels = np.sort(np.r_[labels, every * (n_labels + 1) + n_labels])  # row L likewise
            row, label = labels // (n_labels + 1), labels % (n_labels + 1)
            n_words = np.bincount(here // (v + 1), minlength=len(every))
            start = np.cumsum(n_words) - n_words
            reach = np.cumsum(n_words[row])
            a = 0
            while a < len(row):
                b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + HELD // 2, side="right")))
                c = n_words[row[a:b]]
                first = np.repeat(start[row[a:b]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                held.append(np.repeat(label[a:b] * (v + 1), c) + here[first] % (v + 1))
                size += len(held[-1])
                if size > HELD:
                    yield out()
                    size = 0
                a = b
        yield out()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, phi = shared.value
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in batches_of(batches, [np.int64, np.int64], PART):
            keys, inverse = np.unique(np.r_[keys, a], return_inverse=True)
            counts = np.bincount(inverse, np.r_[counts, b], len(keys)).astype(np.int64)
        label, w = keys // (v + 1), keys % (v + 1)
        rows: list[tuple[np.ndarray, ...]] = []  # label, z, n, a, b

        def add(label, z, n=0, a=0.0, b=0.0):
            label = np.asarray(label)
            rows.append(tuple(np.broadcast_to(x, label.shape) for x in (label, z, n, a, b)))

        add(label[w == v], -1, n=counts[w == v])  # documents of each label, and all (label L)
        joint, single = (w < v) & (label < n_labels), (w < v) & (label == n_labels)
        weight = np.log((counts[joint] + smoothing) / smoothing)
        for z in range(k):
            sums = np.bincount(label[joint], phi[z, w[joint]] * weight, n_labels)
            some = np.flatnonzero(sums)
            add(some, z, a=sums[some])
            p = phi[z, w[single]]
            add(np.array([n_labels]), z, a=p.sum(), b=(p * np.log(counts[single])).sum())
        columns = [np.concatenate(c) for c in zip(*rows)]
        kinds = (np.int32, np.int32, np.int64, np.float64, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, kinds)], ["l", "z", "n", "a", "b"])

    packed = word_docs.select("doc_id", "words").mapInArrow(count, "part int, pairs binary, counts binary").repartitionById(parts, F.col("part"))
    sums = written(packed.mapInArrow(reduce, "l int, z int, n long, a double, b double").groupBy("l", "z").agg(*[F.sum(c).alias(c) for c in "nab"]), "labels")
    names = spark.createDataFrame(pa.table({"l": pa.array(np.arange(n_labels, dtype=np.int32)), "label": pa.array([" ".join(p) for p in trie.phrases], pa.string())}))
    mine, all_ = sums.where(F.col("l") < n_labels), sums.where(F.col("l") == n_labels)
    docs = mine.where("z < 0").join(names, "l").select("label", F.col("n").alias("dc"))
    more = mine.where("z >= 0").join(names, "l").select("label", "z", F.col("a").alias("more"))
    return docs, all_.where("z >= 0").select("z", F.col("a").alias("mass"), F.col("b").alias("logs")), all_.where("z < 0").select(F.col("n").alias("d")), more


def surface_forms(docs: DataFrame, phrases: DataFrame, *, text_col: str = "text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(words, form, n): how often each phrase stands in which spelling, with what is between its
    words, in the raw texts. At most ngrams.MAX_LISTED phrases, which are broadcast."""
    known = listed(phrases)
    if known is None:
        raise ValueError("too many phrases")
    shared = docs.sparkSession.sparkContext.broadcast(Phrases(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        texts = pa.array([list(p) for p in trie.phrases], pa.list_(pa.string()))
        size = np.array([len(p) for p in trie.phrases], np.int64)
        for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            rows = Rows(batch.column(1))
            at, which = trie.find(rows)
            order = np.argsort(at, kind="stable")  # row by row, so that each text is held once, not for each place in it
            at, which = at[order], which[order]
            begin = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            end = begin + batch.column(3).flatten().to_numpy(zero_copy_only=False)
            begin, end, row = begin[at], end[at + size[which] - 1], rows.row[at]
            counts: Counter[tuple[int, str]] = Counter()
            ends = np.r_[np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)] if len(row) else []
            a = 0
            for b in ends:
                text = batch.column(4)[int(row[a])].as_py()
                counts.update((k, text[i:j]) for k, i, j in zip(which[a:b].tolist(), begin[a:b].tolist(), end[a:b].tolist()))
                a = b
            found, forms = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(found, pa.int64())), pa.array(forms, pa.string()), pa.array(counts.values(), pa.int64())], ["words", "form", "n"])

    made = span_lists(docs.where(F.col(text_col).isNotNull()), text_col=text_col, pattern=pattern, keep=text_col)
    return made.mapInArrow(run, "words array<string>, form string, n long").groupBy("words", "form").agg(F.sum("n").alias("n"))


def named_candidates(candidates: DataFrame, forms: DataFrame) -> DataFrame:
    """candidates(words, ...) with names, their spellings by falling number, and name, the first."""
    ranked = forms.groupBy("words").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "form"))).alias("f"))
    names = F.transform("f", lambda x: x["form"])
    joined = candidates.join(ranked.select("words", names.alias("names")), "words", "left")
    return joined.withColumn("name", F.coalesce(F.get("names", F.lit(0)), F.concat_ws(" ", "words")))


def top_labels(labels: DataFrame, top_n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "label"))
    return labels.withColumn("rank_no", rank).where(F.col("rank_no") <= top_n)
