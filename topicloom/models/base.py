"""The sweep engine and LDA.

Documents are one row each: word ids, weights, topics. A sweep reads the rows once, without a
shuffle: each document samples its tokens one after the other against the topic-word counts of the
last merge (broadcast), less the token itself; a block of documents moves in step, one token of each
at a time, as numpy operations over block and topics. Then the counts are merged by a groupBy.
Nothing depends on how rows are partitioned. The rows are written to the shared folder after every
merge, so a lost executor costs one sweep of its partitions.

The broadcast state is topics x used words; MAX_STATE_BYTES bounds it (prune the vocabulary, or use
operators.readout.jacobi_sweep, which joins instead).
"""

from __future__ import annotations

import inspect
import io
import json
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.hashing import uniforms
from topicloom.functions.special import digamma, lgamma
from topicloom.operators import corpus
from topicloom.sources.tables import dropped, written

MAX_STATE_BYTES = 4 << 30
#: Used words are broadcast too, to encode documents inside their rows: at most so many.
MAX_WORDS = 5_000_000
#: saves(full=True) takes the documents through the driver: at most so many tokens.
MAX_SAVED_TOKENS = 50_000_000
#: Padded tokens of a block of documents that move in step.
BLOCK_TOKENS = 400_000
#: A sweep has at least a task for so many tokens, and one for each core.
TASK_TOKENS = 2_000_000
ROW = "doc_id long, wid array<int>, w array<float>, sent array<int>, x array<double>, z array<int>, nd array<double>, s array<double>, p array<int>"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_TYPES = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32())]
REGISTRY: dict[str, type] = {}


class Block:
    """Documents in step, the longest first. Arrays are [documents, places]; a document's places
    behind its end are never read."""

    def __init__(self, batch: pa.RecordBatch, which: np.ndarray) -> None:
        lists = {c: batch.column(i) for i, c in enumerate(_NAMES) if c in ("wid", "w", "z", "sent")}
        offsets = lists["wid"].offsets.to_numpy().astype(np.int64)
        self.doc = batch.column(0).to_numpy()[which]
        self.len = np.diff(offsets)[which]
        b, n = len(which), int(self.len.max(initial=0))
        self.inside = np.arange(n)[None, :] < self.len[:, None]

        def filled(c: str, kind: type) -> np.ndarray:
            out = np.zeros((b, n), kind)
            column = lists[c]
            if column.null_count == 0:
                start = column.offsets.to_numpy().astype(np.int64)[which]
                at = np.repeat(start - np.cumsum(self.len) + self.len, self.len) + np.arange(self.len.sum())
                out[self.inside] = column.values.to_numpy(zero_copy_only=False)[at]
            return out

        self.w, self.weight, self.z, self.sent = filled("wid", np.int64), filled("w", float), filled("z", np.int64), filled("sent", np.int64)
        self.new = lists["z"].null_count > 0
        self.active = np.cumsum(np.bincount(self.len, minlength=n + 1)[::-1])[::-1][1:] if n else np.zeros(0, int)
        some = batch.take(pa.array(which)).select(["x", "s", "p"]).to_pydict()
        self.x = [np.array(x, float) if x is not None else np.zeros(0) for x in some["x"]]
        self.s = [np.array(x, float) if x is not None else None for x in some["s"]]
        self.p = [list(x) if x is not None else None for x in some["p"]]
        self.rows = np.arange(b)

    def counts(self, states: int, of: np.ndarray | None = None) -> np.ndarray:
        """[documents, states]: summed weights by z (or by `of`)."""
        z = self.z if of is None else of
        key = (self.rows[:, None] * states + z)[self.inside]
        return np.bincount(key, self.weight[self.inside], len(self.doc) * states).reshape(-1, states)

    def out(self, nd: np.ndarray) -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum(self.len)].astype(np.int32)
        cut = lambda a, t: pa.ListArray.from_arrays(offsets, pa.array(a[self.inside], t))
        rows = pa.ListArray.from_arrays(np.arange(len(nd) + 1, dtype=np.int32) * nd.shape[1], pa.array(nd.ravel()))
        columns = [pa.array(self.doc), cut(self.w, pa.int32()), cut(self.weight, pa.float32()), cut(self.sent, pa.int32()), pa.array(self.x, _TYPES[4]), cut(self.z, pa.int32()), rows, pa.array(self.s, _TYPES[7]), pa.array(self.p, _TYPES[8])]
        return pa.RecordBatch.from_arrays(columns, _NAMES)


def draw(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An index by row, with the chances p (not normalised)."""
    c = np.cumsum(p, axis=1)
    return np.minimum((c <= u[:, None] * c[:, -1:]).sum(1), p.shape[1] - 1)


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    size = np.diff(batch.column(1).offsets.to_numpy())
    order = np.lexsort((batch.column(0).to_numpy(), -size))
    a = 0
    while a < len(order):
        b = a + max(1, BLOCK_TOKENS // max(1, int(size[order[a]])))
        yield Block(batch, order[a:b])
        a = b


class LDA:
    """Latent Dirichlet allocation, and what all models share.

    add(docs) takes documents as (doc_id, words array<string>, ...) with the columns the model's
    `needs` names; train(n) samples; the rest reads out. Words of null (holes) and documents without
    used words are left out.
    """

    needs: tuple[str, ...] = ()
    supports_word_prior = True
    asymmetric_alpha = True

    def __init_subclass__(cls) -> None:
        REGISTRY[cls.__name__] = cls

    def __init__(self, k: int = 1, *, alpha: float | list[float] = 0.1, eta: float = 0.01, tw: str = "one", min_cf: int = 0, min_df: int = 0, rm_top: int = 0, seed: int = 42, optim_interval: int = 10, burn_in: int = 0) -> None:
        if not 1 <= k < 2**31:
            raise ValueError("k must be 1 or more")
        many = isinstance(alpha, (list, tuple))
        if many and not self.asymmetric_alpha:
            raise ValueError(f"{type(self).__name__} takes a single alpha")
        if many and len(alpha) not in (1, k):
            raise ValueError("alpha must be one number or k numbers")
        values = list(alpha) if many else [alpha]
        if min(values) <= 0 or eta <= 0:
            raise ValueError("alpha and eta must be positive")
        if tw not in ("one", "idf", "pmi"):
            raise ValueError(f"unknown term weight {tw!r}")
        self.k, self.eta, self.tw, self.seed = k, eta, tw, seed
        self.alpha = np.array(values * k if len(values) == 1 else values, float)
        self.min_cf, self.min_df, self.rm_top = min_cf, min_df, rm_top
        self.optim_interval, self.burn_in, self.global_step = optim_interval, burn_in, 0
        self.priors: dict[str, list[float]] = {}
        self.spark: SparkSession | None = None
        self.rows: DataFrame | None = None
        self.docs: DataFrame | None = None
        self.n: np.ndarray | None = None
        self.prior: np.ndarray | None = None

    # --- documents ----------------------------------------------------------------------------------

    def add(self, docs: DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None) -> LDA:
        """Add documents; before training only. More than one call adds corpora one behind the other.
        transform turns the columns documents come with into those the model needs."""
        if self.n is not None:
            raise RuntimeError("documents can't be added after training")
        own = self._needed(transform(docs) if transform else docs)
        self.spark = docs.sparkSession
        self.docs = own if self.docs is None else corpus.concat_corpora(self.docs, own)
        return self

    def add_doc(self, words: list[str], **values) -> LDA:
        """Add one document, given as a list of words and the values of the model's columns."""
        if isinstance(words, str):
            raise ValueError("words must be a list of strings")
        if not self.spark:
            self.spark = SparkSession.getActiveSession()
        kinds = {"metadata": "string", "multi_metadata": "array<string>", "numeric_metadata": "array<double>", "labels": "array<string>", "y": "array<double>", "timepoint": "int"}
        spec = ", ".join(["doc_id long", "words array<string>", *(f"{c} {kinds[c]}" for c in values)])
        return self.add(self.spark.createDataFrame([(0, list(words), *values.values())], spec))

    def _needed(self, docs: DataFrame) -> DataFrame:
        missing = [c for c in ("doc_id", "words", *self.needs) if c not in docs.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
        return docs.select("doc_id", "words", *self.needs)

    def set_word_prior(self, word: str, prior: list[float] | dict[int, float]) -> None:
        """Prior weights of a word by topic; topics a dict doesn't name keep eta."""
        if not self.supports_word_prior:
            raise RuntimeError(f"{type(self).__name__} has no word priors")
        if self.n is not None:
            raise RuntimeError("word priors can't be set after training")
        values = [prior.get(i, self.eta) for i in range(self.topics)] if isinstance(prior, dict) else list(prior)
        if len(values) != self.topics or min(values) < 0:
            raise ValueError("a word prior needs a weight of 0 or more for each topic")
        self.priors[word] = values

    def get_word_prior(self, word: str) -> list[float]:
        return self.priors.get(word, [self.eta] * self.topics)

    @property
    def topics(self) -> int:
        """Topics that have words: rows of the topic-word counts."""
        return self.k

    #: The word that ends a sentence, for models with sentences.
    delimiter: str | None = None

    def _pack(self, docs: DataFrame, given: pa.Array | None = None) -> DataFrame:
        """Rows of docs, encoded inside the row with the broadcast vocabulary: documents without used
        words have none. given: a weight for each word, instead of the term weights of training."""
        used = self.vocab.where("used").select("wid", "word", "cf", "df").orderBy("wid").toArrow()  # bounded by _fits
        shared = self.spark.sparkContext.broadcast({"words": used.column("word").combine_chunks().cast(pa.string()), "cf": used.column("cf").to_numpy(), "df": used.column("df").to_numpy(), "given": given})
        total = self.vocab.agg(F.sum("cf")).first()[0] or 1 if self.tw == "pmi" and given is None else 1
        full = self._with_words(docs, shared) if self.tw == "idf" and given is None else 1
        columns = docs.select("doc_id", "words", *self.features(docs))
        return columns.mapInArrow(encoder(shared, self.tw if given is None else "given", self.delimiter, total, full), ROW)

    @staticmethod
    def _with_words(docs: DataFrame, shared) -> int:
        """Documents with any used word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = corpus.Rows(batch.column(0))
                known = pc.is_in(rows.values, value_set=shared.value["words"]).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(rows.row[known]))], pa.int64())], ["n"])

        return docs.select("words").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 1

    def features(self, docs: DataFrame) -> list[Column]:
        """x array<double>: what the model knows of a document besides its words."""
        return [F.lit(None).cast("array<double>").alias("x")]

    def countable(self, docs: DataFrame) -> DataFrame:
        """docs with the words that count for the vocabulary."""
        return docs.select("doc_id", "words")

    def learn(self, docs: DataFrame) -> None:
        """What must be known of all documents before features() are made."""

    def prepare(self) -> None:
        """Prune, weigh, pack and draw first topics: the first train() does it."""
        if self.docs is None:
            raise RuntimeError("add documents before training")
        self.vocab = corpus.vocabulary(self.countable(self.docs), min_cf=self.min_cf, min_df=self.min_df, rm_top=self.rm_top)
        self.v = self.vocab.where("used").count()
        self._fits()
        self.learn(self.docs)
        words = self.vocab.where("used").agg(F.sum("cf")).first()[0] or 0
        parts = max(self.spark.sparkContext.defaultParallelism, -(-words // TASK_TOKENS))
        self.rows = written(self._pack(self.docs).repartition(parts, "doc_id"), "packed")
        if self.priors:
            wanted = self.spark.createDataFrame([(w,) for w in self.priors], "word string")
            self.prior = np.full((self.v, self.topics), self.eta)
            for r in self.vocab.where("used").join(F.broadcast(wanted), "word").select("word", "wid").toLocalIterator():
                self.prior[r["wid"]] = self.priors[r["word"]]
        self.n = np.zeros((self.v, self.topics))
        self.begin()
        self._sweep(0, first=True)

    def adopt(self, vocab: DataFrame, rows: DataFrame, docs: DataFrame | None = None, **state) -> LDA:
        """Take topics that are given instead of drawing first ones. vocab: as of corpus.vocabulary;
        rows(doc_id, wid, z, and any of w, sent, x, s, p), lists by place: topics and, as the model
        keeps them, sentences, features, document parameters and discrete states. docs: documents
        that learn() and features() read. state: attributes that training would have set. The counts
        are made from the rows; training can go on from there."""
        self.spark, self.vocab, self.docs = rows.sparkSession, vocab, docs
        self.v = vocab.where("used").count()
        self._fits()
        if docs is not None:
            self.learn(docs)
            if "x" not in rows.columns:
                rows = rows.join(docs.select("doc_id", *self.features(docs)), "doc_id")
        self.n = np.zeros((self.v, self.topics))
        self.begin()
        vars(self).update(state)
        kinds = dict(c.split() for c in ROW.split(", "))
        have = {c: F.col(c) for c in rows.columns}
        have.setdefault("w", F.transform("wid", lambda x: F.lit(1.0)))
        have.setdefault("nd", F.array().cast("array<double>"))
        plain = rows.select(*[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        fold, states, settle = self.folded, self._states(), type(self).settle
        shared = self.spark.sparkContext.broadcast(self.state())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _blocks(batch):
                    settle(block, shared.value)
                    yield block.out(block.counts(states, fold(block.z)))

        self.rows = written(plain.mapInArrow(run, ROW), "adopted")
        self.n = self._counted()
        return self

    def _states(self) -> int:
        """Length of a document's counts nd."""
        return len(self.alpha)

    @property
    def folded(self) -> Callable[[np.ndarray], np.ndarray]:
        """The place in nd of each drawn z."""
        return lambda z: z

    @staticmethod
    def settle(block: Block, g: dict) -> None:
        """Fill what a kernel leaves in rows besides topics, for topics that are given."""

    def _fits(self) -> None:
        if self.v > MAX_WORDS:
            raise ValueError(f"more than {MAX_WORDS} used words; prune the vocabulary (min_cf, min_df)")
        if self.v * self.topics * 8 > MAX_STATE_BYTES:
            raise ValueError(f"{self.v} words x {self.topics} topics don't fit the broadcast state; prune the vocabulary (min_cf, min_df)")

    def begin(self) -> None:
        """Set up global state before the first draw."""

    # --- sampling -----------------------------------------------------------------------------------

    def state(self) -> dict:
        """What the samplers need, broadcast: likelihoods and priors."""
        prior = self.prior if self.prior is not None else self.eta
        total = self.prior.sum(0) if self.prior is not None else self.eta * self.v
        return {"n": self.n, "nk": self.n.sum(0), "prior": prior, "total": total, "alpha": self.alpha, "seed": self.seed}

    def topic_of(self, z: Column) -> Column:
        """The topic (row of counts) of a drawn z."""
        return z

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        """Draw the topics of a block anew; [documents, k] counts of the result."""
        return sample(block, g, sweep, lambda nd, a: nd + g["alpha"])

    def _run(self, rows: DataFrame, g, sweep: int, times: int, scored: bool = False) -> DataFrame:
        """rows after some sweeps; scored: with ll, what each document adds to the likelihood."""
        kernel, own, words, topic = type(self).kernel, type(self).doc_lls, type(self).word_lls, self.topic_array

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = g.value
            if "n" in state and "like" not in state:
                state["like"] = (state["n"] + state["prior"]) / (state["nk"] + state["total"])
            for batch in batches:
                for block in _blocks(batch):
                    for i in range(times):
                        nd = kernel(block, state, sweep + i)
                        block.new = False
                    out = block.out(nd)
                    if scored:
                        ll = own(block, state) + words(block, state, topic(block))
                        out = pa.RecordBatch.from_arrays([*out.columns, pa.array(ll)], [*_NAMES, "ll"])
                    yield out

        return rows.mapInArrow(run, ROW + (", ll double" if scored else ""))

    def _sweep(self, sweep: int, times: int = 1, first: bool = False) -> None:
        shared = self.spark.sparkContext.broadcast(self.state())
        old = self.rows
        self.rows = written(self._run(old, shared, sweep, times), "swept")
        self.merge()
        shared.destroy()
        dropped(old)

    def _counted(self, rows: DataFrame | None = None) -> np.ndarray:
        """Topic-word counts of all documents: at most topics x words rows reach the driver."""
        flat = (self.rows if rows is None else rows).select(F.explode(F.arrays_zip("wid", "z", "w")).alias("t")).select("t.wid", self.topic_of(F.col("t.z")).cast("int").alias("z"), "t.w")
        got = flat.groupBy("wid", "z").agg(F.sum("w").alias("n")).toArrow()
        n = np.zeros((self.v, self.topics))
        n[got.column("wid").to_numpy(), got.column("z").to_numpy()] = got.column("n").to_numpy()
        return n

    def merge(self) -> None:
        self.n = self._counted()

    def train(self, iterations: int = 10, *, sync_interval: int = 1, callback: Callable | None = None, callback_interval: int = 10, freeze_topics: bool = False, workers: int = 0, parallel: int = 0) -> None:
        """Sample; repeated calls go on. sync_interval: sweeps of each document between two merges.
        callback(model, iterations done, iterations) is called every callback_interval. workers and
        parallel are taken for compatibility: Spark's partitions decide."""
        if self.n is None:
            self.prepare()
        self.frozen = freeze_topics
        done = 0
        while done < iterations and self.v:
            times = min(sync_interval, iterations - done)
            before = self.global_step
            self._sweep(self.global_step + 1, times)
            self.global_step += times
            done += times
            every = max(self.optim_interval, 0)
            if every and self.global_step > self.burn_in and self.global_step // every > before // every:
                self.optimize()
            if callback and done // callback_interval > (done - times) // callback_interval:
                callback(self, done, iterations)

    def optimize(self) -> None:
        """Fixed-point steps of the document prior, from histograms of topic counts."""
        self.alpha = fixed_point(self.alpha, *count_histogram(self.rows, len(self.alpha)))

    # --- reading out --------------------------------------------------------------------------------

    def _trained(self) -> None:
        if self.n is None:
            raise RuntimeError("train first")

    def phi(self) -> np.ndarray:
        """[topics, words]; word priors don't count, eta does."""
        self._trained()
        return ((self.n + self.eta) / (self.n.sum(0) + self.eta * self.v)).T

    def topic_word_dist(self) -> DataFrame:
        """(topic, wid, word, p)."""
        phi = self.phi()
        t = pa.table({"wid": np.arange(self.v, dtype=np.int32), "p": list(phi.T)}, schema=pa.schema([("wid", pa.int32()), ("p", pa.list_(pa.float64()))]))
        dist = self.spark.createDataFrame(t).select("wid", F.posexplode("p").alias("topic", "p"))
        return dist.join(self.vocab.where("used").select("wid", "word"), "wid").select("topic", "wid", "word", "p")

    def topic_words(self, top_n: int = 10) -> DataFrame:
        """(topic, rank_no, word, p); ties by wid."""
        phi = self.phi()
        best = np.lexsort((np.broadcast_to(np.arange(self.v), phi.shape), -phi), axis=1)[:, :top_n] if self.v else np.zeros((len(phi), 0), int)
        rows = [(k, r + 1, int(w), float(phi[k, w])) for k in range(len(phi)) for r, w in enumerate(best[k])]
        top = self.spark.createDataFrame(rows, "topic int, rank_no int, wid int, p double")
        return top.join(self.vocab.where("used").select("wid", "word"), "wid").select("topic", "rank_no", "word", "p")

    def theta_expr(self) -> Column:
        """array<double>: topic shares of a row of self.rows."""
        return shares(F.col("nd"), F.lit(self.alpha.tolist()))

    def doc_topic_dist(self) -> DataFrame:
        """(doc_id, theta array<double>)."""
        self._trained()
        return self.rows.select("doc_id", self.theta_expr().alias("theta"))

    def doc_topics(self, top_n: int = 10) -> DataFrame:
        """(doc_id, topics array<struct<p, topic>>): the largest topics, ties by topic."""
        ranked = F.array_sort(F.transform("theta", lambda p, i: F.struct((-p).alias("n"), i.alias("topic"))))
        return self.doc_topic_dist().select("doc_id", F.transform(F.slice(ranked, 1, top_n), lambda x: F.struct((-x["n"]).alias("p"), x["topic"].alias("topic"))).alias("topics"))

    def token_topics(self) -> DataFrame:
        """(doc_id, place, wid, topic) of the used tokens, in text order."""
        self._trained()
        t = self.rows.select("doc_id", F.posexplode(F.arrays_zip("wid", "z")).alias("place", "t"))
        return t.select("doc_id", "place", "t.wid", self.topic_of(F.col("t.z")).alias("topic"))

    def attributes(self) -> dict[str, Column]:
        """What the model keeps of a document besides its topics, by name."""
        return {}

    def documents(self) -> DataFrame:
        """(doc_id, words, weights, topics, theta, and the model's attributes): words by wid, in text
        order."""
        self._trained()
        topics = F.transform("z", lambda z: self.topic_of(z).cast("int"))
        own = [c.alias(n) for n, c in self.attributes().items()]
        return self.rows.select("doc_id", F.col("wid").alias("words"), F.col("w").alias("weights"), topics.alias("topics"), self.theta_expr().alias("theta"), *own)

    def count_by_topics(self) -> DataFrame:
        """(topic, n): tokens, whatever their weights."""
        return self.token_topics().groupBy("topic").agg(F.count("*").alias("n"))

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        """Log-likelihood of each document's own part: its topics given the prior."""
        return dirichlet_lls(block.counts(len(g["alpha"])), g["alpha"])

    def _doc_lls(self, rows: DataFrame, extra: dict | None = None) -> DataFrame:
        f = type(self).doc_lls
        g = self.spark.sparkContext.broadcast({**self.state(), **(extra or {})})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _blocks(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc), pa.array(f(block, g.value).astype(float))], ["doc_id", "ll"])

        return rows.mapInArrow(run, "doc_id long, ll double")

    def doc_lls_of(self) -> DataFrame:
        """(doc_id, ll) of the training documents."""
        self._trained()
        return self._doc_lls(self.rows)

    def doc_ll(self) -> float:
        return self.doc_lls_of().agg(F.sum("ll")).first()[0] or 0.0

    def state_ll(self) -> float:
        """Log-likelihood of what all documents share: words given topics, and the model's priors."""
        return self.word_ll()

    def word_ll(self, live: np.ndarray | None = None) -> float:
        prior = self.prior if self.prior is not None else self.state()["prior"]
        prior = np.broadcast_to(prior, self.n.shape)
        total, some = prior.sum(0), self.n > 0
        each = (lgamma(self.n[some] + prior[some]) - lgamma(prior[some])).sum()
        topics = lgamma(self.n.sum(0) + total) - lgamma(total)
        return float(each - (topics if live is None else topics[live]).sum()) if self.v else 0.0

    @property
    def ll_per_word(self) -> float:
        self._trained()
        words = float(self.n.sum())
        return (self.doc_ll() + self.state_ll()) / words if words else float("nan")

    @property
    def perplexity(self) -> float:
        return float(np.exp(-self.ll_per_word))

    def facts(self) -> dict[str, object]:
        """What summary() says of the model besides its parameters and topics."""
        freq = self.n.sum(1) / max(self.n.sum(), 1e-300)
        vocabs, tokens = self.vocab.agg(F.count("*"), F.coalesce(F.sum("cf"), F.lit(0))).first()
        removed = [r["word"] for r in self.vocab.where("removed").orderBy(F.desc("cf"), F.desc("df"), "first_at").limit(50).collect()]
        return {"documents": self.rows.count(), "words": int(tokens), "used words (weighted)": round(float(self.n.sum()), 3), "vocabulary": int(vocabs), "used vocabulary": self.v, "entropy": round(float(-(freq * np.log(freq + 1e-20)).sum()), 5), "removed": " ".join(removed) or "-", "sweeps": self.global_step, "log-likelihood a word": round(self.ll_per_word, 5), **self.more_facts()}

    def more_facts(self) -> dict[str, object]:
        return {}

    def summary(self, top_n: int = 5) -> str:
        """Sizes, parameters and the top words of each topic, as text."""
        self._trained()
        words: dict[int, list] = {}
        for r in self.topic_words(top_n).collect():
            words.setdefault(r["topic"], []).append((r["rank_no"], r["word"]))
        counts = {r["topic"]: r["n"] for r in self.count_by_topics().collect()}
        table = [(k, str(v)) for k, v in {**self.facts(), **self.params()}.items()]
        width = max(len(k) for k, _ in table)
        topics = [f"topic {k} [{counts.get(k, 0)}]  {', '.join(w for _, w in sorted(words.get(k, [])))}" for k in range(self.topics)]
        return "\n".join([type(self).__name__, *(f"  {k.ljust(width)}  {v}" for k, v in table), *topics])

    def used_words(self) -> DataFrame:
        """(wid, word, cf, df, weight): the used vocabulary with its summed term weights."""
        weight = self.spark.createDataFrame(pa.table({"wid": np.arange(self.v, dtype=np.int32), "weight": self.n.sum(1)}))
        return self.vocab.where("used").select("wid", "word", "cf", "df").join(weight, "wid")

    @property
    def removed_top_words(self) -> list[str]:
        return [r["word"] for r in self.vocab.where("removed").orderBy(F.desc("cf"), F.desc("df"), "first_at").collect()]

    # --- new documents ------------------------------------------------------------------------------

    def make_docs(self, docs: DataFrame) -> DataFrame:
        """Unseen documents (same columns as add()) as rows for infer(). Out-of-vocabulary words are
        dropped; a document without known words has no row."""
        self._trained()
        if self.tw == "one":
            return self._pack(docs, pa.array(np.ones(self.v)))
        weights = np.zeros(self.v)
        for r in self.word_weights().toLocalIterator():
            weights[r["wid"]] = r["w"]
        return self._pack(docs, pa.array(weights))

    def infer(self, docs: DataFrame, iterations: int = 100, *, together: bool = False, sync_interval: int = 5, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(doc_id, theta, ll) of unseen documents: topic shares, and the log-likelihood of the
        document's topics and words beside the training documents. docs: as for add(), or rows of
        make_docs().

        Each document is drawn on its own against the trained counts: one pass, no shuffle. With
        together, the documents also learn from each other: their counts join the trained ones, and
        are merged every sync_interval sweeps; the model itself stays as it was.
        """
        return self._read_inferred(self._inferred(transform(docs) if transform else docs, iterations, together, sync_interval))

    def _inferred(self, docs: DataFrame, iterations: int, together: bool = False, sync_interval: int = 5) -> DataFrame:
        """Rows of the documents with their topics, and ll."""
        self._trained()
        rows = docs if "wid" in docs.columns else self.make_docs(docs)
        if not together:
            shared = self.spark.sparkContext.broadcast({**self.state(), "infer": True})
            return self._run(rows, shared, 1_000_000, iterations, scored=True)
        made, extra = self._inferred_together(rows, iterations, sync_interval)
        return made.join(self._gains(made, extra), "doc_id")

    def _read_inferred(self, rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", self.theta_expr().alias("theta"), "ll")

    def _inferred_together(self, rows: DataFrame, iterations: int, sync_interval: int) -> tuple[DataFrame, dict]:
        parts = max(self.spark.sparkContext.defaultParallelism, 1)
        now, own, done = written(rows.repartition(parts, "doc_id"), "made"), np.zeros_like(self.n), 0
        while True:
            extra = {"n": self.n + own, "nk": (self.n + own).sum(0)}
            if done >= iterations:
                return now, {**extra, "own": True}
            times = min(sync_interval, iterations - done) if done else 1
            shared = self.spark.sparkContext.broadcast({**self.state(), **extra, **({} if done else {"infer": True})})
            before, now = now, written(self._run(now, shared, 1_000_000 + done, times), "made")
            own, done = self._counted(now), done + times
            shared.destroy()
            dropped(before)

    def _gains(self, rows: DataFrame, extra: dict) -> DataFrame:
        """(doc_id, ll): own part and what the document's words add to the words of all."""
        own, words, topic = type(self).doc_lls, type(self).word_lls, self.topic_array
        shared = self.spark.sparkContext.broadcast({**self.state(), **extra})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = shared.value
            for batch in batches:
                for block in _blocks(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc), pa.array(own(block, g) + words(block, g, topic(block)))], ["doc_id", "ll"])

        return rows.mapInArrow(run, "doc_id long, ll double")

    @staticmethod
    def word_lls(block: Block, g: dict, topic: np.ndarray) -> np.ndarray:
        """What each document's words add to the likelihood of the words given the topics."""
        return word_gain(block, g, topic)

    @property
    def topic_array(self) -> Callable[[Block], np.ndarray]:
        """A function of blocks: the topic (row of counts) of each token."""
        return lambda block: block.z

    def word_weights(self) -> DataFrame:
        """(wid, w): the mean training weight of each word, for new documents."""
        flat = self.rows.select(F.explode(F.arrays_zip("wid", "w")).alias("t"))
        return flat.groupBy(F.col("t.wid").alias("wid")).agg(F.avg("t.w").alias("w"))

    # --- saving -------------------------------------------------------------------------------------

    def params(self) -> dict:
        """Constructor arguments."""
        names = {n for c in type(self).__mro__ if issubclass(c, LDA) for n in inspect.signature(c.__init__).parameters} - {"self", "kw"}
        return {n: (v.tolist() if isinstance(v := getattr(self, n), np.ndarray) else v) for n in sorted(names) if hasattr(self, n)}

    def arrays(self) -> dict[str, np.ndarray]:
        """Trained state besides the documents."""
        return {n: v for n, v in vars(self).items() if isinstance(v, np.ndarray)}

    def _manifest(self, full: bool) -> str:
        plain = {n: v for n, v in vars(self).items() if isinstance(v, (int, float, str, bool, list, tuple, dict)) and n not in ("priors",)}
        return json.dumps({"class": type(self).__name__, "params": self.params(), "plain": plain, "priors": self.priors, "full": full})

    def saves(self, full: bool = True) -> bytes:
        """The model as bytes: a zip of the manifest, the arrays, the vocabulary and, with full, the
        documents, at most MAX_SAVED_TOKENS tokens of them (save() writes larger ones to a folder)."""
        self._trained()
        if full and (self.rows.agg(F.sum(F.size("wid"))).first()[0] or 0) > MAX_SAVED_TOKENS:
            raise ValueError("too many documents for bytes; save() to a folder or use full=False")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("manifest.json", self._manifest(full))
            for n, a in self.arrays().items():
                held = io.BytesIO()
                np.save(held, a, allow_pickle=False)
                z.writestr(f"arrays/{n}.npy", held.getvalue())
            for n, df in {"vocab": self.vocab, **({"rows": self.rows} if full else {})}.items():
                held = io.BytesIO()
                pq.write_table(df.toArrow(), held)
                z.writestr(f"{n}.parquet", held.getvalue())
        return out.getvalue()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LDA:
        """load_model() of a model of this class."""
        return cls._same(load_model(spark, path))

    @classmethod
    def loads(cls, spark: SparkSession, data: bytes) -> LDA:
        return cls._same(loads_model(spark, data))

    @classmethod
    def _same(cls, model: LDA) -> LDA:
        if type(model) is not cls:
            raise ValueError(f"the model saved is a {type(model).__name__}, not a {cls.__name__}")
        return model

    def save(self, path: str, full: bool = True) -> None:
        """A folder: manifest (JSON with the class name), vocabulary, arrays, and with full the
        documents too, so that training can go on."""
        self._trained()
        manifest = self._manifest(full)
        self.spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        rows = [(n, str(a.dtype), [int(x) for x in a.shape], a.tobytes()) for n, a in self.arrays().items()]
        self.spark.createDataFrame(rows, "name string, dtype string, shape array<long>, data binary").write.mode("overwrite").parquet(f"{path}/arrays")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        if full:
            self.rows.write.mode("overwrite").parquet(f"{path}/rows")

    def copy(self) -> LDA:
        import copy

        spark, self.spark = self.spark, None
        frames = {n: v for n, v in vars(self).items() if isinstance(v, DataFrame)}
        for n in frames:
            setattr(self, n, None)
        try:
            out = copy.deepcopy(self)
        finally:
            for o in (self,):
                o.spark = spark
                for n, v in frames.items():
                    setattr(o, n, v)
        out.spark = spark
        for n, v in frames.items():
            setattr(out, n, v)
        if out.rows is not None:
            out.rows = written(out.rows, "copied")  # each drops its own
        return out

    def get_hash(self) -> int:
        """A hash of the vocabulary and topic assignments, whatever the order of rows."""
        self._trained()
        words = self.vocab.agg(F.sum(F.xxhash64("word", "wid").cast("decimal(38,0)")).alias("h")).first()["h"] or 0
        topics = self.rows.agg(F.sum(F.xxhash64("doc_id", "wid", "z").cast("decimal(38,0)")).alias("h")).first()["h"] or 0
        return int(words) * 31 + int(topics)


REGISTRY["LDA"] = LDA


def _loaded(spark: SparkSession, manifest: dict, arrays: dict[str, np.ndarray], vocab: DataFrame, rows: DataFrame | None) -> LDA:
    model = REGISTRY[manifest["class"]].__new__(REGISTRY[manifest["class"]])
    vars(model).update({"spark": spark, "docs": None, "rows": None, "prior": None, **manifest["plain"], "priors": manifest["priors"]})
    for n, a in arrays.items():
        setattr(model, n, a)
    model.vocab = vocab
    if rows is not None:
        model.rows = written(rows, "loaded")
    return model


def load_model(spark: SparkSession, path: str) -> LDA:
    """The model saved at path, of the class its manifest names."""
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    arrays = {r["name"]: np.frombuffer(bytes(r["data"]), r["dtype"]).reshape(r["shape"]).copy() for r in spark.read.parquet(f"{path}/arrays").collect()}
    return _loaded(spark, manifest, arrays, spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/rows") if manifest["full"] else None)


def loads_model(spark: SparkSession, data: bytes) -> LDA:
    """The model of saves()."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        manifest = json.loads(z.read("manifest.json"))
        arrays = {n[7:-4]: np.load(io.BytesIO(z.read(n)), allow_pickle=False) for n in z.namelist() if n.startswith("arrays/")}
        tables = {n[:-8]: spark.createDataFrame(pq.read_table(io.BytesIO(z.read(n)))) for n in z.namelist() if n.endswith(".parquet")}
    return _loaded(spark, manifest, arrays, written(tables["vocab"], "vocab"), tables.get("rows"))


def encoder(shared, weights: str, delimiter: str | None, total: int, documents: int):
    """mapInArrow function: (doc_id, words, x) -> rows of the sweep engine without topics yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        v = max(len(known["words"]), 1)
        for batch in batches:
            rows = corpus.Rows(batch.column(1))
            wid = pc.fill_null(pc.index_in(rows.values, value_set=known["words"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            used = np.flatnonzero(wid >= 0)
            row, w = rows.row[used], wid[used]
            if weights == "idf":
                weight = np.log(documents / known["df"])[w]
            elif weights == "pmi":
                _, inverse, times = np.unique(row * v + w, return_inverse=True, return_counts=True)
                weight = np.maximum(np.log(times[inverse] / (known["cf"][w] / total) / rows.size[row]), 0)
            elif weights == "given":
                weight = known["given"].to_numpy()[w]
            else:
                weight = np.ones(len(w))
            some, size = np.unique(row, return_counts=True)
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            cut = lambda a, t: pa.ListArray.from_arrays(offsets, pa.array(a.astype(t)))
            empty = lambda i: pa.nulls(len(some), _TYPES[i])
            if delimiter is None:
                sent = empty(3)
            else:
                ends = pc.fill_null(pc.equal(rows.values, delimiter), False).to_numpy(zero_copy_only=False).astype(np.int64)
                sent = cut(rows.running(ends)[used], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), cut(w, np.int32), cut(weight, np.float32), sent, batch.column(2).take(pa.array(some)).cast(_TYPES[4]), empty(5), empty(6), empty(7), empty(8)], _NAMES)

    return run


def dirichlet_lls(n: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """By row, the log-likelihood of counts drawn from a Dirichlet prior: alpha by column, or by row
    and column."""
    a = np.broadcast_to(alpha, n.shape)
    s = a.sum(-1)
    return (lgamma(n + a) - lgamma(a)).sum(-1) - lgamma(n.sum(-1) + s) + lgamma(s)


def word_gain(block: Block, g: dict, topic: np.ndarray) -> np.ndarray:
    """By document, what its words add to the log-likelihood of the words given the topics, beside
    the counts in g (less its own, if they are among those)."""
    v, k = g["n"].shape
    d, w, t, c = np.broadcast_to(block.rows[:, None], block.w.shape)[block.inside], block.w[block.inside], topic[block.inside], block.weight[block.inside]
    key, inverse = np.unique((d * k + t) * v + w, return_inverse=True)
    own = np.bincount(inverse, c, len(key))
    d, t, w = key // v // k, key // v % k, key % v
    prior = np.full(len(key), g["prior"]) if np.isscalar(g["prior"]) else g["prior"][w, t]
    total = np.broadcast_to(g["total"], k)
    less = own if g.get("own") else 0
    before = np.maximum(g["n"][w, t] - less, 0) + prior
    out = np.bincount(d, lgamma(before + own) - lgamma(before), len(block.doc))
    pair, inverse = np.unique(d * k + t, return_inverse=True)
    size = np.bincount(inverse, own, len(pair))
    before = np.maximum(g["nk"][pair % k] - (size if g.get("own") else 0), 0) + total[pair % k]
    return out - np.bincount(pair // k, lgamma(before + size) - lgamma(before), len(block.doc))


def shares(n: Column, alpha: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both = F.zip_with(n, alpha, lambda x, a: x + a)
    return F.transform(both, lambda x: x / (total(n) + total(alpha)))


def sample(block: Block, g: dict, sweep: int, doc_factor: Callable[[np.ndarray, int], np.ndarray], *, purpose: int = 0, like: np.ndarray | None = None, rows_of: np.ndarray | None = None) -> np.ndarray:
    """One sweep of models whose token states are topics. doc_factor(counts, active): chances of the
    topics by document, [active, k]. Before the first sweep topics are drawn from the prior of
    documents (and of words, if they have one)."""
    k = g["n"].shape[1]
    u = uniforms(g["seed"], block.doc, block.w.shape[1], sweep, purpose)
    nd = np.zeros((len(block.doc), k)) if block.new else block.counts(k)
    n, nk, like = g["n"], g["nk"] + g["total"], g["like"] if like is None else like
    by_word = not np.isscalar(g["prior"])
    for t in range(block.w.shape[1]):
        a = block.active[t]
        r, w, c = block.rows[:a], block.w[:a, t], block.weight[:a, t]
        if block.new and not g.get("infer"):
            p = doc_factor(np.zeros((a, k)), a) * (g["prior"][w] if by_word else 1.0)
        elif block.new:
            p = doc_factor(nd[:a], a) * like[w]
        else:
            z = block.z[:a, t]
            nd[r, z] -= c
            p = like[w]
            if not g.get("infer"):
                own = g["prior"][w, z] if by_word else g["prior"]
                p[r, z] = np.maximum(n[w, z] - c, 0) + own
                p[r, z] /= np.maximum(nk[z] - c, 1e-12)
            p = p * doc_factor(np.maximum(nd[:a], 0), a)
        z = draw(p, u[:a, t])
        nd[r, z] += c
        block.z[:a, t] = z
    return np.maximum(nd, 0)


def count_histogram(rows: DataFrame, k: int, counts: Column | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Values and numbers of documents, of each topic's counts and of the totals. Counts are rounded
    to 3 digits, so the histogram is bounded by topics x longest document, not by the documents.
    counts: an array of k counts of a row, instead of nd."""
    nd = F.slice("nd", 1, k) if counts is None else counts
    each = rows.select(nd.alias("n")).select(F.posexplode(F.concat("n", F.array(F.aggregate("n", F.lit(0.0), lambda s, x: s + x)))).alias("k", "n"))
    got = each.groupBy("k", F.round("n", 3).alias("n")).agg(F.count("*").alias("c")).toArrow().to_pandas()
    parts = [got[got["k"] == i] for i in range(k + 1)]
    return [p["n"].to_numpy() for p in parts[:k]], [p["c"].to_numpy(float) for p in parts[:k]], parts[k]["n"].to_numpy(), parts[k]["c"].to_numpy(float)


def fixed_point(alpha: np.ndarray, values: list[np.ndarray], weights: list[np.ndarray], totals: np.ndarray, total_weights: np.ndarray, steps: int = 10) -> np.ndarray:
    alpha = alpha.copy()
    for _ in range(steps):
        s = alpha.sum()
        down = float((total_weights * (digamma(totals + s) - digamma(s))).sum())
        if down <= 0:
            return alpha
        for i in range(len(alpha)):
            up = float((weights[i] * (digamma(values[i] + alpha[i]) - digamma(alpha[i]))).sum())
            alpha[i] = max(up / down * alpha[i], 1e-5)
    return alpha
