"""A growing collection of documents, and exports of a model's tables."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import corpus, ngrams
from topicloom.sources.tables import shared_dir

#: Columns of documents beside raw and words.
VALUES = {"uid": "string", "metadata": "string", "multi_metadata": "array<string>", "numeric_metadata": "array<double>", "labels": "array<string>", "y": "array<double>", "timepoint": "int", "weight": "double"}


@dataclass
class Document:
    """A document of a corpus, taken to the driver."""

    row: Row

    @property
    def words(self) -> list[str | None]:
        return self.row["words"]

    @property
    def spans(self) -> list[tuple[int, int]]:
        return [(s["start"], s["start"] + s["len"]) for s in self.row["spans"]]

    def __getattr__(self, name: str):
        if name.startswith("__") or name not in self.row:
            raise AttributeError(name)
        return self.row[name]

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, place: int | slice):
        return self.words[place]


class CallableTokenizer:
    """Any function of (raw, user data) that gives words: strings, (word, start, length), or None for a
    hole. It runs on the executors, document by document; for a pattern use SimpleTokenizer."""

    def __init__(self, f: Callable) -> None:
        self.f = f

    def lists(self, docs: DataFrame, *, text_col: str = "raw", user_col: str | None = None) -> DataFrame:
        """(doc_id, words, start, len), a list each; start and len are null for words without."""
        f = self.f

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, start, size = [], [], []
                for raw, user in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    got = [(t, None, None) if t is None or isinstance(t, str) else tuple(t) for t in (f(raw, user) if raw is not None else ())]
                    words.append([t[0] for t in got])
                    start.append([t[1] for t in got])
                    size.append([t[2] for t in got])
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(start, ints), pa.array(size, ints)], ["doc_id", "words", "start", "len"])

        user = F.col(user_col).cast("string") if user_col else F.lit(None).cast("string")
        return docs.select("doc_id", text_col, user.alias("_user")).mapInArrow(run, "doc_id long, words array<string>, start array<int>, len array<int>")


class Corpus:
    """Documents in order, as a DataFrame docs(doc_id, uid, raw, words, ...).

    tokenizer is used on raw texts: SimpleTokenizer, or a function of (raw, user data); user data are a
    document's uid. stopwords, a list or predicate, become holes, which n-grams don't span. Documents
    without words are left out. uids are unique and not empty: checked when documents are added.
    """

    def __init__(self, spark: SparkSession, tokenizer: corpus.SimpleTokenizer | Callable | None = None, stopwords: Iterable[str] | Callable[[str], bool] | None = None) -> None:
        tokenizer = tokenizer or corpus.SimpleTokenizer()
        self.spark, self.tokenizer = spark, tokenizer if hasattr(tokenizer, "lists") else CallableTokenizer(tokenizer)
        self.stopwords = stopwords if stopwords is None or callable(stopwords) else set(stopwords)
        self.docs: DataFrame | None = None
        self._placed: DataFrame | None = None

    def add(self, docs: DataFrame) -> Corpus:
        """Add documents that have words (array<string>) or raw (string), in order of doc_id if there
        is one. Other columns are kept."""
        if ("words" in docs.columns) == ("raw" in docs.columns):
            raise ValueError("documents need either words or raw")
        if "doc_id" not in docs.columns:
            docs = corpus.numbered(docs, F.lit(1)).withColumn("doc_id", F.col("rn") - 1).drop("rn")
        if "raw" in docs.columns:
            user = {"user_col": "uid"} if isinstance(self.tokenizer, CallableTokenizer) and "uid" in docs.columns else {}
            made = self.tokenizer.lists(docs, text_col="raw", **user)
            docs = docs.join(made.select("doc_id", "words", F.arrays_zip("start", "len").alias("spans")), "doc_id")
        if self.stopwords is not None:
            docs = docs.withColumn("words", self._holed(F.col("words")))
        docs = docs.where(F.size("words") > 0)
        joined = docs if self.docs is None else corpus.concat_corpora(self.docs, docs)
        if "uid" in joined.columns and corpus.uid_duplicates(joined).limit(1).count():
            raise ValueError("uids must be unique and not empty")
        self.docs, self._placed = joined, None
        return self

    def _holed(self, words):
        """words with null for each stop word."""
        if callable(self.stopwords):
            ask = self.stopwords

            @F.pandas_udf("array<string>")
            def without(lists):
                known: dict[str, bool] = {}  # asked once for each different word of a batch
                for w in {w for x in lists if x is not None for w in x if w is not None}:
                    known[w] = bool(ask(w))
                return lists.map(lambda x: [None if w is None or known[w] else w for w in x] if x is not None else None)

            return without(words)
        return F.transform(words, lambda w: F.when(~w.isin(sorted(self.stopwords)), w)) if self.stopwords else words

    def add_doc(self, words: list[str] | None = None, raw: str | None = None, **values) -> Corpus:
        """Add one document, given as words or raw, with values of VALUES."""
        if (words is None) == (raw is None):
            raise ValueError("documents need either words or raw")
        name, kind, value = ("words", "array<string>", list(words)) if raw is None else ("raw", "string", raw)
        spec = ", ".join([f"doc_id long, {name} {kind}", *(f"{c} {VALUES[c]}" for c in values)])
        return self.add(self.spark.createDataFrame([(0, value, *values.values())], spec))

    def process(self, texts: Iterable[str | tuple], batch: int = 10_000) -> Corpus:
        """Add raw texts from a Python iterable: strings, (raw, uid) or (raw, uid, values), values a
        dict by the names of VALUES. A batch at a time is held and written to the shared folder; a
        corpus that lies somewhere is read with Spark and given to add()."""
        path, n, seen = f"{shared_dir(self.spark)}/texts-{uuid.uuid4().hex}", 0, set()
        spec = ", ".join(["doc_id long, raw string", *(f"{c} {t}" for c, t in VALUES.items())])
        texts = iter(texts)
        while rows := list(itertools.islice(texts, batch)):
            made = []
            for t in rows:
                raw, uid, values = (t, None, {}) if isinstance(t, str) else (*t, None, {})[:2] + ((t[2],) if len(t) > 2 else ({},))
                values = {**({"uid": uid} if uid is not None else {}), **values}
                if unknown := set(values) - set(VALUES):
                    raise ValueError(f"unknown values {sorted(unknown)}")
                seen |= set(values)
                made.append((n, raw, *(values.get(c) for c in VALUES)))
                n += 1
            self.spark.createDataFrame(made, spec).write.mode("append").parquet(path)
        return self.add(self.spark.read.schema(spec).parquet(path).select("doc_id", "raw", *[c for c in VALUES if c in seen or c == "uid"])) if n else self

    def __len__(self) -> int:
        return self.docs.count() if self.docs is not None else 0

    def __getitem__(self, key: int | str | slice | list) -> DataFrame:
        """Documents by place, uid, slice of places, or a list of either."""
        if self.docs is None:
            raise IndexError(key)
        if isinstance(key, str):
            found = self.docs.where(F.col("uid") == key)
            if not found.limit(1).count():
                raise KeyError(key)
            return found
        if self._placed is None:  # numbered once, and again after documents are added
            self._placed = corpus.numbered(self.docs, F.asc("doc_id")).withColumn("_at", F.col("rn") - 1)
        placed = self._placed
        if isinstance(key, slice):
            a, b, step = key.indices(len(self))
            kept = placed.where((F.col("_at") >= a) & (F.col("_at") < b) & (F.pmod(F.col("_at") - a, F.lit(step)) == 0))
        elif isinstance(key, list):
            kept = placed.where(F.col("uid").isin(key) if key and isinstance(key[0], str) else F.col("_at").isin(key))
        else:
            kept = placed.where(F.col("_at") == key + (len(self) if key < 0 else 0))
            if not kept.limit(1).count():
                raise IndexError(key)
        return kept.drop("rn", "_at")

    def document(self, key: int | str) -> Document:
        """One document, by place or uid."""
        return Document(self[key].first())

    def permuted(self, seed: int = 0) -> DataFrame:
        """The documents in a pseudo-random order: docs with at, their place in it."""
        return corpus.numbered(self.docs, F.xxhash64(F.lit(seed), "doc_id"), F.asc("doc_id")).withColumn("at", F.col("rn") - 1).drop("rn")

    def extract_ngrams(self, **options) -> DataFrame:
        """See operators.ngrams.extract_ngrams."""
        return ngrams.extract_ngrams(self.docs.select("doc_id", "words"), **options)

    def concat_ngrams(self, candidates: DataFrame, delimiter: str = "_", *, limit: int = corpus.MAX_PHRASES) -> Corpus:
        """A corpus in which each of the candidates(words) is one word. At most limit phrases, which
        are broadcast."""
        words = ngrams.Phraser(corpus.listed_phrases(candidates, limit), delimiter)(self.docs)
        out = Corpus(self.spark, self.tokenizer, self.stopwords)
        out.docs = self.docs.drop("words", "spans").join(words, "doc_id")
        return out

    @property
    def vocab(self) -> DataFrame:
        """(word, cf, df, first_at)."""
        return corpus.count_words(self.docs)

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: corpus.SimpleTokenizer | None = None) -> Corpus:
        out = cls(spark, tokenizer)
        out.docs = spark.read.parquet(path)
        return out


def wide_topic_words(dist: DataFrame, k: int) -> DataFrame:
    """(word, topic_0, topic_1, ...): dist(z, wid, word, p) with a column for each topic."""
    return dist.groupBy("wid", "word").agg(*[F.max(F.when(F.col("z") == i, F.col("p"))).alias(f"topic_{i}") for i in range(k)]).drop("wid")


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers."""
    df.write.mode("overwrite").option("header", True).csv(path)
