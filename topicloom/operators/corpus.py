"""From documents to tokens, vocabulary, encoded tokens and weights.

Tables: docs(doc_id bigint, text string, ...), word_docs(doc_id, words array<string>, ...),
tokens(doc_id, pos, word) and vocab(word, cf, df, first_at, used, removed, wid). A null word is a
hole: a stop word whose place is kept. What concerns one document is done inside its row, on whole
Arrow batches, so that only sums by word are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import TOKEN_PATTERN, token_list
from topicloom.sources.tables import written

#: Positions within a document are below this.
POSITIONS = 1 << 24
#: Phrases are broadcast: at most this many.
MAX_PHRASES = 100_000
#: Used words are broadcast to encode lists inside the row up to this many; beyond, tokens are joined with them.
MAX_USED = 1_000_000


def numbered(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """df with a 1-based global row number in the given order, without a single-task sort: ranges are
    sorted in parallel and written; only their sizes reach the driver."""
    at = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    at = written(at, "ordered")
    sizes = {r["p"]: r["n"] for r in at.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.lit(starts).cast("array<bigint>"), (F.shiftright("_at", 33) + 1).cast("int"))
    return at.withColumn(name, start + F.col("_at").bitwiseAND(2**33 - 1) + 1).drop("_at")


def tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN_PATTERN, lowercase: bool = True) -> DataFrame:
    """(doc_id, pos, word). Null and empty texts have no tokens."""
    words = token_list(F.col(text_col), pattern=pattern, lowercase=lowercase)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words).alias("pos", "word"))


def word_tokens(docs: DataFrame, *, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """(doc_id, pos, word) of documents given as lists of words; null entries are holes."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words_col).alias("pos", "word"))


class Rows:
    """A batch of lists as flat values: of each value its row and its place in the row."""

    def __init__(self, lists: pa.ListArray) -> None:
        self.values = lists.flatten()
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.row)) - self.start[self.row]

    def running(self, values: np.ndarray) -> np.ndarray:
        """Sums of the values of a row up to each place."""
        c = np.cumsum(values)
        return c - np.r_[0, c][self.start[self.row]]

    def lists(self, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.size)].astype(np.int32)), values)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, words, len, gap, ...) -> (doc_id, words, start, len, ...)."""
    for batch in batches:
        length, gap = Rows(batch.column(2)), Rows(batch.column(3))
        n = length.values.to_numpy(zero_copy_only=False).astype(np.int64)
        ahead = gap.values.to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), length.lists(pa.array((length.running(ahead + n) - n).astype(np.int32))), batch.column(2), *batch.columns[4:]], ["doc_id", "words", "start", "len", *batch.schema.names[4:]])


def span_lists(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN_PATTERN, lowercase: bool = True, keep: str | None = None) -> DataFrame:
    """(doc_id, words, start, len), a list each, and the string column keep: the tokens of each text that isn't null and their
    places in characters. Gaps and tokens alternate, so a token starts behind the gaps up to it and
    the tokens before it: one pass over the row, no shuffle."""
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    words = F.transform(found, F.lower) if lowercase else found
    pieces = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), words.alias("words"), F.transform(found, F.length).alias("len"), gaps.alias("gap"), *([keep] if keep else []))
    kind = dict(docs.dtypes)[id_col]
    return pieces.mapInArrow(_starts, f"doc_id {kind}, words array<string>, start array<int>, len array<int>" + (f", `{keep}` string" if keep else ""))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(doc_id, pos, start, len) of the tokens, in characters."""
    made = span_lists(docs, id_col=id_col, text_col=text_col, pattern=pattern)
    return made.select("doc_id", F.posexplode(F.arrays_zip("start", "len")).alias("pos", "p")).select("doc_id", "pos", "p.start", "p.len")


class SimpleTokenizer:
    """Pattern, lower case, stemmer, and merging of listed phrases.

    A stemmer (a Python callable) runs once for each different word, not for each token. ngram_list
    gives phrases; where one occurs with nothing but white space between its words, they become one
    token joined by ngram_delimiter, the longest phrase first, from left to right.
    """

    def __init__(self, stemmer: Callable[[str], str] | None = None, pattern: str | None = None, lowercase: bool = True, ngram_list: list[str] | None = None, ngram_delimiter: str = "_") -> None:
        if stemmer is not None and not callable(stemmer):
            raise ValueError("stemmer must be callable")
        self.stemmer, self.pattern, self.lowercase, self.delimiter = stemmer, pattern or TOKEN_PATTERN, lowercase, ngram_delimiter
        self.phrases = [p for p in (self._words(x) for x in ngram_list or []) if len(p) > 1]

    def _words(self, phrase: str) -> tuple[str, ...]:
        import regex

        found = regex.findall(self.pattern, phrase.lower() if self.lowercase else phrase)
        return tuple(self.stemmer(w) if self.stemmer else w for w in found)

    def lists(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, words, start, len), a list each. Without stemmer and phrases inside the row."""
        if not self.stemmer and not self.phrases:
            return span_lists(docs, id_col=id_col, text_col=text_col, pattern=self.pattern, lowercase=self.lowercase)
        made = self.tokens(docs, id_col=id_col, text_col=text_col)
        packed = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "start", "len"))).alias("t"))
        return packed.select("doc_id", F.transform("t", lambda x: x["word"]).alias("words"), F.transform("t", lambda x: x["start"]).alias("start"), F.transform("t", lambda x: x["len"]).alias("len"))

    def tokens(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, pos, word, start, len)."""
        made = span_lists(docs, id_col=id_col, text_col=text_col, pattern=self.pattern, lowercase=self.lowercase)
        zipped = F.arrays_zip(F.col("words").alias("word"), "start", "len")
        out = made.select("doc_id", F.posexplode(zipped).alias("pos", "t")).select("doc_id", "pos", "t.word", "t.start", "t.len")
        if self.stemmer:
            out = apply_to_words(out, self.stemmer)
        if self.phrases:
            texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw"))
            out = merge_phrases(out, self.phrases, self.delimiter, texts)
        return out


def apply_to_words(tokens_: DataFrame, f: Callable[[str], str]) -> DataFrame:
    """tokens with f(word) for word; f is called for each different word."""
    @F.pandas_udf("string")
    def mapped(words: pd.Series) -> pd.Series:
        return words.map(f)

    table = tokens_.where("word is not null").select("word").distinct().withColumn("_to", mapped("word"))
    return tokens_.join(table, "word", "left").withColumn("word", F.col("_to")).drop("_to").select(*tokens_.columns)


def listed_phrases(candidates: DataFrame, limit: int = MAX_PHRASES) -> list[tuple[str, ...]]:
    """All phrases of candidates(words); more than limit, which merge_phrases would broadcast, are an error."""
    phrases = [tuple(r["words"]) for r in candidates.select("words").limit(limit + 1).collect()]
    if len(phrases) > limit:
        raise ValueError(f"more than {limit} phrases")
    return phrases


def merge_phrases(tokens_: DataFrame, phrases: Iterable[tuple[str, ...]], delimiter: str = "_", texts: DataFrame | None = None) -> DataFrame:
    """tokens with the words of each listed phrase merged into one token at the place of the first:
    from left to right, the longest phrase first. Holes break phrases. With texts (doc_id, _raw) and
    token spans, only phrases with nothing but white space between their words are merged.

    pos is renumbered; start and len, if there, become those of the merged span.
    """
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for p in sorted(set(phrases), key=lambda p: (-len(p), p)):
        by_first.setdefault(p[0], []).append(p)
    has_spans = "start" in tokens_.columns
    fields = ["pos", "word", *(["start", "len"] if has_spans else [])]
    docs = tokens_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t"))
    docs = docs.join(texts, "doc_id") if texts is not None else docs.withColumn("_raw", F.lit(None).cast("string"))
    shared = tokens_.sparkSession.sparkContext.broadcast(by_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (whole.slice(a, 200) for whole in batches for a in range(0, whole.num_rows, 200)):  # bounds what is held as objects
            out: dict[str, list] = {"doc_id": [], **{f: [] for f in fields}}
            for doc, ts, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                i = n = 0
                while i < len(ts):
                    size = 1
                    for p in known.get(ts[i]["word"], ()):
                        if tuple(t["word"] for t in ts[i : i + len(p)]) == p and (raw is None or all(raw[a["start"] + a["len"] : b["start"]].isspace() for a, b in zip(ts[i : i + len(p) - 1], ts[i + 1 : i + len(p)]))):
                            size = len(p)
                            break
                    out["doc_id"].append(doc)
                    out["pos"].append(n)
                    out["word"].append(delimiter.join(t["word"] for t in ts[i : i + size]) if size > 1 else ts[i]["word"])
                    if has_spans:
                        last = ts[i + size - 1]
                        out["start"].append(ts[i]["start"])
                        out["len"].append(last["start"] + last["len"] - ts[i]["start"])
                    i, n = i + size, n + 1
            kinds = {"doc_id": batch.schema.field(0).type, "word": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds.get(c, pa.int32())) for c in out], list(out))

    kind = dict(tokens_.dtypes)["doc_id"]
    spec = "".join(f", {f} {'string' if f == 'word' else 'int'}" for f in fields)
    return docs.select("doc_id", "t", "_raw").mapInArrow(run, f"doc_id {kind}{spec}")


def without_stopwords(tokens_: DataFrame, stop: DataFrame | Iterable[str] | Callable[[str], bool], *, keep_places: bool = False) -> DataFrame:
    """tokens without stop words; keep_places leaves a hole (null word) for each instead. stop: a
    table with column word, words, or a predicate, which is asked once for each different word."""
    spark = tokens_.sparkSession
    if isinstance(stop, DataFrame):
        table = stop.select("word").distinct()
    elif callable(stop):
        asked = F.pandas_udf(lambda w: w.map(stop).astype(bool), "boolean")
        table = tokens_.where("word is not null").select("word").distinct().where(asked("word"))
    else:
        table = spark.createDataFrame([(w,) for w in sorted(set(stop))], "word string")
    if not keep_places:
        return tokens_.join(table, "word", "left_anti").select(*tokens_.columns)
    marked = tokens_.join(table.withColumn("_stop", F.lit(True)), "word", "left")
    return marked.withColumn("word", F.when(F.col("_stop").isNull(), F.col("word"))).select(*tokens_.columns)


def cf_df(tokens_: DataFrame) -> DataFrame:
    """(word, cf, df, first_at): occurrences, documents, and the place of the first occurrence, of
    tokens that stand in rows of their own. Documents given as lists are counted by count_words."""
    at = (F.col("doc_id") * POSITIONS + F.col("pos")).alias("at")
    per_doc = tokens_.where("word is not null").select("doc_id", "word", at).groupBy("doc_id", "word").agg(F.count("*").alias("c"), F.min("at").alias("at"))
    return per_doc.groupBy("word").agg(F.sum("c").alias("cf"), F.count("*").alias("df"), F.min("at").alias("first_at"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, words) -> (word, cf, df, first_at) of the batch."""
    for batch in batches:
        rows = Rows(batch.column(1))
        coded = rows.values.dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(code, kind="stable")
        order = order[code[order] >= 0]  # by word, documents and places still in order
        if not len(order):
            continue
        c, row = code[order], rows.row[order]
        new = np.r_[True, c[1:] != c[:-1]]
        first = np.flatnonzero(new)
        at = batch.column(0).to_numpy(zero_copy_only=False)[row] * POSITIONS + rows.place[order]
        in_doc = np.add.reduceat((new | np.r_[True, row[1:] != row[:-1]]).astype(np.int64), first)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(c[first])), pa.array(np.diff(np.r_[first, len(c)])), pa.array(in_doc), pa.array(np.minimum.reduceat(at, first))], ["word", "cf", "df", "first_at"])


def count_words(word_docs: DataFrame) -> DataFrame:
    """(word, cf, df, first_at) of documents given as lists, one row each: counted within each batch
    of documents, then summed by word, which is the only shuffle."""
    partial = word_docs.select("doc_id", "words").mapInArrow(_word_counts, "word string, cf long, df long, first_at long")
    return partial.groupBy("word").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.min("first_at").alias("first_at"))


def vocabulary(source: DataFrame, *, min_cf: int = 0, min_df: int = 0, rm_top: int = 0) -> DataFrame:
    """(word, cf, df, first_at, used, removed, wid) of tokens(doc_id, pos, word) or of
    word_docs(doc_id, words). Words that pass min_cf and min_df come first, by falling cf and df, ties
    in order of first occurrence; the first rm_top words of all are removed. Used words have wid 0, 1,
    ... in that order; all other words have no wid."""
    passes = (F.col("cf") >= min_cf) & (F.col("df") >= min_df)
    counted = (count_words if "words" in source.columns else cf_df)(source).withColumn("_pass", passes)
    n = numbered(counted, F.desc("_pass"), F.desc("cf"), F.desc("df"), F.asc("first_at"))
    used = F.col("_pass") & (F.col("rn") > rm_top)
    return n.select("word", "cf", "df", "first_at", used.alias("used"), (F.col("rn") <= rm_top).alias("removed"), F.when(used, F.col("rn") - rm_top - 1).cast("int").alias("wid"))


def encode(tokens_: DataFrame, vocab: DataFrame) -> DataFrame:
    """tokens of used words with their wid; others are dropped (also out-of-vocabulary words, so the
    same call encodes new documents with a frozen vocabulary)."""
    return tokens_.join(vocab.where("used").select("word", "wid"), "word").select(*tokens_.columns, "wid")


def _encoded(shared):
    """mapInArrow function: (doc_id, words) -> (doc_id, pos, wid) of the used words, lists both; documents
    without any are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch.column(1))
            coded = rows.values.dictionary_encode()
            wid = np.r_[pc.fill_null(pc.index_in(coded.dictionary, value_set=shared.value), -1).to_numpy(zero_copy_only=False), -1]
            wid = wid[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)].astype(np.int32)
            known = wid >= 0
            size = np.bincount(rows.row[known], minlength=batch.num_rows)
            ends = pa.array(np.r_[0, np.cumsum(size[size > 0])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[known].astype(np.int32))) for x in (rows.place, wid)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(size > 0)), *lists], ["doc_id", "pos", "wid"])

    return run


def encode_lists(word_docs: DataFrame, vocab: DataFrame, *, limit: int = MAX_USED) -> DataFrame:
    """(doc_id, pos, wid), lists both, of word_docs(doc_id, words): encode of documents given as lists,
    inside the row with the broadcast vocabulary. More than limit used words are joined instead."""
    used = vocab.where("used").select("wid", "word")
    kind = dict(word_docs.dtypes)["doc_id"]
    if used.count() > limit:
        per_doc = encode(word_tokens(word_docs), vocab).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "wid"))).alias("t"))
        return per_doc.select("doc_id", F.col("t.pos").alias("pos"), F.col("t.wid").alias("wid"))
    words = used.toArrow().sort_by("wid").column("word").combine_chunks().cast(pa.string())
    shared = word_docs.sparkSession.sparkContext.broadcast(words)
    return word_docs.select("doc_id", "words").mapInArrow(_encoded(shared), f"doc_id {kind}, pos array<int>, wid array<int>")


def remap(own: DataFrame, other: DataFrame) -> DataFrame:
    """(wid, word, other_wid): the ids of own's words in another vocabulary; -1 if missing there."""
    to = other.where("used").select("word", F.col("wid").alias("other_wid"))
    return own.where("used").select("wid", "word").join(to, "word", "left").select("wid", "word", F.coalesce("other_wid", F.lit(-1)).alias("other_wid"))


def with_idf(encoded: DataFrame) -> DataFrame:
    """encoded with w = ln(D / df), D and df over documents with any used word."""
    per = encoded.select("doc_id", "wid").distinct()
    df = per.groupBy("wid").agg(F.count("*").alias("_df"))
    total = per.agg(F.countDistinct("doc_id").alias("_d"))
    return encoded.join(df, "wid").crossJoin(F.broadcast(total)).withColumn("w", F.log(F.col("_d") / F.col("_df"))).select(*encoded.columns, "w")


def with_pmi(encoded: DataFrame, vocab: DataFrame, tokens_: DataFrame) -> DataFrame:
    """encoded with w = max(ln(tf / (cf / sum of all cf) / document length), 0). The sum is over all
    words, and the length counts excluded words too."""
    total = vocab.agg(F.sum("cf").alias("_all"))
    length = tokens_.groupBy("doc_id").agg(F.count("*").alias("_len"))
    tf = encoded.groupBy("doc_id", "wid").agg(F.count("*").alias("_tf"))
    cf = vocab.where("used").select("wid", "cf")
    weight = F.greatest(F.log(F.col("_tf") / (F.col("cf") / F.col("_all")) / F.col("_len")), F.lit(0.0))
    table = tf.join(cf, "wid").join(length, "doc_id").crossJoin(F.broadcast(total)).select("doc_id", "wid", weight.alias("w"))
    return encoded.join(table, ["doc_id", "wid"]).select(*encoded.columns, "w")


def weighted(encoded: DataFrame, how: str, vocab: DataFrame, tokens_: DataFrame) -> DataFrame:
    if how == "one":
        return encoded.withColumn("w", F.lit(1.0))
    if how == "idf":
        return with_idf(encoded)
    if how == "pmi":
        return with_pmi(encoded, vocab, tokens_)
    raise ValueError(f"unknown term weight {how!r}")


def count_vectors(weighted_: DataFrame) -> DataFrame:
    """(doc_id, wid, n): summed weights, sparse."""
    return weighted_.groupBy("doc_id", "wid").agg(F.sum("w").alias("n"))


def doc_top_words(tokens_: DataFrame, top_n: int = 10) -> DataFrame:
    """(doc_id, rank_no, word, share): share of all the document's tokens; ties by word."""
    tf = tokens_.where("word is not null").groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    per = Window.partitionBy("doc_id")
    ranked = tf.withColumn("share", F.col("c") / F.sum("c").over(per)).withColumn("rank_no", F.row_number().over(per.orderBy(F.desc("c"), "word")))
    return ranked.where(F.col("rank_no") <= top_n).select("doc_id", "rank_no", "word", "share")


def entropy(weights: DataFrame, col: str) -> DataFrame:
    """(entropy): -sum p ln(p + 1e-20) of the shares of col."""
    total = weights.agg(F.sum(col).alias("_t"))
    p = F.col(col) / F.col("_t")
    return weights.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log(p + 1e-20))).alias("entropy"))


def uid_duplicates(docs: DataFrame, uid_col: str = "uid") -> DataFrame:
    """(uid, n): uids that are empty or given to more than one document; null uids are none."""
    return docs.where(F.col(uid_col).isNotNull()).groupBy(F.col(uid_col).alias("uid")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("uid") == ""))


def concat_corpora(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both corpora; the documents of the second are numbered on behind the first's largest id."""
    most = first.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("_m"))
    moved = second.crossJoin(F.broadcast(most)).withColumn("doc_id", F.col("doc_id") + F.col("_m") + 1).select(*second.columns)
    return first.unionByName(moved, allowMissingColumns=True)


def _sentence_numbers(delimiter: str):
    """mapInArrow function: (doc_id, words) -> (doc_id, words, sent), sent a list like words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch.column(1))
            ends = pc.fill_null(pc.equal(rows.values, delimiter), False).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows.lists(rows.values), rows.lists(pa.array(rows.running(ends).astype(np.int32)))], ["doc_id", "words", "sent"])

    return run


def split_sentences(word_docs: DataFrame, delimiter: str) -> DataFrame:
    """(doc_id, pos, word, sent) of word_docs(doc_id, words): sent is the number of delimiter tokens
    before; delimiters and holes are dropped. Counted inside the row."""
    kind = dict(word_docs.dtypes)["doc_id"]
    made = word_docs.select("doc_id", "words").mapInArrow(_sentence_numbers(delimiter), f"doc_id {kind}, words array<string>, sent array<int>")
    each = made.select("doc_id", F.posexplode(F.arrays_zip(F.col("words").alias("word"), "sent")).alias("pos", "t"))
    return each.select("doc_id", "pos", "t.word", "t.sent").where(F.col("word") != delimiter)


def word_forms(docs: DataFrame, vocab: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word, form, n): how often each used word stands in which spelling in the raw texts."""
    raw = tokens(docs, text_col=text_col, lowercase=False).select(F.col("word").alias("form"), F.lower("word").alias("word"))
    counted = raw.groupBy("word", "form").agg(F.count("*").alias("n"))
    return counted.join(vocab.where("used").select("word"), "word", "left_semi").select("word", "form", "n")


def word_documents(tokens_: DataFrame) -> DataFrame:
    """(doc_id, words): each document's words in text order."""
    return tokens_.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
