"""Collocations: bigrams, n-grams, scores, branching entropy.

Words come as word_docs(doc_id, words array<string>); a null entry is a hole that nothing spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.corpus import Rows, count_words
from topicloom.sources.tables import written

#: Phrases and valid pairs are broadcast up to so many; beyond, tokens are joined with them.
MAX_LISTED = 500_000


def unigrams(word_docs: DataFrame) -> DataFrame:
    """(word, cf, df)."""
    return count_words(word_docs).select("word", "cf", "df")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, words) -> (w1, w2, cf, df) of neighbours in the batch."""
    for batch in batches:
        rows = Rows(batch.column(1))
        coded = rows.values.dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        pair = np.flatnonzero((rows.row[1:] == rows.row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
        if not len(pair):
            continue
        key = code[pair] * 2**32 + code[pair + 1]
        order = np.argsort(key, kind="stable")  # documents still in order
        key, row = key[order], rows.row[pair][order]
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        in_doc = np.add.reduceat((new | np.r_[True, row[1:] != row[:-1]]).astype(np.int64), first)
        w1, w2 = (coded.dictionary.take(pa.array(k)) for k in (key[first] >> 32, key[first] & (2**32 - 1)))
        yield pa.RecordBatch.from_arrays([w1, w2, pa.array(np.diff(np.r_[first, len(key)])), pa.array(in_doc)], ["w1", "w2", "cf", "df"])


def _pairs(word_docs: DataFrame) -> DataFrame:
    """(doc_id, pos, w1, w2) of neighbours, read off the arrays without a shuffle."""
    n = F.size("words")
    zipped = F.arrays_zip(F.slice("words", 1, n - 1).alias("w1"), F.slice("words", 2, n - 1).alias("w2"))
    p = word_docs.where(n > 1).select("doc_id", F.posexplode(zipped).alias("pos", "p")).select("doc_id", "pos", "p.w1", "p.w2")
    return p.where("w1 is not null and w2 is not null")


def _frequent(words: DataFrame, min_cf: int, min_df: int) -> DataFrame:
    return words.where((F.col("cf") >= min_cf) & (F.col("df") >= min_df))


def bigrams(word_docs: DataFrame, *, min_cf: int = 10, min_df: int = 5, uni: DataFrame | None = None) -> DataFrame:
    """(w1, w2, cf, df) of neighbours of which both words and the pair reach min_cf and min_df. uni:
    unigrams(word_docs), if they are there."""
    ok = _frequent(unigrams(word_docs) if uni is None else uni, min_cf, min_df).select("word")
    partial = word_docs.select("doc_id", "words").mapInArrow(_pair_counts, "w1 string, w2 string, cf long, df long")
    counted = partial.groupBy("w1", "w2").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    kept = _frequent(counted, min_cf, min_df)
    return kept.join(ok.withColumnRenamed("word", "w1"), "w1", "left_semi").join(ok.withColumnRenamed("word", "w2"), "w2", "left_semi").select("w1", "w2", "cf", "df")


def pair_score(c: Column, f1: Column, f2: Column, n: Column, normalized: bool) -> Column:
    pmi = F.log(c * n / f1 / f2)
    return pmi / F.log(n / c) if normalized else pmi


def scored_bigrams(word_docs: DataFrame, *, min_cf: int = 10, min_df: int = 5, min_score: float = float("-inf"), normalized: bool = False) -> DataFrame:
    """(w1, w2, cf, df, score): PMI, or NPMI if normalized; N is the number of words without holes."""
    uni = written(unigrams(word_docs), "unigrams")
    return _scored(uni, bigrams(word_docs, min_cf=min_cf, min_df=min_df, uni=uni), min_score, normalized)


def _scored(uni: DataFrame, b: DataFrame, min_score: float, normalized: bool) -> DataFrame:
    total = uni.agg(F.sum("cf").cast("double").alias("n"))
    f = uni.select("word", "cf")
    j = b.join(f.select(F.col("word").alias("w1"), F.col("cf").alias("f1")), "w1").join(f.select(F.col("word").alias("w2"), F.col("cf").alias("f2")), "w2").crossJoin(F.broadcast(total))
    score = pair_score(F.col("cf"), F.col("f1"), F.col("f2"), F.col("n"), normalized)
    return j.select("w1", "w2", "cf", "df", score.alias("score")).where(F.col("score") >= min_score)


def _pairs_of(valid: DataFrame):
    """A broadcast of the words of the pairs and the pairs as sorted codes."""
    got = valid.toArrow()
    words = pc.unique(pa.chunked_array([*got.column(0).chunks, *got.column(1).chunks], pa.string()))
    a, b = (pc.index_in(got.column(i), value_set=words).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    return valid.sparkSession.sparkContext.broadcast((words, np.sort(a * 2**32 + b)))


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, x)
    return (sorted_[np.minimum(at, len(sorted_) - 1)] == x) if len(sorted_) else np.zeros(len(x), bool)


def _ngram_counts(shared, max_len: int):
    """mapInArrow function: (doc_id, words) -> (words, cf): counts in the batch of the n-grams of 3 to
    max_len words all of whose neighbouring pairs are valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, valid = shared.value
        for batch in batches:
            rows = Rows(batch.column(1))
            code = pc.fill_null(pc.index_in(rows.values, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ok = np.r_[(rows.row[1:] == rows.row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0), False][: len(code)]
            ok[ok] = _among(valid, code[:-1][ok[:-1]] * 2**32 + code[1:][ok[:-1]])
            at = np.flatnonzero(ok)
            for n in range(3, max_len + 1):
                at = at[at + n - 2 < len(ok)]
                at = at[ok[at + n - 2]]  # a run of n - 1 valid pairs
                if not len(at):
                    break
                grams, counts = np.unique(code[at[:, None] + np.arange(n)], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1, dtype=np.int32) * n), words.take(pa.array(grams.ravel()))), pa.array(counts)], ["words", "cf"])

    return run


def ngrams(word_docs: DataFrame, *, min_cf: int = 10, min_df: int = 5, max_len: int = 5, pairs: DataFrame | None = None) -> DataFrame:
    """(words array, cf) of the n-grams of 3 to max_len words in which every neighbouring pair is one
    of bigrams(), n-grams of at least min_cf occurrences. Up to MAX_LISTED valid pairs are broadcast
    and runs of them cut inside the row; more are joined. pairs: bigrams(word_docs), if written."""
    valid = (written(bigrams(word_docs, min_cf=min_cf, min_df=min_df), "valid") if pairs is None else pairs).select("w1", "w2")
    if valid.count() <= MAX_LISTED:
        runs = word_docs.select("doc_id", "words").mapInArrow(_ngram_counts(_pairs_of(valid), max_len), "words array<string>, cf long")
        return runs.groupBy("words").agg(F.sum("cf").alias("cf")).where(F.col("cf") >= min_cf)
    at = _pairs(word_docs).join(valid, ["w1", "w2"])
    doc = Window.partitionBy("doc_id").orderBy("pos")
    run = F.col("pos") - F.row_number().over(doc)  # equal for consecutive pairs
    island = at.withColumn("run", run)
    ahead = Window.partitionBy("doc_id", "run").orderBy("pos").rowsBetween(0, max_len - 2)
    longest = island.select(F.concat(F.array("w1"), F.collect_list("w2").over(ahead)).alias("words"))
    each = longest.where(F.size("words") > 2).select(F.explode(F.transform(F.sequence(F.lit(3), F.size("words")), lambda n: F.slice("words", 1, n))).alias("words"))
    return each.groupBy("words").agg(F.count("*").alias("cf")).where(F.col("cf") >= min_cf)


def extract_ngrams(word_docs: DataFrame, *, min_cf: int = 10, min_df: int = 5, max_len: int = 5, max_cand: int = 5000, min_score: float = float("-inf"), normalized: bool = False) -> DataFrame:
    """(words array, score, cf, df): the max_cand best collocations of 2 to max_len words, by falling
    score, ties by words. df is 0 beyond pairs, where it isn't counted."""
    word_docs = written(word_docs.select("doc_id", "words"), "words")  # read two or three times
    uni = written(unigrams(word_docs), "unigrams")
    pairs = written(bigrams(word_docs, min_cf=min_cf, min_df=min_df, uni=uni), "pairs")
    two = _scored(uni, pairs, min_score, normalized)
    found = two.select(F.array("w1", "w2").alias("words"), "score", "cf", "df")
    if max_len > 2:
        total = uni.agg(F.sum("cf").cast("double").alias("n"))
        long = ngrams(word_docs, min_cf=min_cf, min_df=min_df, max_len=max_len, pairs=pairs)
        parts = long.select("words", "cf", F.explode("words").alias("word")).join(uni.select("word", F.col("cf").alias("f")), "word")
        summed = parts.crossJoin(F.broadcast(total)).groupBy("words", "cf").agg(F.sum(F.log(F.col("n") / F.col("f"))).alias("s"), F.first("n").alias("n"))
        score = F.log("cf") - F.log("n") + F.col("s")
        if normalized:
            score = score / ((F.log("n") - F.log("cf")) * (F.size("words") - 1))
        more = summed.select("words", score.alias("score"), "cf", F.lit(0).cast("long").alias("df")).where(F.col("score") >= min_score)
        found = found.unionByName(more)
    return found.orderBy(F.desc("score"), "words").limit(max_cand)


def pmi_candidates(word_docs: DataFrame, *, min_cf: int = 10, min_df: int = 5, min_len: int = 1, max_len: int = 5, max_cand: int = 5000, normalized: bool = False) -> DataFrame:
    """Label candidates: extract_ngrams with scores from 0 up and, with min_len 1, every frequent
    single word with score 0 beside them."""
    found = extract_ngrams(word_docs, min_cf=min_cf, min_df=min_df, max_len=max_len, max_cand=max_cand, min_score=0.0, normalized=normalized)
    if min_len <= 1:
        one = _frequent(unigrams(word_docs), min_cf, min_df)
        found = found.unionByName(one.select(F.array("word").alias("words"), F.lit(0.0).alias("score"), "cf", "df"))
    return found


def _context_counts(shared):
    """mapInArrow function: (doc_id, words) -> (pair, side, word, c): counts in the batch of the words
    behind (side 0) and before (side 1) each valid pair, null at a border or a hole. pair: its place
    among the sorted codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, valid = shared.value
        for batch in (whole.slice(a, 2000) for whole in batches for a in range(0, whole.num_rows, 2000)):
            rows = Rows(batch.column(1))
            coded = rows.values.dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.r_[pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64), -1][code]
            at = np.flatnonzero((rows.row[1:] == rows.row[:-1]) & (known[1:] >= 0) & (known[:-1] >= 0))
            key = known[at] * 2**32 + known[at + 1]
            hit = _among(valid, key)
            at, pair = at[hit], np.searchsorted(valid, key[hit])
            for side, to in ((0, at + 2), (1, at - 1)):
                inside = (to >= 0) & (to < len(code))
                to = np.where(inside, to, 0)
                word = np.where(inside & (rows.row[to] == rows.row[at]), code[to], -1) + 1
                key, c = np.unique(pair * (len(coded.dictionary) + 1) + word, return_counts=True)
                word = key % (len(coded.dictionary) + 1) - 1
                yield pa.RecordBatch.from_arrays([pa.array(key // (len(coded.dictionary) + 1)), pa.array(np.full(len(key), side, np.int32)), coded.dictionary.take(pa.array(word, mask=word < 0)), pa.array(c)], ["pair", "side", "word", "c"])

    return run


def _pair_words(shared):
    """mapInArrow function: (pair, rbe, lbe) -> (w1, w2, rbe, lbe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, valid = shared.value
        for batch in batches:
            code = valid[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(code >> 32)), words.take(pa.array(code & (2**32 - 1))), *batch.columns[1:]], ["w1", "w2", "rbe", "lbe"])

    return run


def _entropies(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, rbe, lbe) of counts(keys, side, word, c): ln t - sum c ln c / t of each side's counts,
    which is the entropy of their shares without a window over their sum t."""
    each = counts.groupBy(*keys, "side", "word").agg(F.sum("c").alias("c"))

    def of(side: int) -> Column:
        c = F.when(F.col("side") == side, F.col("c").cast("double"))
        t = F.sum(c)
        return F.when(F.max(c) < t, F.log(t) - F.sum(c * F.log(c)) / t).otherwise(0.0)

    return each.groupBy(*keys).agg(of(0).alias("rbe"), of(1).alias("lbe"))


def branching_entropy(word_docs: DataFrame, *, min_cf: int = 10, min_df: int = 5, pairs: DataFrame | None = None) -> DataFrame:
    """(w1, w2, rbe, lbe) of each pair of bigrams(): entropy of the word that follows (rbe) and that
    comes before (lbe). Occurrences at a border or a hole are one more outcome. Up to MAX_LISTED pairs
    are broadcast and their neighbours counted inside the row; more are joined. pairs:
    bigrams(word_docs), if written."""
    if pairs is None:
        word_docs = written(word_docs.select("doc_id", "words"), "words")  # read three times
        pairs = written(bigrams(word_docs, min_cf=min_cf, min_df=min_df, uni=written(unigrams(word_docs), "unigrams")), "pairs")
    valid = pairs.select("w1", "w2")
    if valid.count() <= MAX_LISTED:
        shared = _pairs_of(valid)
        counts = word_docs.select("doc_id", "words").mapInArrow(_context_counts(shared), "pair long, side int, word string, c long")
        return _entropies(counts, "pair").mapInArrow(_pair_words(shared), "w1 string, w2 string, rbe double, lbe double")
    n = F.size("words")
    none = F.array(F.lit(None).cast("string"))
    zipped = F.arrays_zip(F.concat(none, F.slice("words", 1, n - 1)).alias("before"), F.col("words").alias("w1"), F.concat(F.slice("words", 2, n - 1), none).alias("w2"), F.concat(F.slice("words", 3, F.greatest(n - 2, F.lit(0))), none, none).alias("after"))
    at = word_docs.where(n > 1).select(F.explode(zipped).alias("p")).select("p.*").join(valid, ["w1", "w2"])
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(x).alias("word")) for i, x in enumerate(("after", "before"))])
    return _entropies(at.select("w1", "w2", F.explode(sides).alias("x")).select("w1", "w2", "x.*", F.lit(1).alias("c")), "w1", "w2")


def pmi_be(word_docs: DataFrame, *, min_cf: int = 10, min_df: int = 5) -> DataFrame:
    """(w1, w2, score): npmi * sqrt(rbe * lbe) / ln cf."""
    word_docs = written(word_docs.select("doc_id", "words"), "words")  # read three times
    uni = written(unigrams(word_docs), "unigrams")
    pairs = written(bigrams(word_docs, min_cf=min_cf, min_df=min_df, uni=uni), "pairs")
    npmi = _scored(uni, pairs, float("-inf"), normalized=True)
    be = branching_entropy(word_docs, pairs=pairs)
    return npmi.join(be, ["w1", "w2"]).select("w1", "w2", (F.col("score") * F.sqrt(F.greatest(F.col("rbe") * F.col("lbe"), F.lit(0.0))) / F.log("cf")).alias("score"))


class Phrases:
    """A trie of phrases as sorted arrays: every place of a batch is matched at once, word by word."""

    def __init__(self, phrases: list[tuple[str, ...]]) -> None:
        self.phrases = sorted(set(phrases))
        self.words = pa.array(sorted({w for p in self.phrases for w in p}), pa.string())
        code = {w: i for i, w in enumerate(self.words.to_pylist())}
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(self.phrases):
            state = 0
            for w in p:
                state = steps.setdefault((state, code[w]), len(steps) + 1)
            ends[state] = i
        keys = sorted(steps)
        self.key = np.array([a * 2**32 + b for a, b in keys], np.int64)
        self.to = np.array([steps[k] for k in keys], np.int64)
        self.end = np.full(len(steps) + 1, -1)
        self.end[list(ends)] = list(ends.values())
        self.longest = max(map(len, self.phrases), default=0)

    def find(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """(place among all values, phrase) of every occurrence."""
        code = pc.fill_null(pc.index_in(rows.values, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at, state, found = np.flatnonzero(code >= 0), None, []
        for n in range(self.longest):
            if n:
                inside = at + n < len(code)
                at, state = at[inside], state[inside]
                go = (rows.row[at + n] == rows.row[at]) & (code[at + n] >= 0)
                at, state = at[go], state[go]
            key = (0 if state is None else state * 2**32) + code[at + n]
            where = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[where] == key
            at, state = at[hit], self.to[where[hit]]
            whole = self.end[state] >= 0
            found.append((at[whole], self.end[state[whole]]))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def listed(phrases: DataFrame, limit: int = MAX_LISTED) -> list[tuple[str, ...]] | None:
    """All phrases(words), to be broadcast; None if there are more than limit."""
    got = [tuple(r["words"]) for r in phrases.select("words").where(F.size("words") > 0).limit(limit + 1).collect()]
    return got if len(got) <= limit else None


def find_phrases(word_docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, pos, words): every occurrence of the phrases(words array) in the documents. Up to
    MAX_LISTED phrases are broadcast and matched inside the row; more are joined with all n-grams."""
    known = listed(phrases)
    kind = dict(word_docs.dtypes)["doc_id"]
    if known is not None:
        shared = word_docs.sparkSession.sparkContext.broadcast(Phrases(known))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = shared.value
            texts = pa.array([list(p) for p in trie.phrases], pa.list_(pa.string()))
            for batch in batches:
                rows = Rows(batch.column(1))
                at, which = trie.find(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows.row[at])), pa.array(rows.place[at].astype(np.int32)), texts.take(pa.array(which))], ["doc_id", "pos", "words"])

        return word_docs.select("doc_id", "words").mapInArrow(run, f"doc_id {kind}, pos int, words array<string>")
    sizes = sorted(r[0] for r in phrases.select(F.size("words")).distinct().collect())
    n = F.size("words")
    out = None
    for size in sizes:
        starts = word_docs.where(n >= size).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.slice("words", i, size))).alias("pos", "words"))
        found = starts.join(phrases.where(n == size).select("words"), "words").select("doc_id", "pos", "words")
        out = found if out is None else out.unionByName(found)
    return out


class Phraser:
    """Finds listed phrases in documents and merges them into one word each, the longest from left to
    right; can be saved and loaded."""

    def __init__(self, candidates: DataFrame, delimiter: str = "_", *, limit: int = MAX_LISTED) -> None:
        found = candidates if isinstance(candidates, list) else listed(candidates, limit)
        if found is None:
            raise ValueError(f"more than {limit} phrases")
        self.phrases, self.delimiter = sorted({tuple(p) for p in found}), delimiter

    def find_all(self, word_docs: DataFrame) -> DataFrame:
        """(doc_id, pos, words): every occurrence, overlapping ones too."""
        rows = [(list(p),) for p in self.phrases]
        return find_phrases(word_docs, word_docs.sparkSession.createDataFrame(rows, "words array<string>"))

    def __call__(self, word_docs: DataFrame) -> DataFrame:
        """word_docs(doc_id, words) with the phrases merged. Holes break phrases."""
        shared = word_docs.sparkSession.sparkContext.broadcast((Phrases(self.phrases), self.delimiter))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, delimiter = shared.value
            size_of = np.array([len(p) for p in trie.phrases], np.int64)
            name_of = pa.array([delimiter.join(p) for p in trie.phrases], pa.string())
            for batch in batches:
                rows = Rows(batch.column(1))
                n = len(rows.row)
                at, which = trie.find(rows)
                size, best = np.ones(n, np.int64), np.full(n, -1)
                order = np.argsort(size_of[which], kind="stable")  # the longest comes last and stays
                best[at[order]], size[at[order]] = which[order], size_of[which[order]]
                keep, free = np.zeros(n, bool), 0
                for i in np.flatnonzero(best >= 0):  # a merged phrase takes its places
                    if i >= free:
                        keep[i], free = True, i + size[i]
                best[~keep] = -1
                gone = np.zeros(n + 1, np.int64)
                merged = np.flatnonzero(best >= 0)
                gone[merged + 1] += 1
                gone[merged + size[merged]] -= 1
                stay = np.cumsum(gone)[:n] == 0
                index = np.where(best >= 0, n + best, np.arange(n))[stay]
                values = pa.concat_arrays([rows.values.cast(pa.string()), name_of]).take(pa.array(index))
                ends = np.r_[0, np.cumsum(np.bincount(rows.row[stay], minlength=len(rows.size)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "words"])

        kind = dict(word_docs.dtypes)["doc_id"]
        return word_docs.select("doc_id", "words").mapInArrow(run, f"doc_id {kind}, words array<string>")

    def save(self, path: str, spark) -> None:
        spark.createDataFrame([(list(p), self.delimiter) for p in self.phrases], "words array<string>, delimiter string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Phraser:
        rows = spark.read.parquet(path).collect()
        return cls([tuple(r["words"]) for r in rows], rows[0]["delimiter"] if rows else "_")
