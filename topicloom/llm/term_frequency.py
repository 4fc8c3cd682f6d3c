"""Occurrences and records of every distinct term, with last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm._common import one_delivery, words_of, written

#: A task hands its counters on when it holds so many terms; they are summed by term later.
HELD_TERMS = 400_000


class LastSeen:
    """Counters by term. A term keeps its occurrences, its records and the number of the record it
    was last seen in, so that no set of records or of a record's terms is ever held. Records must
    arrive one after the other."""

    def __init__(self) -> None:
        self.record = 0
        self.filled = 0
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)

    def add(self, lists: pa.ListArray) -> None:
        """Count a batch of whole records."""
        words, code, row, n = words_of(lists)
        here, own = words.to_pylist(), self.code
        to_own = np.fromiter((own.setdefault(w, len(own)) for w in here), np.int64, len(here))
        while len(self.last) < len(own):
            self.occurrences = np.concatenate([self.occurrences, np.zeros_like(self.occurrences)])
            self.records = np.concatenate([self.records, np.zeros_like(self.records)])
            self.last = np.concatenate([self.last, np.full(len(self.last), -1)])
        term, record = to_own[code], self.record + row
        self.record += n
        self.filled += len(np.unique(row))
        if not len(term):
            return
        order = np.argsort(term, kind="stable")  # by term, records still in order
        term, record = term[order], record[order]
        first = np.r_[True, term[1:] != term[:-1]]
        before = np.where(first, self.last[term], np.r_[-1, record[:-1]])
        n = len(own)
        self.occurrences[:n] += np.bincount(term, minlength=n)
        self.records[:n] += np.bincount(term[record != before], minlength=n)
        ends = np.r_[first[1:], True]
        self.last[term[ends]] = record[ends]

    def rows(self, with_total: bool) -> pa.RecordBatch:
        """The counters; the row without a term has the number of records with any term."""
        n = len(self.code)
        term, occ, rec = list(self.code), self.occurrences[:n], self.records[:n]
        if with_total:
            term, occ, rec = [*term, None], np.r_[occ, 0], np.r_[rec, self.filled]
        return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(occ), pa.array(rec)], ["word", "n_occurrences", "n_docs"])


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = LastSeen()
    for batch in batches:
        seen.add(batch.column(0))
        if len(seen.code) > HELD_TERMS:  # between records, so none is counted twice
            yield seen.rows(False)
            seen.clear()
    yield seen.rows(True)


def term_frequency(docs: DataFrame, *, id_col: str = "doc_id", words_col: str = "words", order_col: str | None = "added_at", min_docs: int = 3, max_share: float = 0.2) -> DataFrame:
    """(word, n_occurrences, n_docs, mark) of every distinct word of docs; mark is 'rare' (fewer
    than min_docs documents), 'common' (more than max_share of the documents with any word) or null.

    Words are compared in lower case without surrounding blanks and tabs; null and blank entries are
    no words. A document delivered again counts once (its earliest delivery). Rows without id, null
    and empty lists count for nothing; an empty table gives no rows. Other columns of docs are not
    read, whatever their names.

    Records are read whole, one after the other, by last-seen counters in the task that reads them; the
    counters are hash-partitioned by term and summed. What is shuffled is one row per term and task,
    so a term of every record is no hot key.
    """
    records = one_delivery(docs, id_col, F.col(words_col), order_col)
    partial = records.select("payload").mapInArrow(_counters, "word string, n_occurrences long, n_docs long")
    counts = written(partial.groupBy("word").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_docs").alias("n_docs")), "terms")
    total = counts.where("word is null").first()
    n = total["n_docs"] if total else 0
    mark = F.when(F.col("n_docs") < min_docs, "rare").when(F.col("n_docs") > F.lit(max_share) * n, "common")
    return counts.where("word is not null").withColumn("mark", mark)
