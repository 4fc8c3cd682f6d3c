"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.packed import batches_of, parted, parts_for
from topicloom.operators.corpus import Rows
from topicloom.sources.tables import spread, table, written

__all__ = ["batches_of", "one_delivery", "parted", "parts_for", "small", "spread", "table", "word_sets", "words_of", "written"]

#: Ids that come more than once are broadcast up to so many (8 bytes each); beyond, all rows are
#: grouped by id.
REPEATED = 1_000_000


def small(df: DataFrame, limit: int = REPEATED) -> DataFrame:
    """A written table of few columns, broadcast if it has at most limit rows, else left to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def words_of(lists: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, int]:
    """(dictionary in order, codes, row of each, number of rows): the words of lists, in lower case
    without surrounding blanks and tabs; null and empty ones are no words. Only different spellings
    are looked at one by one."""
    rows = Rows(lists)
    coded = rows.values.dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    plain = [w.strip(" \t").lower() if w is not None else "" for w in coded.dictionary.to_pylist()]
    words = sorted(set(plain) - {""})
    place = {w: i for i, w in enumerate(words)}
    to = np.array([*(place.get(w, -1) for w in plain), -1], np.int64)
    code = to[code]
    kept = code >= 0
    return pa.array(words, pa.string()), code[kept], rows.row[kept], len(rows.size)


def word_sets(rows: DataFrame, least: int = 1) -> DataFrame:
    """(id, words): the different words of each row of (id, list), in order; rows with fewer than least
    of them are left out."""
    kind, name = rows.dtypes[0][1], rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, code, row, n = words_of(batch.column(1))
            v = max(len(words), 1)
            both = np.unique(row * v + code)
            size = np.bincount(both // v, minlength=n)
            some = np.flatnonzero(size >= max(least, 1))
            both = both[(size >= max(least, 1))[both // v]]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[some])].astype(np.int32)), words.take(pa.array(both % v)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists], [name, "words"])

    return rows.mapInArrow(run, f"`{name}` {kind}, words array<string>")


def one_delivery(docs: DataFrame, id_col: str, payload: Column, order_col: str | None, *, repeated: int = REPEATED) -> DataFrame:
    """(id_col, payload): one row per id, the earliest by order_col (ties: the smaller payload).

    Rows without id take no part. Only ids are counted over the whole table; rows whose id comes once
    stay where they are, whole and unshuffled, and those of repeated ids are grouped, equal ids merged
    on the map side first, so an id that holds a third of all rows moves one row per map task.
    """
    order = F.col(order_col) if order_col else F.lit(0)
    named = docs.where(F.col(id_col).isNotNull())
    again = written(named.groupBy(id_col).agg(F.count("*").alias("_times")).where("_times > 1").select(id_col), "again")
    n = again.count()
    named = spread(docs).where(F.col(id_col).isNotNull())

    def first(rows: DataFrame) -> DataFrame:
        each = rows.select(F.col(id_col), F.struct(order.alias("o"), payload.alias("p")).alias("_s"))
        return each.groupBy(id_col).agg(F.min("_s").alias("_s")).select(id_col, F.col("_s.p").alias("payload"))

    if n > repeated:
        return first(named)
    plain = lambda rows: rows.select(F.col(id_col), payload.alias("payload"))
    if not n:
        return plain(named)
    few = F.broadcast(again)
    return plain(named.join(few, id_col, "left_anti")).unionByName(first(named.join(few, id_col, "left_semi")))
