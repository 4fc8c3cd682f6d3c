"""The most similar vectors of every vector, through a permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm._common import one_delivery, small, written

#: A vector is represented by its so many nearest pivots in order, and posted in the files of the
#: first POSTED of them.
PREFIX, POSTED = 8, 3
#: In a file of more than BLOCK postings, each goes on to the files of that pivot with the nearest
#: SPLIT of the others.
BLOCK, SPLIT = 4096, 4
#: At most so many pivots; 2 * sqrt(vectors) below.
MAX_PIVOTS = 65_535
#: Candidates with the least footrule distance that are reranked, for each vector and file; more if
#: they tie.
RERANKED = 32
#: Postings hold half-precision vectors: cosines there are this exact.
HALF = 0.004


def valid_vector(v: Column, dims: int) -> Column:
    """dims finite numbers that are not all zero."""
    return v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _directions(v: pa.ListArray, dims: int) -> np.ndarray:
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[n, PREFIX]: pivots by falling cosine, equal ones by number."""
    m = min(PREFIX, len(pivots))
    out = np.zeros((len(x), m), np.uint16)
    step = max(1, 2_000_000 // len(pivots))  # bounds what is held at a time
    for a in range(0, len(x), step):
        s = x[a : a + step] @ pivots.T
        part = np.sort(np.argpartition(-s, m - 1, axis=1)[:, :m], axis=1) if m < len(pivots) else np.broadcast_to(np.arange(m), (len(s), m))
        out[a : a + step] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)
    return out


def footrule(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """[queries, data]: footrule distance of the permutation prefixes, up to a term of each query
    alone. A pivot outside a prefix stands behind its end."""
    m = queries.shape[1]
    known, flat = np.unique(np.concatenate([data.ravel(), queries.ravel()]), return_inverse=True)
    place = np.full((len(known), len(data)), m, np.uint8)  # of each pivot in each data prefix
    place[flat[: data.size], np.repeat(np.arange(len(data)), m)] = np.tile(np.arange(m, dtype=np.uint8), len(data))
    out = np.zeros((len(queries), len(data)), np.uint8)
    own = flat[data.size :].reshape(queries.shape)
    for j in range(m):  # |place - j| for the query's pivots; those of data alone enter as -(m - place)
        p = place[own[:, j]]
        out += np.abs(p.astype(np.int8) - np.int8(j)).astype(np.uint8) + p
    return out


def _rows(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, first = np.unique(table.column("id").combine_chunks().to_numpy(zero_copy_only=False), return_index=True)
    table = table.take(pa.array(first))
    half = np.frombuffer(b"".join(table.column("half").to_pylist()), np.float16).reshape(len(ids), dims).astype(np.float32)
    prefix = np.frombuffer(b"".join(table.column("prefix").to_pylist()), np.uint16).reshape(len(ids), -1)
    return ids, half, prefix, table.column("part").to_numpy()


def _best(dims: int, k: int, least: float):
    """applyInArrow function over one pair of blocks of a pivot's file."""

    def search(q, d, same: bool) -> tuple[np.ndarray, np.ndarray]:
        ids_q, x_q, p_q = q
        ids_d, x_d, p_d = d
        got_q, got_d = [], []
        for a in range(0, len(ids_q), 256):
            x = x_q[a : a + 256]
            far = footrule(p_q[a : a + 256], p_d).astype(np.int16)
            if same:
                far[np.arange(len(x)), a + np.arange(len(x))] = 1000  # itself
            c = min(RERANKED, len(ids_d))
            near = far <= np.partition(far, c - 1, axis=1)[:, c - 1 : c]  # with all that tie with the last
            cos = np.where(near & (far < 1000), x @ x_d.T, -2)
            bar = np.partition(cos, len(ids_d) - k, axis=1)[:, len(ids_d) - k] if len(ids_d) > k else np.full(len(x), -2.0)
            i, j = np.nonzero((cos > -2) & (cos >= np.maximum(bar - 2 * HALF, least - HALF)[:, None]))
            got_q.append(ids_q[a + i])
            got_d.append(ids_d[j])
        return np.concatenate(got_q), np.concatenate(got_d)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, x, prefix, part = _rows(table, dims)
        if key[1].as_py() == key[2].as_py():
            all_ = (ids, x, prefix)
            found = [search(all_, all_, True)]
        else:
            one, two = ((ids[part == p.as_py()], x[part == p.as_py()], prefix[part == p.as_py()]) for p in key[1:3])
            found = [search(one, two, False), search(two, one, False)] if len(one[0]) and len(two[0]) else []
        a = np.concatenate([f[0] for f in found]) if found else ids[:0]
        b = np.concatenate([f[1] for f in found]) if found else ids[:0]
        return pa.table({"a": a, "b": b})

    return run


def _sizes(postings: DataFrame, label: str) -> DataFrame:
    """(cell, blocks) of the files of more than a block: at most postings / BLOCK of them."""
    large = postings.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    return written(large.select("cell", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), label)


def _postings(indexed: DataFrame) -> DataFrame:
    """(id, half, prefix, cell, blocks) of each posting. The file of a pivot with more than a block is
    split by the second pivot; of a file that is still larger, blocks says in how many blocks it is
    searched. A vector may come twice to the file of two pivots that are both split."""
    posted = indexed.select("id", "half", "prefix", "pivots", F.explode(F.slice("pivots", 1, POSTED)).alias("cell")).withColumn("cell", F.col("cell").cast("long"))
    large = _sizes(posted, "files")
    if not large.limit(1).count():
        return posted.select("id", "half", "prefix", "cell", F.lit(1).alias("blocks"))
    other = F.slice(F.filter("pivots", lambda p: p != F.col("cell")), 1, SPLIT)
    both = F.transform(other, lambda p: (F.least(p, F.col("cell")) + 1) * (1 << 20) + F.greatest(p, F.col("cell")))
    marked = posted.join(small(large.select("cell", F.lit(True).alias("hot"))), "cell", "left")
    split = marked.select("id", "half", "prefix", F.explode(F.when(F.col("hot"), both).otherwise(F.array("cell"))).alias("cell"))
    still = _sizes(split.where(F.col("cell") >= 1 << 20), "still")
    return split.join(small(still), "cell", "left").select("id", "half", "prefix", "cell", F.coalesce("blocks", F.lit(1)).alias("blocks"))


def neighbours(rows: DataFrame, *, dims: int, k: int = 5, least: float = -1.0, id_col: str = "doc_id", vector_col: str = "topic_dist", order_col: str | None = "inferred_at", max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(id_a, id_b, rank_no, cosine): the k vectors most similar to each, those with a cosine of at
    least `least`; equal cosines by rising id. A vector is no neighbour of itself.

    Only vectors of dims finite numbers that are not all zero take part; lengths don't matter. An id
    that comes more than once counts once (its earliest vector). Null ids don't count. An empty
    table gives no rows. Ids are integers. Other columns are not read, whatever their names.

    Permutation index: 2 * sqrt(n) pivots, the vectors with the least hashes of their ids (a bounded
    sample, max_pivots at most). Each vector is represented by its PREFIX nearest pivots in order and
    posted in the inverted files of the first POSTED. Within a file, the RERANKED vectors with the
    least footrule distance between the prefixes are compared with half-precision cosines; what can
    be among the k best is reranked exactly. A file of more than BLOCK postings is split by the
    second pivot, so that a popular pivot costs SPLIT postings a vector, however large its file; what
    is still larger is searched by pairs of blocks, each a task's work of its own.

    Every vector is indexed and searched for. Of equal vectors the k + 1 with the least ids stand in
    the index: no more can be among anyone's k best; the rest have the k first of those.
    """
    spark = rows.sparkSession
    v = F.col(vector_col)
    fit = rows.where(F.col(id_col).isNotNull() & valid_vector(v, dims))
    one = one_delivery(fit, id_col, v.cast("array<float>"), order_col).select(F.col(id_col).alias("id"), F.col("payload").alias("v"))
    n = one.count()
    wanted = max(1, min(max_pivots, n, math.ceil(2 * math.sqrt(n))))
    sample = one.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(wanted).select("v").toArrow().column("v").combine_chunks() if n else None
    pivots = spark.sparkContext.broadcast(_directions(sample, dims) if n else np.ones((1, dims), np.float32))
    id_type = dict(rows.dtypes)[id_col]

    copies = one.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    shared = copies.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    shared = written(shared, "shared")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    ranked = written(copies.join(small(shared), ["h1", "h2"], "left_semi").withColumn("place", place), "copies")
    late = ranked.where(F.col("place") > k + 1)
    held = one.join(small(late.select("id")), "id", "left_anti") if late.limit(1).count() else one

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                x = _directions(part.column(1), dims)
                prefix = nearest_pivots(x, pivots.value)
                half = x.astype(np.float16)
                every = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * prefix.shape[1], pa.array(prefix.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in half], pa.binary()), pa.array([r.tobytes() for r in prefix], pa.binary()), every], ["id", "v", "half", "prefix", "pivots"])

    indexed = written(held.mapInArrow(index, f"id {id_type}, v array<float>, half binary, prefix binary, pivots array<int>"), "index")
    placed = _postings(indexed).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("id", "half", "prefix", "cell", "part", other)
    placed = placed.select("id", "half", "prefix", "part", "cell", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    close = placed.groupBy("cell", "x", "y").applyInArrow(_best(dims, k, least), f"a {id_type}, b {id_type}").distinct()

    vec = indexed.select("id", "v")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    pair = close.join(vec.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vec.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    cosine = dot(F.col("va"), F.col("vb")) / (F.sqrt(dot(F.col("va"), F.col("va"))) * F.sqrt(dot(F.col("vb"), F.col("vb"))))
    exact = pair.select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= least)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    best = exact.withColumn("rank_no", rank).where(F.col("rank_no") <= k).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "rank_no", "cosine")
    first = ranked.where(F.col("place") <= k).select("h1", "h2", F.col("id").alias("id_b"), F.col("place").alias("rank_no"))
    rest = late.select("h1", "h2", F.col("id").alias("id_a")).join(first, ["h1", "h2"]).select("id_a", "id_b", "rank_no", F.lit(1.0).alias("cosine"))
    return best.unionByName(rest.where(F.col("cosine") >= least))
